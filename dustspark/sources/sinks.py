"""Writers: CSV, JSON reports, numbered chunks, models, per-site staging."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustspark.operators.ranks import running_number


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted CSV with a header, nulls as empty fields. The sort is a range exchange, not one task."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """Parquet in one order over all files: the files' names follow the ranges, the rows in a file follow the order."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def order_breaks(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """(n_rows, out_of_order): rows of sorted files that are below the row before them, by file name and row position."""
    key = F.struct(*order)
    rows = spark.read.parquet(path).select(key.alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("row"))
    files = rows.withColumn("broken", F.coalesce(F.col("key") < before, F.lit(False))).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("broken").alias("broken"), F.min("key").alias("low"), F.max("key").alias("high"))
    above = F.lag("high").over(Window.orderBy("file"))  # one row a file
    files = files.withColumn("broken", F.col("broken") + F.coalesce(F.col("low") < above, F.lit(False)).cast("int"))
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("broken"), F.lit(0)).alias("out_of_order"))


def write_daily(df: DataFrame, path: str, partition: str = "site_id") -> None:
    """Daily table as Parquet, one folder per site, rows sorted by date inside each file."""
    df.repartition(partition).sortWithinPartitions(partition, "date").write.mode("overwrite") \
        .partitionBy(partition).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A report back from its JSON document, under the schema that it was written with."""
    return spark.read.schema(like.schema).json(path)


def numbered_chunks(chunks: DataFrame, order: list[str], proxy: Column | None = None) -> DataFrame:
    """Chunks with a running id ``chunk-00001`` in the given order; ``proxy`` balances the numbering."""
    lead = F.col(order[0]) if proxy is None else proxy
    rn = running_number(chunks, order, lead)
    width = F.greatest(F.length(F.col("rn").cast("string")), F.lit(5))
    return rn.withColumn("id", F.concat(F.lit("chunk-"), F.lpad(F.col("rn").cast("string"), width, F.lit("0")))).drop("rn")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def stage_site_pulls(raw: DataFrame, path: str, partition: str = "site_id") -> None:
    """Stage raw pulls per site; only the partitions present in ``raw`` are replaced."""
    raw.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def sites_to_pull(sites: DataFrame, staged: DataFrame, partition: str = "site_id") -> DataFrame:
    """Sites which have no staged pull yet."""
    return sites.join(staged.select(partition).distinct(), partition, "left_anti")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.withColumn("threshold", F.round("threshold", 1)).write.mode("overwrite").parquet(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
