"""Postings kept on disk and refreshed only where their source files changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.operators.retrieval import Index, corpus_stats, postings, term_stats

BUCKETS = 64
#: characters of text whose postings one task sorts and writes; a bucket of more is written by several
TASK_CHARS = 1 << 21
_MANIFEST = "file string, modified timestamp, run long, live boolean"


def source_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file with its path and modification time."""
    meta = F.col("_metadata")
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(meta["file_path"]).alias("doc_id"), F.col("value").alias("text"),
        meta["file_path"].alias("file"), meta["file_modification_time"].alias("modified"))


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _state(spark: SparkSession, path: str) -> DataFrame:
    """Latest known modification time per live file (the manifest is an append-only log)."""
    log = _existing(spark, f"{path}/manifest")
    if log is None:
        return spark.createDataFrame([], _MANIFEST)
    last = log.groupBy("file").agg(F.max(F.struct("run", "modified", "live")).alias("s"))
    return last.select("file", "s.modified", "s.run", "s.live").filter("live")


def _bucket(file: str = "file"):
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")


def refresh(docs: DataFrame, path: str) -> int:
    """Bring the postings under ``path`` up to date with ``docs`` (doc_id, text, file, modified).

    Files are grouped into buckets; buckets with a new, changed or vanished file are tokenised again and
    overwritten, all others stay. Returns the number of rewritten buckets. A run which dies before the
    manifest is appended is simply repeated.
    """
    spark = docs.sparkSession
    current = docs.select("file", "modified").distinct()
    known = _state(spark, path)
    fresh = current.join(known.select("file", "modified"), ["file", "modified"], "left_anti")
    gone = known.join(current.select("file"), "file", "left_anti").select("file")
    stale = sorted(r["b"] for r in fresh.select("file").union(gone).select(_bucket().alias("b")).distinct().collect())
    if not stale:
        return 0
    touched = docs.withColumn("bucket", _bucket()).filter(F.col("bucket").isin(stale))
    # texts are dealt by document, where their terms are counted and meet their file; from there on a document is one row, its
    # terms (which have no blanks) one text
    counted = postings(touched.repartition("doc_id")).groupBy("doc_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("_t"))
    counted = counted.select("doc_id", "dl", F.array_join("_t.term", " ").alias("_terms"), F.col("_t.tf").alias("_tfs"))
    new = counted.join(touched.select("doc_id", "file", "bucket").hint("shuffle_hash"), "doc_id")
    # a row without a file keeps a stale bucket from staying as it was when none of its documents has a token left
    emptied = spark.createDataFrame([(b,) for b in stale], "bucket int")
    sizes = {r["bucket"]: r["n"] for r in touched.groupBy("bucket").agg(F.sum(F.length("text")).alias("n")).collect()}  # at most BUCKETS rows
    pieces = {b: 1 + (sizes.get(b) or 0) // TASK_CHARS for b in stale}
    piece = F.pmod(F.xxhash64("doc_id"), F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv])[F.col("bucket")])
    dealt = new.unionByName(emptied, allowMissingColumns=True).repartition(sum(pieces.values()), "bucket", piece)
    pairs = F.arrays_zip(F.split("_terms", " ").alias("term"), F.col("_tfs").alias("tf"))
    dealt.withColumn("_t", F.explode_outer(pairs)).select("doc_id", "dl", "_t.term", "_t.tf", "file", "bucket") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/postings")
    log = _existing(spark, f"{path}/manifest")  # vanished files count as well: a run number is never used twice
    run = ((log.agg(F.max("run")).first()[0] if log is not None else None) or 0) + 1
    marks = fresh.select("file", "modified", F.lit(run).cast("long").alias("run"), F.lit(True).alias("live")).unionByName(
        gone.select("file", F.lit(None).cast("timestamp").alias("modified"), F.lit(run).cast("long").alias("run"),
                    F.lit(False).alias("live")))
    marks.write.mode("append").parquet(f"{path}/manifest")
    return len(stale)


def load_index(docs: DataFrame, path: str) -> Index:
    """The stored index, restricted to files which still exist. ``docs`` gives the corpus statistics."""
    spark = docs.sparkSession
    live = _state(spark, path).select("file")
    posts = spark.read.parquet(f"{path}/postings").join(live, "file", "left_semi").select("doc_id", "dl", "term", "tf")
    return Index(posts, term_stats(posts), corpus_stats(docs))
