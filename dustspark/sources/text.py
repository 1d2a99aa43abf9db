"""Line, document and catalogue formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from dustspark import constants as C
from dustspark.functions import text as T
from dustspark.functions.cleaning import num

CHUNK_SCHEMA = "id string, source string, url string, page int, text string, kind string"
FACT_SCHEMA = ("id string, topic string, claim string, statement string, fact string, text string, "
               "source string, source_url string, source_title string, url string, value map<string,double>, "
               "unit string, region string, verified boolean, verification string, source_quote string")
LAYER_SCHEMA = (
    "Identifier string, Title string, Format array<string>, Style array<struct<Identifier:string>>, "
    "Dimension array<struct<Identifier:string, Default:string, Value:array<string>>>, "
    "TileMatrixSetLink array<struct<TileMatrixSet:string>>")


def read_daily_csv(spark: SparkSession, path: str, columns: list[str], key: str = "site") -> DataFrame:
    """Daily CSV with a header: blanks, ``None`` and non-numbers become null; adds the day of year."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(path, header=True)
    text = {key, "date", "region", "source", "aq_source"}
    return raw.select(*[
        F.to_date("date").alias("date") if c == "date" else F.col(c) if c in text else num(c).alias(c)
        for c in columns]).withColumn("doy", F.dayofyear("date"))


def parse_json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON lines as rows; blank and malformed lines drop out."""
    parsed = lines.filter(F.length(F.trim(column)) > 0).select(
        F.from_json(column, f"{schema}, _bad string",
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_j"))
    return parsed.filter(F.col("_j").isNotNull() & F.col("_j._bad").isNull()).select("_j.*").drop("_bad")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return usable_chunks(parse_json_lines(spark.read.text(path), CHUNK_SCHEMA))


def usable_chunks(chunks: DataFrame, minimum: int = 80) -> DataFrame:
    """Chunks with more than ``minimum`` characters of text, stripped, tagged as literature."""
    return chunks.withColumns({
        "text": T.strip(F.coalesce("text", F.lit(""))), "source": F.coalesce("source", F.lit("corpus")),
        "url": F.coalesce("url", F.lit("")), "kind": F.lit("literature"),
    }).filter(F.length("text") > minimum)


def first_text(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def usable_facts(facts: DataFrame) -> DataFrame:
    """Facts as corpus rows; the text is the first non-empty of the known text keys, the claim included."""
    out = facts.select(
        F.coalesce("source", F.lit("knowledge base")).alias("source"), F.coalesce("url", F.lit("")).alias("url"),
        first_text("statement", "fact", "text", "claim").alias("text"), F.lit("fact").alias("kind"))
    return out.filter(F.col("text").isNotNull())


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a knowledge file ``{"facts": [...]}``."""
    fact = T_.StructType.fromDDL(FACT_SCHEMA)
    schema = T_.StructType([T_.StructField("facts", T_.ArrayType(fact))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("facts"))


def fact_counts(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified"),
                     F.count_if(~F.coalesce("verified", F.lit(False))).alias("unverified"))


def split_pages(docs: DataFrame) -> DataFrame:
    """Whole texts with ``<<<PAGE n>>>`` markers as (page, text) rows; without a marker it is page 1.

    Text before the first marker is not part of any page.
    """
    marker = r"<<<PAGE (\d+)>>>"
    numbers = F.transform(F.regexp_extract_all("text", F.lit(marker), F.lit(1)), lambda n: n.cast("int"))
    bodies = F.split("text", marker)
    marked = F.arrays_zip(numbers.alias("page"), F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(1))).alias("text"))
    whole = F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")))
    pages = F.when(F.size(bodies) > 1, marked).otherwise(whole)
    return docs.withColumn("_p", pages).drop("text").select("*", F.inline_outer("_p")).drop("_p")


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file; the source is the file name without its ending."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("source"), F.col("value").alias("text"))
    return split_pages(raw)


def parse_stations(lines: DataFrame, column: str = "value") -> DataFrame:
    """``name,lon,lat,elevation`` lines; short lines and lines with unparsable numbers drop out."""
    part = F.split(F.col(column), ",")
    rows = lines.withColumn("_p", part).filter(F.size("_p") >= 4)
    number = {n: F.trim(F.col("_p")[i]).try_cast("double") for i, n in ((1, "lon"), (2, "lat"), (3, "elev_m"))}
    others = [c for c in lines.columns if c != column]
    return rows.select(*others, F.trim(F.col("_p")[0]).alias("name"), *[c.alias(n) for n, c in number.items()]) \
        .dropna(subset=["lon", "lat", "elev_m"])


def read_stations(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """Station list with ``skip`` leading lines. The file is read whole (a list of some thousand lines)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("_i", "value"))
    return parse_stations(lines.filter(F.col("_i") >= skip).select("value"))


def layer_rows(layers: DataFrame, keywords: tuple[str, ...] = C.LAYER_KEYWORDS,
               keep: tuple[str, ...] | None = C.LAYERS_KEPT) -> DataFrame:
    """Catalogue rows of the layers of interest: per dimension default, count, first and last value."""
    name = F.trim("Identifier")
    wanted = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(name), k))
    rows = layers.filter(wanted)
    if keep is not None:
        rows = rows.filter(name.isin(*keep))
    values = lambda d: F.filter(d["Value"], lambda v: F.length(F.trim(v)) > 0)
    dims = F.map_from_entries(F.transform(F.coalesce(
        "Dimension", F.array().cast(layers.schema["Dimension"].dataType)), lambda d: F.struct(
        F.trim(d["Identifier"]), F.struct(
            F.trim(d["Default"]).alias("default"), F.coalesce(F.size(values(d)), F.lit(0)).alias("n_values"),
            F.try_element_at(values(d), F.lit(1)).alias("first"),
            F.try_element_at(values(d), F.lit(-1)).alias("last")))))
    return rows.select(
        name.alias("layer"), F.trim("Title").alias("title"), F.col("Format")[0].alias("format"),
        F.col("Style.Identifier").alias("styles"),
        F.array_sort(F.array_distinct(F.col("TileMatrixSetLink.TileMatrixSet"))).alias("tile_matrix_sets"),
        dims.alias("dimensions"))


def read_layers(spark: SparkSession, path: str, row_tag: str = "Layer") -> DataFrame:
    """Layers of an XML capabilities document (namespace prefixes are ignored)."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true") \
        .schema(LAYER_SCHEMA).load(path)


def keyword_filter(df: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    """Rows whose column contains any of the keywords, whatever the case."""
    low = F.lower(column)
    return df.filter(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k)))


PROBE_SCHEMA = ("id string, url string, code int, bytes bigint, content_type string, final_url string, "
                "redirects int, err string")


def read_probe_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE_SCHEMA).csv(path, sep="\t")


def parse_probe_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_csv(F.col(column), PROBE_SCHEMA, {"sep": "\t"}).alias("_r")).select("_r.*")


def listing_keys(listing: DataFrame, column: str = "value") -> DataFrame:
    """All ``<Key>`` values of an object listing, one row each."""
    others = [c for c in listing.columns if c != column]
    return listing.select(*others, F.explode(F.regexp_extract_all(
        column, F.lit("<Key>([^<]+)</Key>"), F.lit(1))).alias("key"))


def latest_runs(listing: DataFrame, column: str = "value", last: int = 3) -> DataFrame:
    """The last distinct 8-digit run ids over the whole listing: distinct first, then a top-k."""
    runs = listing.select(F.explode(F.regexp_extract_all(column, F.lit(r"(\d{8})/"), F.lit(1))).alias("run"))
    return runs.distinct().orderBy(F.desc("run")).limit(last)


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename known aliases; several columns of one meaning merge left to right by first non-null."""
    canonical = C.ALIASES | {name: name for name in C.ALIASES.values()}
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(canonical.get(c.strip().lower(), c.strip()), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(name) for name, cs in groups.items()])


def fill_rolling(df: DataFrame) -> DataFrame:
    """Absent rolling columns take the instantaneous value they would average."""
    out = df
    for source, targets in C.ROLL_SOURCES.items():
        if source in df.columns:
            now = F.col(source)
            out = out.withColumns({t: F.coalesce(F.col(t), now) if t in df.columns else now for t in targets})
    return out
