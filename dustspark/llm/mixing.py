"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time t in [0, 1]; a source with target T and slope s is drawn at the rate
T * (1 + s * (2t - 1)), whose integral is the cumulative demand T * (t + s * (t*t - t)). A document's place in its source's
stream is turned into t by inverting that demand, and the mix is the documents in the order of t.

Within a source the stream is ordered by the MD5 of the id, so reruns agree. Running sums are taken in two levels (small
hash ranges, then ranges of a source), so that a source with a third of all rows is spread over many tasks.

Null source: a source of its own, last. Null or empty text: size 0, nothing taken. Rows equal in id, source and size share
alike what they take together. Empty table: empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark.llm.common import words
from dustspark.session import cut_lineage

WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.5, 0.0)
SHARE_PERCENT = 150
MOST_REPEATS = 2
RANGE_ROWS = 500
SALTS = 32


def _cycle(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index - 1, F.lit(len(values))).cast("int"))


def targets(units: DataFrame) -> DataFrame:
    """Per source: size, rows, weight, slope and target. The windows run over one row per source.

    The targets are min(cap, level * weight) with the level at which they sum to the share: sources sorted by cap / weight
    fill up first, and the level is the one at which the next source does not.
    """
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    s = s.withColumns({"weight": _cycle(WEIGHTS, F.col("rank")), "slope": _cycle(SLOPES, F.col("rank")),
                       "cap": F.col("source_size") * MOST_REPEATS})
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * SHARE_PERCENT / 100.0)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # the first source that does not fill up fixes the level for all
    s = s.withColumn("fill", F.row_number().over(by_fill))
    s = s.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("fill"))).over(everything))
    s = s.withColumn("level", F.max(F.when(F.col("fill") == F.col("open"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "source_rows", "slope", F.round(target, 6).alias("target"))


def invert(demand: Column, slope: Column) -> Column:
    """The t in [0, 1] with t + slope * (t*t - t) = demand."""
    b = 1 - slope
    root = (F.sqrt(b * b + 4 * slope * demand) - b) / (2 * slope)
    return F.when(slope == 0, demand).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def allocate(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, size): copies, source_size, target, first, second (words of each pass) and positions."""
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    units = cut_lineage(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    salted = units.withColumns({"key": key, "salt": F.pmod(F.hash("doc_id", "size"), F.lit(SALTS))})
    goals = targets(units).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    a, b = salted.alias("a"), goals.alias("b")
    rows = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.salt") == F.col("b.salt"))).select(
        "a.*", "source_size", "source_rows", "slope", "target")
    ranges = F.ceil(F.col("source_rows") / RANGE_ROWS)
    rows = rows.withColumn("range", F.floor(place * ranges / (1 << 32))).drop("salt")
    rows = rows.withColumns({"known": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    sums = rows.groupBy("known", "source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    earlier = Window.partitionBy("known", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("known", "source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("known", "source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    rows = rows.join(offsets, ["known", "source", "range"])
    start, unit, demand = F.col("inside") + F.col("offset"), F.col("size") * F.col("copies"), F.floor("target")

    def taken(place: Column) -> Column:
        return F.floor(F.greatest(F.lit(0), F.least(unit, demand - place)) / F.col("copies")).cast("long")

    def time(place: Column) -> Column:
        return invert(place / F.col("target"), F.col("slope"))
    second = F.col("source_size") + start
    return rows.select(
        "doc_id", F.when(F.col("known"), F.col("source")).alias("source"), "size", "copies", "source_size", "target",
        taken(start).alias("first"), taken(second).alias("second"),
        F.when(taken(start) > 0, time(start)).alias("first_position"),
        F.when(taken(second) > 0, time(second)).alias("second_position"))


def plan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, range-sorted by the position of its first pass (rows that are not taken come last)."""
    rows = allocate(docs).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = rows.select("doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"),
                      "first_position", "second_position")
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents in training order: a row for each pass of each document, with the columns of ``docs``.

    A document at the end of its source's demand is cut to the words that are taken; ``n_chars`` follows the text.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.size(words(F.col("text"))).cast("long").alias("n"))
    plan_ = allocate(docs).select(
        "doc_id", "source", "size", F.posexplode(F.array(F.struct(F.col("first").alias("take"), F.col("first_position").alias("at")),
                                                        F.struct(F.col("second").alias("take"), F.col("second_position").alias("at")))))
    plan_ = plan_.select("doc_id", "source", "size", "pos", "col.take", "col.at").where("take > 0")
    both = rows.join(plan_, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & F.col("doc.source").eqNullSafe(F.col("source"))
                     & (F.col("n") == F.col("size")))
    head = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("take").cast("int")), "")
    text = F.when(F.col("take") == F.col("n"), F.col("doc.text")).otherwise(head)
    both = both.orderBy("at", "doc_id", "pos").withColumn("mixed_text", text)
    fields = []
    for c in names:
        if c == "text":
            fields.append(F.col("mixed_text").alias(c))
        elif c == "n_chars":
            fields.append(F.when(F.col("take") == F.col("n"), F.col("doc.n_chars")).otherwise(F.length("mixed_text").cast("long")).alias(c))
        else:
            fields.append(F.col(f"doc.`{c}`").alias(c))
    return both.select(*fields)


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, [-0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE][(rank - 1) % 3 + 1] AS slope,
    source_size * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 150 / 100.0::DOUBLE AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
    row_number() OVER (ORDER BY cap::DOUBLE / weight, rank) AS fill FROM w),
o AS (SELECT *, min(CASE WHEN level * weight <= cap THEN fill END) OVER () AS open FROM l),
v AS (SELECT *, max(CASE WHEN fill = open THEN level END) OVER () AS chosen FROM o),
t AS (SELECT source, source_size, slope, round(least(cap::DOUBLE, coalesce(chosen * weight, cap::DOUBLE)), 6) AS target FROM v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(greatest(0, least(size, floor(target) - start)) AS BIGINT) AS a,
    CAST(greatest(0, least(size, floor(target) - source_size - start)) AS BIGINT) AS b FROM c)
SELECT doc_id, size, source_size, target, a + b AS taken,
    CASE WHEN a > 0 THEN {first} END AS first_position, CASE WHEN b > 0 THEN {second} END AS second_position FROM k
"""


def _inverse(place: str) -> str:
    u = f"(({place})::DOUBLE / target)"
    return (f"CASE WHEN slope = 0 THEN {u} ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, "
            f"(sqrt((1 - slope) * (1 - slope) + 4 * slope * {u}) - (1 - slope)) / (2 * slope))) END")


SQL = SQL.replace("{first}", _inverse("start")).replace("{second}", _inverse("source_size + start"))
