"""Exact global ranks, order statistics and quantiles without a single-task sort.

Values are first counted (a hot value collapses to one row), then cut into many ordered buckets at
approximate quantiles. A rank is the size of all lower buckets (a tiny table) plus the rank inside
the bucket, so no task ever sees more than a bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark.session import cut_lineage

BUCKETS = 512


def _edges(df: DataFrame, column: str) -> list[float]:
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    inner = sorted(set(df.approxQuantile(column, probs, 0.5 / BUCKETS)))
    return [float("-inf"), *(inner or [0.0]), float("inf")]


def cumulative_counts(df: DataFrame, value: str, weights: dict | None = None,
                      by: str | None = None) -> DataFrame:
    """One row per distinct value (and ``by``) with its counts and the counts of all smaller values.

    ``weights`` maps output names to aggregate columns; the default is ``n``, the row count. Adds
    ``<name>_before`` for each. Null values are left out.
    """
    weights = weights or {"n": F.count(F.lit(1))}
    keys = [by] if by else []
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[w.alias(n) for n, w in weights.items()]))
    bucketed = Bucketizer(splits=_edges(counts, value), inputCol=value, outputCol="_bucket").transform(counts)
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in weights])
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_{n}").over(lower), F.lit(0)).alias(f"_{n}_off") for n in weights])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.join(offsets, [*keys, "_bucket"])
    return out.withColumns({
        f"{n}_before": F.col(f"_{n}_off") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in weights}) \
        .drop("_bucket", *[f"_{n}_off" for n in weights])


def _positions(table: DataFrame, grid: list[float], position, by: str | None) -> DataFrame:
    """Rows of a cumulative table which hold a wanted position, one row per (grid entry, match).

    The grid is a short literal; positions come from the total of each ``by`` group.
    """
    keys = [by] if by else []
    if by:
        totals = table.groupBy(by).agg(F.sum("n").alias("_n"))
        rows = table.join(totals, by)
    else:
        rows = table.withColumn("_n", F.lit(table.agg(F.sum("n")).first()[0] or 0))
    entries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(float(g)).alias("grid")) for i, g in enumerate(grid)])
    placed = F.transform(entries, lambda e: F.struct(
        e["ord"].alias("ord"), e["grid"].alias("grid"), position(e["grid"], F.col("_n")).alias("_at")))
    first, after = F.col("n_before"), F.col("n_before") + F.col("n")
    held = F.filter(placed, lambda e: ((F.floor(e["_at"]) >= first) & (F.floor(e["_at"]) < after))
                    | ((F.ceil(e["_at"]) >= first) & (F.ceil(e["_at"]) < after)))
    return rows.select(*keys, *[c for c in table.columns if c not in keys], F.inline(held))


def nearest_rank(df: DataFrame, value: str, percents: list[float], by: str | None = None) -> DataFrame:
    """Percentile p as the value at zero-based position floor(n * p / 100), capped at the last one."""
    table = cumulative_counts(df, value, by=by)
    hits = _positions(table, percents, lambda g, n: F.least(F.floor(n * g / 100.0), n - 1).cast("double"), by)
    return hits.select(*([by] if by else []), F.col("grid").alias("percent"), F.col(value).alias("value"))


def interpolated_quantiles(df: DataFrame, value: str, probs: list[float], by: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles (position p * (n - 1)), one row per probability."""
    return quantiles_of(cumulative_counts(df, value, by=by), value, probs, by)


def quantiles_of(table: DataFrame, value: str, probs: list[float], by: str | None = None) -> DataFrame:
    """The same from a table of cumulative counts (``n``, ``n_before``)."""
    keys = [by] if by else []
    hits = _positions(table, probs, lambda g, n: g * (n - 1), by)
    low, high, after = F.floor("_at"), F.ceil("_at"), F.col("n_before") + F.col("n")
    holds_low = (low >= F.col("n_before")) & (low < after)
    holds_high = (high >= F.col("n_before")) & (high < after)
    return (hits.groupBy(*keys, "ord", F.col("grid").alias("prob"), "_at")
            .agg(F.max(F.when(holds_low, F.col(value))).alias("_lo"),
                 F.max(F.when(holds_high, F.col(value))).alias("_hi"))
            .select(*keys, "ord", "prob",
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("value")))


def running_number(df: DataFrame, order: list[str], proxy: Column, name: str = "rn") -> DataFrame:
    """Global 1-based row number in the given (unique) order.

    ``proxy`` is a double which never falls along that order; it only balances the buckets, the exact
    order columns decide inside each of them.
    """
    keyed = df.withColumn("_proxy", proxy.cast("double"))
    bucketed = Bucketizer(splits=_edges(keyed, "_proxy"), inputCol="_proxy", outputCol="_bucket").transform(keyed)
    lower = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (bucketed.withColumn("_in", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_bucket")
            .withColumn(name, F.col("_off") + F.col("_in")).drop("_proxy", "_bucket", "_in", "_off"))
