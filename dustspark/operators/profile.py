"""Dataset profiles and threshold studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.operators.ranks import interpolated_quantiles

STORM_CUTS = (200, 300, 400, 500, 700, 1000)


def exceedance(df: DataFrame, value: str, cuts: tuple[int, ...] = STORM_CUTS) -> DataFrame:
    """Count and share of values at or above each cut: one aggregate row, unpivoted."""
    one = df.agg(F.count(value).alias("_n"), *[F.count_if(F.col(value) >= c).alias(f"c{c}") for c in cuts])
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"c{c}").alias("days")) for c in cuts])
    return one.select(F.inline(rows), "_n").select(
        "cut", "days", (100.0 * F.try_divide(F.col("days"), F.col("_n"))).alias("pct"))


def site_exceedance(df: DataFrame, value: str, cut: float) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col(value) >= cut).alias("events")) \
        .withColumn("pct", 100.0 * F.col("events") / F.col("days"))


def relative_storms(df: DataFrame, value: str = "pm10_max") -> DataFrame:
    """Per site: interpolated median, p90 and p99 by nearest rank, relative threshold and its events.

    The percentiles are aggregates over one site's days; each row of the site is then compared once.
    """
    rows = df.filter(F.col(value).isNotNull())

    def at(p: float) -> Column:
        # zero-based position floor(n * p) of the ascending order, from a bounded sorted array
        return F.element_at("_v", F.floor(F.size("_v") * p).cast("int") + 1)

    sites = rows.groupBy("site_id").agg(
        F.percentile(F.col(value), F.lit(0.5)).alias("median"), F.sort_array(F.collect_list(value)).alias("_v"))
    cut = F.greatest(C.STORM_MULT * F.col("median"), F.lit(C.STORM_FLOOR))
    events = F.size(F.filter("_v", lambda v: v >= F.col("threshold")))
    return (sites.withColumn("threshold", cut)
            .select("site_id", "median", at(0.90).alias("p90"), at(0.99).alias("p99"), "threshold",
                    F.size("_v").alias("days"), events.alias("events"))
            .withColumn("pct", 100.0 * F.col("events") / F.col("days")))


def storm_rate_summary(sites: DataFrame) -> DataFrame:
    return sites.agg(F.sum("events").alias("events"), F.sum("days").alias("days"),
                     (100.0 * F.sum("events") / F.sum("days")).alias("pct"),
                     F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"),
                     F.count_if(F.col("events") == 0).alias("sites_without_events"))


def monthly_events(df: DataFrame, event: Column) -> DataFrame:
    return df.filter(event).groupBy(F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("events"))


def key_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows of the key, from one pre-aggregated pass."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return per_key.agg(F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias("distinct_keys")) \
        .withColumn("duplicate_rows", F.col("n_rows") - F.col("distinct_keys"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of non-null values, min, mean, max, non-null count. One aggregate, unpivoted."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__n"), F.min(c).cast("double").alias(f"{c}__lo"),
                 F.avg(c).alias(f"{c}__avg"), F.max(c).cast("double").alias(f"{c}__hi")]
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("non_null"), F.col(f"{c}__lo").alias("min_value"),
        F.col(f"{c}__avg").alias("mean_value"), F.col(f"{c}__hi").alias("max_value")) for c in columns])
    return df.agg(*aggs).select("_rows", F.inline(rows)).withColumn(
        "non_null_pct", F.round(100.0 * F.try_divide(F.col("non_null"), F.col("_rows")), 3)).drop("_rows")


def site_profile(df: DataFrame) -> DataFrame:
    """Rows, date range, PM10 days and the two storm counts per site."""
    pm10, dust = (F.coalesce(c, F.lit(0.0)) for c in ("pm10_max", "dust_max"))
    return df.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("pm10_max").alias("pm10_days"), F.count_if(F.col("pm10_max") >= 200.0).alias("storm_pm10"),
        F.count_if((pm10 >= 200.0) | (dust >= 100.0)).alias("storm_pm10_or_dust"))


def coverage(rows: DataFrame) -> DataFrame:
    """Measured, modelled and missing aerosol days per site."""
    return rows.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col("aq_source") == s).alias(n) for s, n in (
            ("measured_cams", "measured_days"), ("modelled_climatology", "modelled_days"),
            ("missing", "missing_days"))])


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(whole).alias("complete_rows"))


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median, min, max, mean and population standard deviation of every column."""
    aggs = [a for c in columns for a in (
        F.min(c).cast("double").alias(f"{c}__lo"), F.max(c).cast("double").alias(f"{c}__hi"),
        F.avg(c).alias(f"{c}__avg"), F.stddev_pop(c).alias(f"{c}__sd"))]
    rows = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"{c}__lo").alias("min_value"), F.col(f"{c}__hi").alias("max_value"),
        F.col(f"{c}__avg").alias("mean_value"), F.col(f"{c}__sd").alias("std_value")) for c in columns])
    plain = df.agg(*aggs).select(F.inline(rows))
    medians = interpolated_quantiles(unpivot(df, columns), "value", [0.5], by="feature") \
        .select("feature", F.col("value").alias("median_value"))
    return plain.join(medians, "feature")


def bin_edges(df: DataFrame, columns: list[str], bins: int = 32) -> DataFrame:
    """Unique inner quantiles of every column, as one sorted array per feature."""
    probs = [i / bins for i in range(1, bins)]
    cuts = interpolated_quantiles(unpivot(df, columns), "value", probs, by="feature")
    return cuts.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"))


def bin_values(df: DataFrame, columns: list[str], edges: DataFrame) -> DataFrame:
    """(feature, value, bin) with bin = number of edges below the value; edges are one row per feature."""
    return unpivot(df, columns).join(F.broadcast(edges), "feature").select(
        "feature", "value", F.size(F.filter("edges", lambda e: e < F.col("value"))).alias("bin"))


def imputation_bounds(ranges: DataFrame, columns: list[str]) -> DataFrame:
    """Feature ranges as one wide row (median, min, max per column)."""
    return ranges.agg(*[F.max(F.when(F.col("feature") == c, F.col(f"{stat}_value"))).alias(f"{c}__{stat}")
                        for c in columns for stat in ("median", "min", "max")])


def impute_with_range_check(df: DataFrame, columns: list[str], bounds: DataFrame) -> DataFrame:
    """Nulls take the training median, NaN becomes 0; adds the share of values outside the training range."""
    wide = df.join(F.broadcast(bounds))
    filled = {c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.col(f"{c}__median")) for c in columns}
    out = wide.withColumns(filled)
    flags = [F.when((F.col(c) < F.col(f"{c}__min") - 1e-9) | (F.col(c) > F.col(f"{c}__max") + 1e-9), 1).otherwise(0)
             for c in columns]
    return out.withColumn("out_of_range", sum(flags, F.lit(0)) / float(len(columns))).drop(*bounds.columns)
