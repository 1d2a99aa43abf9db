"""User-level reports, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions.geo import in_box
from dustspark.operators import nearest as N
from dustspark.operators import policy as PL
from dustspark.operators import profile as PR
from dustspark.operators import schedule as SC
from dustspark.session import written


def station_report(points: DataFrame, stations: DataFrame, k: int = 3, inside: int = 8,
                   max_km: float = 1500.0) -> DataFrame:
    """The ``k`` nearest stations of every point, and up to ``inside`` stations within the box."""
    boxed = stations.filter(in_box(F.col("lat"), F.col("lon")))
    lists = [("nearest", N.k_nearest(points, stations, k, max_km, digits=1)),
             ("inside", N.k_nearest(points, boxed, inside, max_km, digits=1))]
    parts = [found.filter(F.col("entry").isNotNull()).select(
        "site_id", F.lit(name).alias("list"), F.col("entry.station_id").alias("station_id"),
        F.round("distance", 1).alias("km"), "pos") for name, found in lists]
    return parts[0].unionByName(parts[1])


def compare_pairs(pairs: DataFrame, report: DataFrame) -> DataFrame:
    """Two site rows side by side (structs ``a`` and ``b``) for every pair of sites."""
    row = F.struct(*report.columns)
    a = report.select(F.col("site_id").alias("site_a"), row.alias("a"))
    b = report.select(F.col("site_id").alias("site_b"), row.alias("b"))
    return pairs.join(a, "site_a").join(b, "site_b")


def plants_with_policy(sites: DataFrame, costs: DataFrame, cost_per_mwp: float | None = None,
                       interval_days: int = C.DEFAULT_CLEANING_INTERVAL) -> DataFrame:
    """Sites with the trigger tuned to their own economics."""
    tuned = PL.best_policy(costs).select("site_id", "tuned_threshold_pct")
    return sites.join(tuned, "site_id").withColumns({
        "interval_days": F.lit(interval_days),
        "cost_per_mwp": F.lit(C.CLEANING_COST_SAR_PER_MWP if cost_per_mwp is None else float(cost_per_mwp))})


def site_report(rollup: DataFrame, sites: DataFrame, horizon: int | None = 14,
                interval_days: int = C.DEFAULT_CLEANING_INTERVAL, cost_per_mwp: float | None = None,
                capacity_kwp: float | None = None) -> DataFrame:
    """Verdict, both schedules and the yearly comparison of every site, one row each.

    ``horizon`` keeps the first days of each site's roll-up, as a forecast would hold.
    """
    if capacity_kwp is not None:
        sites = sites.withColumn("capacity_kwp", F.lit(float(capacity_kwp)))
    days = rollup if horizon is None else head_days(rollup, horizon)
    # both are read by several parts of the report, which would walk all days again for each
    costs = written(PL.policy_costs(rollup, sites, cost_per_mwp))
    plants = plants_with_policy(sites, costs, cost_per_mwp, interval_days)
    rows = written(SC.project(days, plants))
    totals = SC.schedule_totals(rows)
    fixed = totals.filter(F.col("schedule") == "fixed").select(
        "site_id", "energy_kwh", "clean_kwh", "lost_kwh", "mean_loss_pct", "max_loss_pct", "cleaning_events", "net_sar")
    delta = SC.adaptive_delta(totals).select("site_id", "energy_pct", "saved_sar", "events_adaptive", "water_saved_litres")
    year = PL.annual_habits(costs).select("site_id", "sar_saved_year", "tuned_trigger")
    return sites.select("site_id", "name", "climate").join(SC.verdict(rows), "site_id").join(fixed, "site_id") \
        .join(delta, "site_id").join(year, "site_id")


def head_days(rollup: DataFrame, n: int) -> DataFrame:
    """The first ``n`` days of every site. The rank filter is also applied before the exchange."""
    from pyspark.sql import Window
    w = Window.partitionBy("site_id").orderBy("date")
    return rollup.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def harvest_report(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Key counts, column coverage and overall statistics as one nested row."""
    keys = PR.key_profile(daily, ["site_id", "date"])
    cols = PR.column_profile(daily, columns).agg(F.array_sort(F.collect_list(F.struct(
        "column_name", "non_null_pct", "min_value", "mean_value", "max_value", "non_null"))).alias("columns"))
    storms = daily.agg(F.count_if(F.col("pm10_max") >= 200.0).alias("storm_pm10"),
                       F.count_if((F.coalesce("pm10_max", F.lit(0.0)) >= 200.0) | (F.coalesce("dust_max", F.lit(0.0)) >= 100.0))
                       .alias("storm_pm10_or_dust"))
    return keys.join(F.broadcast(cols)).join(F.broadcast(storms))


def feature_parity(training: DataFrame, serving: DataFrame) -> DataFrame:
    """One row per feature: present on both sides, finite everywhere, and not all zero."""
    both = [c for c in C.FEATURES if c in training.columns and c in serving.columns]

    def ok(df: DataFrame, prefix: str) -> DataFrame:
        aggs = []
        for c in both:
            v = F.col(c)
            aggs += [F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias(f"{prefix}{c}__bad"),
                     F.count_if(v != 0).alias(f"{prefix}{c}__set")]
        return df.agg(*aggs)

    wide = ok(training, "t_").join(F.broadcast(ok(serving, "s_")))
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(c in both).alias("in_both"),
                     *[(F.col(f"{p}_{c}__bad") if c in both else F.lit(None).cast("long")).alias(f"{n}_bad")
                       for p, n in (("t", "training"), ("s", "serving"))],
                     *[(F.col(f"{p}_{c}__set") > 0 if c in both else F.lit(False)).alias(f"{n}_nonzero")
                       for p, n in (("t", "training"), ("s", "serving"))]) for c in C.FEATURES]
    return wide.select(F.inline(F.array(*rows)))
