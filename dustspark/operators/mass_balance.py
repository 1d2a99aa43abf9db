"""Dust mass balance with rain, wind and scheduled cleaning; calibration of the site factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions import physics as P
from dustspark.functions.cleaning import finite
from dustspark.operators import windows as Wn
from dustspark.operators.policy import with_site_columns
from dustspark.operators.series import fold
from dustspark.sources.dimensions import region_factors, region_targets

GRID = 24


def site_factor(sites: DataFrame, calibrated: DataFrame | None = None) -> DataFrame:
    """Adds ``site_factor``: the calibrated value, else the region's, else the general default."""
    out = sites.join(F.broadcast(region_factors(sites.sparkSession)), "region", "left")
    fitted = F.lit(None).cast("double")
    if calibrated is not None:
        out = out.join(calibrated.select("site_id", F.col("site_factor").alias("_fitted")), "site_id", "left")
        fitted = F.col("_fitted")
    return out.withColumn("site_factor", F.coalesce(fitted, F.col("region_factor"), F.lit(C.UNKNOWN_FACTOR))) \
        .drop("_fitted", "region_factor")


def prepare(daily: DataFrame) -> DataFrame:
    """Fill gaps (site median for PM10, wind and humidity, zero for rain) and derive the daily terms.

    ``daily`` has ``pm10_mean``, ``wind_kmh``, ``rh_mean_pct`` and ``precip_mm``. Sites without any PM10 drop out.
    """
    every = Window.partitionBy("site_id")

    def filled(name: str) -> Column:
        x = finite(F.col(name))
        return F.coalesce(x, F.percentile(x, F.lit(0.5)).over(every))

    out = Wn.with_row_number(daily, Wn.by_site()).withColumns({
        "pm10_mean": filled("pm10_mean"), "wind_kmh": filled("wind_kmh"), "rh_mean_pct": filled("rh_mean_pct"),
        "precip_mm": finite(F.col("precip_mm"), 0.0)}).filter(F.col("pm10_mean").isNotNull())
    return out.withColumns({
        "unit_flux": P.deposition_flux(F.col("pm10_mean"), F.col("wind_kmh")),
        "kept": P.kept_after_rain_and_wind(F.col("precip_mm"), F.col("wind_kmh"))})


def counters(prepared: DataFrame, interval: int = C.BALANCE_INTERVAL) -> DataFrame:
    """Cleaning flag and the two day counters. A clean falls on the first row and then every
    ``interval + 1`` rows, so it needs no state."""
    w = Wn.by_site()
    since_clean = F.pmod(F.col("_rn") - 1, F.lit(interval + 1))
    wet = F.col("precip_mm") >= C.PARTIAL_RAIN_MM
    return prepared.withColumns({
        "cleaned": F.when(since_clean == 0, 1).otherwise(0),
        "days_since_clean": F.least(since_clean, F.lit(999)),
        "days_since_rain": Wn.days_since(wet, w, cap=999),
        "wet": F.when(wet, 1).otherwise(0)})


def balance_series(prepared: DataFrame, interval: int = C.BALANCE_INTERVAL) -> DataFrame:
    """One row per site: its days and the unit mass (site factor 1) after each of them."""
    fields = F.struct("date", (F.col("_rn") - 1).alias("i"), "unit_flux", "kept", "rh_mean_pct")
    series = prepared.groupBy("site_id").agg(F.sort_array(F.collect_list(fields)).alias("days"))

    def step(mass: Column, day: Column) -> tuple[Column, Column]:
        grown = mass * day["kept"] + day["unit_flux"]
        left = F.when(F.pmod(day["i"], F.lit(interval + 1)) == 0, grown * (1.0 - C.CLEAN_EFFICIENCY)).otherwise(grown)
        return left, left

    return series.withColumn("unit_mass", fold(F.col("days"), F.lit(0.0), "double", "double", step))


def mass_balance(prepared: DataFrame, factors: DataFrame, interval: int = C.BALANCE_INTERVAL) -> DataFrame:
    """Daily deposition, mass and loss. Mass is linear in the site factor, so the fold runs once for
    factor 1 and is scaled."""
    rows = balance_series(prepared, interval).select("site_id", F.inline_outer(F.arrays_zip("days", "unit_mass")))
    out = rows.select("site_id", "days.*", "unit_mass")
    out = with_site_columns(out, factors.select("site_id", "site_factor"))
    mass = F.col("unit_mass") * F.col("site_factor")
    return out.select(
        "site_id", "date", (F.col("unit_flux") * F.col("site_factor")).alias("deposition"), mass.alias("mass"),
        P.mass_loss_pct(mass, F.col("rh_mean_pct")).alias("soiling_loss_pct"))


def calibrate(prepared: DataFrame, sites: DataFrame, interval: int = C.BALANCE_INTERVAL,
              low: float = 0.005, high: float = 40.0) -> DataFrame:
    """Site factor whose mean loss meets the region's target: three passes over a geometric grid.

    All passes run on the site's own row (an array bounded by its days), without further shuffles.
    """
    targets = F.broadcast(region_targets(sites.sparkSession))
    out = balance_series(prepared, interval).select("site_id", F.zip_with(
        "unit_mass", "days",
        lambda m, d: C.K_LOSS * m * P.cementation(d["rh_mean_pct"])).alias("k"))
    out = with_site_columns(out, sites.select("site_id", "region")).join(targets, "region", "left").withColumn(
        "target_loss_pct", F.coalesce("target_loss_pct", F.lit(C.UNKNOWN_TARGET_LOSS)))
    out = out.withColumns({"_lo": F.lit(low), "_hi": F.lit(high)})

    def mean_loss(f: Column) -> Column:
        total = F.aggregate("k", F.lit(0.0), lambda a, k: a + 1.0 - F.exp(-f * k))
        return 100.0 * total / F.size("k")

    for _ in range(3):
        ratio = F.pow(F.col("_hi") / F.col("_lo"), F.lit(1.0 / GRID))
        points = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda j: F.col("_lo") * F.pow(ratio, j))
        tried = F.transform(points, lambda f: F.struct(mean_loss(f).alias("loss"), f.alias("f")))
        scored = F.transform(tried, lambda t: F.struct(
            F.abs(t["loss"] - F.col("target_loss_pct")).alias("err"), t["f"].alias("f"), t["loss"].alias("loss")))
        out = out.withColumns({"_ratio": ratio, "_best": F.array_min(scored)}).withColumns({
            "_lo": F.col("_best.f") / F.col("_ratio"), "_hi": F.col("_best.f") * F.col("_ratio")})
    return out.select("site_id", "region", "target_loss_pct", F.col("_best.f").alias("site_factor"),
                      F.col("_best.loss").alias("achieved_loss_pct"))


def steady_state(prepared: DataFrame, factors: DataFrame, rows: int = 365, interval: int = 3650) -> DataFrame:
    """Mean loss of the last ``rows`` days of an (almost) uncleaned run."""
    w = Window.partitionBy("site_id").orderBy(F.col("date").desc())
    run = mass_balance(prepared, factors, interval)
    return (run.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= rows)
            .groupBy("site_id").agg(F.avg("soiling_loss_pct").alias("no_clean_loss_pct")))


def calibration_table(calibrated: DataFrame, yearly: DataFrame) -> DataFrame:
    """Means of the calibrated loss by coast and region group, and of the last-year means (site_id, mean_value) by coast, one row."""
    loss = F.col("achieved_loss_pct")
    return calibrated.join(yearly.select("site_id", "mean_value"), "site_id", "left").agg(
        F.avg(F.when(F.col("region") == "west", loss)).alias("west_mean_pct"),
        F.avg(F.when(F.col("region") == "east", loss)).alias("east_mean_pct"),
        F.avg(loss).alias("all_mean_pct"),
        F.avg(F.when(F.col("region") != "east", loss)).alias("non_east_mean_pct"),
        F.avg(F.when(F.col("region") == "west", F.col("mean_value"))).alias("west_last_year_pct"),
        F.avg(F.when(F.col("region") == "east", F.col("mean_value"))).alias("east_last_year_pct"))


def last_year_mean(rows: DataFrame, value: str) -> DataFrame:
    """Mean over the last calendar year present at each site: yearly sums first, then the latest year."""
    yearly = rows.groupBy("site_id", F.year("date").alias("year")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return yearly.groupBy("site_id").agg(F.max(F.struct("year", "_s", "_n")).alias("y")).select(
        "site_id", F.col("y.year").alias("year"), F.try_divide("y._s", "y._n").alias("mean_value"))
