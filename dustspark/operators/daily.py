"""Hourly to daily roll-ups and the joins which assemble the daily table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustspark.functions.cleaning import day_key, finite

_KEY = ["site_id", "date"]


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def rollup_serving(hourly: DataFrame, tz: str | None = None, mode: str = "nonnull") -> DataFrame:
    """One row per site and day for the exposure model.

    ``mode="reference"`` divides temperature and humidity sums by all hours, so a missing hour counts
    as zero; ``"nonnull"`` averages the hours which have a value. Wind, gust and rain treat null as 0.
    """
    c = {n: _col(hourly, n) for n in ("ghi_wm2", "temp_c", "rh_pct", "wind_ms", "gust_ms", "precip_mm",
                                      "pm10", "dust_ugm3", "aod")}
    zero = {n: F.coalesce(v, F.lit(0.0)) for n, v in c.items()}

    def mean(name: str) -> Column:
        return F.sum(zero[name]) / F.count(F.lit(1)) if mode == "reference" else F.avg(c[name])

    def peak(name: str) -> Column:
        return F.greatest(F.max(zero[name]), F.lit(0.0))

    return hourly.groupBy("site_id", day_key(F.col("ts"), tz).alias("date")).agg(
        (F.sum(zero["ghi_wm2"]) / 1000.0).alias("irradiation_kwh_m2"),
        F.max(c["temp_c"]).alias("tair_max_c"),
        mean("temp_c").alias("tair_mean_c"),
        F.max(c["temp_c"] + zero["ghi_wm2"] * 0.028).alias("tcell_max_c"),
        mean("rh_pct").alias("rh_mean_pct"),
        peak("wind_ms").alias("wind_max_ms"), peak("gust_ms").alias("gust_max_ms"),
        F.sum(zero["precip_mm"]).alias("precip_mm"),
        F.avg(c["pm10"]).alias("pm10_ugm3"), F.avg(c["dust_ugm3"]).alias("dust_ugm3"),
        F.avg(c["aod"]).alias("aod"), peak("ghi_wm2").alias("peak_ghi_wm2"))


def rollup_stats(hourly: DataFrame, measures: list[str], tz: str | None = None,
                 keep_empty: bool = False) -> DataFrame:
    """Max, mean and count per measure; a day without any value is left out unless ``keep_empty``."""
    aggs = []
    for m in measures:
        v = finite(F.col(m))
        aggs += [F.max(v).alias(f"{m}_max"), F.avg(v).alias(f"{m}_mean"), F.count(v).alias(f"{m}_n")]
    out = hourly.groupBy("site_id", day_key(F.col("ts"), tz).alias("date")).agg(*aggs)
    return out if keep_empty else out.filter(F.greatest(*[F.col(f"{m}_n") for m in measures], F.lit(0)) > 0)


def rollup_training(hourly: DataFrame, measures: list[str], tz: str | None = None) -> DataFrame:
    """Mean and max per measure plus ``aq_hours``, the number of measures with data on the day."""
    stats = rollup_stats(hourly, measures, tz)
    present = sum((F.when(F.col(f"{m}_n") > 0, 1).otherwise(0) for m in measures), F.lit(0))
    return stats.withColumn("aq_hours", present).drop(*[f"{m}_n" for m in measures])


def assemble_left(spine: DataFrame, *others: DataFrame) -> DataFrame:
    """Weather spine with every other daily table joined on site and day; unmatched stays null."""
    out = spine
    for other in others:
        out = out.join(other, _KEY, "left")
    return out


def assemble_inner(weather: DataFrame, aerosol: DataFrame) -> DataFrame:
    """Days with both feeds; a day without PM10 is unusable and dropped."""
    return weather.join(aerosol.filter(F.col("pm10_max").isNotNull()), _KEY)


def proxy_fallback(df: DataFrame) -> DataFrame:
    """Dust from PM10 where dust is missing, mean AOD from its maximum where the mean is missing."""
    gone = F.col("dust_max").isNull()
    out = df.withColumns({
        "dust_max": F.coalesce(F.col("dust_max"), 0.45 * F.col("pm10_max")),
        "dust_mean": F.when(gone, 0.30 * F.col("pm10_mean")).otherwise(F.col("dust_mean"))})
    return out.withColumn("aod_mean", F.coalesce("aod_mean", "aod_max")) if "aod_max" in df.columns else out


def missing_days(spine: DataFrame, measured: DataFrame) -> DataFrame:
    """Spine days without a measurement."""
    return spine.join(measured.select(*_KEY), _KEY, "left_anti")


def by_priority(spine: DataFrame, measured: DataFrame, modelled: DataFrame, columns: list[str]) -> DataFrame:
    """Aerosol columns from the measurement, else the model, else null, with their provenance."""
    m = measured.select(*_KEY, *[F.col(c).alias(f"_m_{c}") for c in columns], F.lit(True).alias("_m"))
    b = modelled.select(*_KEY, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_b"))
    out = spine.join(m, _KEY, "left").join(b, _KEY, "left")
    out = out.withColumns({c: F.when(F.col("_m"), F.col(f"_m_{c}")).otherwise(F.col(f"_b_{c}")) for c in columns})
    source = F.when(F.col("_m"), "measured_cams").when(F.col("_b"), "modelled_climatology").otherwise("missing")
    return out.withColumns({
        "aq_source": source,
        "source": F.when(F.col("_m"), "open-meteo-archive+daily").otherwise("open-meteo-archive+aq-climatology"),
    }).drop("_m", "_b", *[f"_m_{c}" for c in columns], *[f"_b_{c}" for c in columns])


def complete_spine(df: DataFrame) -> DataFrame:
    """Days with a finite maximum and minimum temperature; adds the mean of both if it is absent."""
    out = df.withColumns({"tmax_c": finite(F.col("tmax_c")), "tmin_c": finite(F.col("tmin_c"))}) \
        .dropna(subset=["tmax_c", "tmin_c"])
    mean = 0.5 * (F.col("tmax_c") + F.col("tmin_c"))
    return out.withColumn("tmean_c", F.coalesce(finite(F.col("tmean_c")), mean)
                          if "tmean_c" in df.columns else mean)


def as_of_row(daily: DataFrame, back: int = 3, need: int = 45) -> DataFrame:
    """Per site the row ``back`` rows before its last one, for sites with at least ``need`` rows.

    The date is found with two partial aggregates, then joined back: no window over the history.
    """
    last = daily.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("history_days"),
        F.reverse(F.array_sort(F.collect_set("date"))).alias("_dates"))
    pick = last.filter(F.col("history_days") >= need).select(
        "site_id", "history_days", F.col("_dates")[back].alias("date"))
    return daily.join(pick, _KEY)
