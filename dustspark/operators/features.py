"""Causal features, labels and the training sample table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions import physics as P
from dustspark.functions.cleaning import doy_angle, finite
from dustspark.operators import windows as Wn


def storm_thresholds(daily: DataFrame, val_start: str) -> DataFrame:
    """Storm threshold per site: three times its upper median PM10, at least the floor.

    Only rows before ``val_start`` count, unless a site has none. ``percentile_disc`` over the
    descending order is the upper median; it merges value counts map-side.
    """
    median = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC)"
    early = F.col("date") < F.lit(val_start).cast("date")
    return (daily.withColumn("_pm", finite(F.col("pm10_max")))
            .withColumn("_train", F.when(early, F.col("_pm")))
            .groupBy("site_id").agg(
                F.count_if(early).alias("_n"),
                F.expr(median.format("_train")).alias("_a"), F.expr(median.format("_pm")).alias("_b"))
            .select("site_id", F.coalesce(F.greatest(
                C.STORM_MULT * F.when(F.col("_n") > 0, F.col("_a")).otherwise(F.col("_b")),
                F.lit(C.STORM_FLOOR)), F.lit(C.STORM_FLOOR)).alias("threshold")))


def with_threshold(daily: DataFrame, val_start: str) -> DataFrame:
    """Same rule as a window column, so it shares the exchange of the rolling features."""
    every = Window.partitionBy("site_id")
    early = F.col("date") < F.lit(val_start).cast("date")
    median = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC) OVER (PARTITION BY site_id)"
    pm = finite(F.col("pm10_max"))
    numbered = Wn.with_row_number(daily, Wn.by_site())
    out = (numbered.withColumn("_pm", pm).withColumn("_train", F.when(early, pm))
           .withColumn("_a", F.expr(median.format("_train")))
           .withColumn("_b", F.expr(median.format("_pm")))
           .withColumn("_n", F.count_if(early).over(every)))
    base = F.when(F.col("_n") > 0, F.col("_a")).otherwise(F.col("_b"))
    return out.withColumn("threshold", F.coalesce(
        F.greatest(C.STORM_MULT * base, F.lit(C.STORM_FLOOR)), F.lit(C.STORM_FLOOR))) \
        .drop("_pm", "_train", "_a", "_b", "_n")


def _input(df: DataFrame, name: str, default: float | None) -> Column:
    if name not in df.columns:
        return F.lit(default).cast("double")
    return finite(F.col(name).cast("double"), default)


def build_features(daily: DataFrame, doy_offset: int = 0) -> DataFrame:
    """The feature vector of every row from that row and earlier rows of the same site only.

    Needs ``threshold`` on each row. Unknown measures default to 0 (wind to 3). All input columns
    stay; ``deposit_rate`` and ``mass`` are added for the labels.
    """
    w = Wn.by_site()
    measures = ("lat", "lon", "elevation_m", "tmax_c", "tmin_c", "tmean_c", "rh_mean_pct", "wind_max_ms",
                "gust_max_ms", "precip_mm", "wind_dir_deg", "ghi_mj_m2", "pm10_max", "pm10_mean",
                "dust_max", "dust_mean", "aod_mean", "pm25_mean")
    raw = {m: _input(daily, m, None) for m in measures}
    zero = {m: _input(daily, m, 3.0 if m == "wind_max_ms" else 0.0) for m in measures}
    angle = doy_angle(F.col("date"), doy_offset)
    base = Wn.with_row_number(daily, w).withColumns({
        "deposit_rate": P.deposit_rate(raw["pm10_max"], raw["dust_max"],
                                       _input(daily, "gust_max_ms", 0.0), raw["precip_mm"])})
    rain, dust = raw["precip_mm"], raw["dust_mean"]
    cols: dict[str, Column] = {
        "doy_sin": F.sin(angle), "doy_cos": F.cos(angle),
        "days_since_rain": Wn.days_since(F.coalesce(rain, F.lit(0.0)) >= 1.0, w).cast("double"),
        "days_since_storm": Wn.days_since(
            F.coalesce(raw["pm10_max"], F.lit(0.0)) >= F.col("threshold"), w).cast("double"),
        "dust_mean_lag1": Wn.lagged(dust, 1, w),
        "aod_mean_7d": Wn.rolling(raw["aod_mean"], 7, "mean", w),
    }
    for n in (3, 7, 30):
        cols[f"pm10_max_{n}d"] = Wn.rolling(raw["pm10_max"], n, "max", w)
    for n in (7, 30):
        cols[f"dust_mean_{n}d"] = Wn.rolling(dust, n, "mean", w)
        cols[f"gust_max_{n}d"] = Wn.rolling(raw["gust_max_ms"], n, "max", w)
        cols[f"precip_{n}d"] = Wn.rolling(rain, n, "sum", w)
    for n in (1, 2, 3):
        cols[f"pm10_max_lag{n}"] = Wn.lagged(raw["pm10_max"], n, w)
    out = base.withColumns(cols)
    out = out.withColumn("dust_factor_today",
                         P.dust_factor_today(F.col("days_since_rain"), F.col("deposit_rate")))
    out = Wn.segmented_mass(out, F.col("deposit_rate"), rain)
    return out.withColumns(zero)


def add_labels(features: DataFrame) -> DataFrame:
    """Today's labels: storm flag, soiling loss, specific yield."""
    loss = P.optical_loss_pct(F.col("mass"))
    return features.withColumns({
        "soiling": loss,
        "storm": P.is_storm(F.col("pm10_max"), F.col("threshold")),
        "yield_kwh": P.specific_yield(F.col("ghi_mj_m2"), F.col("tmean_c"), loss)})


def make_samples(daily: DataFrame, val_start: str, doy_offset: int = 0) -> DataFrame:
    """Features of day t with the targets of the next three rows; warm-up and tail rows dropped."""
    w = Window.partitionBy("site_id").orderBy("_segment", "date")
    rows = add_labels(build_features(with_threshold(daily, val_start), doy_offset))
    targets = {f"storm_t{h}": F.lead("storm", h).over(w) for h in (1, 2, 3)}
    targets |= {
        "yield_t1": F.lead("yield_kwh", 1).over(w),
        "ghi_t1": F.lead(F.col("ghi_mj_m2") / 3.6, 1).over(w),
        "soiling_t1": F.lead("soiling", 1).over(w),
        "pm10_t1": F.lead("pm10_max", 1).over(w)}
    keep = (F.col("_rn") > C.WARMUP_ROWS) & F.col("storm_t3").isNotNull()
    return rows.withColumns(targets).filter(keep).select(
        "site_id", "date", *C.FEATURES, F.col("threshold").alias("thr"),
        "storm_t1", "storm_t2", "storm_t3", "yield_t1", "ghi_t1", "soiling_t1", "pm10_t1",
        F.col("pm10_max").alias("pm10_today"), F.col("storm").alias("storm_today"))


def training_table(daily: DataFrame, labels: DataFrame) -> DataFrame:
    """First-generation table: strict rolling features on day t, mass-balance labels of the next row.

    ``daily`` holds the km/h columns of the training schema; ``labels`` comes from the mass balance
    and holds ``soiling_loss_pct``, ``deposition``, ``days_since_rain`` and ``days_since_clean``.
    A row with any missing feature or target is dropped.
    """
    w = Wn.by_site()
    joined = daily.join(labels, ["site_id", "date"])
    cols: dict[str, Column] = {"doy_sin": F.sin(doy_angle(F.col("date"))), "doy_cos": F.cos(doy_angle(F.col("date")))}
    for c, n, how in C.TRAINING_ROLLS:
        if c in daily.columns:
            cols[f"{c}_{n}d_{how}"] = Wn.rolling_strict(F.col(c), n, how, w)
    for c in C.TRAINING_EXPANDING:
        if c in daily.columns:
            cols[f"{c}_expmean"] = Wn.expanding_mean_strict(F.col(c), w)
    cols["target_loss"] = F.lead("soiling_loss_pct").over(w)
    cols["target_deposition"] = F.lead("deposition").over(w)
    return joined.withColumns(cols).dropna(how="any")
