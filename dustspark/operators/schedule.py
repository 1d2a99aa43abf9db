"""Day-by-day projection of a fixed and a tuned cleaning schedule over the same weather."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions import soiling as S
from dustspark.operators.policy import day_factor, with_climate, with_site_columns
from dustspark.operators.series import fold

_STATE = "struct<exposure:double,severe:boolean,n:int>"
_OUT = "struct<exposure:double,act:boolean>"


def _exposure_at(loss: Column | float, lmax: Column, tau: Column) -> Column:
    """Exposure at which the loss reaches a value; never for values above the ceiling."""
    loss = loss if isinstance(loss, Column) else F.lit(float(loss))
    return F.when(loss > 100.0 * C.MAX_LOSS_FRAC, float("inf")).otherwise(-tau * F.ln(1.0 - loss / (100.0 * lmax)))


def _walk(days: Column, start: Column, act: Callable[[Column, Column, Column], Column]) -> Column:
    """Exposure fold: add the day's factor, wash by heavy rain, then clean if ``act(n, exposure, severe)`` on the n-th day.

    Loss grows with exposure, so every loss threshold is an exposure threshold, worked out once per row;
    the loop itself only adds and compares.
    """
    def step(state: Column, day: Column) -> tuple[Column, Column]:
        exposure = day["keep"] * F.least(F.lit(C.MAX_EXPOSURE), state["exposure"] + day["f"])
        clean = act(state["n"], exposure, state["severe"])
        return (F.struct(F.when(clean, 0.0).otherwise(exposure).alias("exposure"),
                         (exposure >= day["severe_at"]).alias("severe"), (state["n"] + 1).alias("n")),
                F.struct(exposure.alias("exposure"), clean.alias("act")))

    return fold(days, F.struct(start.alias("exposure"), F.lit(False).alias("severe"), F.lit(1).alias("n")), _STATE, _OUT, step)


def _severe_at(risk: Column) -> Column:
    """Exposure from which the day counts as severe, given its weather score."""
    lmax, tau = F.col("lmax"), F.col("tau")
    return (F.when(risk >= 5, float("-inf")).when(risk >= 4, _exposure_at(12.0, lmax, tau))
            .when(risk >= 3, _exposure_at(25.0, lmax, tau)).otherwise(float("inf")))


def project(rollup: DataFrame, plants: DataFrame) -> DataFrame:
    """Rows of both schedules for every plant and day.

    ``plants`` has ``site_id``, ``climate``, ``capacity_kwp``, ``tuned_threshold_pct`` and optionally
    ``interval_days``, ``start_exposure``, ``cost_per_mwp``. The series is collected once per plant and both
    schedules fold over it in the same row.
    """
    defaults = {"interval_days": F.lit(C.DEFAULT_CLEANING_INTERVAL), "start_exposure": F.lit(0.0),
                "cost_per_mwp": F.lit(C.CLEANING_COST_SAR_PER_MWP)}
    known = plants.withColumns({n: c for n, c in defaults.items() if n not in plants.columns})
    plant = ["site_id", "climate", "capacity_kwp", "tuned_threshold_pct", "interval_days",
             "start_exposure", "cost_per_mwp"]
    risk = S.weather_risk_score(F.col("gust_max_ms"), F.col("pm10_ugm3"), F.col("aod"))
    ratio = S.performance_ratio(F.col("tcell_max_c"), F.col("tair_max_c"), F.col("peak_ghi_wm2"))
    days = with_climate(with_site_columns(rollup, known.select(*plant))).select(
        *plant, "lmax", "tau", "date", day_factor().alias("f"),
        F.coalesce("precip_mm", F.lit(0.0)).alias("precip_mm"), risk.alias("risk"), ratio.alias("perf_ratio"),
        F.when(F.col("precip_mm") >= C.RAIN_WASHOFF_MM, C.RAIN_WASHOFF_KEEP).otherwise(1.0).alias("keep"),
        _severe_at(risk).alias("severe_at"),
        S.day_irradiation(F.col("irradiation_kwh_m2"), F.col("peak_ghi_wm2")).alias("irr"))
    series = days.groupBy("site_id").agg(
        *[F.first(c).alias(c) for c in (*plant[1:], "lmax", "tau")],
        F.sort_array(F.collect_list(F.struct("date", "f", "precip_mm", "risk", "perf_ratio", "irr", "keep", "severe_at")))
        .alias("days"))
    tuned = F.col("tuned_threshold_pct")
    series = series.withColumns({
        "_early": _exposure_at(tuned * 0.6, F.col("lmax"), F.col("tau")),
        "_late": _exposure_at(tuned, F.col("lmax"), F.col("tau"))})
    both = series.withColumns({
        "fixed": _walk(F.col("days"), F.col("start_exposure"),
                       lambda n, exposure, severe: F.pmod(n, F.col("interval_days")) == 0),
        "adaptive": _walk(F.col("days"), F.col("start_exposure"),
                          lambda n, exposure, severe: exposure >= F.when(severe, F.col("_early"))
                          .otherwise(F.col("_late")))})
    rows = both.select(
        # the outer form keeps the optimizer from folding once more to test for empty series
        *plant, "lmax", "tau", F.posexplode_outer(F.arrays_zip("days", "fixed", "adaptive")).alias("i", "z")).select(
        *plant, "lmax", "tau", "i", "z.days.*", F.inline(F.array(
            F.struct(F.lit("fixed").alias("schedule"), F.col("z.fixed").alias("o")),
            F.struct(F.lit("adaptive").alias("schedule"), F.col("z.adaptive").alias("o"))))).select(
        "site_id", "schedule", "date", "i", "capacity_kwp", "cost_per_mwp", "interval_days",
        F.col("f").alias("dust_factor"), "precip_mm", "risk", "perf_ratio", "irr",
        S.loss_pct(F.col("o.exposure"), F.col("lmax"), F.col("tau")).alias("loss_pct"),
        F.when(F.col("o.act"), 0.0).otherwise(F.col("o.exposure")).alias("exposure"), F.col("o.act").alias("cleaned"))
    clean_kwh = F.col("capacity_kwp") * F.col("irr") * F.col("perf_ratio")
    lost = clean_kwh * F.col("loss_pct") / 100.0
    return rows.withColumns({
        "clean_kwh": clean_kwh, "energy_kwh": clean_kwh - lost, "lost_kwh": lost,
        "lost_sar": lost * C.TARIFF_SAR_PER_KWH,
        "dust_mass_g_m2": S.mass_from_loss(F.col("loss_pct")),
        "dust_risk": S.risk_label(F.col("risk") + S.loss_risk_score(F.col("loss_pct")))})


def schedule_totals(rows: DataFrame, tariff: float = C.TARIFF_SAR_PER_KWH) -> DataFrame:
    """Totals of each schedule: energy, money, passes, water, loss."""
    out = rows.groupBy("site_id", "schedule").agg(
        F.first("capacity_kwp").alias("capacity_kwp"), F.first("cost_per_mwp").alias("cost_per_mwp"),
        F.sum("energy_kwh").alias("energy_kwh"), F.sum("clean_kwh").alias("clean_kwh"),
        F.sum("lost_kwh").alias("lost_kwh"), F.count_if("cleaned").alias("cleaning_events"),
        F.avg("loss_pct").alias("mean_loss_pct"), F.max("loss_pct").alias("max_loss_pct"))
    cost = F.col("cleaning_events") * S.cleaning_cost(F.col("capacity_kwp"), F.col("cost_per_mwp"))
    return out.withColumns({
        "lost_sar": F.col("lost_kwh") * tariff, "cleaning_cost_sar": cost,
        "water_litres": F.col("cleaning_events") * S.water_litres(F.col("capacity_kwp")),
        "net_sar": F.col("energy_kwh") * tariff - cost})


def first_days(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` days of every site; rows carry their position ``i``."""
    return rows.filter(F.col("i") < n)


def verdict(rows: DataFrame, horizon: int = 7) -> DataFrame:
    """Clean now or wait, from the money at risk in the first days of the fixed schedule."""
    fixed = first_days(rows.filter(F.col("schedule") == "fixed"), horizon)
    out = fixed.groupBy("site_id").agg(
        F.sum(F.round("lost_sar", 2)).alias("risk_sar"), F.count(F.lit(1)).alias("days"),
        F.first("capacity_kwp").alias("capacity_kwp"), F.first("cost_per_mwp").alias("cost_per_mwp"),
        F.min(F.struct("i", "loss_pct", "dust_factor", "dust_risk")).alias("now"))
    cost = S.cleaning_cost(F.col("capacity_kwp"), F.col("cost_per_mwp"))
    urgency = 3.0 * F.round("now.loss_pct", 2) / F.greatest(F.round("now.dust_factor", 2), F.lit(0.3))
    return out.select(
        "site_id", F.when(F.col("risk_sar") > cost * 0.9, "clean_now").otherwise("wait").alias("decision"),
        F.col("now.loss_pct").alias("current_loss_pct"), F.col("now.dust_risk").alias("risk_today"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), urgency)).alias("urgency"),
        "risk_sar", cost.alias("cleaning_cost_sar"),
        (cost / F.greatest(F.col("risk_sar") / F.greatest(F.col("days"), F.lit(1)), F.lit(0.01))).alias("payback_days"))


def adaptive_delta(totals: DataFrame) -> DataFrame:
    """What the tuned schedule changes against the fixed one; saved water is never negative."""
    wide = totals.groupBy("site_id").agg(
        F.first("capacity_kwp").alias("capacity_kwp"),
        *[F.max(F.when(F.col("schedule") == s, F.col(c))).alias(f"{s}_{c}")
          for s in ("fixed", "adaptive") for c in ("energy_kwh", "lost_sar", "cleaning_events")])
    fewer = F.greatest(F.lit(0), F.col("fixed_cleaning_events") - F.col("adaptive_cleaning_events"))
    return wide.select(
        "site_id", F.coalesce(100.0 * (F.try_divide("adaptive_energy_kwh", "fixed_energy_kwh") - 1.0), F.lit(0.0))
        .alias("energy_pct"),
        F.col("fixed_lost_sar").alias("lost_sar_fixed"), F.col("adaptive_lost_sar").alias("lost_sar_adaptive"),
        (F.col("fixed_lost_sar") - F.col("adaptive_lost_sar")).alias("saved_sar"),
        F.col("fixed_cleaning_events").alias("events_fixed"), F.col("adaptive_cleaning_events").alias("events_adaptive"),
        (fewer * S.water_litres(F.col("capacity_kwp"))).alias("water_saved_litres"))


def dust_outlook(rollup: DataFrame, sites: DataFrame) -> DataFrame:
    """Daily dust risk (no loss term) and dust factor of every site."""
    days = with_climate(with_site_columns(rollup, sites.select("site_id", "name", "climate")))
    score = S.weather_risk_score(F.col("gust_max_ms"), F.col("pm10_ugm3"), F.col("aod"))
    return days.select("site_id", "name", "climate", "date", "pm10_ugm3", "dust_ugm3", "aod", "wind_max_ms",
                       "gust_max_ms", "precip_mm", S.risk_label(score).alias("risk"),
                       day_factor().alias("dust_factor"))


def dust_events(outlook: DataFrame) -> DataFrame:
    return outlook.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("risk").isin("high", "severe")).alias("dust_events"))


def mean_factor(days: DataFrame, rows: int = 7) -> DataFrame:
    """Trailing mean of the dust factor."""
    w = Window.partitionBy("site_id").orderBy("date").rowsBetween(-(rows - 1), 0)
    return days.withColumn("mean_factor", F.avg("dust_factor").over(w))
