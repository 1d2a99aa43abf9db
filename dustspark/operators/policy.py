"""Exposure over calendars and observed days, policy candidates and their cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dustspark import constants as C
from dustspark.functions import soiling as S
from dustspark.session import send_code
from dustspark.sources.dimensions import climate_dimension, policy_candidates

# the four climates are a constant table, so the joins below may broadcast them


def known_climate(climate: Column, fallback: str = C.DEFAULT_CLIMATE) -> Column:
    """The climate's name; null and unknown ones count as the default."""
    return F.when(climate.isin([c[0] for c in C.CLIMATES]), climate).otherwise(fallback)


def with_climate(df: DataFrame, fallback: str = C.DEFAULT_CLIMATE) -> DataFrame:
    """Climate parameters by the ``climate`` column; null and unknown climates become ``fallback``."""
    dim = F.broadcast(climate_dimension(df.sparkSession))
    return df.withColumn("climate", known_climate(F.col("climate"), fallback)).join(dim, "climate")


def with_site_columns(days: DataFrame, sites: DataFrame) -> DataFrame:
    """Days joined with their site's row, partitioned by site.

    The per-site windows and folds which follow need the days hashed on the site anyway, so the join
    uses that exchange (building the table on the one-row-per-site side) instead of a broadcast: it
    needs no size bound, and a small site table never decides how many tasks the days get.
    """
    return days.join(sites.hint("shuffle_hash"), "site_id")


def day_factor(bias: Column | None = None) -> Column:
    return S.dust_factor(F.col("pm10_ugm3"), F.col("dust_ugm3"), F.col("wind_max_ms"), F.col("gust_max_ms"),
                         F.col("rh_mean_pct"), F.col("irradiation_kwh_m2"),
                         F.col("dust_bias") if bias is None else bias)


def calendar_year(df: DataFrame, year: int = 2026) -> DataFrame:
    """One row per input row and day of the year: ``i`` (zero-based), ``date``, ``doy``."""
    days = F.sequence(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))
    return df.select("*", F.posexplode(days).alias("i", "date")).withColumn("doy", F.dayofyear("date"))


def interval_exposure(days: DataFrame, factor: str, intervals: tuple[int, ...], order: str = "date") -> DataFrame:
    """Exposure before cleaning under each fixed calendar: rows of ``days`` per interval.

    The exposure is the running sum minus its value at the start of the cleaning cycle, so all intervals
    share one window over (site, date); the rows are multiplied only afterwards, inside the task. The
    factor is positive, so capping the sum equals capping each step. Needs ``i``, the zero-based row.
    """
    w = Window.partitionBy("site_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("_sum", F.sum(factor).over(w))
    start = F.col("_sum") - F.col(factor)
    out = out.withColumns({f"_start{k}": F.last(F.when(F.col("i") % k == 0, start), ignorenulls=True).over(w)
                           for k in intervals})
    arms = F.array(*[F.struct(
        F.lit(k).alias("interval_days"),
        F.least(F.lit(C.MAX_EXPOSURE), F.col("_sum") - F.col(f"_start{k}")).alias("exposure")) for k in intervals])
    return out.select(*days.columns, F.inline(arms))


def observed_intervals(rollup: DataFrame, sites: DataFrame,
                       intervals: tuple[int, ...] = C.INTERVAL_CANDIDATES) -> DataFrame:
    """Loss and energy of every observed day under each fixed interval.

    One exchange on the site and one sort serve the join, the numbering and all intervals.
    """
    w = Window.partitionBy("site_id").orderBy("date")
    days = with_climate(with_site_columns(rollup, sites.select("site_id", "climate", "capacity_kwp")))
    days = days.withColumn("i", F.row_number().over(w) - 1).select(
        "site_id", "date", "i", "capacity_kwp", "lmax", "tau", day_factor().alias("factor"),
        (F.col("capacity_kwp") * S.day_irradiation(F.col("irradiation_kwh_m2"), F.col("peak_ghi_wm2"))
         * S.performance_ratio(F.col("tcell_max_c"), F.col("tair_max_c"), F.col("peak_ghi_wm2"))).alias("clean_kwh"))
    out = interval_exposure(days, "factor", intervals)
    loss = S.loss_pct(F.col("exposure"), F.col("lmax"), F.col("tau"))
    return out.withColumn("loss_pct", loss).withColumn("lost_kwh", F.col("clean_kwh") * F.col("loss_pct") / 100.0)


def interval_totals(days: DataFrame, tariff: float = C.TARIFF_SAR_PER_KWH) -> DataFrame:
    """Cost of each interval per site: lost output at the tariff plus the cleaning passes."""
    totals = days.groupBy("site_id", "interval_days").agg(
        F.count(F.lit(1)).alias("days"), F.first("capacity_kwp").alias("capacity_kwp"),
        F.sum("clean_kwh").alias("clean_kwh"), F.sum("lost_kwh").alias("lost_kwh"),
        F.avg("loss_pct").alias("mean_loss_pct"))
    cleans = F.floor(F.col("days") / F.col("interval_days"))
    return totals.withColumns({
        "cleans": cleans, "lost_sar": F.col("lost_kwh") * tariff,
        "cleaning_sar": cleans * S.cleaning_cost(F.col("capacity_kwp")),
        "net_cost_sar": F.col("lost_kwh") * tariff + cleans * S.cleaning_cost(F.col("capacity_kwp"))})


def cheapest_interval(totals: DataFrame) -> DataFrame:
    """The interval with the lowest net cost per site; ties go to the shorter interval."""
    return totals.groupBy("site_id").agg(F.min(F.struct(
        "net_cost_sar", "interval_days", "cleans", "mean_loss_pct", "lost_sar", "cleaning_sar")).alias("b")) \
        .select("site_id", "b.*")


def observed_series(rollup: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site: climate parameters and its observed days in order, as (i, f, kwh per kWp).

    The array is bounded by the calendar. A day without a factor or without irradiation adds nothing.
    """
    days = with_climate(with_site_columns(rollup, sites.select("site_id", "climate"))).select(
        "site_id", "date", "lmax", "tau", F.coalesce(day_factor(), F.lit(0.0)).alias("f"),
        F.coalesce(S.day_irradiation(F.col("irradiation_kwh_m2"), F.col("peak_ghi_wm2"))
                   * S.performance_ratio(F.col("tcell_max_c"), F.col("tair_max_c"), F.col("peak_ghi_wm2")), F.lit(0.0)).alias("kwh"))
    series = days.groupBy("site_id").agg(
        F.first("lmax").alias("lmax"), F.first("tau").alias("tau"),
        F.sort_array(F.collect_list(F.struct("date", "f", "kwh"))).alias("days"))
    return series.withColumn("days", F.transform("days", lambda d, i: F.struct(
        i.alias("i"), d["f"].alias("f"), d["kwh"].alias("kwh"))))


def observed_candidates(rollup: DataFrame, sites: DataFrame) -> DataFrame:
    """Every policy candidate (21 constants) over each site's observed days: events, mean loss, lost kWh per kWp."""
    spark = sites.sparkSession
    send_code(spark)
    series = observed_series(rollup, sites).select(
        "site_id", "lmax", "tau", F.col("days.f").alias("f"), F.col("days.kwh").alias("kwh"))
    kind = StructType([series.schema["site_id"]]).add("ord", "integer").add("n_days", "integer").add("events", "integer") \
        .add("loss_sum", "double").add("lost_kwh", "double")
    totals = series.mapInPandas(_candidate_rows, kind).join(F.broadcast(policy_candidates(spark)), "ord")
    return totals.select(
        "site_id", "ord", "kind", "interval_days", "threshold_pct", "n_days", "events",
        F.col("lost_kwh").alias("lost_kwh_per_kwp"), (100.0 * F.col("loss_sum") / F.col("n_days")).alias("mean_loss_pct"))


#: sites whose days are walked together
_SITES = 256


def _candidate_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # sites of like length stand together, so that few days are filled up
        batch = batch.iloc[np.argsort(batch["f"].map(len).to_numpy(), kind="stable")]
        for k in range(0, len(batch), _SITES):
            part = batch.iloc[k:k + _SITES]
            n = part["f"].map(len).to_numpy()
            f, kwh = np.zeros((2, len(part), n.max()))
            for row, (x, y) in enumerate(zip(part["f"], part["kwh"], strict=True)):
                f[row, :len(x)], kwh[row, :len(y)] = x, y
            events, loss_sum, lost = candidate_totals(f, kwh, n, part["lmax"].to_numpy(float), part["tau"].to_numpy(float))
            arms = events.shape[1]
            yield pd.DataFrame({
                "site_id": np.repeat(part["site_id"].to_numpy(), arms), "ord": np.tile(np.arange(arms, dtype=np.int32), len(part)),
                "n_days": np.repeat(n.astype(np.int32), arms), "events": events.ravel(), "loss_sum": loss_sum.ravel(), "lost_kwh": lost.ravel()})


def candidate_totals(f: np.ndarray, kwh: np.ndarray, n: np.ndarray, lmax: np.ndarray,
                     tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events, summed loss and lost kWh per kWp of all candidates (columns) over the first ``n`` days of some sites (rows).

    One step a day for all sites and candidates; the state is a few numbers of each.
    """
    every = np.array([*C.INTERVAL_CANDIDATES, *[0] * (len(C.THRESHOLD_CANDIDATES) + 1)])
    limit = np.array([*[np.inf] * len(C.INTERVAL_CANDIDATES), *C.THRESHOLD_CANDIDATES, np.inf])
    exposure, loss_sum, lost = np.zeros((3, len(f), len(every)))
    events, last = np.zeros(exposure.shape, np.int32), np.full(exposure.shape, -999)
    lmax, tau = lmax[:, None], tau[:, None]
    for i in range(f.shape[1]):
        exposure = np.fmin(C.MAX_EXPOSURE, exposure + f[:, i, None])
        raw = lmax * (1.0 - np.exp(-np.maximum(exposure, 0.0) / tau))
        loss = 100.0 * np.minimum(raw, C.MAX_LOSS_FRAC)
        clean = ((every > 0) & ((i + 1) % np.maximum(every, 1) == 0)) | ((loss >= limit) & (i - last >= 2))
        open_ = (i < n)[:, None]
        loss_sum += np.where(open_, loss / 100.0, 0.0)
        lost += np.where(open_, kwh[:, i, None] * loss / 100.0, 0.0)
        events += clean & open_
        exposure[clean] = 0.0
        last[clean] = i
    return events, loss_sum, lost


def policy_costs(rollup: DataFrame, sites: DataFrame, cost_per_mwp: Column | float | None = None,
                 tariff: float = C.TARIFF_SAR_PER_KWH) -> DataFrame:
    """Cost of every candidate at every site over its observed days, per 365 days, rounded to whole SAR and kWh.

    ``events`` is the number of passes in the whole record. Sites without a day drop out.
    """
    rows = sites.withColumn("climate", known_climate(F.col("climate"))).join(observed_candidates(rollup, sites), "site_id")
    year = F.lit(365.0) / F.col("n_days")
    lost = F.col("capacity_kwp") * F.col("lost_kwh_per_kwp") * year
    spend = F.col("events") * S.cleaning_cost(F.col("capacity_kwp"), cost_per_mwp) * year
    return rows.withColumns({
        "energy_lost_kwh": F.round(lost, 0), "value_lost_sar": F.round(lost * tariff, 0),
        "cleaning_cost_sar": F.round(spend, 0), "net_cost_sar": F.round(lost * tariff + spend, 0),
        "water_litres": F.round(F.col("events") * S.water_litres(F.col("capacity_kwp")) * year, 0),
        "mean_loss_pct": F.round("mean_loss_pct", 2)})


_PICK = ("net_cost_sar", "ord", "kind", "interval_days", "threshold_pct", "events", "energy_lost_kwh",
         "value_lost_sar", "cleaning_cost_sar", "water_litres", "mean_loss_pct")


def _picks() -> list[Column]:
    pick = F.struct(*_PICK)
    return [F.min(F.when(F.col("kind") != "never", pick)).alias("best"),
            F.min(F.when(F.col("kind") == "interval", pick)).alias("fixed"),
            F.min(F.when(F.col("kind") == "never", pick)).alias("never"),
            F.count(F.lit(1)).alias("candidates")]


def _compared(best: DataFrame) -> DataFrame:
    saving = F.col("fixed.net_cost_sar") - F.col("best.net_cost_sar")
    return best.withColumns({
        "beats_calendar": F.col("best.net_cost_sar") < F.col("fixed.net_cost_sar") - 1,
        "saving_vs_best_calendar_sar": F.round(saving, 0),
        "tuned_threshold_pct": F.coalesce(F.col("best.threshold_pct"), F.lit(C.DEFAULT_THRESHOLD_PCT))})


def best_policy(costs: DataFrame) -> DataFrame:
    """Cheapest candidate and cheapest fixed calendar per site; the first one wins a tie."""
    return _compared(costs.groupBy("site_id").agg(*_picks()))


def annual_habits(costs: DataFrame, default_interval: int = C.DEFAULT_CLEANING_INTERVAL) -> DataFrame:
    """Yearly result of the usual habits per site, and what the tuned policy saves against today's.

    Habits and picks share one aggregate, so the candidates are walked once.
    """
    arm = {f"d{k}": F.max(F.when(F.col("interval_days") == k, F.struct(*_PICK[:1], *_PICK[5:])))
           for k in (7, 14, 30, default_interval)}
    today = f"d{default_interval}"
    out = _compared(costs.groupBy("site_id").agg(*[c.alias(n) for n, c in arm.items()], *_picks()))
    return out.select(
        "site_id", F.col("d7.net_cost_sar").alias("weekly_net_sar"),
        F.col("d14.net_cost_sar").alias("d14_net_sar"), F.col("d30.net_cost_sar").alias("d30_net_sar"),
        F.col(f"{today}.net_cost_sar").alias("today_net_sar"),
        F.col("best.net_cost_sar").alias("adaptive_net_sar"), F.col("never.net_cost_sar").alias("never_net_sar"),
        F.col("d7.mean_loss_pct").alias("weekly_loss_pct"),
        F.col("best.mean_loss_pct").alias("adaptive_loss_pct"),
        F.round(100.0 * (1 - F.col("best.energy_lost_kwh") / F.greatest(
            F.col(f"{today}.energy_lost_kwh"), F.lit(1.0))), 2).alias("energy_kept_pct"),
        F.round(F.col(f"{today}.net_cost_sar") - F.col("best.net_cost_sar"), 0).alias("sar_saved_year"),
        (F.col(f"{today}.events") - F.col("best.events")).alias("events_saved"),
        F.round(F.greatest(F.lit(0.0), F.col(f"{today}.water_litres") - F.col("best.water_litres")), 0)
        .alias("water_saved_litres"),
        "beats_calendar", "saving_vs_best_calendar_sar", F.col("best.threshold_pct").alias("tuned_trigger"))
