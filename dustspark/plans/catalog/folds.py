"""Cleaning policies, schedules and the mass balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.operators import mass_balance as MB
from dustspark.operators import policy as PL
from dustspark.operators import schedule as SC
from dustspark.plans.catalog.base import (SQL_IRR, SQL_PR, SQL_WEATHER_RISK, pick, query, rounded, sql,
                                          sql_dust_factor, sql_loss, sql_loss_risk, sql_risk_label)
from dustspark.sources import fixtures as X

# ---- observed days under fixed intervals
_OBSERVED = f"""days AS (SELECT r.*, capacity_kwp, lmax, tau, row_number() OVER (PARTITION BY r.site_id ORDER BY date)-1 AS i,
      {sql_dust_factor()} AS f, capacity_kwp*{SQL_IRR}*{SQL_PR} AS clean_kwh
      FROM rollup r JOIN sites s ON s.site_id=r.site_id JOIN clim USING (climate)),
  exposed AS (SELECT site_id, date, i, k AS interval_days, capacity_kwp, clean_kwh, lmax, tau,
      least(400, sum(f) OVER (PARTITION BY site_id, k, i // k ORDER BY i ROWS UNBOUNDED PRECEDING)) AS exposure
      FROM days, (SELECT unnest([5,7,10,14,21,30,45,60]) AS k)),
  lossy AS (SELECT *, {sql_loss('exposure')} AS loss_pct FROM exposed),
  totals AS (SELECT site_id, interval_days, count(*) // interval_days AS cleans, avg(loss_pct) AS mean_loss_pct,
      sum(clean_kwh*loss_pct/100)*0.18::DOUBLE AS lost_sar,
      (count(*) // interval_days)*greatest(max(capacity_kwp)/1000,0.001::DOUBLE)*1800 AS cleaning_sar FROM lossy GROUP BY 1, 2)"""


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return PL.observed_intervals(X.rollup(spark, d), X.sites(spark, d))


@query("cheapest_cleaning_interval", "J6 X6 W13 X7 X11 A13 A16", sql(
    "rollup sites clim", """SELECT site_id, interval_days, cleans, round(mean_loss_pct,4) AS mean_loss_pct,
      round(lost_sar,2) AS lost_sar, round(cleaning_sar,2) AS cleaning_sar, round(lost_sar+cleaning_sar,2) AS net_cost_sar
    FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY lost_sar+cleaning_sar, interval_days) AS rn FROM totals)
    WHERE rn = 1""", _OBSERVED))
def cheapest(spark: SparkSession, d: str) -> DataFrame:
    best = PL.cheapest_interval(PL.interval_totals(_observed(spark, d)))
    return rounded(best, 2, mean_loss_pct=4)


@query("w13_interval_exposure", "W13 J15", sql(
    "rollup sites clim", """SELECT site_id, interval_days, count(*) AS days, round(max(exposure),4) AS max_exposure,
      round(avg(exposure),4) AS mean_exposure FROM lossy GROUP BY 1, 2""", _OBSERVED))
def interval_exposure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_observed(spark, d).groupBy("site_id", "interval_days").agg(
        F.count(F.lit(1)).alias("days"), F.max("exposure").alias("max_exposure"), F.avg("exposure").alias("mean_exposure")))


# ---- policy candidates over observed days
_POLICIES = f"""pdays AS MATERIALIZED (SELECT r.site_id, lmax, tau, row_number() OVER (PARTITION BY r.site_id ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY r.site_id) AS n_days,
      {sql_dust_factor()} AS f, {SQL_IRR}*{SQL_PR} AS kwh FROM rollup AS r INNER JOIN sites s ON s.site_id=r.site_id JOIN clim USING (climate)),
  walk AS (
    SELECT site_id, n_days, ord, kind, interval_days, threshold_pct, -1::BIGINT AS i, 0.0::DOUBLE AS exposure, 0.0::DOUBLE AS loss_sum,
      0.0::DOUBLE AS lost, 0 AS events, -999::BIGINT AS last FROM (SELECT DISTINCT site_id, n_days FROM pdays), candidates
    UNION ALL
    SELECT site_id, n_days, ord, kind, interval_days, threshold_pct, i, CASE WHEN cl THEN 0 ELSE e END, loss_sum+loss/100, lost+kwh*loss/100,
      events + CASE WHEN cl THEN 1 ELSE 0 END, CASE WHEN cl THEN i ELSE last END
    FROM (SELECT *, CASE WHEN interval_days IS NOT NULL THEN (i+1) % interval_days = 0
              WHEN threshold_pct IS NOT NULL THEN loss >= threshold_pct AND i-last >= 2 ELSE false END AS cl
        FROM (SELECT *, {sql_loss('e')} AS loss FROM (
          SELECT w.site_id, w.n_days, w.ord, w.kind, w.interval_days, w.threshold_pct, y.i, least(400, w.exposure+y.f) AS e, w.loss_sum, w.lost,
            w.events, w.last, y.kwh, y.lmax, y.tau FROM walk w JOIN pdays y ON y.site_id=w.site_id AND y.i=w.i+1)))),
  costs AS (SELECT site_id, capacity_kwp, ord, kind, interval_days, threshold_pct, events, round(100*loss_sum/n_days,2) AS mean_loss_pct,
      round(capacity_kwp*lost*(365.0::DOUBLE/n_days),0) AS energy_lost_kwh, round(capacity_kwp*lost*(365.0::DOUBLE/n_days)*0.18::DOUBLE,0) AS value_lost_sar,
      round(events*(greatest(capacity_kwp/1000,0.001::DOUBLE)*1800)*(365.0::DOUBLE/n_days),0) AS cleaning_cost_sar,
      round(events*(2500*capacity_kwp/1000)*(365.0::DOUBLE/n_days),0) AS water_litres,
      round(capacity_kwp*lost*(365.0::DOUBLE/n_days)*0.18::DOUBLE+events*(greatest(capacity_kwp/1000,0.001::DOUBLE)*1800)*(365.0::DOUBLE/n_days),0) AS net_cost_sar
    FROM sites JOIN walk USING (site_id) WHERE i = n_days-1),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY net_cost_sar, ord) AS rn FROM costs WHERE kind <> 'never') WHERE rn=1),
  bestfix AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY net_cost_sar, ord) AS rn FROM costs WHERE kind = 'interval') WHERE rn=1)"""


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return PL.policy_costs(X.rollup(spark, d), X.sites(spark, d))


@query("f4_policy_candidates", "F4 J15 J16 X12", sql(
    "rollup sites clim candidates", """SELECT site_id, ord, kind, CAST(interval_days AS DOUBLE) AS interval_days, threshold_pct, events, mean_loss_pct, energy_lost_kwh,
      value_lost_sar, cleaning_cost_sar, water_litres, net_cost_sar FROM costs""", _POLICIES, recursive=True))
def policy_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _costs(spark, d).select(
        "site_id", "ord", "kind", F.col("interval_days").cast("double").alias("interval_days"), "threshold_pct", "events", "mean_loss_pct", "energy_lost_kwh",
        "value_lost_sar", "cleaning_cost_sar", "water_litres", "net_cost_sar")


@query("a16_best_policy", "A16", sql(
    "rollup sites clim candidates", """SELECT b.site_id, b.ord AS best_ord, b.kind AS best_kind, b.threshold_pct AS best_threshold_pct,
      b.net_cost_sar AS best_net_sar, f.interval_days AS best_interval_days, f.net_cost_sar AS fixed_net_sar,
      b.net_cost_sar < f.net_cost_sar-1 AS beats_calendar, round(f.net_cost_sar-b.net_cost_sar,0) AS saving_sar
    FROM best b JOIN bestfix f USING (site_id)""", _POLICIES, recursive=True))
def best_policy(spark: SparkSession, d: str) -> DataFrame:
    return PL.best_policy(_costs(spark, d)).select(
        "site_id", F.col("best.ord").alias("best_ord"), F.col("best.kind").alias("best_kind"),
        F.col("best.threshold_pct").alias("best_threshold_pct"), F.col("best.net_cost_sar").alias("best_net_sar"),
        F.col("fixed.interval_days").alias("best_interval_days"), F.col("fixed.net_cost_sar").alias("fixed_net_sar"),
        "beats_calendar", F.col("saving_vs_best_calendar_sar").alias("saving_sar"))


@query("a17_annual_habits", "A17", sql(
    "rollup sites clim candidates", """SELECT b.site_id, d7.net_cost_sar AS weekly_net_sar, d14.net_cost_sar AS d14_net_sar, d30.net_cost_sar AS d30_net_sar,
      d10.net_cost_sar AS today_net_sar, b.net_cost_sar AS adaptive_net_sar, n.net_cost_sar AS never_net_sar,
      d7.mean_loss_pct AS weekly_loss_pct, b.mean_loss_pct AS adaptive_loss_pct,
      round(100*(1-b.energy_lost_kwh/greatest(d10.energy_lost_kwh,1)),2) AS energy_kept_pct,
      round(d10.net_cost_sar-b.net_cost_sar,0) AS sar_saved_year, d10.events-b.events AS events_saved,
      round(greatest(0,d10.water_litres-b.water_litres),0) AS water_saved_litres,
      b.net_cost_sar < f.net_cost_sar-1 AS beats_calendar, round(f.net_cost_sar-b.net_cost_sar,0) AS saving_vs_best_calendar_sar,
      b.threshold_pct AS tuned_trigger
    FROM best b JOIN bestfix f USING (site_id) JOIN costs d7 ON d7.site_id=b.site_id AND d7.interval_days=7
      JOIN costs d14 ON d14.site_id=b.site_id AND d14.interval_days=14 JOIN costs d30 ON d30.site_id=b.site_id AND d30.interval_days=30
      JOIN costs d10 ON d10.site_id=b.site_id AND d10.interval_days=10 JOIN costs n ON n.site_id=b.site_id AND n.kind='never'""",
    _POLICIES, recursive=True))
def annual_habits(spark: SparkSession, d: str) -> DataFrame:
    return PL.annual_habits(_costs(spark, d))


# ---- schedules over observed days
_SCHEDULE = f"""days AS (SELECT r.site_id, r.date, capacity_kwp, lmax, tau, coalesce(tuned, 6.0::DOUBLE) AS th,
      row_number() OVER (PARTITION BY r.site_id ORDER BY date)-1 AS i, {sql_dust_factor()} AS f, coalesce(precip_mm,0) AS precip_mm,
      {SQL_WEATHER_RISK} AS risk, {SQL_PR} AS pr, {SQL_IRR} AS irr
      FROM rollup r JOIN sites s ON s.site_id=r.site_id JOIN clim USING (climate)
      JOIN (SELECT site_id AS bid, threshold_pct AS tuned FROM best) b ON b.bid=r.site_id),
  fold AS (
    SELECT d.site_id, a.schedule, -1::BIGINT AS i, 0.0::DOUBLE AS exposure, false AS severe, 0.0::DOUBLE AS loss, false AS act
      FROM (SELECT DISTINCT site_id FROM days) d, (SELECT unnest(['fixed','adaptive']) AS schedule) a
    UNION ALL
    SELECT site_id, schedule, i, CASE WHEN act THEN 0 ELSE e END, risk+{sql_loss_risk('loss')} >= 5, loss, act FROM (
      SELECT *, CASE WHEN schedule='fixed' THEN (i+1) % 10 = 0 ELSE loss >= th OR (severe AND loss >= th*0.6::DOUBLE) END AS act FROM (
        SELECT *, {sql_loss('e')} AS loss FROM (
          SELECT w.site_id, w.schedule, d.i, CASE WHEN d.precip_mm >= 5 THEN least(400, w.exposure+d.f)*0.15::DOUBLE ELSE least(400, w.exposure+d.f) END AS e,
            w.severe, d.risk, d.lmax, d.tau, d.th FROM fold w JOIN days d ON d.site_id=w.site_id AND d.i=w.i+1)))),
  projected AS (SELECT d.*, w.schedule, w.loss AS loss_pct, w.exposure, w.act AS cleaned, capacity_kwp*irr*pr AS clean_kwh,
      capacity_kwp*irr*pr*w.loss/100 AS lost_kwh, capacity_kwp*irr*pr*w.loss/100*0.18::DOUBLE AS lost_sar,
      {sql_risk_label('(d.risk+' + sql_loss_risk('w.loss') + ')')} AS dust_risk
    FROM fold w JOIN days d ON d.site_id=w.site_id AND d.i=w.i),
  totals AS (SELECT site_id, schedule, max(capacity_kwp) AS capacity_kwp, sum(clean_kwh-lost_kwh) AS energy_kwh, sum(clean_kwh) AS clean_kwh,
      sum(lost_kwh) AS lost_kwh, count(*) FILTER (cleaned) AS cleaning_events, avg(loss_pct) AS mean_loss_pct, max(loss_pct) AS max_loss_pct,
      sum(lost_kwh)*0.18::DOUBLE AS lost_sar, count(*) FILTER (cleaned)*max(capacity_kwp)/1000*1800 AS cleaning_cost_sar,
      count(*) FILTER (cleaned)*2500*max(capacity_kwp)/1000 AS water_litres FROM projected GROUP BY 1, 2),
  verdicts AS (SELECT *, capacity_kwp/1000*1800 AS cost FROM (SELECT site_id, sum(round(lost_sar,2)) AS risk_sar, count(*) AS n, max(capacity_kwp) AS capacity_kwp,
      max(CASE WHEN i=0 THEN loss_pct END) AS loss0, max(CASE WHEN i=0 THEN f END) AS f0, max(CASE WHEN i=0 THEN dust_risk END) AS risk0
    FROM projected WHERE schedule='fixed' AND i < 7 GROUP BY 1))"""
SCHEDULE_SQL = _POLICIES + ",\n" + _SCHEDULE


def plants(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    tuned = PL.best_policy(PL.policy_costs(X.rollup(spark, d), s)).select("site_id", "tuned_threshold_pct")
    return s.join(tuned, "site_id")


def projected(spark: SparkSession, d: str) -> DataFrame:
    return SC.project(X.rollup(spark, d), plants(spark, d))


@query("f3_schedule_projection", "F3 W20 X8", sql(
    "rollup sites clim candidates", """SELECT site_id, schedule, date, round(loss_pct,4) AS loss_pct, round(exposure,2) AS exposure, cleaned,
      dust_risk, round(lost_sar,2) AS lost_sar, round(-9*ln(greatest(1e-6,1-least(greatest(loss_pct,0),99)/100)),4) AS dust_mass_g_m2
    FROM projected""", SCHEDULE_SQL, recursive=True))
def schedule_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(projected(spark, d).select(
        "site_id", "schedule", "date", "loss_pct", "exposure", "cleaned", "dust_risk", "lost_sar", "dust_mass_g_m2"),
        4, lost_sar=2, exposure=2)


@query("a13_schedule_totals", "A13", sql(
    "rollup sites clim candidates", """SELECT site_id, schedule, round(energy_kwh,2) AS energy_kwh, round(clean_kwh,2) AS clean_kwh, round(lost_kwh,2) AS lost_kwh,
      cleaning_events, round(mean_loss_pct,4) AS mean_loss_pct, round(max_loss_pct,4) AS max_loss_pct, round(lost_sar,2) AS lost_sar,
      round(cleaning_cost_sar,2) AS cleaning_cost_sar, round(water_litres,0) AS water_litres,
      round(energy_kwh*0.18::DOUBLE-cleaning_cost_sar,2) AS net_sar FROM totals""", SCHEDULE_SQL, recursive=True))
def schedule_totals(spark: SparkSession, d: str) -> DataFrame:
    t = SC.schedule_totals(projected(spark, d)).drop("capacity_kwp", "cost_per_mwp")
    return rounded(t, 2, mean_loss_pct=4, max_loss_pct=4, water_litres=0)


@query("a14_verdict", "A14 T3", sql(
    "rollup sites clim candidates", """SELECT site_id, CASE WHEN risk_sar > cost*0.9::DOUBLE THEN 'clean_now' ELSE 'wait' END AS decision,
      round(loss0,4) AS current_loss_pct, risk0 AS risk_today, round(least(100,greatest(0,3*round(loss0,2)/greatest(round(f0,2),0.3::DOUBLE))),4) AS urgency,
      round(risk_sar,4) AS risk_sar, round(cost,4) AS cleaning_cost_sar, round(cost/greatest(risk_sar/n,0.01::DOUBLE),4) AS payback_days
    FROM verdicts""", SCHEDULE_SQL, recursive=True))
def verdict(spark: SparkSession, d: str) -> DataFrame:
    return rounded(SC.verdict(projected(spark, d)))


@query("a15_adaptive_delta", "A15", sql(
    "rollup sites clim candidates", """SELECT f.site_id, round(100*(a.energy_kwh/f.energy_kwh-1),4) AS energy_pct, round(f.lost_sar,4) AS lost_sar_fixed,
      round(a.lost_sar,4) AS lost_sar_adaptive, round(f.lost_sar-a.lost_sar,4) AS saved_sar, f.cleaning_events AS events_fixed,
      a.cleaning_events AS events_adaptive, round(greatest(0,f.cleaning_events-a.cleaning_events)*2500*f.capacity_kwp/1000,4) AS water_saved_litres
    FROM totals f JOIN totals a ON a.site_id=f.site_id AND a.schedule='adaptive' WHERE f.schedule='fixed'""", SCHEDULE_SQL, recursive=True))
def adaptive_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(SC.adaptive_delta(SC.schedule_totals(projected(spark, d))))


# ---- mass balance
def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return MB.prepare(X.daily(spark, d, with_nulls=True).withColumn("wind_kmh", F.col("wind_max_ms") * 3.6))


def _factors(spark: SparkSession, d: str) -> DataFrame:
    return MB.site_factor(X.sites(spark, d))


def balance_sql(interval: int) -> str:
    return f"""base AS (SELECT site_id, date, row_number() OVER (PARTITION BY site_id ORDER BY date)-1 AS i,
      coalesce(pm10_mean, median(pm10_mean) OVER (PARTITION BY site_id)) AS pm, wind_max_ms*3.6::DOUBLE AS wk, rh_mean_pct AS rh,
      coalesce(precip_mm,0) AS rain FROM daily_n),
  terms AS (SELECT *, 0.08::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*exp(-0.5::DOUBLE*(ln(greatest(wk,0.5::DOUBLE)/3.6::DOUBLE/5.5::DOUBLE)/0.85::DOUBLE)*(ln(greatest(wk,0.5::DOUBLE)/3.6::DOUBLE/5.5::DOUBLE)/0.85::DOUBLE)))
        *pow(greatest(pm,5)/100, 1.15::DOUBLE) AS flux,
      (CASE WHEN rain >= 5 THEN 0 WHEN rain >= 0.5::DOUBLE THEN exp(-0.35::DOUBLE*rain) ELSE 1 END)
       *(CASE WHEN wk > 45 THEN greatest(0, 1-0.011::DOUBLE*(wk-45)) ELSE 1 END) AS kept,
      1+0.35::DOUBLE*greatest(rh-40,0)/60 AS cement FROM base),
  fold AS (
    SELECT site_id, -1::BIGINT AS i, 0.0::DOUBLE AS m FROM (SELECT DISTINCT site_id FROM terms)
    UNION ALL
    SELECT t.site_id, t.i, (f.m*t.kept+t.flux)*(CASE WHEN t.i % {interval + 1} = 0 THEN 1-0.95::DOUBLE ELSE 1 END)
      FROM fold f JOIN terms t ON t.site_id=f.site_id AND t.i=f.i+1),
  unit AS (SELECT t.*, f.m FROM terms t JOIN fold f ON f.site_id=t.site_id AND f.i=t.i),
  factors AS (SELECT site_id, CASE region WHEN 'west' THEN 0.55::DOUBLE WHEN 'east' THEN 1.10::DOUBLE WHEN 'central' THEN 0.60::DOUBLE WHEN 'north' THEN 0.55::DOUBLE
      WHEN 'northwest' THEN 0.45::DOUBLE WHEN 'southwest_highland' THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END AS site_factor,
      CASE region WHEN 'west' THEN 15.0::DOUBLE WHEN 'east' THEN 45.0::DOUBLE WHEN 'central' THEN 28.0::DOUBLE WHEN 'north' THEN 24.0::DOUBLE
      WHEN 'northwest' THEN 23.0::DOUBLE WHEN 'southwest_highland' THEN 14.0::DOUBLE ELSE 25.0::DOUBLE END AS target, region FROM sites),
  lossy AS (SELECT u.site_id, date, flux*site_factor AS deposition, m*site_factor AS mass,
      100*(1-exp(-0.81::DOUBLE*m*site_factor*cement)) AS soiling_loss_pct FROM unit u JOIN factors USING (site_id))"""


@query("f1_mass_balance", "F1 X16 J5", sql(
    "daily_n sites", """SELECT site_id, date, round(deposition,6) AS deposition, round(mass,6) AS mass,
      round(soiling_loss_pct,4) AS soiling_loss_pct FROM lossy""", balance_sql(7), recursive=True))
def mass_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(MB.mass_balance(_prepared(spark, d), _factors(spark, d)), 6, soiling_loss_pct=4)


@query("f2_day_counters", "F2", sql("daily_n", """SELECT site_id, date, CASE WHEN (rn-1) % 8 = 0 THEN 1 ELSE 0 END AS cleaned, least((rn-1) % 8, 999) AS days_since_clean,
      least(coalesce(rn-max(CASE WHEN coalesce(precip_mm,0) >= 0.5::DOUBLE THEN rn END) OVER (PARTITION BY site_id ORDER BY date ROWS UNBOUNDED PRECEDING), 999), 999) AS days_since_rain,
      CASE WHEN coalesce(precip_mm,0) >= 0.5::DOUBLE THEN 1 ELSE 0 END AS wet
    FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn FROM daily_n)"""))
def day_counters(spark: SparkSession, d: str) -> DataFrame:
    return MB.counters(_prepared(spark, d)).select(
        "site_id", "date", "cleaned", F.col("days_since_clean").cast("long").alias("days_since_clean"),
        F.col("days_since_rain").cast("long").alias("days_since_rain"), "wet")


_GRID = """, p1 AS (SELECT site_id, region, target, f, mean_loss FROM (SELECT site_id, region, target, f, avg(100*(1-exp(-f*k))) AS mean_loss
      FROM ks, (SELECT 0.005::DOUBLE*pow(pow(8000::DOUBLE,1/24::DOUBLE), unnest(range(25))) AS f) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY abs(mean_loss-target), f) = 1),
  p2 AS (SELECT site_id, region, target, f, r2, mean_loss FROM (SELECT ks.site_id, ks.region, ks.target, lo*pow(r2, j) AS f, r2, avg(100*(1-exp(-lo*pow(r2, j)*k))) AS mean_loss
      FROM ks JOIN (SELECT site_id, f/pow(8000::DOUBLE,1/24::DOUBLE) AS lo, pow(pow(8000::DOUBLE,2/24::DOUBLE), 1/24::DOUBLE) AS r2 FROM p1) USING (site_id), (SELECT unnest(range(25)) AS j) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY abs(mean_loss-target), f) = 1),
  p3 AS (SELECT site_id, region, target, f, mean_loss FROM (SELECT ks.site_id, ks.region, ks.target, lo*pow(r3, j) AS f, avg(100*(1-exp(-lo*pow(r3, j)*k))) AS mean_loss
      FROM ks JOIN (SELECT site_id, f/r2 AS lo, pow(r2*r2, 1/24::DOUBLE) AS r3 FROM p2) USING (site_id), (SELECT unnest(range(25)) AS j) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY abs(mean_loss-target), f) = 1)"""
_KS = """, ks AS (SELECT u.site_id, region, target, 0.81::DOUBLE*m*cement AS k FROM unit u JOIN factors USING (site_id))"""
_CALIBRATED = balance_sql(7) + _KS + _GRID


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    return MB.calibrate(_prepared(spark, d), X.sites(spark, d))


@query("f5_site_factor_calibration", "F5", sql(
    "daily_n sites", "SELECT site_id, region, target AS target_loss_pct, round(f,6) AS site_factor, round(mean_loss,4) AS achieved_loss_pct FROM p3",
    _CALIBRATED, recursive=True))
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_calibrated(spark, d), 4, site_factor=6)


@query("f6_no_clean_steady_state", "F6", sql(
    "daily_n sites", """SELECT site_id, round(avg(soiling_loss_pct),4) AS no_clean_loss_pct FROM
      (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS back FROM lossy) WHERE back <= 365 GROUP BY 1""",
    balance_sql(3650), recursive=True))
def steady_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(MB.steady_state(_prepared(spark, d), _factors(spark, d)))


@query("q10_calibration_table", "Q10 A18 A19", sql(
    "daily_n sites", """, ly AS (SELECT site_id, avg(soiling_loss_pct) AS last_year FROM lossy l WHERE year(date) = (SELECT max(year(date)) FROM lossy m WHERE m.site_id=l.site_id) GROUP BY 1)
    SELECT round(avg(CASE WHEN region='west' THEN mean_loss END),4) AS west_mean_pct, round(avg(CASE WHEN region='east' THEN mean_loss END),4) AS east_mean_pct,
      round(avg(mean_loss),4) AS all_mean_pct, round(avg(CASE WHEN region<>'east' THEN mean_loss END),4) AS non_east_mean_pct,
      round(avg(CASE WHEN region='west' THEN last_year END),4) AS west_last_year_pct, round(avg(CASE WHEN region='east' THEN last_year END),4) AS east_last_year_pct FROM p3 LEFT JOIN ly USING (site_id)""",
    _CALIBRATED, recursive=True))
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    """Means of the calibrated loss by coast and region group, and of the last calendar year of each site."""
    yearly = MB.last_year_mean(MB.mass_balance(_prepared(spark, d), _factors(spark, d)), "soiling_loss_pct")
    return rounded(MB.calibration_table(_calibrated(spark, d), yearly))


@query("a19_last_year_mean", "A19", sql(
    "daily_n sites", """SELECT site_id, year(date) AS year, round(avg(soiling_loss_pct),4) AS mean_value FROM lossy l
      WHERE year(date) = (SELECT max(year(date)) FROM lossy m WHERE m.site_id=l.site_id) GROUP BY 1, 2""", balance_sql(7), recursive=True))
def last_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(MB.last_year_mean(MB.mass_balance(_prepared(spark, d), _factors(spark, d)), "soiling_loss_pct")) \
        .withColumn("year", F.col("year").cast("long"))
