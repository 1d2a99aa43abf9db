"""User-level reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.operators import daily as D
from dustspark.operators import features as FE
from dustspark.operators import schedule as SC
from dustspark.plans import reports as RP
from dustspark.plans.catalog.base import SQL_FEATURES, SQL_WEATHER_RISK, query, rounded, settled, sql, sql_dust_factor, sql_risk_label
from dustspark.plans.catalog.folds import SCHEDULE_SQL
from dustspark.sources import fixtures as X

def _report_sql(cost: float, interval: int, capacity: float | None, horizon: int = 14) -> str:
    head = f"(SELECT * FROM rollup QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY date) <= {horizon})"
    text = SCHEDULE_SQL.replace("FROM rollup r JOIN", f"FROM {head} r JOIN").replace("(i+1) % 10 = 0", f"(i+1) % {interval} = 0")
    text = text.replace("*1800", f"*{cost}::DOUBLE")
    if capacity is not None:
        text = text.replace("FROM sites JOIN walk", f"FROM (SELECT * REPLACE ({capacity}::DOUBLE AS capacity_kwp) FROM sites) JOIN walk")
        text = text.replace("JOIN sites s ON", f"JOIN (SELECT * REPLACE ({capacity}::DOUBLE AS capacity_kwp) FROM sites) s ON")
    return text


_REPORT_BODY = """SELECT v.site_id, s.name, s.climate, CASE WHEN risk_sar > cost*0.9::DOUBLE THEN 'clean_now' ELSE 'wait' END AS decision, round(loss0,4) AS current_loss_pct, risk0 AS risk_today,
      round(risk_sar,4) AS risk_sar, round(cost,4) AS cleaning_cost_sar, round(f.energy_kwh,2) AS energy_kwh, round(f.mean_loss_pct,4) AS mean_loss_pct, f.cleaning_events, round(f.energy_kwh*0.18::DOUBLE-f.cleaning_cost_sar,2) AS net_sar,
      round(f.lost_sar-a.lost_sar,2) AS saved_sar, a.cleaning_events AS events_adaptive, round(d10.net_cost_sar-b.net_cost_sar,0) AS sar_saved_year, b.threshold_pct AS tuned_trigger
    FROM verdicts v JOIN sites s USING (site_id) JOIN totals f ON f.site_id=v.site_id AND f.schedule='fixed' JOIN totals a ON a.site_id=v.site_id AND a.schedule='adaptive'
      JOIN best b ON b.site_id=v.site_id JOIN costs d10 ON d10.site_id=v.site_id AND d10.interval_days=10"""
_REPORT_COLS = ("site_id", "name", "climate", "decision", "current_loss_pct", "risk_today", "risk_sar", "cleaning_cost_sar", "energy_kwh",
                "mean_loss_pct", "cleaning_events", "net_sar", "saved_sar", "events_adaptive", "sar_saved_year", "tuned_trigger")


def _shape(report: DataFrame) -> DataFrame:
    return rounded(report.select(*_REPORT_COLS), 4, energy_kwh=2, net_sar=2, saved_sar=2)


@query("q1_site_report", "Q1", sql("rollup sites clim candidates", _REPORT_BODY, _report_sql(1800.0, 10, None), recursive=True))
def site_report(spark: SparkSession, d: str) -> DataFrame:
    return _shape(RP.site_report(X.rollup(spark, d), X.sites(spark, d)))


@query("q9_what_if", "Q9", sql("rollup sites clim candidates", _REPORT_BODY, _report_sql(600.0, 5, 20000.0), recursive=True))
def what_if(spark: SparkSession, d: str) -> DataFrame:
    return _shape(RP.site_report(X.rollup(spark, d), X.sites(spark, d), interval_days=5, cost_per_mwp=600.0, capacity_kwp=20000.0))


@query("q2_dust_outlook", "Q2 A25 X6 X13", sql("rollup sites clim", f"""SELECT r.site_id, name, climate, date, round(pm10_ugm3,6) AS pm10_ugm3, {sql_risk_label(SQL_WEATHER_RISK)} AS risk, round({sql_dust_factor()}+1e-9,2) AS dust_factor
    FROM rollup r JOIN sites s ON s.site_id=r.site_id JOIN clim USING (climate)"""))
def dust_outlook(spark: SparkSession, d: str) -> DataFrame:
    out = SC.dust_outlook(X.rollup(spark, d), X.sites(spark, d))
    return out.select("site_id", "name", "climate", "date", F.round("pm10_ugm3", 6).alias("pm10_ugm3"), "risk",
                      settled(F.col("dust_factor"), 2).alias("dust_factor"))


@query("a25_dust_events", "A25", sql("rollup", f"SELECT site_id, count(*) AS days, count(*) FILTER (risk IN ('high','severe')) AS dust_events FROM (SELECT site_id, {sql_risk_label(SQL_WEATHER_RISK)} AS risk FROM rollup) GROUP BY 1"))
def dust_events(spark: SparkSession, d: str) -> DataFrame:
    return SC.dust_events(SC.dust_outlook(X.rollup(spark, d), X.sites(spark, d)))


@query("q3_site_comparison", "Q3 J14", sql("rollup sites clim candidates", """, rep AS (SELECT v.site_id, s.climate, literature_pct, loss0, f.mean_loss_pct, CASE WHEN risk_sar > cost*0.9::DOUBLE THEN 'clean_now' ELSE 'wait' END AS decision, risk_sar
      FROM verdicts v JOIN totals f ON f.site_id=v.site_id AND f.schedule='fixed' JOIN sites s ON s.site_id=v.site_id JOIN clim USING (climate))
    SELECT a.site_id AS site_a, b.site_id AS site_b, a.climate AS climate_a, b.climate AS climate_b, round(a.loss0,4) AS loss_a, round(b.loss0,4) AS loss_b, round(a.mean_loss_pct,4) AS mean_a, round(b.mean_loss_pct,4) AS mean_b, a.decision AS decision_a, b.decision AS decision_b,
      round(a.risk_sar,4) AS risk_a, round(b.risk_sar,4) AS risk_b, a.literature_pct AS literature_a, b.literature_pct AS literature_b FROM rep a JOIN rep b ON b.site_id = a.site_id+1""", _report_sql(1800.0, 7, 1000.0, 10), recursive=True))
def site_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring sites side by side, each as a plant of 1000 kWp cleaned weekly, over ten days, with its climate's published yearly loss."""
    sites = X.sites(spark, d)
    report = RP.site_report(X.rollup(spark, d), sites, horizon=10, interval_days=7, capacity_kwp=1000.0)
    published = spark.createDataFrame([(name, float(pct)) for name, _, _, _, pct, *_ in C.CLIMATES], "climate string, literature_pct double")
    report = report.join(F.broadcast(published), "climate").select("site_id", "climate", "current_loss_pct", "mean_loss_pct", "decision", "risk_sar", "literature_pct")
    pairs = sites.select(F.col("site_id").alias("site_a"), (F.col("site_id") + 1).alias("site_b"))
    both = RP.compare_pairs(pairs, report)
    names = {"climate": "climate", "loss": "current_loss_pct", "mean": "mean_loss_pct", "decision": "decision", "risk": "risk_sar", "literature": "literature_pct"}
    return rounded(both.select("site_a", "site_b", *[F.col(f"{s}.{c}").alias(f"{n}_{s}") for n, c in names.items() for s in ("a", "b")]))


_BAD = ", ".join(f"count(*) FILTER ({c} IS NULL OR NOT isfinite({c})) AS {c}__bad, count(*) FILTER ({c} <> 0) > 0 AS {c}__set" for c in C.FEATURES)
_PARITY = f""", served AS (SELECT *, 98*(1-exp(-greatest(1,days_since_rain)*greatest(0,rate)/30))/100 AS dust_factor_today FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY site_id) AS history_days FROM featured) WHERE back = 4 AND history_days >= 45),
    t AS (SELECT {_BAD} FROM (SELECT {SQL_FEATURES} FROM samples)), s AS (SELECT {_BAD} FROM (SELECT {SQL_FEATURES} FROM served))
    """ + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, true AS in_both, t.{c}__bad AS training_bad, s.{c}__bad AS serving_bad, t.{c}__set AS training_nonzero, s.{c}__set AS serving_nonzero FROM t, s" for c in C.FEATURES)


@query("q11_feature_parity", "Q11", sql("samples", _PARITY))
def feature_parity(spark: SparkSession, d: str) -> DataFrame:
    days = X.daily(spark, d)
    training = FE.make_samples(days, X.VAL_START)
    serving = D.as_of_row(FE.build_features(FE.with_threshold(days, X.VAL_START)))
    return RP.feature_parity(training, serving)
