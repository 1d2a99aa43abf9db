"""Window features, labels, samples, carry-forward, chat windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions import physics as P
from dustspark.operators import conversation as CV
from dustspark.operators import daily as D
from dustspark.operators import features as FE
from dustspark.operators import mass_balance as MB
from dustspark.operators import schedule as SC
from dustspark.operators import windows as W
from dustspark.plans import reports as RP
from dustspark.plans.catalog.base import pick, query, rounded, settled, sql, sql_dust_factor
from dustspark.plans.catalog.folds import balance_sql
from dustspark.session import written
from dustspark.sources import fixtures as X

_ROLL = ["pm10_max_3d", "pm10_max_7d", "pm10_max_30d", "dust_mean_7d", "dust_mean_30d", "gust_max_7d", "gust_max_30d",
         "precip_7d", "precip_30d", "pm10_max_lag1", "pm10_max_lag2", "pm10_max_lag3", "dust_mean_lag1", "aod_mean_7d",
         "days_since_rain", "days_since_storm", "doy_sin", "doy_cos"]


def _features(spark: SparkSession, d: str, nulls: bool = False) -> DataFrame:
    return FE.build_features(FE.with_threshold(X.daily(spark, d, nulls), X.VAL_START))


@query("w1_rolling_features", "W1 W2 W3 W4 W6 X1", sql("featured", f"SELECT site_id, date, {', '.join(f'round({c},6) AS {c}' for c in _ROLL)} FROM featured"))
def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    return pick(_features(spark, d), "site_id", "date", *_ROLL, digits=6)


@query("w2_rolling_with_gaps", "W1 W2 W4", sql("daily_n", """SELECT site_id, date, round(coalesce(max(pm10_max) OVER (w ROWS 2 PRECEDING),0),6) AS pm10_max_3d, round(coalesce(max(pm10_max) OVER (w ROWS 29 PRECEDING),0),6) AS pm10_max_30d,
      round(coalesce(avg(pm10_mean) OVER (w ROWS 6 PRECEDING),0),6) AS pm10_mean_7d, round(coalesce(lag(pm10_max,2) OVER w,0),6) AS pm10_max_lag2 FROM daily_n WINDOW w AS (PARTITION BY site_id ORDER BY date)"""))
def rolling_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_site()
    return pick(X.daily(spark, d, True), "site_id", "date", W.rolling(F.col("pm10_max"), 3, "max", w).alias("pm10_max_3d"),
                W.rolling(F.col("pm10_max"), 30, "max", w).alias("pm10_max_30d"), W.rolling(F.col("pm10_mean"), 7, "mean", w).alias("pm10_mean_7d"),
                W.lagged(F.col("pm10_max"), 2, w).alias("pm10_max_lag2"), digits=6)


@query("w11_segmented_mass", "W11 X2 X3 X15", sql("labelled", "SELECT site_id, date, round(rate,8) AS rate, round(mass,6) AS mass, round(soiling,6) AS soiling, storm, round(yield_kwh,6) AS yield_kwh FROM labelled"))
def segmented_mass(spark: SparkSession, d: str) -> DataFrame:
    out = FE.add_labels(_features(spark, d))
    return rounded(out.select("site_id", "date", F.col("deposit_rate").alias("rate"), "mass", "soiling", "storm", "yield_kwh"), 6, rate=8)


_SAMPLE = ["dust_factor_today", "days_since_rain", "pm10_max_30d", "precip_30d", "storm_t1", "storm_t2", "storm_t3", "yield_t1", "ghi_t1",
           "soiling_t1", "pm10_t1"]
_INTS = ("storm_t1", "storm_t2", "storm_t3")


@query("w5_training_samples", "W5 W14 J13 X4 X5", sql("samples", "SELECT site_id, date, " + ", ".join(
    c if c in _INTS else f"round({c},6) AS {c}" for c in _SAMPLE) + ", round(threshold,6) AS thr, storm AS storm_today FROM samples"))
def samples(spark: SparkSession, d: str) -> DataFrame:
    return pick(FE.make_samples(X.daily(spark, d), X.VAL_START), "site_id", "date", *_SAMPLE, "thr", "storm_today", digits=6)


@query("w14_trimmed_rows", "W14", sql("daily", "SELECT site_id, date FROM (SELECT site_id, date, row_number() OVER (PARTITION BY site_id ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY site_id) AS n FROM daily) WHERE i >= 45 AND i < n-3"))
def trimmed(spark: SparkSession, d: str) -> DataFrame:
    return W.trim_ends(X.daily(spark, d).select("site_id", "date"))


@query("w7_strict_rolling", "W7 W8 W9", sql("daily_n", """, k AS (SELECT *, CASE WHEN site_id % 2 = 0 THEN dust_mean WHEN dayofyear(date) = 200 THEN NULL ELSE dust_mean END AS v, wind_max_ms*3.6::DOUBLE AS wk FROM daily_n)
    SELECT site_id, date, CASE WHEN bad = 0 THEN round(m7,9) END AS v_7d_mean, CASE WHEN bad = 0 THEN round(s30,9) END AS v_30d_sum, round(x7,9) AS wind_7d_max, CASE WHEN bad = 0 THEN round(em,9) END AS v_expmean FROM (
      SELECT *, avg(v) OVER (w ROWS 6 PRECEDING) AS m7, sum(v) OVER (w ROWS 29 PRECEDING) AS s30, max(wk) OVER (w ROWS 6 PRECEDING) AS x7, avg(v) OVER (w ROWS UNBOUNDED PRECEDING) AS em,
        sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS bad FROM k WINDOW w AS (PARTITION BY site_id ORDER BY date))"""))
def strict_rolling(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_site()
    gap = (F.col("site_id") % 2 != 0) & (F.dayofyear("date") == 200)
    n = X.daily(spark, d, True).withColumns({"v": F.when(~gap, F.col("dust_mean")), "wk": F.col("wind_max_ms") * 3.6})
    return pick(n, "site_id", "date", W.rolling_strict(F.col("v"), 7, "mean", w).alias("v_7d_mean"), W.rolling_strict(F.col("v"), 30, "sum", w).alias("v_30d_sum"),
                W.rolling_strict(F.col("wk"), 7, "max", w).alias("wind_7d_max"),
                W.expanding_mean_strict(F.col("v"), w).alias("v_expmean"), digits=9)


@query("w10_carry_forward", "W10", sql("hourly", """SELECT site_id, strftime(ts, '%Y-%m-%d %H') AS hour, round(last_value(pm10 IGNORE NULLS) OVER w,6) AS pm10, round(last_value(aod IGNORE NULLS) OVER w,6) AS aod, round(dust_ugm3,6) AS dust_ugm3 FROM hourly
    WINDOW w AS (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"""))
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    out = W.carry_forward(X.hourly(spark, d), ["pm10", "aod"])
    return pick(out, "site_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "pm10", "aod", "dust_ugm3", digits=6)


@query("w12_mean_dust_factor", "W12 X6", sql("rollup sites clim", f"""SELECT site_id, date, round(f+1e-9,4) AS dust_factor, round(avg(f) OVER (PARTITION BY site_id ORDER BY date ROWS 6 PRECEDING)+1e-9,4) AS mean_factor FROM (
      SELECT r.site_id, date, {sql_dust_factor()} AS f FROM rollup r JOIN sites s ON s.site_id=r.site_id JOIN clim USING (climate))"""))
def mean_dust_factor(spark: SparkSession, d: str) -> DataFrame:
    out = SC.mean_factor(SC.dust_outlook(X.rollup(spark, d), X.sites(spark, d)))
    return out.select("site_id", "date", settled(F.col("dust_factor"), 4).alias("dust_factor"), settled(F.col("mean_factor"), 4).alias("mean_factor"))


@query("w17_recent_turns", "W17", """SELECT conv_id, turn, role, left(text, 4000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    WHERE back <= 6 AND role IN ('user','assistant') AND length(text) > 0""")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return CV.recent_turns(X.chat(spark, d))


@query("w18_first_calls", "W18", "SELECT event_type AS name, props AS args, min(event_id) AS call_id, count(*)-1 AS reused FROM events GROUP BY 1, 2")
def first_calls(spark: SparkSession, d: str) -> DataFrame:
    return CV.first_calls(X.calls(spark, d))


@query("m20_as_of_rows", "M20", sql("daily", """SELECT site_id, date, history_days, round(pm10_max,4) AS pm10_max FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY site_id) AS history_days FROM daily)
    WHERE back = 4 AND history_days >= 45"""))
def as_of_rows(spark: SparkSession, d: str) -> DataFrame:
    return pick(D.as_of_row(X.daily(spark, d)), "site_id", "date", "history_days", "pm10_max")


@query("t3_first_days", "T3", sql("rollup", "SELECT site_id, date, round(pm10_ugm3,4) AS pm10_ugm3 FROM rollup QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY date) <= 10"))
def first_days(spark: SparkSession, d: str) -> DataFrame:
    return pick(RP.head_days(X.rollup(spark, d), 10), "site_id", "date", "pm10_ugm3")


@query("t5_worst_horizon", "T5 X14", sql("samples", """, h AS (SELECT site_id, date, p1, p2, p3, greatest(p1,p2,p3) AS m FROM (SELECT site_id, date, pm10_max/(pm10_max+threshold) AS p1, pm10_max_lag1/(pm10_max_lag1+threshold) AS p2, pm10_max_lag2/(pm10_max_lag2+threshold) AS p3 FROM samples))
    SELECT site_id, date, round(m,6) AS max_p, CASE WHEN p1=m THEN 't1' WHEN p2=m THEN 't2' ELSE 't3' END AS horizon, CASE WHEN m >= 0.5::DOUBLE THEN 'storm likely' WHEN m >= 0.6::DOUBLE*0.4::DOUBLE THEN 'watch' ELSE 'quiet' END AS level FROM h"""))
def worst_horizon(spark: SparkSession, d: str) -> DataFrame:
    from dustspark.plans.models import worst_horizon as worst
    s = FE.make_samples(X.daily(spark, d), X.VAL_START)
    p = {f"t{i}": F.col(c) / (F.col(c) + F.col("thr")) for i, c in ((1, "pm10_today"), (2, "pm10_max_lag1"), (3, "pm10_max_lag2"))}
    return pick(worst(s.withColumns({f"p_{k}": v for k, v in p.items()}), F.lit(0.4)), "site_id", "date", "max_p", "horizon", "level", digits=6)


_TABLE = ["pm10_mean_ugm3", "pm10_max_ugm3", "dust_mean_ugm3", "aod_mean", "wind_max_kmh", "gust_max_kmh", "rh_mean_pct", "precip_mm", "deposition", "soiling_loss_pct"]
_AGG = {"mean": "avg", "sum": "sum", "max": "max"}
_TRAINING = """, counts AS (SELECT site_id, date, (rn-1) % 8 AS days_since_clean, least(coalesce(rn-max(CASE WHEN coalesce(precip_mm,0) >= 0.5::DOUBLE THEN rn END) OVER (PARTITION BY site_id ORDER BY date ROWS UNBOUNDED PRECEDING), 999), 999) AS days_since_rain
      FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn FROM daily)),
    days AS (SELECT d.site_id, d.date, pm10_mean AS pm10_mean_ugm3, pm10_max AS pm10_max_ugm3, dust_mean AS dust_mean_ugm3, aod_mean, wind_max_ms*3.6::DOUBLE AS wind_max_kmh,
      gust_max_ms*3.6::DOUBLE AS gust_max_kmh, rh_mean_pct, precip_mm, deposition, soiling_loss_pct, days_since_clean, days_since_rain
      FROM daily d JOIN lossy l ON l.site_id=d.site_id AND l.date=d.date JOIN counts c ON c.site_id=d.site_id AND c.date=d.date),
    tabled AS (SELECT *, sin(2*pi()*dayofyear(date)/365.25::DOUBLE) AS doy_sin, cos(2*pi()*dayofyear(date)/365.25::DOUBLE) AS doy_cos, """ + ", ".join(
    [f"{_AGG[how]}({c}) OVER (w ROWS {n - 1} PRECEDING) AS {c}_{n}d_{how}" for c, n, how in C.TRAINING_ROLLS]
    + [f"avg({c}) OVER (w ROWS UNBOUNDED PRECEDING) AS {c}_expmean" for c in C.TRAINING_EXPANDING]) + """,
      lead(soiling_loss_pct) OVER w AS target_loss, lead(deposition) OVER w AS target_deposition FROM days WINDOW w AS (PARTITION BY site_id ORDER BY date))
    SELECT site_id, date, days_since_clean, days_since_rain, """ + ", ".join(f"round({c}+1e-9,4) AS {c}" for c in [
    *_TABLE, "doy_sin", "doy_cos", *[f"{c}_{n}d_{how}" for c, n, how in C.TRAINING_ROLLS], *[f"{c}_expmean" for c in C.TRAINING_EXPANDING],
    "target_loss", "target_deposition"]) + " FROM tabled WHERE target_loss IS NOT NULL"


@query("m0_training_table", "W7 W8 W9 J13 P6", sql("daily sites", _TRAINING, balance_sql(7).replace("daily_n", "daily"), recursive=True))
def training_table(spark: SparkSession, d: str) -> DataFrame:
    n = written(X.daily(spark, d))  # features, balance and counters read the days, and the last two the prepared ones
    days = n.select("site_id", "date", F.col("pm10_mean").alias("pm10_mean_ugm3"), F.col("pm10_max").alias("pm10_max_ugm3"),
                    F.col("dust_mean").alias("dust_mean_ugm3"), "aod_mean", (F.col("wind_max_ms") * 3.6).alias("wind_max_kmh"),
                    (F.col("gust_max_ms") * 3.6).alias("gust_max_kmh"), "rh_mean_pct", "precip_mm")
    prepared = written(MB.prepare(n.withColumn("wind_kmh", F.col("wind_max_ms") * 3.6)))
    labels = MB.mass_balance(prepared, MB.site_factor(X.sites(spark, d))).drop("mass")
    counts = MB.counters(prepared).select("site_id", "date", *[F.col(c).cast("long").alias(c) for c in ("days_since_clean", "days_since_rain")])
    out = FE.training_table(days, labels.join(counts, ["site_id", "date"]))
    return out.select(*[settled(F.col(c), 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
