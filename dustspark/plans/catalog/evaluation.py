"""Splits, scores and thresholds on a deterministic pseudo-forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.operators import evaluation as EV
from dustspark.operators import features as FE
from dustspark.plans.catalog.base import SQL_FEATURES, query, rounded, sql
from dustspark.sources import fixtures as X

_PARTS = """, parts AS (SELECT *, CASE WHEN date < DATE '2000-01-01' THEN 'train' WHEN date < DATE '2001-01-01' THEN 'val' ELSE 'test' END AS split FROM scored) """


def scored(spark: SparkSession, d: str) -> DataFrame:
    s = FE.make_samples(X.daily(spark, d), X.VAL_START)
    return s.select("site_id", "date", F.col("storm_t1").alias("y"), (F.col("pm10_today") / (F.col("pm10_today") + F.col("thr"))).alias("p"),
                    "storm_today", "yield_t1", "soiling_t1", "ghi_mj_m2")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return EV.time_split(scored(spark, d), X.VAL_START, X.TEST_START)


@query("m1_time_split", "M1", sql("scored", _PARTS.lstrip() + "SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM parts GROUP BY 1"))
def time_split(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("m2_date_quantile_split", "M2", sql("daily", """, dd AS (SELECT list_sort(list(DISTINCT date)) AS l FROM daily)
    SELECT CASE WHEN date < l[CAST(floor(len(l)*0.8::DOUBLE) AS BIGINT)+1] THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(date) AS first_date FROM daily, dd GROUP BY 1"""))
def date_quantile(spark: SparkSession, d: str) -> DataFrame:
    return EV.date_quantile_split(X.daily(spark, d).select("site_id", "date")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


@query("m3_site_folds", "M3", sql("scored", """SELECT site_id, CAST(n_train AS BIGINT) AS n_train, n_test FROM (SELECT site_id, (SELECT count(*) FROM scored WHERE date < DATE '2000-01-01')-count(*) FILTER (date < DATE '2000-01-01') AS n_train,
      count(*) FILTER (date >= DATE '2000-01-01') AS n_test FROM scored GROUP BY 1) WHERE n_train >= 200 AND n_test >= 50"""))
def site_folds(spark: SparkSession, d: str) -> DataFrame:
    return EV.site_folds(scored(spark, d).select("site_id", "date"), X.VAL_START)


@query("m7_standardise", "M7", sql("samples", ", f AS (SELECT site_id, date, " + SQL_FEATURES + " FROM samples), st AS (SELECT " + ", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in C.FEATURES)
    + " FROM f WHERE date < DATE '2000-01-01')\n    SELECT site_id, date, "
    + ", ".join(f"round(({c}-{c}__m)/CASE WHEN {c}__s < 1e-9 THEN 1 ELSE {c}__s END,4) AS {c}" for c in C.FEATURES) + " FROM f, st"))
def standardise(spark: SparkSession, d: str) -> DataFrame:
    """All features that the models see."""
    n = FE.make_samples(X.daily(spark, d), X.VAL_START).select("site_id", "date", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in C.FEATURES])
    return rounded(EV.standardise(n, C.FEATURES, F.col("date") < F.lit(X.VAL_START).cast("date")), 4)


@query("m8_blend_weights", "M8", sql("scored", """, tr AS (SELECT *, row_number() OVER (ORDER BY date, site_id) AS pos, count(*) OVER () AS n FROM scored WHERE date < DATE '2000-01-01'),
    e AS (SELECT avg(abs(p-y)) AS ea, avg(abs(storm-y)) AS eb, count(*) AS n FROM tr WHERE pos > floor(n*0.85::DOUBLE))
    SELECT round((1/ea)/(1/ea+1/eb),6) AS weight_a, round((1/eb)/(1/ea+1/eb),6) AS weight_b, n FROM e"""))
def blend(spark: SparkSession, d: str) -> DataFrame:
    train = scored(spark, d).filter(F.col("date") < F.lit(X.VAL_START).cast("date")).select("site_id", "date", "y", "p", "storm_today")
    return rounded(EV.blend_weights(EV.last_share(train), "p", "storm_today"), 6)


def _regression(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("split", F.col("yield_t1").alias("y"), (F.col("ghi_mj_m2") / 3.6 * 0.8).alias("p"))


_REG = _PARTS.lstrip() + """, r AS (SELECT split, yield_t1 AS y, ghi_mj_m2/3.6::DOUBLE*0.8::DOUBLE AS p FROM parts), g AS (SELECT split, avg(abs(y)) AS ma FROM r GROUP BY 1)
    SELECT split, count(*) AS n, round(avg(abs(p-y)),6) AS mae, round(sqrt(avg((p-y)*(p-y))),6) AS rmse, round(1-avg((p-y)*(p-y))/var_pop(y),6) AS r2, round(100*avg(abs(p-y))/avg(abs(y)),6) AS mae_pct_of_mean,
      round(100*avg(CASE WHEN abs(y) >= 0.1::DOUBLE*ma THEN abs(p-y)/abs(y) END),6) AS mape_pct, round(avg(p-y),6) AS bias, round(avg(y),6) AS mean_actual FROM r JOIN g USING (split) GROUP BY 1"""


@query("m9_regression_report", "M9 M15", sql("scored", _REG))
def regression(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.regression_report(_regression(spark, d), ["split"]), 6)


@query("m10_log_r2", "M10", sql("scored", _PARTS.lstrip() + """SELECT split, round(1-avg(pow(ln(greatest(yield_t1,1e-9))-ln(greatest(ghi_mj_m2/3.6::DOUBLE*0.8::DOUBLE,1e-9)),2))/var_pop(ln(greatest(yield_t1,1e-9))),6) AS r2_log FROM parts GROUP BY 1"""))
def log_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.log_r2(_regression(spark, d), ["split"]), 6)


def _cls(p: str, cut: str) -> str:
    return f"""c AS (SELECT split, count(*) FILTER (y=1 AND {p} >= {cut}) AS tp, count(*) FILTER (y=0 AND {p} >= {cut}) AS fp, count(*) FILTER (y=1 AND {p} < {cut}) AS fn, count(*) FILTER (y=0 AND {p} < {cut}) AS tn FROM parts GROUP BY 1)
    SELECT split, tp, fp, fn, tn, round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall, round(coalesce(2*(tp/nullif(tp+fp,0))*(tp/nullif(tp+fn,0))/nullif(tp/nullif(tp+fp,0)+tp/nullif(tp+fn,0),0),0),6) AS f1,
      round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy, round((tp+fn)/(tp+fp+fn+tn),6) AS base_rate FROM c"""


@query("m11_classification_report", "M11", sql("scored", _PARTS.lstrip() + ", " + _cls("p", "0.4::DOUBLE")))
def classification(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.classification_report(parts(spark, d), 0.4, ["split"]), 6)


@query("m15_persistence_storms", "M15", sql("scored", _PARTS.lstrip() + ", " + _cls("storm", "0.5::DOUBLE")))
def persistence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.classification_report(parts(spark, d).withColumn("p", F.col("storm_today").cast("double")), 0.5, ["split"]), 6)


@query("m12_roc_auc", "M12 W15", sql("scored", """, rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS r FROM scored WHERE date >= DATE '2000-01-01')
    SELECT round((sum(CASE WHEN y=1 THEN r ELSE 0 END)-count(*) FILTER (y=1)*(count(*) FILTER (y=1)+1)/2.0::DOUBLE)/(count(*) FILTER (y=1)*count(*) FILTER (y=0)),6) AS auc, count(*) FILTER (y=1) AS n_pos, count(*) FILTER (y=0) AS n_neg FROM rk"""))
def auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.roc_auc(scored(spark, d).filter(F.col("date") >= F.lit(X.VAL_START).cast("date"))), 6)


@query("w15_tied_ranks", "W15", sql("scored", """SELECT DISTINCT round(p,8) AS p, r AS rank FROM (SELECT p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS r FROM scored)"""))
def tied_ranks(spark: SparkSession, d: str) -> DataFrame:
    return EV.tied_ranks(scored(spark, d).select("p")).select(F.round("p", 8).alias("p"), "rank")


@query("m13_probability_scores", "M13", sql("scored", _PARTS.lstrip() + """SELECT split, round(avg((p-y)*(p-y)),6) AS brier, round(avg(-(y*ln(least(greatest(p,1e-12),1-1e-12))+(1-y)*ln(1-least(greatest(p,1e-12),1-1e-12)))),6) AS log_loss,
      round(avg(y),6) AS base_rate, round(avg(y)*(1-avg(y)),6) AS climatology_brier FROM parts GROUP BY 1"""))
def probability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.probability_scores(parts(spark, d), ["split"]), 6)


_PROBS = "[" + ",".join(repr(p) for p in EV.sweep_probs()) + "]::DOUBLE[]"
_SWEEP = f""", v AS (SELECT y, p FROM scored WHERE date >= DATE '2000-01-01' AND date < DATE '2001-01-01'), l AS (SELECT list_sort(list(p)) AS l FROM v), h AS (SELECT unnest(list_transform({_PROBS}, lambda g: g*(len(l)-1))) AS h, l FROM l),
    q AS (SELECT DISTINCT l[CAST(floor(h) AS BIGINT)+1]+(l[CAST(ceil(h) AS BIGINT)+1]-l[CAST(floor(h) AS BIGINT)+1])*(h-floor(h)) AS threshold FROM h),
    c AS (SELECT threshold, count(*) FILTER (y=1 AND p >= threshold) AS tp, count(*) FILTER (y=0 AND p >= threshold) AS fp, count(*) FILTER (y=1 AND p < threshold) AS fn, count(*) FILTER (y=0 AND p < threshold) AS tn FROM v, q GROUP BY 1),
    s AS (SELECT *, coalesce(2*(tp/nullif(tp+fp,0))*(tp/nullif(tp+fn,0))/nullif(tp/nullif(tp+fp,0)+tp/nullif(tp+fn,0),0),0) AS f1, tp/nullif(tp+fn,0) AS recall FROM c) """


@query("m14_threshold_sweep", "M14", sql("scored", _SWEEP.lstrip() + "SELECT round(threshold,6) AS threshold, tp, fp, fn, tn, round(f1,6) AS f1 FROM s"))
def sweep(spark: SparkSession, d: str) -> DataFrame:
    val = parts(spark, d).filter(F.col("split") == "val")
    out = EV.threshold_sweep(val).select("threshold", "tp", "fp", "fn", "tn", "f1")
    return rounded(out, 6)


@query("m14_chosen_threshold", "M14", sql("scored", _SWEEP.lstrip() + "SELECT round(threshold,6) AS threshold, round(f1,3) AS f1, round(100*recall,2) AS recall_pct FROM s ORDER BY round(f1,3) DESC, round(100*recall,2) DESC, s.threshold LIMIT 1"))
def chosen(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.choose_threshold(parts(spark, d).filter(F.col("split") == "val")), 6)


@query("m16_mean_baseline", "M16 M9", sql("scored", _PARTS.lstrip() + """, m AS (SELECT avg(soiling_t1) AS mp FROM parts WHERE split='train')
    SELECT count(*) AS n, round(avg(abs(mp-soiling_t1)),6) AS mae, round(max(mp),6) AS baseline FROM parts, m WHERE split='test'"""))
def mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d).select("split", F.col("soiling_t1").alias("y"))
    out = EV.with_train_mean(rows, F.col("split") == "train").filter(F.col("split") == "test")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.max("p").alias("baseline")), 6)


@query("m15_site_baseline_means", "M15 M9", sql("scored", _PARTS.lstrip() + """, f AS (SELECT site_id, avg(abs(ghi_mj_m2/3.6::DOUBLE*0.8::DOUBLE-yield_t1)) AS mae, 1-avg(pow(ghi_mj_m2/3.6::DOUBLE*0.8::DOUBLE-yield_t1,2))/var_pop(yield_t1) AS r2 FROM parts WHERE split <> 'train' GROUP BY 1)
    SELECT round(avg(mae),6) AS mae_mean, round(avg(r2),6) AS r2_mean FROM f"""))
def site_baseline_means(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d).filter(F.col("split") != "train").select("site_id", F.col("yield_t1").alias("y"), (F.col("ghi_mj_m2") / 3.6 * 0.8).alias("p"))
    return rounded(EV.fold_means(EV.regression_report(rows, ["site_id"]), ["mae", "r2"]), 6)
