"""Splits, baselines and scores of forecasts held as columns ``y`` (label) and ``p`` (forecast)."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark.functions.cleaning import clamp
from dustspark.operators.ranks import cumulative_counts, quantiles_of, running_number


def time_split(df: DataFrame, val_start: str, test_start: str) -> DataFrame:
    d = F.col("date")
    part = F.when(d < F.lit(val_start).cast("date"), "train").when(d < F.lit(test_start).cast("date"), "val")
    return df.withColumn("split", part.otherwise("test"))


def date_quantile_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Train before the date at position floor(share * n) of the distinct dates (a calendar), test after."""
    dates = df.agg(F.array_sort(F.collect_set("date")).alias("_d")).select(
        F.element_at("_d", F.floor(F.size("_d") * share).cast("int") + 1).alias("_cut"))
    return df.join(F.broadcast(dates)).withColumn(
        "split", F.when(F.col("date") < F.col("_cut"), "train").otherwise("test")).drop("_cut")


def site_folds(df: DataFrame, val_start: str, min_train: int = 200, min_test: int = 50) -> DataFrame:
    """Leave-one-site-out fold sizes. A fold trains on all other sites' early rows: total minus own."""
    early = F.col("date") < F.lit(val_start).cast("date")
    own = df.groupBy("site_id").agg(F.count_if(early).alias("_own"), F.count_if(~early).alias("n_test"))
    total = own.agg(F.sum("_own").alias("_all"))
    return (own.join(F.broadcast(total)).withColumn("n_train", F.col("_all") - F.col("_own"))
            .filter((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
            .select("site_id", "n_train", "n_test"))


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """z-scores with mean and population deviation of the training rows; tiny deviations count as 1."""
    stats = df.filter(train).agg(*[a for c in columns for a in (
        F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd"))])
    wide = df.join(F.broadcast(stats))
    return wide.withColumns({c: (F.col(c) - F.col(f"{c}__mu")) / F.when(
        F.col(f"{c}__sd") < 1e-9, 1.0).otherwise(F.col(f"{c}__sd")) for c in columns}).drop(*stats.columns)


def blend_weights(rows: DataFrame, a: str, b: str, y: str = "y") -> DataFrame:
    """Inverse-error weights of two members, one row."""
    err = rows.agg(F.avg(F.abs(F.col(a) - F.col(y))).alias("ea"), F.avg(F.abs(F.col(b) - F.col(y))).alias("eb"),
                   F.count(F.lit(1)).alias("n"))
    wa, wb = 1.0 / F.greatest("ea", F.lit(1e-9)), 1.0 / F.greatest("eb", F.lit(1e-9))
    even = ((F.col("ea") <= 1e-9) & (F.col("eb") <= 1e-9)) | (F.col("n") < 40)
    return err.select(F.when(even, 0.5).otherwise(wa / (wa + wb)).alias("weight_a"),
                      F.when(even, 0.5).otherwise(wb / (wa + wb)).alias("weight_b"), "n")


def last_share(train: DataFrame, share: float = 0.85) -> DataFrame:
    """The training rows from position floor(share * n) on, in (date, site) order."""
    # the balance key follows the order by date alone, so site ids may be of any type
    numbered = running_number(train, ["date", "site_id"], F.unix_date("date").cast("double"), "_pos")
    total = train.agg(F.count(F.lit(1)).alias("_n"))
    return (numbered.join(F.broadcast(total)).filter(F.col("_pos") > F.floor(F.col("_n") * share))
            .drop("_pos", "_n"))


def regression_report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, MAE, RMSE, R2, MAE % of the mean, MAPE over meaningful targets, bias, mean.

    Two passes: the MAPE filter needs the mean absolute target first.
    """
    by = by or []
    err = F.col("p") - F.col("y")
    first = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err * err).alias("_mse"), F.var_pop("y").alias("_var"), F.avg(err).alias("bias"),
        F.avg("y").alias("mean_actual"), F.avg(F.abs("y")).alias("mean_abs"))
    scale = first.select(*by, "mean_abs")
    keyed = rows.join(scale, by) if by else rows.join(F.broadcast(scale))
    meaningful = keyed.filter((F.col("mean_abs") > 1e-9) & (F.abs("y") >= 0.10 * F.col("mean_abs")))
    mape = meaningful.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) >= 5, 100.0 * F.avg(F.abs(err) / F.abs("y"))).alias("mape_pct"))
    both = first.join(mape, by, "left") if by else first.join(F.broadcast(mape), how="left")
    return both.select(
        *by, "n", "mae", "rmse", F.when(F.col("_var") > 0, 1.0 - F.try_divide("_mse", "_var")).alias("r2"),
        F.when(F.col("mean_abs") > 1e-9, 100.0 * F.try_divide("mae", "mean_abs")).alias("mae_pct_of_mean"),
        "mape_pct", "bias", "mean_actual")


def log_r2(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    ly, lp = F.ln(F.greatest("y", F.lit(1e-9))), F.ln(F.greatest("p", F.lit(1e-9)))
    out = rows.groupBy(*(by or [])).agg(F.avg((ly - lp) * (ly - lp)).alias("_m"), F.var_pop(ly).alias("_v"))
    return out.select(*(by or []), F.when(F.col("_v") > 0, 1.0 - F.try_divide("_m", "_v")).alias("r2_log"))


def _confusion_scores(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    n = tp + fp + fn + tn
    return df.withColumns({
        "precision": precision, "recall": recall, "f1": f1,
        "accuracy": F.try_divide(tp + tn, n), "base_rate": F.try_divide(tp + fn, n)})


def classification_report(rows: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and the scores from them; the forecast is positive at or above the threshold."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    yes, hit = F.col("y") == 1, F.col("p") >= cut
    out = rows.groupBy(*(by or [])).agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"))
    return _confusion_scores(out)


def probability_scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score, log-loss (clipped) and the Brier score of the constant base rate."""
    p = clamp(F.col("p"), 1e-12, 1 - 1e-12)
    y = F.col("y").cast("double")
    out = rows.groupBy(*(by or [])).agg(
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg(y).alias("base_rate"))
    return out.withColumn("climatology_brier", F.col("base_rate") * (1 - F.col("base_rate")))


def tied_ranks(rows: DataFrame, value: str = "p", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value with the average rank its rows share."""
    table = cumulative_counts(rows, value, {"n": F.count(F.lit(1)), **(extra or {})})
    return table.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums, tied scores sharing the mean rank. Null without both classes."""
    ranked = tied_ranks(rows, "p", {"pos": F.sum(F.col("y").cast("long"))})
    total = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("_r"), F.sum("pos").cast("double").alias("n_pos"),
                       F.sum(F.col("n") - F.col("pos")).cast("double").alias("n_neg"))
    u = F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return total.select(F.try_divide(u, F.col("n_pos") * F.col("n_neg")).alias("auc"),
                        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def sweep_probs(points: int = 60, low: float = 0.5, high: float = 0.999) -> list[float]:
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """Confusion scores at up to 60 score quantiles.

    The rows are read once, into counts per distinct score. The grid is at most 60 numbers; every score
    is put between two of them with a binary search and only the 61 interval counts are accumulated, so
    scores and thresholds are never crossed.
    """
    table = cumulative_counts(rows, "p", {"n": F.count(F.lit(1)), "pos": F.count_if(F.col("y") == 1)})
    grid = quantiles_of(table, "p", sweep_probs())
    cuts = sorted({r["value"] for r in grid.select("value").collect()})
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return rows.limit(0).selectExpr("0D threshold", "0L tp", "0L fp", "0L fn", "0L tn")
    placed = Bucketizer(splits=splits, inputCol="p", outputCol="_b").transform(table.select("p", "n", "pos"))
    counts = placed.groupBy("_b").agg(F.sum("pos").alias("_pos"), F.sum(F.col("n") - F.col("pos")).alias("_neg"))
    base = rows.sparkSession.createDataFrame([(float(i), c) for i, c in enumerate([None, *cuts])],
                                             "_b double, threshold double")
    up = Window.orderBy("_b").rowsBetween(0, Window.unboundedFollowing)
    down = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    full = base.join(counts, "_b", "left").na.fill(0, ["_pos", "_neg"])
    confusion = full.select(
        "threshold", F.sum("_pos").over(up).alias("tp"), F.sum("_neg").over(up).alias("fp"),
        F.coalesce(F.sum("_pos").over(down), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("_neg").over(down), F.lit(0)).alias("tn")).filter(F.col("threshold").isNotNull())
    return _confusion_scores(confusion)


def choose_threshold(rows: DataFrame) -> DataFrame:
    """The swept threshold with the best F1 (both rounded as reported), then the best recall, then the
    lowest; 0.5 when there is no positive."""
    f1, recall = F.round("f1", 3), F.coalesce(F.round(100 * F.col("recall"), 2), F.lit(0.0))
    best = threshold_sweep(rows).agg(F.max(F.struct(
        f1.alias("f1"), recall.alias("recall_pct"), (-F.col("threshold")).alias("neg"), "tp", "fn")).alias("b"))
    has = F.coalesce(F.col("b.tp") + F.col("b.fn"), F.lit(0)) > 0
    return best.select(F.when(has, -F.col("b.neg")).otherwise(0.5).alias("threshold"),
                       F.col("b.f1").alias("f1"), F.col("b.recall_pct").alias("recall_pct"))


def fold_means(folds: DataFrame, columns: list[str]) -> DataFrame:
    return folds.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])


def with_train_mean(rows: DataFrame, train: Column) -> DataFrame:
    """Forecast every row by the mean label of the training rows."""
    return rows.join(F.broadcast(rows.filter(train).agg(F.avg("y").alias("p"))))
