"""Seasonal PM10 climatology per site by normal equations, and backfill from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustspark.functions import physics as P

TERMS = 5
GRAM = [f"g{i}{j}" for i in range(TERMS) for j in range(i, TERMS)]
MOMENT = [f"m{i}" for i in range(TERMS)]


def _design(date: Column) -> list[Column]:
    t = 2 * F.pi() * (F.dayofyear(date) - 1) / 365.25
    return [F.lit(1.0), F.cos(t), F.sin(t), F.cos(2 * t), F.sin(2 * t)]


def gram_sums(daily: DataFrame, value: str = "pm10_mean", need: int = 60) -> DataFrame:
    """Sums of the normal equations of ln(value) on the season, one row per site with enough days."""
    y = F.ln(F.col(value))
    x = _design(F.col("date"))
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}{j}") for i in range(TERMS) for j in range(i, TERMS)]
    sums += [F.sum(x[i] * y).alias(f"m{i}") for i in range(TERMS)]
    good = daily.filter((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) != float("inf")))
    return good.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_fit"), F.sum(y * y).alias("yy"),
        F.percentile(F.col(value), F.lit(0.5)).alias("median_pm10"), *sums).filter(F.col("n_fit") >= need)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gram = np.zeros((len(pdf), TERMS, TERMS))
        for name in GRAM:
            i, j = int(name[1]), int(name[2])
            gram[:, i, j] = gram[:, j, i] = pdf[name]
        moment = pdf[MOMENT].to_numpy()
        coef = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), moment)
        rest = np.maximum(pdf["yy"].to_numpy() - np.einsum("ni,ni->n", coef, moment), 0.0)
        yield pd.DataFrame({"site_id": pdf["site_id"], "coef": list(coef),
                            "sigma_log": np.sqrt(rest / pdf["n_fit"].to_numpy()),
                            "n_fit": pdf["n_fit"], "median_pm10": pdf["median_pm10"]})


def fit_climatology(daily: DataFrame, value: str = "pm10_mean", need: int = 60) -> DataFrame:
    """Coefficients, residual spread, day count and median per site.

    The aggregation is Spark's; only the 5 x 5 solve of the one row per site runs in numpy.
    """
    site = daily.schema["site_id"].dataType.simpleString()
    return gram_sums(daily, value, need).mapInPandas(
        _solve, f"site_id {site}, coef array<double>, sigma_log double, n_fit bigint, median_pm10 double")


def backfill(days: DataFrame, fitted: DataFrame) -> DataFrame:
    """Modelled aerosol columns for the given (site, date) rows; sites without a fit give no rows."""
    pm10 = F.exp(P.seasonal_value(F.dayofyear("date"), F.col("coef")))
    rows = days.join(fitted.select("site_id", "coef"), "site_id").withColumn("_pm10", pm10)
    return rows.withColumns(P.backfill_from_pm10(F.col("_pm10"))).drop("_pm10", "coef")
