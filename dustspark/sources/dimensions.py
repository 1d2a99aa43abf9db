"""Constant dimension tables (at most a few dozen rows; safe to broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dustspark import constants as C


def site_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        C.SITES, "id string, name string, province string, climate string, region string, "
                 "lat double, lon double, elevation_m double, capacity_mwp int")


def climate_dimension(spark: SparkSession) -> DataFrame:
    rows = [(name, rate, lmax, round(lmax / (rate / 100.0), 10), bias, published, pr, summer, winter)
            for name, rate, lmax, bias, published, pr, summer, winter in C.CLIMATES]
    return spark.createDataFrame(
        rows, "climate string, rate_pct_per_day double, lmax double, tau double, dust_bias double, "
              "literature_pct double, year_pr double, irr_summer double, irr_winter double")


def region_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.REGION_FACTOR, "region string, region_factor double")


def region_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.REGION_TARGET_LOSS, "region string, target_loss_pct double")


def cleaning_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.CLEANING_PRESETS, "preset string, sar_per_mwp double")


def policy_candidates(spark: SparkSession) -> DataFrame:
    """Fixed calendars, loss thresholds and the never-clean arm, in evaluation order."""
    rows = [(i, "interval", k, None) for i, k in enumerate(C.INTERVAL_CANDIDATES)]
    rows += [(len(rows) + i, "threshold", None, t) for i, t in enumerate(C.THRESHOLD_CANDIDATES)]
    rows.append((len(rows), "never", None, None))
    return spark.createDataFrame(rows, "ord int, kind string, interval_days int, threshold_pct double")
