"""Row-count windows over one row per site and day.

A site holds at most one row per calendar day, so a window partition is bounded by the length of
the record (about 36 500 rows per century) however large the table is. All specs share the
(site, date) order: one exchange and one sort serve every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dustspark import constants as C


def by_site(key: str = "site_id", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def rolling(value: Column, rows: int, how: str, w: WindowSpec) -> Column:
    """Rolling max, mean or sum over the last ``rows`` rows, nulls skipped, empty frame -> 0."""
    frame = w.rowsBetween(-(rows - 1), 0)
    if how == "max":
        out = F.max(value).over(frame)
    elif how == "mean":
        out = F.avg(value).over(frame)
    elif how == "sum":
        out = F.sum(F.coalesce(value, F.lit(0.0))).over(frame)
    else:
        raise ValueError(f"unknown rolling function {how!r}")
    return F.coalesce(out, F.lit(0.0))


def rolling_strict(value: Column, rows: int, how: str, w: WindowSpec) -> Column:
    """Rolling mean or sum which is null from the first null of the site onwards; max over the frame."""
    frame = w.rowsBetween(-(rows - 1), 0)
    if how == "max":
        return F.max(value).over(frame)
    out = F.avg(value).over(frame) if how == "mean" else F.sum(value).over(frame)
    return F.when(~_null_so_far(value, w), out)


def _null_so_far(value: Column, w: WindowSpec) -> Column:
    return F.count_if(value.isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0


def expanding_mean(value: Column, w: WindowSpec) -> Column:
    return F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def expanding_mean_strict(value: Column, w: WindowSpec) -> Column:
    """Expanding mean which is null from the first null of the site onwards."""
    return F.when(~_null_so_far(value, w), expanding_mean(value, w))


def lagged(value: Column, rows: int, w: WindowSpec) -> Column:
    return F.coalesce(F.lag(value, rows).over(w), F.lit(0.0))


def days_since(predicate: Column, w: WindowSpec, cap: int = C.DAYS_SINCE_CAP) -> Column:
    """Rows since the predicate last held (0 on the row itself), at most ``cap``; needs ``_rn``."""
    hit = F.last(F.when(predicate, F.col("_rn")), ignorenulls=True)
    return F.least(F.coalesce(F.col("_rn") - hit.over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(cap)), F.lit(cap))


def with_row_number(df: DataFrame, w: WindowSpec, name: str = "_rn") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.row_number().over(w))


def carry_forward(df: DataFrame, columns: list[str], key: str = "site_id", order: str = "ts") -> DataFrame:
    """Replace nulls by the last value of the same site. The caller names the columns to carry."""
    w = by_site(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def segmented_mass(df: DataFrame, rate: Column, rain: Column, key: str = "site_id", order: str = "date",
                   rain_mm: float = 1.0, rows: int = C.DAYS_SINCE_CAP) -> DataFrame:
    """Adds ``mass``: deposit since the last row with rain (that row excluded), at most ``rows`` rows back.

    ``_segment`` stays: it never falls along the site's dates, so (segment, date) is the date order
    and later windows can use it without another sort.
    """
    wet = F.coalesce(rain, F.lit(0.0)) >= rain_mm
    segment = F.sum(F.when(wet, 1).otherwise(0)).over(
        by_site(key, order).rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(key, "_segment").orderBy(order).rowsBetween(-(rows - 1), 0)
    return (df.withColumn("_segment", segment)
            .withColumn("mass", F.sum(F.when(wet, 0.0).otherwise(rate)).over(within)))


def trim_ends(df: DataFrame, head: int = C.WARMUP_ROWS, tail: int = C.HORIZON_ROWS,
              key: str = "site_id", order: str = "date") -> DataFrame:
    """Keep the rows with at least ``head`` predecessors and ``tail`` successors in their site."""
    w = by_site(key, order)
    return (df.withColumn("_i", F.row_number().over(w) - 1)
            .withColumn("_left", F.lead("_i", tail).over(w) if tail else F.col("_i"))
            .filter((F.col("_i") >= head) & F.col("_left").isNotNull()).drop("_i", "_left"))
