"""Cutting an ordered key into ranges of about equal rows, as an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES_PER_PARTITION = 8


def cuts(rows: DataFrame, order: str, n: int) -> tuple[object, list]:
    """The smallest key and at most ``n - 1`` cut points, which are keys of rows. Bounded by ``n``, not by the data."""
    found = rows.agg(F.min(order).alias("least"), F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()
    return found["least"], sorted(set(found["cuts"] or []) - {found["least"]})


def place(key: Column, points: list) -> Column:
    """The number of cut points that are not above ``key`` (all of them for null), by binary search."""
    if not points:
        return F.lit(0)
    listed = F.array(*[F.lit(c).cast("long") for c in points])
    steps = [1 << b for b in range(len(points).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda p, s: F.when(
        (p + s <= len(points)) & (key.isNull() | (F.get(listed, p + s - 1) <= key)), p + s).otherwise(p))


def range_of(rows: DataFrame, order: str, parts: int) -> Column:
    """The range of a row of ``rows`` by its key ``order``."""
    return place(F.col(order), cuts(rows, order, parts * RANGES_PER_PARTITION)[1])
