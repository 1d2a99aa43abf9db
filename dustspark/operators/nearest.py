"""Nearest and k-nearest catalogue entries by descent through ever finer map cells.

Cells of one level are joined to their parents by equality. A cell is dropped when its closest
possible point is farther than a distance which is known to be reachable, so only a handful of cells
per point survive each level and no group is ever paired in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark.functions.geo import arc_km, haversine_km

# cell edges in degrees, coarse to fine; each divides the one before
LEVELS = (32.0, 4.0, 0.5, 0.0625)


def _cell(lat: Column, lon: Column, edge: float) -> Column:
    return F.struct(F.floor(lat / edge).alias("i"), F.floor(lon / edge).alias("j"))


def _km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat, lon, lat2, lon2)


def _deg2(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return (lat - lat2) * (lat - lat2) + (lon - lon2) * (lon - lon2)


def _gap(x: Column, low: Column, edge: float) -> Column:
    return F.greatest(low - x, x - low - edge, F.lit(0.0))


def _least_km(lat: Column, lon: Column, cell: Column, edge: float) -> Column:
    low = cell["i"] * edge
    dlon = _gap(lon, cell["j"] * edge, edge)
    smallest = F.least(F.cos(F.radians(low)), F.cos(F.radians(low + edge)))
    return arc_km(F.radians(_gap(lat, low, edge)), F.radians(dlon),
                  F.greatest(F.lit(0.0), smallest) * F.cos(F.radians(lat)))


def _least_deg2(lat: Column, lon: Column, cell: Column, edge: float) -> Column:
    a, b = _gap(lat, cell["i"] * edge, edge), _gap(lon, cell["j"] * edge, edge)
    return a * a + b * b


METRICS = {"km": (_km, _least_km), "deg2": (_deg2, _least_deg2)}


def k_nearest(points: DataFrame, catalogue: DataFrame, k: int = 1, within: float | None = None,
              metric: str = "km", digits: int | None = None) -> DataFrame:
    """The ``k`` closest entries of every point, as rows (point columns, entry, distance, pos).

    ``points`` has ``lat`` and ``lon``; ``catalogue`` has ``ord`` (catalogue order, breaks ties), ``lat``,
    ``lon`` and any other columns, returned in the struct ``entry``. ``digits`` orders by the rounded
    distance. Longitudes do not wrap around.
    """
    distance, least = METRICS[metric]
    slack = 10.0 ** -digits if digits is not None else 0.0
    ordering = F.round("distance", digits) if digits is not None else F.col("distance")
    # only the first k entries of one position can be among the k nearest
    same_place = Window.partitionBy("lat", "lon").orderBy("ord")
    entries = (catalogue.withColumn("_n", F.row_number().over(same_place)).filter(F.col("_n") <= k)
               .select(F.col("lat").alias("_elat"), F.col("lon").alias("_elon"), "ord",
                       F.struct(*catalogue.columns).alias("entry")))
    places = points.select("lat", "lon").distinct()

    frontier = None
    for depth, edge in enumerate(LEVELS):
        cell = _cell(F.col("_elat"), F.col("_elon"), edge).alias("cell")
        parent = _cell(F.col("_elat"), F.col("_elon"), LEVELS[depth - 1]).alias("parent")
        cells = entries.groupBy(*([cell, parent] if depth else [cell])).agg(
            F.min(F.struct("ord", "_elat", "_elon")).alias("_one"))
        if frontier is None:
            # at most 6 x 12 cells of 32 degrees exist on the globe
            pairs = places.join(F.broadcast(cells))
        else:
            pairs = frontier.select("lat", "lon", F.col("cell").alias("parent")).join(cells, "parent")
        pairs = pairs.select(
            "lat", "lon", "cell", least(F.col("lat"), F.col("lon"), F.col("cell"), edge).alias("_least"),
            distance(F.col("lat"), F.col("lon"), F.col("_one._elat"), F.col("_one._elon")).alias("_seen"))
        if within is not None:
            pairs = pairs.filter(F.col("_least") <= within)
        by_place = Window.partitionBy("lat", "lon")
        reach = F.sort_array(F.collect_list("_seen").over(by_place))
        bound = F.when(F.size(reach) >= k, F.element_at(reach, k)) if k > 1 else F.min("_seen").over(by_place)
        frontier = (pairs.withColumn("_bound", bound)
                    .filter(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") + slack))
                    .select("lat", "lon", "cell"))

    finest = entries.withColumn("cell", _cell(F.col("_elat"), F.col("_elon"), LEVELS[-1]))
    found = frontier.join(finest, "cell").withColumn(
        "distance", distance(F.col("lat"), F.col("lon"), F.col("_elat"), F.col("_elon")))
    if within is not None:
        found = found.filter(F.col("distance") <= within)
    order = Window.partitionBy("lat", "lon").orderBy(ordering, "ord")
    best = (found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
            .select("lat", "lon", "entry", "distance", "pos"))
    return points.join(best, ["lat", "lon"], "left")


def snap_sites(points: DataFrame, catalogue: DataFrame, max_km: float = 60.0) -> DataFrame:
    """The nearest site within ``max_km``; elsewhere the site is ``custom`` with an inland climate."""
    near = k_nearest(points, catalogue, 1, max_km)
    known = F.col("entry").isNotNull()
    return near.select(
        *points.columns,
        F.when(known, F.col("entry.site_id").cast("string")).otherwise("custom").alias("site"),
        F.when(known, F.col("entry.climate")).otherwise("inland").alias("climate"),
        F.when(known, F.col("distance")).alias("distance_km"))


def resolve_names(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First site, in catalogue order, whose id equals the query or whose name contains it.

    Names are cut into all pieces as long as some query; the first site of every piece is found with a
    partial aggregate and joined by equality, so no query is paired with more than one site.
    """
    asked = queries.withColumn("_q", F.lower(F.trim("query")))
    lengths = asked.agg(F.array_sort(F.collect_set(F.length("_q"))).alias("_lengths"))
    name = F.lower("name")
    pieces = F.flatten(F.transform(F.col("_lengths"), lambda n: F.when(
        (n > 0) & (n <= F.length(name)),
        F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda s: F.substring(name, s, n))
    ).otherwise(F.array().cast("array<string>"))))
    keys = catalogue.join(F.broadcast(lengths)).select(
        F.explode(F.array_distinct(F.concat(F.array(F.lower(F.col("site_id").cast("string"))), pieces))).alias("_q"),
        F.struct("ord", "site_id", "name").alias("site"))
    first = keys.groupBy("_q").agg(F.min("site").alias("site"))
    return asked.join(first, "_q", "left").drop("_q")


def site_thresholds_for(points: DataFrame, catalogue: DataFrame, thresholds: DataFrame,
                        floor: float = 300.0) -> DataFrame:
    """Storm threshold of any coordinate: that of the site nearest in squared degrees, at least usable."""
    near = k_nearest(points, catalogue, 1, metric="deg2").select(
        *points.columns, F.col("entry.site_id").alias("nearest_site_id"))
    table = thresholds.select(F.col("site_id").alias("nearest_site_id"), "threshold")
    return near.join(table, "nearest_site_id", "left").withColumn(
        "threshold", F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(F.lit(floor)))


def tile_cover(views: DataFrame, width: int, height: int, tile_px: int = 256, most: int = 64) -> DataFrame:
    """Tiles under a view of ``width`` x ``height`` pixels centred on (x, y); larger views give no rows."""
    x0, y0 = F.col("x") - width / 2.0, F.col("y") - height / 2.0
    edges = views.withColumns({
        "_x0": F.floor(x0 / tile_px), "_x1": F.floor((x0 + width) / tile_px),
        "_y0": F.floor(y0 / tile_px), "_y1": F.floor((y0 + height) / tile_px)})
    count = (F.col("_x1") - F.col("_x0") + 1) * (F.col("_y1") - F.col("_y0") + 1)
    return (edges.filter(count <= most)
            .withColumn("tile_x", F.explode(F.sequence("_x0", "_x1")))
            .withColumn("tile_y", F.explode(F.sequence("_y0", "_y1")))
            .drop("_x0", "_x1", "_y0", "_y1"))
