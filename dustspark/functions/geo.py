"""Distances, boxes and map tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dustspark import constants as C


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return arc_km(F.radians(lat2 - lat1), F.radians(lon2 - lon1), F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)))


def arc_km(dlat: Column, dlon: Column, cos_product: Column) -> Column:
    """Great-circle length from angle differences (radians) and the product of the latitude cosines."""
    a, b = F.sin(dlat / 2), F.sin(dlon / 2)
    h = a * a + cos_product * b * b
    return 2 * C.EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h)))


def in_box(lat: Column, lon: Column, box: dict[str, float] = C.BBOX) -> Column:
    return lat.between(box["south"], box["north"]) & lon.between(box["west"], box["east"])


def mercator_pixel(lat: Column, lon: Column, zoom: Column, tile_px: int = 256) -> tuple[Column, Column]:
    """Web-Mercator pixel position of a coordinate."""
    scale = tile_px * F.pow(F.lit(2.0), zoom)
    s = F.sin(F.radians(lat))
    x = (lon + 180.0) / 360.0 * scale
    y = (0.5 - F.ln((1 + s) / (1 - s)) / (4 * F.pi())) * scale
    return x, y
