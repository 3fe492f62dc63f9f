"""Distances on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from transitspark.config import EARTH_RADIUS_KM, ZONE_CENTRE


def distance_km(lat: Column, lon: Column, centre: tuple[float, float] = ZONE_CENTRE) -> Column:
    """Haversine distance to a fixed point; the root is held at 1 so rounding cannot give NaN."""
    lat0, lon0 = (math.radians(x) for x in centre)
    half_dlat = (F.radians(lat) - F.lit(lat0)) / 2
    half_dlon = (F.radians(lon) - F.lit(lon0)) / 2
    across = F.lit(math.cos(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin(half_dlon), 2)
    root = F.sqrt(F.pow(F.sin(half_dlat), 2) + across)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(root, F.lit(1.0)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (south, west, north, east), borders included; a missing position is outside."""
    south, west, north, east = box
    inside = lat.between(south, north) & lon.between(west, east)
    return F.coalesce(inside, F.lit(False))
