"""Distances and decay as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def decay(distance: Column, bandwidth: Column) -> Column:
    """exp(-d/b), and 0 beyond b."""
    return F.when(distance > bandwidth, 0.0).otherwise(F.exp(-distance / bandwidth))


def usable(lat: Column, lon: Column) -> Column:
    """Present, in range and not both zero."""
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((F.abs(lat) < 1e-9) & (F.abs(lon) < 1e-9))
    return F.coalesce(ok, F.lit(False))


def zone_from_grid(lat: Column, lon: Column, cell: float) -> Column:
    return F.concat_ws("_", F.lit("g"), F.floor(lat / cell).cast("string"), F.floor(lon / cell).cast("string"))
