"""Great-circle geometry as Column expressions (code-generated) and numpy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius in metres.
EARTH_RADIUS = 6378137.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees; null if any input is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (p2 - p1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def haversine_np(lat1, lon1, lat2, lon2) -> np.ndarray:
    """The same in numpy; arguments broadcast."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


def degree_height(metres: Column | float) -> Column:
    """Degrees of latitude that ``metres`` span."""
    return F.degrees(F.lit(metres) / F.lit(EARTH_RADIUS))


def degree_width(metres: Column | float, lat: Column) -> Column:
    """Degrees of longitude that ``metres`` span at a latitude."""
    return F.degrees(F.lit(metres) / (F.lit(EARTH_RADIUS) * F.cos(F.radians(lat))))


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points on the unit sphere, one row each."""
    p, q = np.radians(lat), np.radians(lon)
    return np.column_stack((np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)))


def usable_position(lat: Column, lon: Column) -> Column:
    """Not null, not both 0 and within the range of degrees."""
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
