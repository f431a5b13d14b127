"""Areas that stops cover."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.functions.geo import EARTH_RADIUS

DEGREE_M = EARTH_RADIUS * np.pi / 180


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y), counter-clockwise from the leftmost; fewer than three different points are their own hull."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for q in rows:
            while len(kept) > 1 and _turn(kept[-2], kept[-1], q) <= 0:
                kept.pop()
            kept.append(q)
        return kept[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _part_hull(batches):
    for batch in batches:
        if len(batch):
            yield pd.DataFrame(hull(batch[["lon", "lat"]].to_numpy()), columns=["lon", "lat"])


def _task_hull(batches):
    held = np.zeros((0, 2))
    for part in _part_hull(batches):
        held = hull(np.concatenate([held, part.to_numpy()]))
    yield pd.DataFrame(held, columns=["lon", "lat"])


#: Tasks whose hulls are merged at once.
MOST_PARTS = 64


def convex_hull(stops: DataFrame) -> np.ndarray:
    """The hull's corners (lon, lat) of all stops: hulls of parts on the workers, merged level by level, and the last few parts' corners once more on the driver."""
    corners = stops.select("lon", "lat").where("lon is not null and lat is not null").mapInPandas(_task_hull, "lon double, lat double")
    parts = corners.rdd.getNumPartitions()
    while parts > MOST_PARTS:
        parts = -(-parts // MOST_PARTS)
        corners = corners.coalesce(parts).mapInPandas(_task_hull, "lon double, lat double")
    corners = corners.toPandas()
    return hull(corners.to_numpy()) if len(corners) else np.zeros((0, 2))


def _metres(lonlat: np.ndarray) -> np.ndarray:
    """A local plane in metres."""
    middle = np.radians((lonlat[:, 1].min() + lonlat[:, 1].max()) / 2)
    return np.column_stack(((lonlat[:, 0] - lonlat[:, 0].min()) * DEGREE_M * np.cos(middle), (lonlat[:, 1] - lonlat[:, 1].min()) * DEGREE_M))


def hull_area_km2(stops: DataFrame) -> float:
    """Area of the hull in a local plane; 0 for fewer than three corners."""
    corners = convex_hull(stops)
    if len(corners) < 3:
        return 0.0
    x, y = _metres(corners).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2e6)


def buffered_area_km2(stops: DataFrame, metres: float, cells: int = 32) -> float:
    """Area within a distance of any stop: cells of a radius' fraction whose middle lies within it, counted once each.

    Error about one cell's width along the edge. Cells are made per stop on the executors and made distinct.
    """
    side = metres / cells
    row_h = side / DEGREE_M
    located = stops.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    rows = located.select("lat", "lon", F.explode(F.sequence(F.floor((F.col("lat") - cells * row_h) / row_h), F.ceil((F.col("lat") + cells * row_h) / row_h))).alias("r"))
    mid = (F.col("r") + 0.5) * row_h
    width = F.lit(row_h) / F.cos(F.radians(mid))
    up = (mid - F.col("lat")) * DEGREE_M
    half = F.sqrt(F.lit(metres * metres) - up * up) / DEGREE_M / F.cos(F.radians(mid))
    spans = rows.where(F.abs(up) <= metres).select("r", F.ceil((F.col("lon") - half) / width - 0.5).alias("a"), F.floor((F.col("lon") + half) / width - 0.5).alias("b")).where("a <= b")
    covered = spans.select("r", F.explode(F.sequence("a", "b")).alias("c")).distinct()
    return covered.count() * side * side / 1e6
