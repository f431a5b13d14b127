"""Lines that vehicles follow: matching stops to them, slices and passage times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.functions.geo import haversine_np

#: A stop's search along the line ends so many points after its best one, once the line is so near and nearer to the next stop.
LOOK_AHEAD, NEAR_M = 100, 500
#: An alignment is given up when its distances add up to more than this, and to more than the second for each stop.
BAD_TOTAL, BAD_EACH = 500, 30


def match_stops(stop_lat: np.ndarray, stop_lon: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[list[int], float]:
    """For each stop in order the index of the line's point nearest to it, searched from the last stop's on, and the sum of distances.

    No indices if the line is too far from the stops.
    """
    found: list[int] = []
    badness, begin = 0.0, 0
    before: np.ndarray | None = None
    for y, x in zip(stop_lat, stop_lon):
        d = haversine_np(y, x, lat[begin:], lon[begin:])
        # the nearest so far at every point, and where it was first met
        least = np.minimum.accumulate(d)
        met = np.maximum.accumulate(np.where(np.concatenate([[True], d[1:] < least[:-1]]), np.arange(len(d)), 0))
        end = len(d)
        if before is not None:
            stop = (before[begin:] >= d) & (d <= NEAR_M) & (np.arange(len(d)) - met >= LOOK_AHEAD)
            if stop.any():
                end = int(stop.argmax()) + 1
        best = int(met[end - 1])
        badness += float(least[end - 1])
        begin += best
        found.append(begin)
        before = haversine_np(y, x, lat, lon)
        if badness > BAD_TOTAL and badness > BAD_EACH * len(found):
            return [], badness
    return found, badness


def shape_breaks(trip_lines: DataFrame, shape_lines: DataFrame) -> DataFrame:
    """(trip_I, breaks, badness): where on its shape each trip's stops lie.

    trip_lines: trip_I, shape_id, points (seq, lat, lon); shape_lines: shape_id, points. Each pattern of stops on a shape is matched
    once; what does not go forward only is no match.
    """
    patterns = trip_lines.groupBy("shape_id", "points").agg(F.collect_list("trip_I").alias("trips")).join(shape_lines.withColumnRenamed("points", "line"), "shape_id")

    def match(batches):
        for batch in batches:
            out = []
            for trips, points, line in zip(batch.trips, batch.points, batch.line):
                at = lambda rows, c: np.array([r[c] for r in rows], "float64")
                breaks, badness = match_stops(at(points, "lat"), at(points, "lon"), at(line, "lat"), at(line, "lon"))
                if any(b < a for a, b in zip(breaks, breaks[1:])):
                    breaks = []
                out += [(t, breaks, badness) for t in trips]
            yield pd.DataFrame(out, columns=["trip_I", "breaks", "badness"])

    return patterns.select("trips", "points", "line").mapInPandas(match, "trip_I long, breaks array<int>, badness double")


def best_shapes(matches: DataFrame, key: str) -> DataFrame:
    """Of several matches the one of least badness per key."""
    return matches.where("size(breaks) > 0").groupBy(key).agg(F.min(F.struct("badness", "shape_id", "breaks")).alias("m")).select(key, "m.shape_id", "m.breaks", "m.badness")


def shape_slices(breaks: DataFrame, shape_lines: DataFrame) -> DataFrame:
    """(trip_I, leg, points): the line from each stop to the next, both ends included."""
    joined = breaks.where("size(breaks) > 1").join(shape_lines, "shape_id")
    legs = joined.select("trip_I", "points", "breaks", F.explode(F.sequence(F.lit(1), F.size("breaks") - 1)).alias("leg"))
    a, b = F.element_at("breaks", F.col("leg")), F.element_at("breaks", F.col("leg") + 1)
    return legs.select("trip_I", "leg", F.slice("points", a + 1, b - a + 1).alias("points"))


def shape_lines(shapes: DataFrame) -> DataFrame:
    """(shape_id, points): each shape as an array of (seq, lat, lon, d)."""
    return shapes.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon", "d"))).alias("points"))


def passage_times(distances: list[float], breaks: list[int], times: list[float]) -> list[float]:
    """Times at all points of a line from those at the breaks, by distance; before the first and after the last break theirs hold.

    Breaks at one distance pass on the earlier one's time.
    """
    d = np.asarray(distances, "float64")
    return np.interp(d, d[breaks], np.asarray(times, "float64")).tolist()


def shape_distance(calls: DataFrame, shapes: DataFrame) -> DataFrame:
    """(trip_I, from_seq, to_seq, metres): along the shape between the points numbered like two calls (trip_I, shape_id, from_seq, to_seq)."""
    inside = calls.join(shapes.select("shape_id", F.col("seq").alias("at"), "d"), "shape_id").where("at between from_seq and to_seq")
    return inside.groupBy("trip_I", "from_seq", "to_seq").agg((F.max("d") - F.min("d")).alias("metres"))
