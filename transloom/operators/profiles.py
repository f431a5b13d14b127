"""How long it takes to a target by time of departure: blocks, and measures of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.operators.pareto import boardings_front, time_front

INF = float("inf")


def profile_blocks(labels: DataFrame, keys: list[str], start: float, end: float, walk: str | None = None) -> DataFrame:
    """(keys, start_time, end_time, distance_start, distance_end): the temporal distance between two times as straight pieces.

    Labels have departure_time and arrival_time_target; ``walk`` names a column with the time on foot, the same for a key's labels
    (null or absent: unreachable on foot). Counted are the fastest labels that depart strictly inside, and of those at the end or
    later the one that arrives first. Where waiting takes longer than walking, the distance is that on foot. Keys without such a
    label have no blocks.
    """
    foot = F.coalesce(F.col(walk).cast("double"), F.lit(INF)) if walk else F.lit(INF)
    typed = labels.select(*keys, F.col("departure_time").cast("double").alias("dep"), F.col("arrival_time_target").cast("double").alias("arr"), foot.alias("foot"))
    inside = typed.where((F.col("dep") > start) & (F.col("dep") < end))
    later = typed.where(F.col("dep") >= end).groupBy(*keys).agg(F.min(F.struct("arr", (-F.col("dep")).alias("m"), "foot")).alias("l")).select(*keys, (-F.col("l.m")).alias("dep"), "l.arr", "l.foot")
    front = time_front(inside.unionByName(later), keys, "dep", "arr")
    order = Window.partitionBy(*keys).orderBy("dep")
    stepped = front.withColumns({"p": F.coalesce(F.lag("dep").over(order), F.lit(float(start))), "e": F.least("dep", F.lit(float(end))), "is_last": F.lead("dep").over(order).isNull()})
    on_foot = F.greatest("p", F.least("e", F.col("arr") - F.col("foot")))
    block = lambda a, b, c, d: F.struct(a.alias("start_time"), b.alias("end_time"), c.alias("distance_start"), d.alias("distance_end"))
    pieces = F.array(
        block(F.col("p"), on_foot, F.col("foot"), F.col("foot")), block(on_foot, F.col("e"), F.col("arr") - on_foot, F.col("arr") - F.col("e")),
        block(F.col("e"), F.when(F.col("is_last"), F.lit(float(end))).otherwise(F.col("e")), F.col("foot"), F.col("foot")),
    )
    return stepped.select(*keys, F.explode(pieces).alias("b")).select(*keys, "b.*").where("start_time < end_time")


def _median(starts: np.ndarray, ends: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> float:
    """The distance that half of the time does not exceed; inf if more than half is unreachable."""
    width = ends - starts
    half = width.sum() / 2
    points = np.unique(np.concatenate([d0[np.isfinite(d0)], d1[np.isfinite(d1)]]))
    held, last = 0.0, None
    flat = d0 == d1
    for x in points:
        if last is not None:
            over = ~flat & (d1 <= last) & (d0 >= x)
            more = over.sum() * (x - last)
            if held + more >= half:
                return float(last + (half - held) / over.sum()) if more > 0 else float(x)
            held += more
        peak = width[flat & (d0 == x)].sum()
        if held + peak >= half and peak > 0:
            return float(x)
        held += peak
        last = x
    return INF


def block_measures(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, min, max, mean, median) of blocks, weighted by time; the median is taken per key in one piece."""
    area = (F.col("distance_start") + F.col("distance_end")) / 2 * (F.col("end_time") - F.col("start_time"))
    simple = blocks.groupBy(*keys).agg(
        F.min(F.least("distance_start", "distance_end")).alias("min"), F.max(F.greatest("distance_start", "distance_end")).alias("max"), (F.sum(area) / F.sum(F.col("end_time") - F.col("start_time"))).alias("mean")
    )
    types = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", median double"

    def median(rows: pd.DataFrame) -> pd.DataFrame:
        value = _median(*(rows[c].to_numpy("float64") for c in ("start_time", "end_time", "distance_start", "distance_end")))
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in keys} | {"median": [value]})

    return simple.join(blocks.groupBy(*keys).applyInPandas(median, schema), keys)


def boardings_blocks(labels: DataFrame, keys: list[str], start: float, end: float, walk: str | None = None) -> DataFrame:
    """Blocks of the boardings on the fastest journey, by the same pieces of time; none while walking is faster, unreachable (inf) after the last."""
    fastest = labels.select(*keys, F.col("departure_time").cast("double").alias("dep_"), F.col("arrival_time_target").cast("double").alias("arr_"), F.col("n_boardings").cast("double").alias("n_")).groupBy(*keys, "dep_", "arr_").agg(F.min("n_").alias("n_"))
    sloping = profile_blocks(labels, keys, start, end, walk)
    arrival = F.when(F.col("distance_start") != F.col("distance_end"), F.col("end_time") + F.col("distance_end"))
    first = fastest.groupBy(*keys, "arr_").agg(F.min("n_").alias("n_"))
    made = sloping.withColumn("arr_", arrival).join(first, [*keys, "arr_"], "left")
    value = F.when(F.col("arr_").isNotNull(), F.col("n_")).when(F.col("distance_start") == INF, INF).otherwise(0.0)
    return made.withColumns({"distance_start": value, "distance_end": value}).select(*keys, "start_time", "end_time", "distance_start", "distance_end")


def property_blocks(labels: DataFrame, keys: list[str], start: float, end: float, value: str, walk: str | None = None) -> DataFrame:
    """Blocks of a property of the fastest journey (the least value of equally fast ones), by the same pieces of time as boardings_blocks."""
    return boardings_blocks(labels.withColumn("n_boardings", F.col(value)), keys, start, end, walk)


def cut_off(blocks: DataFrame, distance: float) -> DataFrame:
    """Blocks with distances of ``distance`` at most; a sloping block that crosses it is split there."""
    crosses = (F.col("distance_start") > distance) & (F.col("distance_end") < distance) & (F.col("distance_start") != F.col("distance_end"))
    share = (F.col("distance_start") - distance) / (F.col("distance_start") - F.col("distance_end"))
    at = F.when(crosses, F.col("start_time") + share * (F.col("end_time") - F.col("start_time"))).otherwise(F.col("end_time"))
    piece = lambda a, b, c, d: F.struct(a.alias("start_time"), b.alias("end_time"), F.least(c, F.lit(float(distance))).alias("distance_start"), F.least(d, F.lit(float(distance))).alias("distance_end"))
    limit = F.lit(float(distance))
    pieces = F.array(piece(F.col("start_time"), at, F.col("distance_start"), F.when(crosses, limit).otherwise(F.col("distance_end"))), piece(at, F.col("end_time"), limit, F.col("distance_end")))
    keys = [c for c in blocks.columns if c not in ("start_time", "end_time", "distance_start", "distance_end")]
    return blocks.select(*keys, F.explode(pieces).alias("b")).select(*keys, "b.*").where("start_time < end_time")


def largest_finite(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, largest): the largest distance that is reachable at some time, null if there is none."""
    finite = lambda c: F.when(F.col(c) < INF, F.col(c))
    return blocks.groupBy(*keys).agg(F.max(F.greatest(finite("distance_start"), finite("distance_end"))).alias("largest"))


def all_measures(labels: DataFrame, keys: list[str], start: float, end: float, walk: str | None = None) -> DataFrame:
    """(keys, min, max, mean, median, largest, and those of trip_measures): the measures of a profile side by side; those of journeys are null where none departs in time."""
    blocks = profile_blocks(labels, keys, start, end, walk)
    return block_measures(blocks, keys).join(largest_finite(blocks, keys), keys).join(trip_measures(labels, keys, start, end), keys, "left")


def mean_by_boardings(labels: DataFrame, keys: list[str], start: float, end: float, most: int, walk: str | None = None) -> DataFrame:
    """(keys, max_boardings, min, max, mean, median): measures of the distance with at most 1, 2, … boardings."""
    return block_measures(blocks_by_boardings(labels, keys, start, end, most, walk), [*keys, "max_boardings"])


def impedance(labels: DataFrame, keys: list[str], start: float, end: float, properties: tuple[str, ...] = (), walk: str | None = None) -> DataFrame:
    """(measure, keys, min, max, mean, median): the temporal distance, and each property of the fastest journeys, over time."""
    made = block_measures(profile_blocks(labels, keys, start, end, walk), keys).withColumn("measure", F.lit("temporal_distance"))
    for p in properties:
        made = made.unionByName(block_measures(property_blocks(labels, keys, start, end, p, walk), keys).withColumn("measure", F.lit(p)))
    return made.select("measure", *keys, "min", "max", "mean", "median")


def blocks_by_boardings(labels: DataFrame, keys: list[str], start: float, end: float, most: int, walk: str | None = None) -> DataFrame:
    """profile_blocks for journeys of at most 1, 2, … ``most`` boardings, with max_boardings as a key."""
    every = labels.withColumn("max_boardings", F.explode(F.sequence(F.lit(1), F.lit(most)))).where("n_boardings <= max_boardings")
    return profile_blocks(every, [*keys, "max_boardings"], start, end, walk)


def trip_measures(labels: DataFrame, keys: list[str], start: float, end: float) -> DataFrame:
    """(keys, n_trips, min, max, mean and median duration and boardings) of the Pareto-optimal journeys that depart from start to end."""
    front = boardings_front(labels.where(F.col("departure_time").between(start, end)), keys)
    took = F.col("arrival_time_target") - F.col("departure_time")
    return front.groupBy(*keys).agg(
        F.count("*").alias("n_trips"), *[f(took).alias(f"{n}_trip_duration") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median))],
        *[f("n_boardings").alias(f"{n}_trip_n_boardings") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median))], F.min_by("n_boardings", took).alias("n_boardings_on_fastest_trip"),
    )


def distance_at(blocks: DataFrame, keys: list[str], time: float) -> DataFrame:
    """(keys, distance) at a time: of two blocks that meet there, the earlier one."""
    there = blocks.where((F.col("start_time") <= time) & (F.col("end_time") >= time))
    share = (F.lit(time) - F.col("start_time")) / (F.col("end_time") - F.col("start_time"))
    value = F.when(F.col("distance_start") == F.col("distance_end"), F.col("distance_start")).otherwise(F.col("distance_start") + share * (F.col("distance_end") - F.col("distance_start")))
    return there.groupBy(*keys).agg(F.min_by(value, "end_time").alias("distance"))


def distance_distribution(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distance, share_below, share_at): the distribution of the distance over time at every end of a block; what is unreachable only counts in the whole."""
    types = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", distance double, share_below double, share_at double"

    def cumulate(rows: pd.DataFrame) -> pd.DataFrame:
        width = (rows.end_time - rows.start_time).to_numpy("float64")
        d0, d1 = rows.distance_start.to_numpy("float64"), rows.distance_end.to_numpy("float64")
        flat = d0 == d1
        points = np.unique(np.concatenate([d0[np.isfinite(d0)], d1[np.isfinite(d1)]]))
        below = [(np.clip(x - d1[~flat], 0, d0[~flat] - d1[~flat]).sum() + width[flat & (d0 < x)].sum()) / width.sum() for x in points]
        at = [width[flat & (d0 == x)].sum() / width.sum() for x in points]
        return pd.DataFrame({k: [rows[k].iloc[0]] * len(points) for k in keys} | {"distance": points, "share_below": below, "share_at": at})

    return blocks.groupBy(*keys).applyInPandas(cumulate, schema)


def pre_journey_waits(labels: DataFrame, keys: list[str], start: float) -> DataFrame:
    """Fastest labels with pre_journey_wait: the time since the one before, or since the start."""
    front = time_front(labels, keys)
    order = Window.partitionBy(*keys).orderBy("departure_time")
    return front.withColumn("pre_journey_wait", F.col("departure_time") - F.coalesce(F.lag("departure_time").over(order), F.lit(start)))
