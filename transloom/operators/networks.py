"""Networks between stops as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.functions.geo import haversine
from transloom.schema import CAPACITY


def walk_network(stop_distances: DataFrame, max_metres: float = 1000.0) -> DataFrame:
    """(stop_a, stop_b, d, d_walk): undirected walking links, stop_a < stop_b, no longer than the limit by d_walk where any is known, else by d.

    Of a pair given in both directions the row from the larger stop holds.
    """
    walked = stop_distances.agg(F.max(F.col("d_walk").isNotNull())).scalar()
    length = F.when(F.coalesce(walked, F.lit(False)), F.col("d_walk")).otherwise(F.col("d"))
    pairs = stop_distances.where("from_stop_I <> to_stop_I").withColumn("length", length).where(F.col("length") <= max_metres)
    return pairs.groupBy(F.least("from_stop_I", "to_stop_I").alias("stop_a"), F.greatest("from_stop_I", "to_stop_I").alias("stop_b")).agg(F.max_by(F.struct("d", "d_walk"), "from_stop_I").alias("e")).select("stop_a", "stop_b", "e.d", "e.d_walk")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges in either direction, as from_stop_I and to_stop_I."""
    rest = [c for c in edges.columns if c not in ("stop_a", "stop_b")]
    return edges.select(F.col("stop_a").alias("from_stop_I"), F.col("stop_b").alias("to_stop_I"), *rest).unionByName(edges.select(F.col("stop_b").alias("from_stop_I"), F.col("stop_a").alias("to_stop_I"), *rest))


def stop_to_stop(events: DataFrame, stops: DataFrame) -> DataFrame:
    """Links of each route type: from_stop_I, to_stop_I, route_type, n_vehicles, duration_min, duration_max, duration_median, duration_avg, capacity_estimate, d and route_I_counts.

    Events are reduced per link and route first, so that a busy link is not one task's; stops are joined to links, not to events.
    """
    weight = events.groupBy("from_stop_I", "to_stop_I", "route_type", "route_I", "duration").agg(F.count("*").alias("n"))
    link = ["from_stop_I", "to_stop_I", "route_type"]
    timed = weight.groupBy(*link).agg(
        F.sum("n").alias("n_vehicles"), F.min("duration").alias("duration_min"), F.max("duration").alias("duration_max"),
        F.expr("percentile(duration, 0.5, n)").alias("duration_median"), (F.sum(F.col("duration") * F.col("n")) / F.sum("n")).alias("duration_avg"),
    )
    routes = weight.groupBy(*link, "route_I").agg(F.sum("n").alias("n")).groupBy(*link).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("route_I", "n")))).alias("route_I_counts"))
    a, b = (stops.select(F.col("stop_I").alias(f"{s}_stop_I"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon")) for s in ("from", "to"))
    located = timed.join(routes, link).join(a, "from_stop_I").join(b, "to_stop_I")
    seats = F.create_map(*[F.lit(x) for pair in CAPACITY.items() for x in pair])
    return located.select(
        *link, "n_vehicles", "duration_min", "duration_max", "duration_median", "duration_avg", (seats[F.col("route_type")] * F.col("n_vehicles")).alias("capacity_estimate"),
        haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")).cast("int").alias("d"), "route_I_counts",
    )


def route_to_route(stop_times: DataFrame, trips: DataFrame, walk: DataFrame, start_ds: int, end_ds: int, max_metres: float) -> DataFrame:
    """(route_a, route_b): pairs of routes between which one can change, route_a < route_b: a stop of one within walking reach of, or shared with, a stop of the other, both with departures strictly inside the time."""
    inside = stop_times.where((F.col("dep_time_ds") > start_ds) & (F.col("dep_time_ds") < end_ds)).select("stop_I", "trip_I")
    served = inside.join(trips.select("trip_I", "route_I").where("route_I is not null"), "trip_I").select("stop_I", "route_I").distinct()
    near = both_ways(walk.where(F.coalesce("d_walk", "d") < max_metres).select("stop_a", "stop_b")).select("from_stop_I", "to_stop_I")
    a, b = served.select(F.col("stop_I").alias("from_stop_I"), F.col("route_I").alias("r")), served.select(F.col("stop_I").alias("to_stop_I"), F.col("route_I").alias("s"))
    return near.join(a, "from_stop_I").join(b, "to_stop_I").where("r <> s").select(F.least("r", "s").alias("route_a"), F.greatest("r", "s").alias("route_b")).distinct()
