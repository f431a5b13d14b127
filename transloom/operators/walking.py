"""Walking distances between stops over a street network given as nodes and edges.

Nodes: node_id, lat, lon. Edges: a, b, metres, walkable both ways. Stops are matched to nodes by the cells of a radius join, and
distances grow edge by edge from all stops at once, each stop's frontier bounded by the longest walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.common import checkpoint
from transloom.functions.geo import haversine
from transloom.operators.proximity import VoronoiPartition

#: Kinds of ways that one can walk on.
WALKABLE = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "pedestrian", "footway", "path", "steps", "track", "cycleway", "road",
)


def street_edges(ways: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = WALKABLE) -> DataFrame:
    """(a, b, metres) of ways (way_id, kind, route, node_ids in order) that one can walk on; ferries (route = 'ferry') are none.

    Edges of unknown nodes and of a node to itself are left out, of repeated ones the shortest stays; a < b.
    """
    walkable = ways.where(F.col("kind").isin(*kinds) & ~F.coalesce(F.col("route") == "ferry", F.lit(False)) & (F.size("node_ids") > 1))
    steps = F.transform(F.sequence(F.lit(1), F.size("node_ids") - 1), lambda i: F.struct(F.element_at("node_ids", i).alias("x"), F.element_at("node_ids", i + 1).alias("y")))
    pairs = walkable.select(F.explode(steps).alias("s")).select(F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b")).where("a <> b").distinct()
    end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon"))
    located = pairs.join(end("a"), "a").join(end("b"), "b")
    return located.groupBy("a", "b").agg(F.min(haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).alias("metres"))


def nearest_nodes(stops: DataFrame, nodes: DataFrame, metres: float = 500.0) -> DataFrame:
    """(stop_I, node_id, metres): of each stop the nearest node within a distance, the smallest id of equals; stops without one have no row.

    Stops and nodes go through one radius join, stops under ids below those of the nodes.
    """
    places = stops.where("stop_I is not null").select((-F.col("stop_I") - 1).alias("pid"), "lat", "lon").unionByName(nodes.where("node_id >= 0").select(F.col("node_id").alias("pid"), "lat", "lon"))
    near = VoronoiPartition(places, "pid", "lat", "lon", metres).near_pairs().where("key_a < 0 and key_b >= 0")
    return near.groupBy((-F.col("key_a") - 1).alias("stop_I")).agg(F.min(F.struct("d", "key_b")).alias("n")).select("stop_I", F.col("n.key_b").alias("node_id"), F.col("n.d").alias("metres"))


def walk_distances(stops: DataFrame, nodes: DataFrame, edges: DataFrame, *, most: float = 1000.0, match: float = 500.0) -> DataFrame:
    """(from_stop_I, to_stop_I, d_walk): ordered pairs of stops that one can walk in at most ``most`` metres: to the nearest node, over edges, and to the stop; whole metres, rounded down.

    Each round lengthens the ways that the last one made shorter by one edge; ways beyond the limit are dropped, so the rounds end.
    """
    matched = checkpoint(nearest_nodes(stops, nodes, match))
    both = checkpoint(edges.select("a", "b", "metres").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "metres")).where(F.col("metres") <= most))
    known = checkpoint(matched.where(F.col("metres") <= most).select("stop_I", "node_id", "metres", F.lit(True).alias("new")))
    while True:
        longer = known.where("new").select("stop_I", F.col("node_id").alias("a"), F.col("metres").alias("so_far")).join(both, "a")
        reached = longer.select("stop_I", F.col("b").alias("node_id"), (F.col("so_far") + F.col("metres")).alias("metres"), F.lit(True).alias("new")).where(F.col("metres") <= most)
        every = known.withColumn("new", F.lit(False)).unionByName(reached)
        # of equal ways the known one: it is not new again
        known = checkpoint(every.groupBy("stop_I", "node_id").agg(F.min(F.struct("metres", "new")).alias("m")).select("stop_I", "node_id", "m.metres", "m.new"))
        if known.where("new").isEmpty():
            break
    ends = matched.select(F.col("stop_I").alias("to_stop_I"), "node_id", F.col("metres").alias("last"))
    met = known.join(ends, "node_id").where(F.col("stop_I") != F.col("to_stop_I"))
    return met.groupBy(F.col("stop_I").alias("from_stop_I"), "to_stop_I").agg(F.min(F.col("metres") + F.col("last")).alias("m")).where(F.col("m") <= most).select("from_stop_I", "to_stop_I", F.floor("m").cast("int").alias("d_walk"))


def with_walk_distances(stop_distances: DataFrame, walked: DataFrame) -> DataFrame:
    """stop_distances with d_walk of the pairs that were walked; pairs only walked are added without d."""
    new = walked.select("from_stop_I", "to_stop_I", F.col("d_walk").alias("new_walk"))
    return stop_distances.join(new, ["from_stop_I", "to_stop_I"], "full").withColumn("d_walk", F.coalesce("new_walk", "d_walk")).select(*stop_distances.columns)
