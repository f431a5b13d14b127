"""Networks and places as files for other tools."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.operators import events, networks
from transloom.schema import TAGS, TRANSIT_TYPES, ZORDER


def walk_edges(feed) -> DataFrame:
    """Walking distances between stops as they are written."""
    return feed["stop_distances"].select("from_stop_I", "to_stop_I", "d", "d_walk")


def located_distances(feed) -> DataFrame:
    """Walking distances with the coordinates of both stops."""
    return events.add_coordinates(events.add_coordinates(walk_edges(feed), feed["stops"], "from_stop_I", "from_"), feed["stops"], "to_stop_I", "to_")


def edge_rows(links: DataFrame) -> DataFrame:
    """Links with route_I_counts as 'route:n,route:n', ready for a flat file."""
    pairs = F.transform(F.array_sort(F.map_entries("route_I_counts")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return links.withColumn("route_I_counts", F.array_join(pairs, ","))


def write_csv(rows: DataFrame, path: str, sep: str = ";") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_static_networks(feed, path: str, start_ut: int | None = None, end_ut: int | None = None) -> None:
    """Links of every type, one folder for each type that has any."""
    tags = F.create_map(*[F.lit(x) for t in TRANSIT_TYPES for x in (t, TAGS[t])])
    links = edge_rows(networks.stop_to_stop(feed.events(start_ut, end_ut), feed["stops"])).withColumn("network", tags[F.col("route_type")])
    links.where("network is not null").repartition("network").write.mode("overwrite").partitionBy("network").option("header", True).option("sep", ";").csv(path)


def write_temporal_network(feed, path: str, start_ut: int | None = None, end_ut: int | None = None) -> None:
    write_csv(events.temporal_network(feed.events(start_ut, end_ut)), path, ",")


def _feature(geometry, properties) -> F.Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def stops_geojson(stops: DataFrame) -> DataFrame:
    """(feature): a point for each stop that has a place."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return stops.where("lat is not null and lon is not null").select(_feature(point, F.struct(F.col("stop_I").cast("string").alias("stop_I"), "name")).alias("feature"))


def sections_geojson(links: DataFrame, stops: DataFrame) -> DataFrame:
    """(feature, zorder): a line for each link, to be drawn in order."""
    both = events.add_coordinates(events.add_coordinates(links, stops, "from_stop_I", "from_"), stops, "to_stop_I", "to_")
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("from_lon", "from_lat"), F.array("to_lon", "to_lat")).alias("coordinates"))
    order = F.create_map(*[F.lit(x) for pair in ZORDER.items() for x in pair])
    return both.select(_feature(line, F.struct("from_stop_I", "to_stop_I", "route_type", "n_vehicles", "d")).alias("feature"), order[F.col("route_type")].alias("zorder"))


def routes_geojson(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """(feature): a line for each route (route_I, points)."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return lines.join(routes.select("route_I", "name", "type"), "route_I").select(_feature(line, F.struct("route_I", "name", F.col("type").alias("route_type"))).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """One collection in one file; features stream through the driver."""
    with open(path, "w", encoding="utf-8") as file:
        file.write('{"type": "FeatureCollection", "features": [')
        for k, row in enumerate(features.toLocalIterator()):
            file.write((",\n" if k else "\n") + row.feature)
        file.write("\n]}\n")


def read_geojson(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)
