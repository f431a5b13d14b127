"""Driver queries of the general data problems (p1, p3, p4, p5) over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.common import table
from transloom.operators.proximity import near_and_containing
from transloom.operators.references import feed_references, orphan_report, orphans
from transloom.operators.skew import heavy_keys, key_profile, mode, weighted_percentiles
from transloom.sources.rejects import load_with_rejects, parse_records

FEED = ("stops", "trips", "routes", "calendar", "stop_times")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_and_containing(table(spark, sf_dir, "stops"), table(spark, sf_dir, "zones"), point_key="stop_I", region_key="zone_I", radius_m=250.0)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = load_with_rejects(table(spark, sf_dir, "raw_stops"))
    return rejected.where("line_no > 1").select("raw_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, _ = load_with_rejects(table(spark, sf_dir, "raw_stops"))
    return loaded.select("raw_id", "stop_id", "stop_name", "stop_code", F.round("stop_lat", 6).alias("stop_lat"), F.round("stop_lon", 6).alias("stop_lon"))


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(table(spark, sf_dir, "raw_stops"))
    return parsed.groupBy("feed", F.coalesce("reason", F.lit("loaded")).alias("reason")).agg(F.count("*").alias("n_records"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(feed_references({t: table(spark, sf_dir, t) for t in FEED}))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("child_table", "child_field", "row_key", "kind")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stop_times")
    made = [key_profile(rows, k, p, "dep_time_ds").select(F.lit(k).alias("field_name"), "*") for k, p in (("stop_I", "trip_I"), ("trip_I", "stop_I"))]
    return made[0].unionByName(made[1]).where("key_value is not null").select(
        "field_name", "key_value", "n_rows", "n_partners", F.col("first_measure").alias("first_dep_time_ds"), F.col("last_measure").alias("last_dep_time_ds")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stop_times")
    made = [heavy_keys(key_profile(rows, k, p, "dep_time_ds"), rows, 0.01).select(F.lit(k).alias("field_name"), "key_value") for k, p in (("stop_I", "trip_I"), ("trip_I", "stop_I"))]
    return made[0].unionByName(made[1])


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_percentiles(table(spark, sf_dir, "stop_times"), "stop_I", "dep_time_ds", [10, 50, 90])


def p5_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode(table(spark, sf_dir, "stop_times"), "stop_I", "trip_I")


_ORPHANS = """
SELECT 'stop_times' AS child_table, 'stop_I' AS child_field, c.stop_time_I AS row_key, c.loaded_at,
  CASE WHEN p.stop_I IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' WHEN p.loaded_at > c.loaded_at THEN 'late' END AS kind
FROM stop_times c LEFT JOIN stops p ON p.stop_I = c.stop_I WHERE c.stop_I IS NOT NULL
UNION ALL
SELECT 'stop_times', 'trip_I', c.stop_time_I, c.loaded_at,
  CASE WHEN p.trip_I IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' WHEN p.loaded_at > c.loaded_at THEN 'late' END
FROM stop_times c LEFT JOIN trips p ON p.trip_I = c.trip_I WHERE c.trip_I IS NOT NULL
UNION ALL
SELECT 'trips', 'route_I', c.trip_I, c.loaded_at,
  CASE WHEN p.route_I IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' WHEN p.loaded_at > c.loaded_at THEN 'late' END
FROM trips c LEFT JOIN routes p ON p.route_I = c.route_I WHERE c.route_I IS NOT NULL
UNION ALL
SELECT 'trips', 'service_I', c.trip_I, c.loaded_at,
  CASE WHEN p.service_I IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' WHEN p.loaded_at > c.loaded_at THEN 'late' END
FROM trips c LEFT JOIN calendar p ON p.service_I = c.service_I WHERE c.service_I IS NOT NULL
"""

_PROFILE = """
SELECT 'stop_I' AS field_name, stop_I AS key_value, count(*) AS n_rows, count(DISTINCT trip_I) AS n_partners, min(dep_time_ds) AS first_dep_time_ds, max(dep_time_ds) AS last_dep_time_ds
FROM stop_times WHERE stop_I IS NOT NULL GROUP BY stop_I
UNION ALL
SELECT 'trip_I', trip_I, count(*), count(DISTINCT stop_I), min(dep_time_ds), max(dep_time_ds) FROM stop_times WHERE trip_I IS NOT NULL GROUP BY trip_I
"""

_FIELD_RE = """(?:"(?:[^"]|"")*"|[^",]*)"""
_VALUE = "trim(coalesce(list_extract(f, list_position(names, '{0}')), ''), ' ')"
_SIZED = "coalesce(regexp_full_match({0}, '[+-]?[0-9]+([.][0-9]+)?') AND abs(TRY_CAST({0} AS DOUBLE)) <= {1}, false)"
#: raw_stops read by a pattern for a field; ``reason`` is null where a record is valid.
_RAW = rf"""
WITH h AS (SELECT feed, list_transform(regexp_extract_all(regexp_replace(replace(min(record) FILTER (line_no = 1), chr(65279), ''), '\r$', '') || ',', '{_FIELD_RE},'), lambda x: trim(rtrim(x, ','), ' "')) AS names FROM raw_stops GROUP BY feed),
r AS (SELECT raw_id, feed, names, CASE WHEN ends_with(record, chr(13)) THEN left(record, length(record) - 1) ELSE coalesce(record, '') END AS rec FROM raw_stops JOIN h USING (feed) WHERE line_no > 1),
s AS (SELECT *, regexp_full_match(rec, '{_FIELD_RE}(?:,{_FIELD_RE})*') AS quoted FROM r),
t AS (SELECT *, CASE WHEN quoted THEN list_transform(regexp_extract_all(rec || ',', '{_FIELD_RE},'), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:length(x) - 2], '""', '"') ELSE x[1:length(x) - 1] END) END AS f FROM s),
v AS (SELECT *, {_VALUE.format('stop_id')} AS stop_id, {_VALUE.format('stop_name')} AS stop_name, {_VALUE.format('stop_code')} AS stop_code, {_VALUE.format('stop_lat')} AS lat, {_VALUE.format('stop_lon')} AS lon FROM t),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> len(names) THEN 'column_count'
  WHEN NOT (regexp_full_match(stop_id, '[A-Za-z0-9_.:-]{{1,40}}') AND stop_name <> '' AND NOT regexp_matches(stop_name, '[\x00-\x1F\x{{FFFD}}]') AND (stop_code = '' OR regexp_full_match(stop_code, '[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}} /-]{{0,11}}'))
    AND {_SIZED.format('lat', 90)} AND {_SIZED.format('lon', 180)}) THEN 'invalid_value' END AS reason FROM v)
"""

_DISTANCE = """2 * 6378137.0 * atan2(sqrt(a), sqrt(greatest(0.0, 1 - a)))"""

#: Statements over whole tables; p1's compares every two stops and serves the small scales.
SQL = {
    "p1_found": f"""
WITH s AS (SELECT stop_I, lat, lon FROM stops WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AND abs(lat) <= 90 AND abs(lon) <= 180),
d AS (SELECT x.stop_I AS key_a, y.stop_I AS key_b,
  pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2) AS a
  FROM s x JOIN s y ON x.stop_I < y.stop_I AND abs(x.lat - y.lat) < 0.0023),
v AS (SELECT zone_I, unnest(ring) AS p FROM zones),
w AS (SELECT zone_I, p.seq AS seq, p.lat AS lat, p.lon AS lon FROM v),
e AS (SELECT zone_I, lat AS y1, lon AS x1, lead(lat, 1, first_lat) OVER (PARTITION BY zone_I ORDER BY seq) AS y2, lead(lon, 1, first_lon) OVER (PARTITION BY zone_I ORDER BY seq) AS x2
  FROM (SELECT *, first_value(lat) OVER (PARTITION BY zone_I ORDER BY seq) AS first_lat, first_value(lon) OVER (PARTITION BY zone_I ORDER BY seq) AS first_lon FROM w))
SELECT 'near' AS kind, key_a, key_b FROM d WHERE {_DISTANCE} <= 250
UNION ALL
SELECT 'zone', e.zone_I, s.stop_I FROM e JOIN s ON (e.y1 > s.lat) <> (e.y2 > s.lat) AND s.lon < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1
GROUP BY e.zone_I, s.stop_I HAVING count(*) % 2 = 1
""",
    "p3_found": f"{_RAW} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_loaded": f"{_RAW} SELECT raw_id, stop_id, stop_name, nullif(stop_code, '') AS stop_code, round(lat::DOUBLE, 6) AS stop_lat, round(lon::DOUBLE, 6) AS stop_lon FROM judged WHERE reason IS NULL",
    "p3_reasons": f"{_RAW} SELECT feed, coalesce(reason, 'loaded') AS reason, count(*) AS n_records FROM judged GROUP BY ALL",
    "p4_found": f"SELECT child_table, child_field, row_key, kind FROM ({_ORPHANS}) WHERE kind IS NOT NULL",
    "p4_report": f"SELECT child_table, child_field, kind, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_rows FROM ({_ORPHANS}) WHERE kind IS NOT NULL GROUP BY ALL",
    "p5_profile": _PROFILE,
    "p5_found": f"SELECT field_name, key_value FROM ({_PROFILE}) WHERE n_rows * 100 >= (SELECT count(*) FROM stop_times)",
    "p5_percentiles": """
SELECT key_value, p.percent, p.value FROM (
  SELECT stop_I AS key_value, unnest([{'percent': 10, 'value': quantile_disc(dep_time_ds, 0.1)}, {'percent': 50, 'value': quantile_disc(dep_time_ds, 0.5)}, {'percent': 90, 'value': quantile_disc(dep_time_ds, 0.9)}]) AS p
  FROM stop_times WHERE stop_I IS NOT NULL AND dep_time_ds IS NOT NULL GROUP BY stop_I)
""",
    "p5_modes": """
SELECT key_value, value, n_rows FROM (
  SELECT stop_I AS key_value, trip_I AS value, count(*) AS n_rows, row_number() OVER (PARTITION BY stop_I ORDER BY count(*) DESC, trip_I) AS r
  FROM stop_times WHERE trip_I IS NOT NULL GROUP BY stop_I, trip_I) WHERE r = 1
""",
}

QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_loaded, p3_reasons, p4_found, p4_report, p5_found, p5_profile, p5_percentiles, p5_modes)}
