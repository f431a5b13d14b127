"""Driver queries of fronts, profiles and routing over whole tables, with their SQL.

Labels are the trips of each route: departure and arrival from their times, boardings from the direction (one more than its number,
three without one), so that every operator sees ties, nulls and hot keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.feed import Feed
from transloom.operators import journeys, profiles, routing
from transloom.operators.pareto import boardings_front, time_front
from transloom.plans.feed_queries import _DAY_EVENTS, _PAIRS, DAY_UT, MORNING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

START, END = 6 * 3600, 10 * 3600
_LABELS = """labels AS (SELECT DISTINCT route_I, start_time_ds::DOUBLE AS departure_time, end_time_ds::DOUBLE AS arrival_time_target, coalesce(CAST(direction_id AS INTEGER) + 1, 3) AS n_boardings FROM trips
  WHERE route_I IS NOT NULL AND start_time_ds IS NOT NULL AND end_time_ds IS NOT NULL)"""
_FRONT = """times AS (SELECT DISTINCT route_I, departure_time, arrival_time_target FROM labels),
front AS (SELECT * FROM times a WHERE NOT EXISTS (SELECT 1 FROM times b WHERE b.route_I = a.route_I AND b.departure_time >= a.departure_time AND b.arrival_time_target <= a.arrival_time_target AND (b.departure_time > a.departure_time OR b.arrival_time_target < a.arrival_time_target)))"""


def query(sql: str | None = None):
    def add(f: Callable[[Feed], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Feed.from_folder(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _labels(feed: Feed) -> DataFrame:
    return feed["trips"].where("route_I is not null and start_time_ds is not null and end_time_ds is not null").select(
        "route_I", F.col("start_time_ds").cast("double").alias("departure_time"), F.col("end_time_ds").cast("double").alias("arrival_time_target"), F.coalesce(F.col("direction_id").try_cast("int") + 1, F.lit(3)).alias("n_boardings")
    )


@query(f"WITH {_LABELS}, {_FRONT} SELECT route_I, departure_time, arrival_time_target FROM front")
def pareto_time(feed):
    return time_front(_labels(feed).drop("n_boardings"), ["route_I"])


@query(f"""WITH {_LABELS} SELECT * FROM labels a WHERE NOT EXISTS (SELECT 1 FROM labels b WHERE b.route_I = a.route_I AND b.departure_time >= a.departure_time AND b.arrival_time_target <= a.arrival_time_target AND b.n_boardings <= a.n_boardings
  AND (b.departure_time > a.departure_time OR b.arrival_time_target < a.arrival_time_target OR b.n_boardings < a.n_boardings))""")
def pareto_time_boardings(feed):
    return boardings_front(_labels(feed), ["route_I"])


@query(f"WITH {_LABELS}, {_FRONT} SELECT route_I, departure_time, departure_time - coalesce(lag(departure_time) OVER (PARTITION BY route_I ORDER BY departure_time), 0.0) AS pre_journey_wait FROM front")
def pre_journey_wait(feed):
    return profiles.pre_journey_waits(_labels(feed).drop("n_boardings"), ["route_I"], 0.0).select("route_I", "departure_time", "pre_journey_wait")


_BLOCKS = f"""{_LABELS}, inside AS (SELECT route_I, departure_time AS dep, arrival_time_target AS arr FROM labels WHERE departure_time > {START} AND departure_time < {END}),
later AS (SELECT route_I, dep, arr FROM (SELECT route_I, departure_time AS dep, arrival_time_target AS arr, row_number() OVER (PARTITION BY route_I ORDER BY arrival_time_target, departure_time DESC) AS r FROM labels WHERE departure_time >= {END}) WHERE r = 1),
x AS (SELECT DISTINCT * FROM (SELECT * FROM inside UNION ALL SELECT * FROM later)),
f AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.route_I = a.route_I AND b.dep >= a.dep AND b.arr <= a.arr AND (b.dep > a.dep OR b.arr < a.arr))),
g AS (SELECT *, coalesce(lag(dep) OVER o, {START}.0) AS p, least(dep, {END}.0) AS e, lead(dep) OVER o IS NULL AS is_last FROM f WINDOW o AS (PARTITION BY route_I ORDER BY dep)),
blocks AS (SELECT route_I, p AS start_time, e AS end_time, arr - p AS distance_start, arr - e AS distance_end FROM g WHERE p < e UNION ALL SELECT route_I, e, {END}.0, 'inf'::DOUBLE, 'inf'::DOUBLE FROM g WHERE is_last AND e < {END})"""


@query(f"WITH {_BLOCKS} SELECT route_I, start_time, end_time, distance_start, distance_end FROM blocks")
def profile_blocks(feed):
    return profiles.profile_blocks(_labels(feed), ["route_I"], START, END)


@query(f"""WITH {_BLOCKS}, n AS (SELECT route_I, arrival_time_target AS arr, min(n_boardings)::DOUBLE AS n FROM labels GROUP BY ALL)
SELECT b.route_I, start_time, end_time, CASE WHEN distance_start <> distance_end THEN n.n WHEN isinf(distance_start) THEN 'inf'::DOUBLE ELSE 0 END AS n_boardings FROM blocks b LEFT JOIN n ON n.route_I = b.route_I AND n.arr = end_time + distance_end""")
def boardings_on_fastest_path(feed):
    return profiles.boardings_blocks(_labels(feed), ["route_I"], START, END).select("route_I", "start_time", "end_time", F.col("distance_start").alias("n_boardings"))


@query(f"""WITH {_BLOCKS}, m AS (SELECT route_I, min(least(distance_start, distance_end)) AS "min", max(greatest(distance_start, distance_end)) AS "max", sum((distance_start + distance_end) / 2 * (end_time - start_time)) / sum(end_time - start_time) AS "mean" FROM blocks GROUP BY route_I)
SELECT route_I, round("min", 4) AS "min", round("max", 4) AS "max", round("mean", 4) AS "mean" FROM m""")
def temporal_distance_summary(feed):
    made = profiles.block_measures(profiles.profile_blocks(_labels(feed), ["route_I"], START, END), ["route_I"])
    return made.select("route_I", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean")])


@query()
def temporal_distance_median(feed):
    return profiles.block_measures(profiles.profile_blocks(_labels(feed), ["route_I"], START, END), ["route_I"]).select("route_I", "median")


@query(f"""WITH {_LABELS}, {_FRONT} SELECT route_I, arrival_time_target, (SELECT min(departure_time) FROM labels b WHERE b.route_I = a.route_I AND b.departure_time >= a.arrival_time_target) AS next_departure_time FROM front a""")
def next_departure_asof(feed):
    labels = _labels(feed)
    front = time_front(labels.drop("n_boardings"), ["route_I"])
    found = routing.next_departures(front, labels.select("route_I", "departure_time").distinct(), ["route_I"], "arrival_time_target", "departure_time", [])
    return found.select("route_I", "arrival_time_target", "next_departure_time")


def _walks(feed: Feed) -> DataFrame:
    return feed.walk_network().select(F.explode(F.array(F.struct(F.col("stop_a").alias("a"), F.col("stop_b").alias("b")), F.struct(F.col("stop_b").alias("a"), F.col("stop_a").alias("b")))).alias("e"), F.coalesce("d_walk", "d").cast("double").alias("d_walk")).select(F.col("e.a").alias("from_stop_I"), F.col("e.b").alias("to_stop_I"), "d_walk")


def _busiest(feed: Feed) -> DataFrame:
    return feed["stop_times"].where("stop_I is not null").groupBy("stop_I").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "stop_I")).alias("s"))


@query()
def earliest_arrival(feed):
    """From the busiest stop at six on the day: a round for each boarding, so no SQL."""
    conns = routing.connections(feed.events(DAY_UT, DAY_UT + 86400))
    seeds = _busiest(feed).select(F.lit(0).alias("seed"), F.col("s.stop_I").alias("stop"), F.lit(float(DAY_UT + START)).alias("at"))
    return routing.earliest_arrivals(conns, seeds, _walks(feed), margin=120).select("stop", "arrival_time")


def _scanned(feed: Feed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Journeys of the morning to the busiest stop, from all others, with the connections they use."""
    conns = routing.connections(feed.events(*MORNING))
    target = _busiest(feed).select(F.col("s.stop_I").alias("target"), F.col("s.stop_I").alias("stop"))
    return (*routing.profile_scan(conns, target, _walks(feed), margin=120), conns)


@query()
def journey_profile_scan(feed):
    """Rounds of joins, so no SQL; compared with a scan and by hand in the tests."""
    return _scanned(feed)[0].select("target", "stop", "departure_time", "arrival_time_target", "n_boardings")


@query()
def journey_components(feed):
    made, legs = journeys.unfolded(*_scanned(feed))
    return journeys.with_components(journeys.with_fastest(made), legs).select("from_stop_I", "to_stop_I", "departure_time", "arrival_time_target", "n_boardings", "fastest_path", "journey_duration", "in_vehicle_duration", "walking_duration", "transfer_wait_duration")


@query()
def legs_to_target_sections(feed):
    made, legs = journeys.unfolded(*_scanned(feed))
    target = _busiest(feed).head().s.stop_I
    return journeys.legs_to_target(made, legs, feed["trips"].join(feed["routes"], "route_I").select("trip_I", "type"), target)


# each trip as a journey from its first stop to its last

_JOURNEYS = """ends AS (SELECT trip_I, min(row(dep_time_ds, seq, stop_time_I, stop_I)) AS a, max(row(dep_time_ds, seq, stop_time_I, stop_I)) AS b FROM stop_times WHERE trip_I IS NOT NULL AND stop_I IS NOT NULL AND dep_time_ds IS NOT NULL AND seq IS NOT NULL GROUP BY trip_I),
j AS (SELECT t.trip_I AS journey_id, a[4] AS from_stop_I, b[4] AS to_stop_I, start_time_ds AS departure_time, end_time_ds AS arrival_time_target, coalesce(route_I, -1) AS route FROM ends JOIN trips t ON t.trip_I = ends.trip_I WHERE start_time_ds IS NOT NULL AND end_time_ds IS NOT NULL)"""


def _trip_journeys(feed: Feed) -> DataFrame:
    whole = feed["stop_times"].where("trip_I is not null and stop_I is not null and dep_time_ds is not null and seq is not null")
    call = F.struct("dep_time_ds", "seq", "stop_time_I", "stop_I")
    ends = whole.groupBy("trip_I").agg(F.min(call).alias("a"), F.max(call).alias("b"))
    timed = feed["trips"].where("start_time_ds is not null and end_time_ds is not null")
    return ends.join(timed, "trip_I").select(F.col("trip_I").alias("journey_id"), F.col("a.stop_I").alias("from_stop_I"), F.col("b.stop_I").alias("to_stop_I"), F.col("start_time_ds").alias("departure_time"), F.col("end_time_ds").alias("arrival_time_target"), F.coalesce("route_I", F.lit(-1)).alias("route"))


@query(f"""WITH {_JOURNEYS}, r AS (SELECT from_stop_I, to_stop_I, route, count(*) AS n FROM j GROUP BY ALL)
SELECT from_stop_I, to_stop_I, sum(n)::BIGINT AS n_journeys, count(*) AS n_routes, round(coalesce(sum(n * (n - 1)) / nullif(sum(n) * (sum(n) - 1), 0), 1.0), 9) AS simpson FROM r GROUP BY from_stop_I, to_stop_I""")
def simpson_alternatives(feed):
    return journeys.simpson_alternatives(_trip_journeys(feed)).withColumn("simpson", F.round("simpson", 9))


@query(f"""WITH {_JOURNEYS}, f AS (SELECT * FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.from_stop_I = a.from_stop_I AND b.to_stop_I = a.to_stop_I AND b.departure_time >= a.departure_time AND b.arrival_time_target <= a.arrival_time_target
  AND (b.departure_time > a.departure_time OR b.arrival_time_target < a.arrival_time_target OR b.journey_id < a.journey_id))),
w AS (SELECT from_stop_I, to_stop_I, route, departure_time - coalesce(lag(departure_time) OVER (PARTITION BY from_stop_I, to_stop_I ORDER BY departure_time), 0) AS wait FROM f),
p AS (SELECT from_stop_I, to_stop_I, route, sum(wait) AS w FROM w GROUP BY ALL), q AS (SELECT *, w / sum(w) OVER (PARTITION BY from_stop_I, to_stop_I) AS p FROM p)
SELECT from_stop_I, to_stop_I, round(sum(p * p), 9) AS simpson FROM q GROUP BY from_stop_I, to_stop_I""")
def simpson_time_weighted(feed):
    return journeys.simpson_time_weighted(journeys.with_waits(_trip_journeys(feed), 0)).withColumn("simpson", F.round("simpson", 9))


@query(f"""WITH {_JOURNEYS}, t AS (SELECT to_stop_I FROM j GROUP BY to_stop_I ORDER BY count(*) DESC, to_stop_I LIMIT 1), own AS (SELECT * FROM j WHERE to_stop_I = (SELECT to_stop_I FROM t)),
p AS (SELECT DISTINCT trip_I FROM stop_times c JOIN stops s ON s.stop_I = c.stop_I WHERE location_type = 0)
SELECT from_stop_I, round(count(p.trip_I) / count(*), 9) AS share FROM own LEFT JOIN p ON p.trip_I = own.journey_id GROUP BY from_stop_I HAVING count(p.trip_I) > 0 AND count(p.trip_I) / count(*) >= 0.5""")
def upstream_stops_ratio(feed):
    made = _trip_journeys(feed)
    target = made.groupBy("to_stop_I").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "to_stop_I")).alias("t")).head().t
    if target is None:
        return made.select("from_stop_I", F.lit(0.0).alias("share")).where(F.lit(False))
    legs = feed["stop_times"].select(F.col("trip_I").alias("journey_id"), F.col("stop_I").alias("from_stop_I"))
    return journeys.upstream_stops(made, legs, target.to_stop_I, feed["stops"].where("location_type = 0"), 0.5).withColumn("share", F.round("share", 9))


_CHANGES = f"""{_PAIRS}, x AS (SELECT p.*, t.direction_id AS dir FROM pairs p JOIN trips t ON t.trip_I = p.trip_I),
m AS (SELECT from_stop_I, to_stop_I, dir, min({{0}}) AS mn, max({{0}}) AS mx, quantile_cont({{0}}, 0.5) AS md, avg({{0}}) AS av FROM x WHERE dir IN ('0', '1') GROUP BY ALL)"""


def _section_measures(feed: Feed, value: F.Column) -> tuple[DataFrame, DataFrame]:
    typed = feed.pairs.join(feed["trips"].select("trip_I", "direction_id"), "trip_I").withColumn("v", value.cast("double"))
    measured = lambda d: typed.where(F.col("direction_id") == d).groupBy("from_stop_I", "to_stop_I").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.median("v").alias("median"), F.avg("v").alias("mean"))
    return measured("0"), measured("1")


@query(f"""WITH {_CHANGES.format('arr_time_ds - from_arr_ds')} SELECT a.from_stop_I, a.to_stop_I, (b.mn - a.mn)::DOUBLE AS diff_min, (b.mx - a.mx)::DOUBLE AS diff_max, b.md - a.md AS diff_median, round(b.av - a.av, 6) AS diff_mean, round((b.av - a.av) / nullif(a.av, 0), 9) AS diff_mean_relative
FROM m a JOIN m b ON a.from_stop_I = b.from_stop_I AND a.to_stop_I = b.to_stop_I AND a.dir = '0' AND b.dir = '1'""")
def measure_diff(feed):
    made = journeys.measure_changes(*_section_measures(feed, F.col("arr_time_ds") - F.col("from_arr_ds")))
    return made.select("from_stop_I", "to_stop_I", "diff_min", "diff_max", "diff_median", F.round("diff_mean", 6).alias("diff_mean"), F.round("diff_mean_relative", 9).alias("diff_mean_relative"))


@query(f"""WITH {_PAIRS}, x AS (SELECT p.*, t.direction_id AS dir FROM pairs p JOIN trips t ON t.trip_I = p.trip_I), m AS (SELECT from_stop_I, to_stop_I, dir, avg(arr_time_ds - dep_time_ds) AS ride, avg(dep_time_ds - from_arr_ds) AS stay FROM x WHERE dir IN ('0', '1') GROUP BY ALL),
d AS (SELECT a.from_stop_I, a.to_stop_I, b.ride - a.ride AS ride, b.stay - a.stay AS stay FROM m a JOIN m b ON a.from_stop_I = b.from_stop_I AND a.to_stop_I = b.to_stop_I AND a.dir = '0' AND b.dir = '1')
SELECT from_stop_I, to_stop_I, CASE WHEN greatest(ride, stay) >= 10 THEN CASE WHEN ride >= stay THEN 'ride' ELSE 'stay' END ELSE 'none' END AS increase, CASE WHEN least(ride, stay) <= -10 THEN CASE WHEN ride <= stay THEN 'ride' ELSE 'stay' END ELSE 'none' END AS decrease FROM d""")
def largest_component(feed):
    changes = {n: journeys.measure_changes(*_section_measures(feed, v)) for n, v in (("ride", F.col("arr_time_ds") - F.col("dep_time_ds")), ("stay", F.col("dep_time_ds") - F.col("from_arr_ds")))}
    return journeys.largest_component(changes, 10)


@query(f"""WITH {_JOURNEYS}, o AS (SELECT route, journey_id, from_stop_I, to_stop_I, departure_time, arrival_time_target, lag(to_stop_I) OVER w AS last_stop, lag(arrival_time_target) OVER w AS last_time, lag(journey_id) OVER w AS last_trip FROM j WINDOW w AS (PARTITION BY route ORDER BY departure_time, journey_id))
SELECT route AS journey_id, last_stop AS arrival_stop, from_stop_I AS departure_stop, departure_time - last_time AS wait FROM o WHERE last_trip IS NOT NULL""")
def transfer_stop_pairs(feed):
    """The trips of a route one after the other, as if they were the legs of one journey."""
    legs = _trip_journeys(feed).select(F.col("route").alias("journey_id"), F.struct("departure_time", "journey_id").alias("seq"), "from_stop_I", "to_stop_I", "departure_time", "arrival_time_target", F.col("journey_id").alias("trip_I"))
    return journeys.transfer_stops(legs)


@query(f"""{_DAY_EVENTS}, w AS (SELECT *, CASE WHEN (SELECT count(d_walk) FROM stop_distances) > 0 THEN d_walk ELSE d END AS length FROM stop_distances WHERE from_stop_I <> to_stop_I),
u AS (SELECT a, b, coalesce(d_walk, d)::DOUBLE AS d FROM (SELECT least(from_stop_I, to_stop_I) AS a, greatest(from_stop_I, to_stop_I) AS b, d, d_walk, row_number() OVER (PARTITION BY least(from_stop_I, to_stop_I), greatest(from_stop_I, to_stop_I) ORDER BY from_stop_I DESC) AS r FROM w WHERE length <= 1000) WHERE r = 1),
both_ways AS (SELECT a, b, d FROM u UNION ALL SELECT b, a, d FROM u)
SELECT DISTINCT a AS departure_stop, from_stop_I AS arrival_stop, round(dep_time_ut - 120 - d / 1.5, 6) AS departure_time, (dep_time_ut - 120)::DOUBLE AS arrival_time FROM today JOIN both_ways ON b = from_stop_I
WHERE dep_time_ut BETWEEN {MORNING[0]} AND {MORNING[1]} AND dep_time_ut - 120 - d / 1.5 BETWEEN {MORNING[0]} AND {MORNING[1]}""")
def pseudo_connections(feed):
    conns = routing.connections(feed.events(DAY_UT, DAY_UT + 86400))
    made = routing.pseudo_connections(conns, _walks(feed), margin=120, start_time=MORNING[0], end_time=MORNING[1])
    return made.select("departure_stop", "arrival_stop", F.round("departure_time", 6).alias("departure_time"), F.col("arrival_time").cast("double").alias("arrival_time")).distinct()
