"""Dated movements between consecutive stops and what is looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.operators.sequence import with_next

CALL_ORDER = ["dep_time_ds", "seq"]


def calls_with_next(stop_times: DataFrame, columns: tuple[str, ...] = ("stop_I", "arr_time_ds", "dep_time_ds", "seq"), order: list[str] | None = None, **settings) -> DataFrame:
    """Each call of a trip with the next one's columns; ties in time and number by the call's own key where there is one."""
    tie = ["stop_time_I"] if "stop_time_I" in stop_times.columns else []
    return with_next(stop_times, ["trip_I"], [*(order or CALL_ORDER), *tie], list(columns), **settings)


def stop_pairs(stop_times: DataFrame, **settings) -> DataFrame:
    """(trip_I, from_stop_I, to_stop_I, dep_time_ds, arr_time_ds, from_arr_ds, from_seq, to_seq): moves of each trip from a call to the next of a higher seq.

    Calls without a trip, stop or time make no move.
    """
    usable = stop_times.where("trip_I is not null and stop_I is not null and arr_time_ds is not null and dep_time_ds is not null")
    paired = calls_with_next(usable, **settings)
    return paired.where("next_seq > seq").select(
        "trip_I", F.col("stop_I").alias("from_stop_I"), F.col("next_stop_I").alias("to_stop_I"), "dep_time_ds", F.col("next_arr_time_ds").alias("arr_time_ds"),
        F.col("arr_time_ds").alias("from_arr_ds"), F.col("seq").alias("from_seq"), F.col("next_seq").alias("to_seq"),
    )


def transit_events(day_trips: DataFrame, trips: DataFrame, routes: DataFrame, stop_times: DataFrame, start_ut: int | None = None, end_ut: int | None = None, route_type: int | None = None) -> DataFrame:
    """The movements of dated trips: from_stop_I, to_stop_I, dep_time_ut, arr_time_ut, shape_id, route_type, route_id, trip_I, duration, from_seq, to_seq, route_I.

    With bounds, departures are at the start or later and arrivals at the end or earlier; a trip's first and last call are bounded as
    in its timetable, so that moves are dropped whole. Pairs are made once per trip, not once per date.
    """
    dated = day_trips.select("trip_I", "day_start_ut", "start_time_ut", "end_time_ut")
    if end_ut is not None:
        dated = dated.where(F.col("start_time_ut") < end_ut)
    if start_ut is not None:
        dated = dated.where(F.col("end_time_ut") > start_ut)
    named = routes.select("route_I", "route_id", F.col("type").alias("route_type"))
    if route_type is not None:
        named = named.where(F.col("route_type") == route_type)
    lines = trips.select("trip_I", "route_I", "shape_id").join(named, "route_I")
    moved = stop_pairs(stop_times).join(lines, "trip_I").join(dated.drop("start_time_ut", "end_time_ut"), "trip_I")
    dep, arr = F.col("day_start_ut") + F.col("dep_time_ds"), F.col("day_start_ut") + F.col("arr_time_ds")
    events = moved.select(
        "from_stop_I", "to_stop_I", dep.alias("dep_time_ut"), arr.alias("arr_time_ut"), "shape_id", "route_type", "route_id", "trip_I", (arr - dep).alias("duration"), "from_seq", "to_seq", "route_I"
    )
    if end_ut is not None:
        events = events.where(F.col("arr_time_ut") <= end_ut)
    if start_ut is not None:
        events = events.where(F.col("dep_time_ut") >= start_ut)
    return events


def temporal_network(events: DataFrame) -> DataFrame:
    """Events as time-stamped links."""
    return events.drop("to_seq", "shape_id", "duration", "route_id").withColumnRenamed("from_seq", "seq")


def trips_active(day_trips: DataFrame, start_ut: int, end_ut: int) -> DataFrame:
    """Dated trips under way at some time strictly between the bounds."""
    return day_trips.where((F.col("end_time_ut") > start_ut) & (F.col("start_time_ut") < end_ut))


def trips_by_day(day_trips: DataFrame, start_ut: int, end_ut: int) -> DataFrame:
    """(day_start_ut, trip_Is): the trips of each service day that touch the closed interval."""
    touching = day_trips.where((F.col("end_time_ut") >= start_ut) & (F.col("start_time_ut") <= end_ut))
    return touching.groupBy("day_start_ut").agg(F.array_sort(F.collect_set("trip_I")).alias("trip_Is"))


def calls_of_trips(stop_times: DataFrame, stops: DataFrame, day_trips: DataFrame) -> DataFrame:
    """Dated calls with coordinates: trip_I, day_start_ut, seq, stop_I, lat, lon, dep_time_ut, arr_time_ut, shape_break."""
    named = stop_times.join(stops.select("stop_I", "lat", "lon"), "stop_I").join(day_trips.select("trip_I", "day_start_ut"), "trip_I")
    return named.select("trip_I", "day_start_ut", "seq", "stop_I", "lat", "lon", (F.col("day_start_ut") + F.col("dep_time_ds")).alias("dep_time_ut"), (F.col("day_start_ut") + F.col("arr_time_ds")).alias("arr_time_ut"), "shape_break")


def stop_departures(calls: DataFrame, stops: DataFrame, start_ut: int, end_ut: int) -> DataFrame:
    """(stop_I, count, lat, lon, name): departures of dated calls within the closed interval; 0 for the other stops."""
    counted = calls.where(F.col("dep_time_ut").between(start_ut, end_ut)).groupBy("stop_I").agg(F.count("*").alias("count"))
    return stops.select("stop_I", "lat", "lon", "name").join(counted, "stop_I", "left").fillna(0, ["count"])


def segment_vehicles(events: DataFrame, start_ut: int, end_ut: int) -> DataFrame:
    """(from_stop_I, to_stop_I, n_vehicles, first_trip_I): moves wholly inside the interval per pair of stops."""
    inside = events.where((F.col("dep_time_ut") >= start_ut) & (F.col("arr_time_ut") <= end_ut))
    return inside.groupBy("from_stop_I", "to_stop_I").agg(F.count("*").alias("n_vehicles"), F.min("trip_I").alias("first_trip_I"))


def stops_of_type(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame, route_type: int) -> DataFrame:
    """Stops that a route type serves; all of them for walking."""
    if route_type == -1:
        return stops
    served = stop_times.select("stop_I", "trip_I").join(trips.select("trip_I", "route_I").join(routes.where(F.col("type") == route_type).select("route_I"), "route_I", "left_semi"), "trip_I", "left_semi")
    return stops.join(served.select("stop_I").distinct(), "stop_I", "left_semi")


def one_trip_per_pattern(served: DataFrame) -> DataFrame:
    """Of distinct (stop_I, trip_I) the rows of one trip for each set of stops: the smallest trip. Sets are told apart by their size and two 64-bit hashes, without a list of stops."""
    sets = served.groupBy("trip_I").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("stop_I")).alias("x"), F.sum(F.pmod(F.xxhash64("stop_I", F.lit(1)), F.lit(1 << 40))).alias("s"))
    return served.join(sets.groupBy("n", "x", "s").agg(F.min("trip_I").alias("trip_I")).select("trip_I"), "trip_I", "left_semi")


def reachable_without_change(distances: DataFrame, stop_times: DataFrame, metres: int) -> DataFrame:
    """(origin, stop_I): for every stop, the stops of any trip that calls within a distance of it.

    Trips that call at the same stops count once, so that a stop with very many trips is not paired with each of them.
    """
    near = distances.where(F.col("d") < metres).select(F.col("from_stop_I").alias("origin"), F.col("to_stop_I").alias("stop_I"))
    served = one_trip_per_pattern(stop_times.select("stop_I", "trip_I").where("stop_I is not null and trip_I is not null").distinct())
    boarding = near.join(served, "stop_I").select("origin", "trip_I").distinct()
    return boarding.join(served, "trip_I").select("origin", "stop_I").distinct()


#: A trip of more stops is not paired with each origin that boards it.
LONG_TRIP = 1000


def reachable_counts(distances: DataFrame, stop_times: DataFrame, metres: int, long_trip: int = LONG_TRIP) -> DataFrame:
    """(origin, n_stops): of every stop, how many stops ``reachable_without_change`` has for it, without a row for each stop of a long trip.

    Origins that board the same long trips reach the same stops by them, and stops of the same long trips are reached together: these sets
    of trips are compared, once each. Stops reached by other trips are listed, and count where none of the origin's long trips has them.
    """
    near = distances.where(F.col("d") < metres).select(F.col("from_stop_I").alias("origin"), F.col("to_stop_I").alias("stop_I")).distinct()
    served = one_trip_per_pattern(stop_times.select("stop_I", "trip_I").where("stop_I is not null and trip_I is not null").distinct())
    long = served.groupBy("trip_I").agg(F.count("*").alias("n")).where(F.col("n") > long_trip).select("trip_I")
    short = served.join(long, "trip_I", "left_anti")
    calls = served.join(long, "trip_I", "left_semi")
    of_stop = calls.groupBy("stop_I").agg(F.array_sort(F.collect_set("trip_I")).alias("calling"))
    of_origin = near.join(calls, "stop_I").groupBy("origin").agg(F.array_sort(F.collect_set("trip_I")).alias("boarded"))
    alike = of_stop.groupBy("calling").agg(F.count("*").alias("n"))
    taken = of_origin.select("boarded").distinct().select("boarded", F.explode("boarded").alias("trip_I"))
    met = taken.join(alike.select("calling", "n", F.explode("calling").alias("trip_I")), "trip_I").select("boarded", "calling", "n").distinct()
    by_long = of_origin.join(met.groupBy("boarded").agg(F.sum("n").alias("n")), "boarded").select("origin", "n")
    boarding = near.join(short, "stop_I").select("origin", "trip_I").distinct()
    reached = boarding.join(short, "trip_I").select("origin", "stop_I").distinct().join(of_stop, "stop_I", "left")
    own = of_origin.withColumnRenamed("origin", "of_origin")
    besides = reached.join(own, F.col("origin").eqNullSafe(F.col("of_origin")), "left").where(~F.coalesce(F.arrays_overlap("boarded", "calling"), F.lit(False)))
    return by_long.unionByName(besides.groupBy("origin").agg(F.count("*").alias("n"))).groupBy("origin").agg(F.sum("n").alias("n_stops"))


def trip_lines(stop_times: DataFrame, stops: DataFrame, key: str = "trip_I") -> DataFrame:
    """(trip_I, points): a trip's stops as an array of (seq, lat, lon) in order."""
    located = stop_times.join(stops.select("stop_I", "lat", "lon"), "stop_I")
    return located.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("points"))


def trajectories(day_trips: DataFrame, stop_times: DataFrame, stops: DataFrame, trips: DataFrame, routes: DataFrame, start_ut: int, end_ut: int, *, shapes: DataFrame | None = None, breaks: DataFrame | None = None, route_name: str | None = None) -> DataFrame:
    """(trip_I, day_start_ut, route_type, name, points): where each trip under way between two times is, as points (time_ut, lat, lon) in order of time.

    With shape lines (shape_id, points) and breaks (trip_I, breaks: the place of each call on the trip's line) the points are those
    of the line, their times by distance between the calls; a trip without both has its calls. ``route_name`` keeps the routes of
    that name. Calls without a place or time are passed over.
    """
    named = routes.select("route_I", "name", F.col("type").alias("route_type"))
    named = named if route_name is None else named.where(F.col("name") == route_name)
    active = trips_active(day_trips, start_ut, end_ut).select("trip_I", "day_start_ut").join(trips.select("trip_I", "route_I", "shape_id"), "trip_I").join(named, "route_I")
    calls = stop_times.join(active.select("trip_I").distinct(), "trip_I", "left_semi").where("dep_time_ds is not null").join(stops.select("stop_I", "lat", "lon").where("lat is not null and lon is not null"), "stop_I")
    lines = calls.groupBy("trip_I").agg(F.array_sort(F.collect_list(F.struct(F.col("dep_time_ds").cast("double").alias("t"), "seq", "lat", "lon"))).alias("calls"))
    placed = active.join(lines, "trip_I")
    at = lambda t, p: F.struct(t.alias("time"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    own = F.transform("calls", lambda c: at(F.col("day_start_ut") + c["t"], c))
    if shapes is None or breaks is None:
        return placed.select("trip_I", "day_start_ut", "route_type", "name", own.alias("points"))
    both = placed.join(breaks.select("trip_I", "breaks"), "trip_I", "left").join(shapes.select("shape_id", F.col("points").alias("line")), "shape_id", "left")
    fits = F.col("line").isNotNull() & (F.size("breaks") == F.size("calls")) & (F.size("breaks") > 1)

    def leg(i):
        a, b = F.element_at("breaks", i), F.element_at("breaks", i + 1)
        t0, t1 = F.element_at("calls", i)["t"], F.element_at("calls", i + 1)["t"]
        d0, d1 = F.element_at("line", a + 1)["d"], F.element_at("line", b + 1)["d"]
        return F.transform(F.slice("line", a + 1, F.greatest(F.lit(1), b - a + 1)), lambda p: at(F.col("day_start_ut") + t0 + F.coalesce(F.try_divide(p["d"] - d0, d1 - d0), F.lit(0.0)) * (t1 - t0), p))

    along = F.flatten(F.transform(F.sequence(F.lit(1), F.size("breaks") - 1), leg))
    return both.select("trip_I", "day_start_ut", "route_type", "name", F.when(fits, F.array_distinct(along)).otherwise(own).alias("points"))


def longest_trip_per_route(trips: DataFrame) -> DataFrame:
    """(route_I, trip_I, shape_id, duration): of each route the trip that lasts longest, the smallest id of equals."""
    lasting = trips.where("start_time_ds is not null and end_time_ds is not null and route_I is not null").withColumn("duration", F.col("end_time_ds") - F.col("start_time_ds"))
    best = lasting.groupBy("route_I").agg(F.min(F.struct((-F.col("duration")).alias("n"), "trip_I", "shape_id")).alias("b"))
    return best.select("route_I", "b.trip_I", "b.shape_id", (-F.col("b.n")).alias("duration"))


def add_coordinates(rows: DataFrame, stops: DataFrame, column: str = "stop_I", prefix: str = "") -> DataFrame:
    """Rows with the coordinates of a stop column; rows of unknown stops go."""
    where = stops.select(F.col("stop_I").alias(column), F.col("lat").alias(f"{prefix}lat"), F.col("lon").alias(f"{prefix}lon"))
    return rows.join(where, column)


def event_key() -> list[Column]:
    return [F.col(c) for c in ("dep_time_ut", "arr_time_ut", "from_stop_I", "to_stop_I", "trip_I")]
