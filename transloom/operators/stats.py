"""Statistics of a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.functions.geo import haversine


def trip_counts_per_day(day_trips: DataFrame) -> DataFrame:
    """(date, trip_counts) from the first to the last date with trips, days between without trips as 0."""
    counted = day_trips.groupBy("date").agg(F.count("*").alias("n"))
    span = counted.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return span.join(counted, "date", "left").select("date", F.coalesce("n", F.lit(0)).cast("long").alias("trip_counts"))


def suitable_date(counts: DataFrame, share: float = 0.9) -> DataFrame:
    """(date): the first date with at least ``share`` of the busiest date's trips; no row without dates."""
    top = counts.agg(F.max("trip_counts")).scalar()
    return counts.where(F.col("trip_counts") >= share * top).agg(F.min("date").alias("date")).where("date is not null")


def weekly_start(counts: DataFrame, after, share: float = 0.9) -> DataFrame:
    """(date): a Monday whose Monday to Friday all have more than ``share`` of the 95th percentile of the daily counts.

    The first of those after ``after`` with seven days left is taken, else the last before it.
    """
    limit = counts.agg(F.percentile("trip_counts", 0.95)).scalar()
    ahead = Window.orderBy("date").rowsBetween(0, 4)  # one row a day: as many as the feed has days
    marked = counts.withColumns({"ok": F.min((F.col("trip_counts") > share * limit).cast("int")).over(ahead), "last": F.max("date").over(Window.partitionBy())})
    mondays = marked.where("weekday(date) = 0 and ok = 1 and date_add(date, 6) <= last")
    after = F.lit(after).cast("date")
    ranked = mondays.withColumns({"late": F.col("date") > after, "far": F.abs(F.datediff("date", after))})
    return ranked.orderBy(F.desc("late"), "far").limit(1).select("date")


def value_counts(table: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column; null is a value."""
    return table.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def stop_bounds(stops: DataFrame) -> DataFrame:
    return stops.agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


def stop_percentiles(stops: DataFrame, percents: tuple[int, ...] = (0, 10, 50, 90, 100)) -> DataFrame:
    """(percent, lat, lon) with linear interpolation."""
    shares = F.array(*[F.lit(p / 100) for p in percents])
    both = stops.agg(F.percentile("lat", shares).alias("lats"), F.percentile("lon", shares).alias("lons"))
    zipped = F.arrays_zip(F.array(*[F.lit(p) for p in percents]).alias("percent"), F.col("lats").alias("lat"), F.col("lons").alias("lon"))
    return both.select(F.explode(zipped).alias("z")).select("z.percent", "z.lat", "z.lon")


def stop_centre(stops: DataFrame) -> DataFrame:
    """Medians and means of the stops' coordinates."""
    return stops.agg(F.median("lat").alias("lat_median"), F.median("lon").alias("lon_median"), F.avg("lat").alias("lat_mean"), F.avg("lon").alias("lon_mean"))


def bounding_box(stops: DataFrame, buffer_ratio: float = 0.0) -> DataFrame:
    """The box of given stops, grown on every side by a share of its diagonal's degrees."""
    box = stop_bounds(stops)
    grow = F.hypot(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min")) * buffer_ratio
    return box.select((F.col("lon_min") - grow).alias("lon_min"), (F.col("lon_max") + grow).alias("lon_max"), (F.col("lat_min") - grow).alias("lat_min"), (F.col("lat_max") + grow).alias("lat_max"))


def extent_km(stops: DataFrame) -> DataFrame:
    """Height at the middle longitude and width at the median latitude, in km, between the 0th and 100th percentile."""
    b = stops.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.median("lat").alias("m"), F.median("lon").alias("n"))
    height = haversine(F.col("a"), F.col("n"), F.col("b"), F.col("n")) / 1000
    return b.select(height.alias("height_km"), (haversine(F.col("m"), F.col("c"), F.col("m"), F.col("d")) / 1000).alias("width_km"))


def trip_stats(pairs: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(trip_I, type, total_distance km, total_traveltime min, avg_speed_kmh) per trip, arrival to arrival; trips that take no time are left out."""
    located = _with_distance(pairs, stops)
    per = located.groupBy("trip_I").agg((F.sum("distance") / 1000).alias("total_distance"), (F.sum("travel_s") / 60).alias("total_traveltime"))
    typed = trips.select("trip_I", "route_I").join(routes.select("route_I", "type"), "route_I").drop("route_I")
    return per.where("total_traveltime <> 0").join(typed, "trip_I").select("trip_I", "type", "total_distance", "total_traveltime", (60 * F.col("total_distance") / F.col("total_traveltime")).alias("avg_speed_kmh"))


def _with_distance(pairs: DataFrame, stops: DataFrame) -> DataFrame:
    a, b = (stops.select(F.col("stop_I").alias(f"{s}_stop_I"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon")) for s in ("from", "to"))
    located = pairs.join(a, "from_stop_I").join(b, "to_stop_I")
    d = haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")).cast("int")
    return located.withColumns({"distance": d, "travel_s": F.col("arr_time_ds") - F.col("from_arr_ds")})


def section_stats(pairs: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(from_stop_I, to_stop_I, type, distance, n_trips, min, max and mean travel minutes) per section and type.

    Pairs are reduced to sections before stops are joined.
    """
    typed = trips.select("trip_I", "route_I").join(routes.select("route_I", "type"), "route_I").drop("route_I")
    travel = (F.col("arr_time_ds") - F.col("from_arr_ds")) / 60
    per = pairs.join(typed, "trip_I").groupBy("from_stop_I", "to_stop_I", "type").agg(
        F.count("*").alias("n_trips"), F.min(travel).alias("min_time"), F.max(travel).alias("max_time"), (F.sum(F.col("arr_time_ds") - F.col("from_arr_ds")) / F.count("*") / 60).alias("mean_time")
    )
    located = _with_distance(per.withColumns({"arr_time_ds": F.lit(0), "from_arr_ds": F.lit(0)}), stops)
    return located.select("from_stop_I", "to_stop_I", "type", "distance", "n_trips", "min_time", "max_time", "mean_time")


def route_frequencies(day_trips: DataFrame, trips: DataFrame, routes: DataFrame, date: DataFrame) -> DataFrame:
    """(route_I, type, name, frequency): trips of each route on the given day."""
    on_day = day_trips.join(date, "date", "left_semi").select("trip_I").join(trips.select("trip_I", "route_I"), "trip_I")
    return on_day.groupBy("route_I").agg(F.countDistinct("trip_I").alias("frequency")).join(routes.select("route_I", "type", "name"), "route_I").select("route_I", "type", "name", "frequency")


def hourly_departures(stop_times: DataFrame, day_trips: DataFrame, date: DataFrame, stops: DataFrame, start_ds: int, end_ds: int) -> DataFrame:
    """(stop_I, frequency): departures an hour of each of the given stops strictly between two seconds of the day."""
    today = day_trips.join(date, "date", "left_semi").select("trip_I")
    inside = stop_times.where((F.col("dep_time_ds") > start_ds) & (F.col("dep_time_ds") < end_ds)).select("stop_I", "trip_I").join(today, "trip_I")
    return inside.groupBy("stop_I").agg((F.count("*") / ((end_ds - start_ds) / 3600)).alias("frequency")).join(stops.select("stop_I"), "stop_I", "left_semi")


def generated_routes(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, day_trips: DataFrame, date: DataFrame, start_ds: int, end_ds: int) -> DataFrame:
    """(stop_sequence, type, n_trips, frequency): trips of the day that start in the half-open time, grouped by the stops they call at in order."""
    chosen = trips.where((F.col("start_time_ds") >= start_ds) & (F.col("start_time_ds") < end_ds)).join(day_trips.join(date, "date", "left_semi").select("trip_I"), "trip_I", "left_semi")
    tie = ["stop_time_I"] if "stop_time_I" in stop_times.columns else []
    lines = stop_times.where("stop_I is not null").join(chosen.select("trip_I"), "trip_I", "left_semi").groupBy("trip_I").agg(F.array_sort(F.collect_list(F.struct("seq", *tie, "stop_I"))).alias("calls"))
    named = lines.select("trip_I", F.array_join(F.transform("calls", lambda c: c["stop_I"].cast("string")), ",").alias("stop_sequence"))
    typed = named.join(chosen.select("trip_I", "route_I"), "trip_I").join(routes.select("route_I", "type"), "route_I")
    return typed.groupBy("stop_sequence").agg(F.count("*").alias("n_trips"), F.min("type").alias("type"), (F.count("*") / ((end_ds - start_ds) / 3600)).alias("frequency"))


def departure_stops(stop_times: DataFrame, trips: DataFrame, day_trips: DataFrame, date: DataFrame, start_ds: int, end_ds: int) -> DataFrame:
    """(stop_I, n_starts): trips of the day that begin at each stop within the half-open time."""
    chosen = trips.where((F.col("start_time_ds") >= start_ds) & (F.col("start_time_ds") < end_ds)).join(day_trips.join(date, "date", "left_semi").select("trip_I"), "trip_I", "left_semi")
    tie = ["stop_time_I"] if "stop_time_I" in stop_times.columns else []
    first = stop_times.join(chosen.select("trip_I"), "trip_I", "left_semi").groupBy("trip_I").agg(F.min(F.struct("seq", *tie, "stop_I")).alias("f"))
    return first.groupBy(F.col("f.stop_I").alias("stop_I")).agg(F.count("*").alias("n_starts"))


def vehicle_hours(day_trips: DataFrame, trips: DataFrame, routes: DataFrame, date: DataFrame) -> DataFrame:
    """(type, vehicle_hours): whole hours that vehicles of each type move on the day."""
    today = day_trips.join(date, "date", "left_semi").join(trips.select("trip_I", "route_I"), "trip_I").join(routes.select("route_I", "type"), "route_I")
    return today.groupBy("type").agg(F.expr("sum(end_time_ut - start_time_ut) div 3600").alias("vehicle_hours"))


def stop_pair_counts(pairs: DataFrame) -> DataFrame:
    """(from_stop_I, to_stop_I, n): how often the timetable has each pair of consecutive stops."""
    return pairs.groupBy("from_stop_I", "to_stop_I").agg(F.count("*").alias("n"))


def busiest_hour(day_trips: DataFrame, stop_times: DataFrame, date: DataFrame) -> DataFrame:
    """(hour, n_departures): the hour of the day with the most departures, the first of equals."""
    today = day_trips.join(date, "date", "left_semi").select("trip_I")
    per = stop_times.where("dep_time_ds is not null").join(today, "trip_I").groupBy(F.expr("dep_time_ds div 3600").alias("hour")).agg(F.count("*").alias("n_departures"))
    return per.agg(F.min(F.struct((-F.col("n_departures")).alias("n"), "hour")).alias("b")).where("b is not null").select("b.hour", (-F.col("b.n")).alias("n_departures"))


def fleet_in_motion(trips: DataFrame, routes: DataFrame, day_trips: DataFrame, date: DataFrame, hour: int) -> DataFrame:
    """(type, vehicles): the most trips of a type under way at once in the minutes of an hour (started by the minute, ending more than a minute after)."""
    today = day_trips.join(date, "date", "left_semi").select("trip_I").join(trips, "trip_I").join(routes.select("route_I", "type"), "route_I")
    lo, hi = hour * 3600, hour * 3600 + 3540
    # the minutes of the hour at which a trip counts, as a range of minute numbers: no range join
    first = F.greatest(F.lit(0), F.ceil((F.col("start_time_ds") - lo) / 60))
    last = F.least(F.lit(59), F.ceil((F.col("end_time_ds") - 60 - lo) / 60) - 1)
    under_way = today.where((F.col("start_time_ds") <= hi) & (F.col("end_time_ds") > lo + 60)).select("type", first.cast("int").alias("a"), last.cast("int").alias("b")).where("a <= b")
    minutes = under_way.select("type", F.explode(F.sequence("a", "b")).alias("minute"))
    return minutes.groupBy("type", "minute").agg(F.count("*").alias("n")).groupBy("type").agg(F.max("n").alias("vehicles"))


def fleet_by_route(trips: DataFrame, routes: DataFrame, day_trips: DataFrame, date: DataFrame, hour: int) -> DataFrame:
    """(type, vehicles): vehicles that one cycle of every route takes, first trip of the hour to the end of its first return, the larger direction."""
    today = day_trips.join(date, "date", "left_semi").select("trip_I").join(trips, "trip_I").where("route_I is not null and direction_id is not null")
    key = lambda *c: F.min(F.struct(*c))
    out = today.where((F.col("start_time_ds") >= hour * 3600) & (F.col("start_time_ds") <= (hour + 1) * 3600)).groupBy("route_I", "direction_id").agg(key("start_time_ds", "end_time_ds").alias("f"))
    first = out.select("route_I", F.col("direction_id").alias("out_direction"), F.col("f.start_time_ds").alias("out_start"), F.col("f.end_time_ds").alias("out_end"))
    back = first.join(trips.where("direction_id is not null").select("route_I", "direction_id", "start_time_ds", "end_time_ds"), "route_I").where("out_direction <> direction_id and start_time_ds >= out_end")
    cycle = back.groupBy("route_I", "direction_id").agg(F.min(F.struct("start_time_ds", "end_time_ds", "out_start")).alias("r")).select("route_I", "direction_id", F.col("r.out_start").alias("lo"), F.col("r.end_time_ds").alias("hi"))
    used = today.join(cycle, ["route_I", "direction_id"]).where("start_time_ds >= lo and start_time_ds < hi").join(routes.select("route_I", "type"), "route_I")
    return used.groupBy("type", "direction_id").agg(F.count("*").alias("n")).groupBy("type").agg(F.max("n").alias("vehicles"))


def calendar_spans(day_trips: DataFrame, trips: DataFrame) -> DataFrame:
    """(feed, first_date, last_date, n_trips) by the feed that a trip's id names."""
    feed = F.regexp_extract("trip_id", r"^feed_(\d+)_", 1)
    per_trip = day_trips.groupBy("trip_I").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return per_trip.join(trips.select("trip_I", feed.alias("feed")), "trip_I").groupBy("feed").agg(F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), F.count("*").alias("n_trips"))


def feed_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, value): row counts, bounds and spans of a feed as text, one row each."""
    rows = [t.agg(F.lit(f"n_{n}").alias("name"), F.count("*").cast("string").alias("value")) for n, t in tables.items()]
    if "stops" in tables:
        rows += [tables["stops"].agg(F.lit(f"{c}_{m}").alias("name"), F.round(f(c), 6).cast("string").alias("value")) for c in ("lat", "lon") for m, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    if "calendar" in tables:
        rows += [tables["calendar"].agg(F.lit("start_date").alias("name"), F.min("start_date").cast("string").alias("value")), tables["calendar"].agg(F.lit("end_date").alias("name"), F.max("end_date").cast("string").alias("value"))]
    first, *rest = rows
    for other in rest:
        first = first.unionByName(other)
    return first
