"""From a calendar-encoded timetable to dated trips: derived tables of a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import numbered as numbered_rows
from transloom.functions.geo import haversine
from transloom.functions.timetable import day_start_ut
from transloom.operators.proximity import VoronoiPartition
from transloom.operators.sequence import with_number

WEEKDAYS = ("m", "t", "w", "th", "f", "s", "su")


def resequenced(stop_times: DataFrame, tie: str = "stop_time_I", **settings) -> DataFrame:
    """stop_times with seq 1..n per trip in the order of the given seq, ties by ``tie``; a trip with very many calls is not one task's."""
    order = ["seq", *([tie] if tie in stop_times.columns else [])]
    return with_number(stop_times, "trip_I", order, "new_seq_", **settings).withColumn("seq", F.col("new_seq_")).drop("new_seq_")


def trip_times(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """trips with start_time_ds and end_time_ds from their first departure and last arrival, as numbers; null without calls."""
    bounds = stop_times.groupBy("trip_I").agg(F.min("dep_time_ds").alias("start_time_ds"), F.max("arr_time_ds").alias("end_time_ds"))
    return trips.drop("start_time_ds", "end_time_ds").join(bounds, "trip_I", "left")


def service_dates(calendar: DataFrame, calendar_dates: DataFrame | None = None) -> DataFrame:
    """(service_I, date): dates in a service's span with its weekday set and no removal, and every added date (not de-duplicated)."""
    span = calendar.where("start_date <= end_date").select("service_I", F.array(*WEEKDAYS).alias("flags"), F.explode(F.sequence("start_date", "end_date")).alias("date"))
    regular = span.where("flags[weekday(date)] = 1").select("service_I", "date")
    if calendar_dates is None:
        return regular
    removed = calendar_dates.where("exception_type = 2").select("service_I", "date").distinct()
    added = calendar_dates.where("exception_type = 1").select("service_I", "date")
    return regular.join(removed, ["service_I", "date"], "left_anti").unionByName(added)


def days(trips: DataFrame, calendar: DataFrame, calendar_dates: DataFrame | None = None, tz: str = "UTC") -> DataFrame:
    """(date, day_start_ut, trip_I) of every trip on every date of its service."""
    dates = service_dates(calendar, calendar_dates).withColumn("day_start_ut", day_start_ut(F.col("date"), tz))
    return dates.join(trips.select("service_I", "trip_I"), "service_I").select("date", "day_start_ut", "trip_I")


def day_trips(days_: DataFrame, trips: DataFrame) -> DataFrame:
    """Dated trips (date, trip_I, start_time_ut, end_time_ut, day_start_ut) without those that lack a time."""
    bounds = trips.where("start_time_ds is not null and end_time_ds is not null").select("trip_I", "start_time_ds", "end_time_ds")
    return days_.join(bounds, "trip_I").select("date", "trip_I", (F.col("day_start_ut") + F.col("start_time_ds")).alias("start_time_ut"), (F.col("day_start_ut") + F.col("end_time_ds")).alias("end_time_ut"), "day_start_ut")


def expand_frequencies(trips: DataFrame, stop_times: DataFrame, frequencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trips, stop_times) with each headway-based trip replaced by one trip per departure.

    A period gives departures from its start, its end excluded, each named <trip_id>_freq_<start>. The calls of the template move as
    a whole: arrivals by the start less the earliest arrival, departures by the start less the earliest departure. Templates go.
    Template trips without calls raise an error. Ids of the new trips continue those of the others in order of template and start.
    """
    made = frequencies.where("headway_secs > 0 and start_time_ds < end_time_ds").select(
        "trip_I", F.explode(F.sequence(F.col("start_time_ds"), F.col("end_time_ds") - 1, F.col("headway_secs"))).alias("start")
    )
    template = stop_times.join(frequencies.select("trip_I").distinct(), "trip_I", "left_semi")
    least = template.groupBy("trip_I").agg(F.min("arr_time_ds").alias("arr0"), F.min("dep_time_ds").alias("dep0"), F.max("arr_time_ds").alias("arr1"))
    checked = made.join(least, "trip_I", "left").withColumn("dep0", F.when(F.col("dep0").isNull(), F.raise_error(F.lit("a trip with a headway has no calls")).cast("int")).otherwise(F.col("dep0")))
    top = trips.agg(F.coalesce(F.max("trip_I"), F.lit(0))).scalar()
    numbered = numbered_rows(checked, ["trip_I", "start"], "k").withColumn("new_I", top + F.col("k"))
    new_trips = numbered.join(trips, "trip_I").select(
        *[
            F.col("new_I").alias("trip_I") if c == "trip_I" else F.concat("trip_id", F.lit("_freq_"), F.col("start")).alias(c) if c == "trip_id"
            else F.col("start").cast("int").alias(c) if c == "start_time_ds" else (F.col("start") + F.col("arr1") - F.col("dep0")).cast("int").alias(c) if c == "end_time_ds" else F.col(c)
            for c in trips.columns
        ]
    )
    moved = {"arr_time_ds": F.col("arr_time_ds") - F.col("arr0") + F.col("start"), "dep_time_ds": F.col("dep_time_ds") - F.col("dep0") + F.col("start")}
    new_calls = template.join(numbered.select("trip_I", "new_I", "start", "arr0", "dep0"), "trip_I").select(
        *[F.col("new_I").alias(c) if c == "trip_I" else moved[c].cast("int").alias(c) if c in moved else F.col(c) for c in stop_times.columns]
    )
    templates = frequencies.select("trip_I").distinct()
    return trips.join(templates, "trip_I", "left_anti").unionByName(new_trips), stop_times.join(templates, "trip_I", "left_anti").unionByName(new_calls)


def shape_distances(shapes: DataFrame) -> DataFrame:
    """shapes with seq from 0 and the whole metres d along the line."""
    along = Window.partitionBy("shape_id").orderBy("seq")
    step = F.coalesce(haversine(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon")), F.lit(0.0))
    return shapes.withColumns({"step": step, "new_seq": F.row_number().over(along) - 1}).withColumn("d", F.sum("step").over(along).cast("int")).drop("step", "seq").withColumnRenamed("new_seq", "seq")


def stop_distances(stops: DataFrame, metres: float = 1000.0, transfers: DataFrame | None = None) -> DataFrame:
    """(from_stop_I, to_stop_I, d, d_walk, min_transfer_time, timed_transfer): ordered pairs of stops at most so far apart, whole metres rounded up; rules of transfers added.

    A rule of kind 2 sets min_transfer_time, of kind 1 a timed transfer of no time, of kind 3 takes the pair out; rules of a stop to
    itself change nothing. A pair that only a rule names gets its distance rounded down.
    """
    near = VoronoiPartition(stops, "stop_I", "lat", "lon", metres).near_pairs().withColumn("d", F.ceil("d").cast("int"))
    both = near.select(F.col("key_a").alias("from_stop_I"), F.col("key_b").alias("to_stop_I"), "d").unionByName(near.select(F.col("key_b").alias("from_stop_I"), F.col("key_a").alias("to_stop_I"), "d"))
    if transfers is None:
        return both.select("*", *[F.lit(None).cast("int").alias(c) for c in ("d_walk", "min_transfer_time", "timed_transfer")])
    rules = transfers.where("from_stop_I <> to_stop_I").groupBy("from_stop_I", "to_stop_I").agg(
        F.max(F.when(F.col("transfer_type") == 2, F.col("min_transfer_time"))).alias("least"), F.max((F.col("transfer_type") == 2).cast("int")).alias("two"),
        F.max((F.col("transfer_type") == 1).cast("int")).alias("one"), F.max((F.col("transfer_type") == 3).cast("int")).alias("never"),
    )
    joined = both.join(rules, ["from_stop_I", "to_stop_I"], "full").where("coalesce(never, 0) = 0 and (d is not null or one = 1 or two = 1)")
    a, b = (stops.select(F.col("stop_I").alias(f"{s}_stop_I"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon")) for s in ("from", "to"))
    located = joined.join(a, "from_stop_I", "left").join(b, "to_stop_I", "left")
    apart = haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")).cast("int")
    return located.select(
        "from_stop_I", "to_stop_I", F.coalesce("d", apart).alias("d"), F.lit(None).cast("int").alias("d_walk"),
        F.when(F.col("one") == 1, 0).otherwise(F.col("least")).cast("int").alias("min_transfer_time"), F.when(F.col("one") == 1, 1).cast("int").alias("timed_transfer"),
    )
