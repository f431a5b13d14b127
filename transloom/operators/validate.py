"""Checks of a feed: each gives rows of what is wrong, summaries are (warning, count)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.functions.geo import haversine
from transloom.operators.events import calls_with_next
from transloom.operators.sequence import with_next
from transloom.schema import MAX_SPEED, MUST_HAVE, SHOULD_HAVE

#: Limits of plausible timetables.
MAX_SPACING_M, MAX_SPACING_S, MAX_TRIP_S, SAME_TIME_STOPS = 20_000, 1_800, 7_200, 5


def null_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, severity, n_rows): rows with a null in a column that must, or should, have a value; every table is read once."""
    made = []
    for name, table in tables.items():
        checks = [(s, [c for c in columns.get(name, ()) if c in table.columns]) for s, columns in (("must", MUST_HAVE), ("should", SHOULD_HAVE))]
        counts = [(s, F.count(F.when(reduce(Column.__or__, [F.col(c).isNull() for c in cols]), 1))) for s, cols in checks if cols]
        if counts:
            rows = table.agg(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(s).alias("severity"), n.alias("n_rows")) for s, n in counts]).alias("r"))
            made.append(rows.select(F.inline("r")))
    return reduce(DataFrame.unionByName, made)


def danglers(tables: dict[str, DataFrame]) -> DataFrame:
    """(warning, n_rows): rows that refer to nothing or that nothing refers to."""
    stops, calls, trips, routes, calendar = (tables[t] for t in ("stops", "stop_times", "trips", "routes", "calendar"))
    keys = lambda df, c, as_: df.select(F.col(c).alias(as_)).where(F.col(as_).isNotNull()).distinct()
    found = {
        "stops without calls or children": stops.join(keys(calls, "stop_I", "stop_I"), "stop_I", "left_anti").join(keys(stops, "parent_I", "stop_I"), "stop_I", "left_anti"),
        "calls without stop": calls.join(keys(stops, "stop_I", "stop_I"), "stop_I", "left_anti"),
        "calls without trip": calls.join(keys(trips, "trip_I", "trip_I"), "trip_I", "left_anti"),
        "trips without calls": trips.join(keys(calls, "trip_I", "trip_I"), "trip_I", "left_anti"),
        "trips without service": trips.where("service_I is null"),
        "trips without route": trips.join(keys(routes, "route_I", "route_I"), "route_I", "left_anti"),
        "trips without calendar": trips.join(keys(calendar, "service_I", "service_I"), "service_I", "left_anti"),
        "routes without trips": routes.join(keys(trips, "route_I", "route_I"), "route_I", "left_anti"),
    }
    if "days" in tables:
        found["trips without days"] = trips.join(keys(tables["days"], "trip_I", "trip_I"), "trip_I", "left_anti")
        found["days without trip"] = tables["days"].join(keys(trips, "trip_I", "trip_I"), "trip_I", "left_anti")
    return reduce(DataFrame.unionByName, [df.agg(F.lit(w).alias("warning"), F.count("*").alias("n_rows")) for w, df in found.items()])


def row_count_differences(source: dict[str, int], tables: dict[str, DataFrame]) -> list[tuple[str, int, int]]:
    """(table, rows in the source, rows loaded) where they differ."""
    counted = {n: tables[n].count() for n in source if n in tables}
    return [(n, source[n], counted[n]) for n in counted if source[n] != counted[n]]


def frequency_trip_count(frequencies: DataFrame) -> DataFrame:
    """(n_trips): departures that all headways make."""
    return frequencies.agg(F.coalesce(F.sum(F.ceil((F.col("end_time_ds") - F.col("start_time_ds")) / F.col("headway_secs"))), F.lit(0)).cast("long").alias("n_trips"))


def same_time_groups(stop_times: DataFrame, least: int = SAME_TIME_STOPS) -> DataFrame:
    """(trip_I, arr_time_ds, n_stops): at least so many calls of a trip at the same time."""
    return stop_times.where("arr_time_ds is not null").groupBy("trip_I", "arr_time_ds").agg(F.count("*").alias("n_stops")).where(F.col("n_stops") >= least)


def _moves(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    a, b = (stops.select(F.col("stop_I").alias(f"{s}stop_I"), F.col("lat").alias(f"{s}lat"), F.col("lon").alias(f"{s}lon")) for s in ("", "next_"))
    paired = calls_with_next(stop_times, order=["seq"]).where("next_stop_I is not null")
    apart = haversine(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")).cast("int")
    return paired.join(a, "stop_I").join(b, "next_stop_I").withColumns({"metres": apart, "seconds": F.col("next_arr_time_ds") - F.col("dep_time_ds")})


def spacing_violations(stop_times: DataFrame, stops: DataFrame, metres: int = MAX_SPACING_M, seconds: int = MAX_SPACING_S) -> DataFrame:
    """(trip_I, seq, stop_I, next_stop_I, metres, seconds): consecutive calls too far apart in place or time."""
    return _moves(stop_times, stops).where((F.col("metres") > metres) | (F.col("seconds") > seconds)).select("trip_I", "seq", "stop_I", "next_stop_I", "metres", "seconds")


def speed_violations(stats: DataFrame) -> DataFrame:
    """(trip_I, type, reason) of trip_stats rows faster than their type can be, or longer than two hours."""
    limits = F.create_map(*[F.lit(x) for pair in MAX_SPEED.items() for x in pair])
    fast = stats.where(F.col("avg_speed_kmh") > limits[F.col("type")]).select("trip_I", "type", F.lit("speed").alias("reason"))
    return fast.unionByName(stats.where(F.col("total_traveltime") * 60 > MAX_TRIP_S).select("trip_I", "type", F.lit("duration").alias("reason")))


def sequence_violations(stop_times: DataFrame) -> DataFrame:
    """(trip_I, seq, next_seq, reason): in order of departure, calls whose number falls ('order') or does not go up by one ('increment')."""
    tie = ["stop_time_I"] if "stop_time_I" in stop_times.columns else []
    paired = with_next(stop_times.where("dep_time_ds is not null and trip_I is not null"), ["trip_I"], ["dep_time_ds", "seq", *tie], ["seq"]).where("next_seq is not null")
    reason = F.when(F.col("next_seq") < F.col("seq"), "order").when(F.col("next_seq") != F.col("seq") + 1, "increment")
    return paired.select("trip_I", "seq", "next_seq", reason.alias("reason")).where("reason is not null")


def misplaced_stops(stops: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Stops farther than the radius and a little more (0.2 %) from a point."""
    return stops.where(haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) > km * 1000 * 1.002)


def check_import(source_counts: dict[str, int], tables: dict[str, DataFrame]) -> Warnings:
    """Warnings of an import: tables with another number of rows than their source, nulls, and references that lead nowhere."""
    found = Warnings()
    for name, expected, loaded in row_count_differences(source_counts, tables):
        found.add(f"rows of {name} differ from the source", (expected, loaded), abs(expected - loaded))
    for r in null_counts(tables).collect():
        found.add(f"nulls in columns of {r.table_name} that {r.severity} have a value", None, r.n_rows)
    for r in danglers(tables).collect():
        found.add(r.warning, None, r.n_rows)
    return found


def check_timetable(tables: dict[str, DataFrame], trip_stats: DataFrame, place: tuple[float, float, float] | None = None) -> Warnings:
    """Warnings of a timetable, each with the rows it is about: spacing, speed, order, calls at one time, and stops outside of a place (lat, lon, km) if given."""
    stops, calls = tables["stops"], tables["stop_times"]
    checks = {"consecutive calls far apart": spacing_violations(calls, stops), "calls of a trip at one time": same_time_groups(calls), "call numbers out of order": sequence_violations(calls), "trips too fast or too long": speed_violations(trip_stats)}
    if place is not None:
        checks["stops outside of the place"] = misplaced_stops(stops, *place)
    found = Warnings()
    for warning, rows in checks.items():
        found.add(warning, rows, rows.count())
    return found


class Warnings:
    """Warnings of checks, counted and kept with their rows."""

    def __init__(self) -> None:
        self._counts: dict[str, int] = {}
        self._reasons: list[tuple[str, object]] = []

    def add(self, warning: str, reason: object, count: int | None = None) -> None:
        """Count a warning once, or as often as said; none is no warning."""
        if count != 0:
            self._counts[warning] = self._counts.get(warning, 0) + (1 if count is None else count)
            self._reasons.append((warning, reason))

    def counts(self) -> dict[str, int]:
        return dict(sorted(self._counts.items(), key=lambda item: -item[1]))

    def reasons(self) -> list[tuple[str, object]]:
        return list(self._reasons)

    def rows(self, warning: str) -> list:
        """What was given as reason for a warning: tables of rows, or single reasons."""
        return [reason for w, reason in self._reasons if w == warning]

    def write_summary(self, stream) -> None:
        """The counts, most frequent first, a line each."""
        stream.write(self.summary() + "\n" if self._counts else "no warnings\n")

    def write_details(self, stream, most: int = 20) -> None:
        """The counts, each followed by its reasons; of a table of rows so many are shown."""
        for warning, n in self.counts().items():
            stream.write(f"{n}\t{warning}\n")
            for reason in self.rows(warning):
                for line in reason.limit(most).collect() if isinstance(reason, DataFrame) else [reason]:
                    if line is not None:
                        stream.write(f"\t{line}\n")

    def summary(self) -> str:
        return "\n".join(f"{n}\t{w}" for w, n in self.counts().items())

    def clear(self) -> None:
        self._counts.clear()
        self._reasons.clear()
