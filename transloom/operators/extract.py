"""Parts of a feed: by date, agency and place. A feed is a dict of tables; a filter gives a new one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import checkpoint, numbered
from transloom.functions.geo import haversine
from transloom.operators.derive import day_trips, days, resequenced, trip_times

Tables = dict[str, DataFrame]


def _semi(tables: Tables, name: str, column: str, keep: DataFrame, keep_column: str | None = None) -> DataFrame:
    kept = keep.select(F.col(keep_column or column).alias(column)).where(F.col(column).isNotNull()).distinct()
    return tables[name].join(kept, column, "left_semi").select(*tables[name].columns)


def used_stops(stops: DataFrame, stop_times: DataFrame, chain: int = 3) -> DataFrame:
    """Stops that calls use, and their parents up to so many steps."""
    used = checkpoint(stop_times.select("stop_I").where("stop_I is not null").distinct())
    # each stop with its chain of parents, so that one join with the used ones finds them all
    above = stops.select("stop_I", "parent_I").where("stop_I is not null and parent_I is not null").distinct()
    step = used
    every = used
    for _ in range(chain):
        step = above.join(step, "stop_I", "left_semi").select(F.col("parent_I").alias("stop_I"))
        every = every.union(step)
    return stops.join(every.distinct(), "stop_I", "left_semi").select(*stops.columns)


def cascade(tables: Tables, start: str = "trips") -> Tables:
    """Tables without what no longer belongs to the trips: calls, stops, distances, routes, agencies, calendars and dated trips.

    Shapes go if no trip names them; as with SQL's NOT IN, all of them stay while any trip names none.
    """
    out = dict(tables)
    out["stop_times"] = _semi(out, "stop_times", "trip_I", out["trips"])
    out["stops"] = used_stops(out["stops"], out["stop_times"])
    out["routes"] = _semi(out, "routes", "route_I", out["trips"])
    for name in ("days", "day_trips2", "frequencies"):
        if name in out:
            out[name] = _semi(out, name, "trip_I", out["trips"])
    if "stop_distances" in out:
        for c in ("from_stop_I", "to_stop_I"):
            out["stop_distances"] = _semi(out, "stop_distances", c, out["stops"], "stop_I")
    if "agencies" in out:
        out["agencies"] = _semi(out, "agencies", "agency_I", out["routes"])
    for name in ("calendar", "calendar_dates"):
        if name in out and start != "calendar":
            out[name] = _semi(out, name, "service_I", out["trips"])
    if "shapes" in out:
        unnamed = out["trips"].agg(F.coalesce(F.max(F.col("shape_id").isNull()), F.lit(False))).scalar()
        named = out["trips"].select("shape_id").where("shape_id is not null").distinct().withColumn("named_", F.lit(True))
        out["shapes"] = out["shapes"].join(named, "shape_id", "left").where(F.col("named_").isNotNull() | unnamed).select(*tables["shapes"].columns)
    return out


def by_dates(tables: Tables, start: dt.date, end: dt.date) -> Tables:
    """The feed from ``start`` to before ``end``: calendars clipped, dated rows cut, then what belongs to them. Raises ValueError if no day is left."""
    out = dict(tables)
    first, last = F.lit(start), F.lit(end - dt.timedelta(days=1))
    cal = out["calendar"].where((F.col("start_date") <= last) & (F.col("end_date") >= first))
    out["calendar"] = cal.withColumns({"start_date": F.greatest("start_date", first), "end_date": F.least("end_date", last)})
    if "calendar_dates" in out:
        out["calendar_dates"] = out["calendar_dates"].where(F.col("date").between(first, last))
    for name in ("days", "day_trips2"):
        if name in out:
            out[name] = out[name].where(F.col("date").between(first, last))
    if "days" in out and out["days"].isEmpty():
        raise ValueError("no service days between the dates")
    out["trips"] = _semi(out, "trips", "service_I", out["calendar"])
    return cascade(out, "calendar")


def by_agencies(tables: Tables, agency_ids: list[str]) -> Tables:
    """The feed of some agencies; stops stay."""
    out = dict(tables)
    out["agencies"] = out["agencies"].where(F.col("agency_id").isin(agency_ids))
    out["routes"] = _semi(out, "routes", "agency_I", out["agencies"])
    out["trips"] = _semi(out, "trips", "route_I", out["routes"])
    return cascade(out) | {"stops": tables["stops"]}


def inside_stops(stops: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Stops whose distance from a point, in whole metres rounded down, is below the radius."""
    return stops.where(haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)).cast("int") < int(km * 1000))


def cut_calls(stop_times: DataFrame, inside: DataFrame) -> DataFrame:
    """Calls of trips cut to the runs inside: columns of stop_times and part, null for a trip that stays one.

    A trip is cut to its first to last call inside; if calls outside remain between, each run of two or more calls inside is a part
    of its own. Trips with fewer than two different call numbers inside have none.
    """
    own = Window.partitionBy("trip_I")
    marked = stop_times.join(inside.select("stop_I").distinct().withColumn("inside", F.lit(True)), "stop_I", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    at = F.when(F.col("inside"), F.col("seq"))
    bounded = marked.withColumns({"lo": F.min(at).over(own), "hi": F.max(at).over(own)}).where("seq between lo and hi and lo < hi")
    order = Window.partitionBy("trip_I").orderBy("seq", *(["stop_time_I"] if "stop_time_I" in stop_times.columns else []))
    runs = bounded.withColumns({"outside_before": F.sum((~F.col("inside")).cast("int")).over(order), "any_outside": F.max(~F.col("inside")).over(own)})
    sized = runs.where("inside").withColumn("n_run", F.count("*").over(Window.partitionBy("trip_I", "outside_before")))
    kept = sized.where("not any_outside or n_run >= 2")
    numbered = kept.withColumn("part", F.when(F.col("any_outside"), F.dense_rank().over(Window.partitionBy("trip_I").orderBy("outside_before")) - 1))
    return numbered.select(*stop_times.columns, "part")


def by_place(tables: Tables, lat: float, lon: float, km: float) -> Tables:
    """The feed within a radius: trips cut to what lies inside and split where they leave and return (<trip_id>_splitted_part_<i>, without shape), shapes that leave the radius removed, then what belongs to the trips.

    Trips with fewer than two different stops left go.
    """
    out = dict(tables)
    inside = inside_stops(out["stops"], lat, lon, km)
    cut = checkpoint(cut_calls(out["stop_times"], inside))
    parts = cut.select("trip_I", "part").distinct()
    top = out["trips"].agg(F.coalesce(F.max("trip_I"), F.lit(0))).scalar()
    whole = parts.where("part is null").select("trip_I", "part", F.col("trip_I").alias("new_I"))
    split = numbered(parts.where("part is not null"), ["trip_I", "part"], "new_I").withColumn("new_I", top + F.col("new_I"))
    names = whole.unionByName(split)
    named = out["trips"].join(names, "trip_I")
    is_part = F.col("part").isNotNull()
    shown = {
        "trip_I": F.col("new_I"), "trip_id": F.when(is_part, F.concat("trip_id", F.lit("_splitted_part_"), F.col("part"))).otherwise(F.col("trip_id")),
        "shape_id": F.when(~is_part, F.col("shape_id")), "start_time_ds": F.when(~is_part, F.col("start_time_ds")), "end_time_ds": F.when(~is_part, F.col("end_time_ds")),
    }
    trips = named.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in out["trips"].columns])
    renamed = names.select(F.col("trip_I").alias("old_I"), F.col("part").alias("of_part"), "new_I")
    calls = cut.join(renamed, (F.col("trip_I") == F.col("old_I")) & F.col("part").eqNullSafe(F.col("of_part"))).select(*[F.col("new_I").alias(c) if c == "trip_I" else F.col(c) for c in out["stop_times"].columns])
    lasting = calls.groupBy("trip_I").agg(F.countDistinct("stop_I").alias("n")).where("n > 1")
    out["trips"], out["stop_times"] = checkpoint(trips.join(lasting, "trip_I", "left_semi").select(*out["trips"].columns)), checkpoint(calls)
    if "shapes" in out:
        leaving = out["shapes"].where(haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) >= km * 1000).select("shape_id").distinct()
        out["shapes"] = out["shapes"].join(leaving, "shape_id", "left_anti").select(*tables["shapes"].columns)
        left = out["shapes"].select("shape_id").distinct().withColumn("left_", F.lit(True))
        out["trips"] = out["trips"].join(left, "shape_id", "left").withColumn("shape_id", F.when(F.col("left_"), F.col("shape_id"))).select(*tables["trips"].columns)
    for name in ("days", "day_trips2"):
        out.pop(name, None)
    return cascade(out)


def touching_place(tables: Tables, lat: float, lon: float, km: float) -> Tables:
    """The feed without the trips that have no call within a radius."""
    out = dict(tables)
    touching = out["stop_times"].join(inside_stops(out["stops"], lat, lon, km).select("stop_I"), "stop_I", "left_semi")
    out["trips"] = _semi(out, "trips", "trip_I", touching)
    return cascade(out)


def rebuilt(tables: Tables, tz: str = "UTC") -> Tables:
    """Derived tables made again: trip times, call numbers, days and dated trips."""
    out = dict(tables)
    out["stop_times"] = resequenced(out["stop_times"])
    out["trips"] = trip_times(out["trips"], out["stop_times"]).select(*tables["trips"].columns)
    out["days"] = days(out["trips"], out["calendar"], out.get("calendar_dates"), tz)
    out["day_trips2"] = day_trips(out["days"], out["trips"])
    return out
