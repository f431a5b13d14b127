"""Journeys and their legs: components, alternatives, and changes between two timetables.

Journeys: journey_id, from_stop_I, to_stop_I, departure_time, arrival_time_target, n_boardings, route (array of routes).
Legs: journey_id, seq, from_stop_I, to_stop_I, departure_time, arrival_time_target, trip_I (below 0 for a walk), leg_stops (array).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import checkpoint, numbered, release
from transloom.operators.pareto import time_front

OD = ["from_stop_I", "to_stop_I"]


def unfolded(labels: DataFrame, rides: DataFrame, conns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journeys, legs) of the labels of a profile scan, followed ride by ride.

    Journeys: journey_id, from_stop_I, to_stop_I (the target), departure_time, arrival_time_target, n_boardings, movement_duration.
    Legs: journey_id, seq, from_stop_I, to_stop_I, departure_time, arrival_time_target, trip_I (-1 for a walk), leg_stops. Journeys
    from a target to itself and walks of no length are left out. Ids follow target, stop and times.
    """
    trip_type = dict(labels.dtypes)["trip_id"]
    ids = checkpoint(numbered(labels.where(~F.col("stop").eqNullSafe(F.col("target"))), ["target", "stop", "departure_time", "arrival_time_target", "n_boardings"], "journey_id"))
    journeys = ids.select("journey_id", F.col("stop").alias("from_stop_I"), F.col("target").alias("to_stop_I"), "departure_time", "arrival_time_target", "n_boardings", F.col("movement").alias("movement_duration"))
    walk = lambda a, b, t, d, seq: (a.alias("from_stop_I"), b.alias("to_stop_I"), t.alias("departure_time"), (t + d).alias("arrival_time_target"), F.lit(-1).cast(trip_type).alias("trip_I"), F.lit(None).cast("int").alias("board_seq"), F.lit(None).cast("int").alias("alight_seq"), seq.alias("seq"))
    found = ids.where("first_walk_s > 0").select("journey_id", *walk(F.col("stop"), F.col("board_stop"), F.col("departure_time"), F.col("first_walk_s"), F.lit(0)))
    way = ["trip_id", "seq", "alight_stop", "alight_time", "alight_seq", "next_stop", "walk_s", "next_departure"]
    state = ids.select("journey_id", "target", "arrival_time_target", F.col("board_stop").alias("stop"), (F.col("departure_time") + F.col("first_walk_s")).alias("departure_time"), *way)
    go_on = rides.groupBy("target", "stop", "departure_time", "arrival_time_target").agg(F.min(F.struct("n_boardings", *way)).alias("m"))
    number = 1
    while True:
        at = F.lit(number)
        ridden = state.select("journey_id", F.col("stop").alias("from_stop_I"), F.col("alight_stop").alias("to_stop_I"), "departure_time", F.col("alight_time").alias("arrival_time_target"), F.col("trip_id").alias("trip_I"), F.col("seq").cast("int").alias("board_seq"), F.col("alight_seq").cast("int").alias("alight_seq"), at.alias("seq"))
        on_foot = state.where("walk_s > 0").select("journey_id", *walk(F.col("alight_stop"), F.col("next_stop"), F.col("alight_time"), F.col("walk_s"), at + 1))
        found = found.unionByName(ridden).unionByName(on_foot)  # read from the states, which are kept
        ahead = state.where("next_departure is not null").select("journey_id", "target", "arrival_time_target", F.col("next_stop").alias("stop"), F.col("next_departure").alias("departure_time"))
        state = checkpoint(ahead.join(go_on, ["target", "stop", "departure_time", "arrival_time_target"]).select("journey_id", "target", "arrival_time_target", "stop", "departure_time", *[f"m.{c}" for c in way]))
        release(labels.sparkSession)
        if state.isEmpty():
            break
        number += 2
    ridden = found.where("board_seq is not null")
    parts = ridden.select("trip_I", "board_seq", "alight_seq").distinct().join(conns.select(F.col("trip_id").alias("trip_I"), F.col("seq").alias("at"), "departure_stop", "arrival_stop"), "trip_I").where("at between board_seq and alight_seq")
    stops = parts.groupBy("trip_I", "board_seq", "alight_seq").agg(F.array_sort(F.collect_list(F.struct("at", "departure_stop"))).alias("d"), F.max_by("arrival_stop", "at").alias("last"))
    passed = stops.select("trip_I", "board_seq", "alight_seq", F.concat(F.transform("d", lambda x: x["departure_stop"]), F.array("last")).alias("leg_stops"))
    whole = found.join(passed, ["trip_I", "board_seq", "alight_seq"], "left").withColumn("leg_stops", F.coalesce("leg_stops", F.array("from_stop_I", "to_stop_I")))
    return journeys, whole.select("journey_id", "seq", "from_stop_I", "to_stop_I", "departure_time", "arrival_time_target", "trip_I", "leg_stops")


def with_routes(journeys: DataFrame, legs: DataFrame, trips: DataFrame) -> DataFrame:
    """Journeys with route: the routes of the vehicles in order, -1 where a trip has none; empty without a vehicle."""
    named = legs.join(trips.select("trip_I", "route_I"), "trip_I").groupBy("journey_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("route_I", F.lit(-1)).alias("r")))).alias("rs"))
    return journeys.join(named.select("journey_id", F.transform("rs", lambda x: x["r"]).alias("route")), "journey_id", "left").withColumn("route", F.coalesce("route", F.array().cast("array<bigint>")))


def stops_passed(legs: DataFrame) -> DataFrame:
    """(journey_id, stops): all stops of a journey in order, the stop between two legs once."""
    per = legs.groupBy("journey_id").agg(F.array_sort(F.collect_list(F.struct("seq", "from_stop_I", "to_stop_I"))).alias("l"))
    return per.select("journey_id", F.concat(F.transform("l", lambda x: x["from_stop_I"]), F.array(F.element_at("l", -1)["to_stop_I"])).alias("stops"))


def passing_journeys(legs: DataFrame) -> DataFrame:
    """(stop_I, n_journeys): journeys that pass each stop, however often."""
    return legs.select("journey_id", F.explode("leg_stops").alias("stop_I")).distinct().groupBy("stop_I").agg(F.count("*").alias("n_journeys"))


def dominates(a: dict, b: dict, *, time: bool = True, boardings: bool = True) -> F.Column:
    """Whether a journey (columns departure_time, arrival_time_target, n_boardings by name) is at least as good in all and better in one."""
    at_least, better = [], []
    if time:
        at_least += [a["departure_time"] >= b["departure_time"], a["arrival_time_target"] <= b["arrival_time_target"]]
        better += [a["departure_time"] > b["departure_time"], a["arrival_time_target"] < b["arrival_time_target"]]
    if boardings:
        at_least.append(a["n_boardings"] <= b["n_boardings"])
        better.append(a["n_boardings"] < b["n_boardings"])
    every, some = F.lit(True), F.lit(False)
    for x in at_least:
        every = every & x
    for x in better:
        some = some | x
    return every & some


def earliest_and_fewest(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, arrival_time_target, n_boardings): the earliest arrival and the fewest boardings among labels."""
    return labels.groupBy(*keys).agg(F.min("arrival_time_target").alias("arrival_time_target"), F.min("n_boardings").alias("n_boardings"))


def origin_target_legs(journeys: DataFrame, legs: DataFrame, origin: int, target: int, *, fastest: bool = True) -> DataFrame:
    """(from_stop_I, to_stop_I, trip_I, leg_stops, departure_times): the legs of journeys between two stops, each with its departures."""
    chosen = with_fastest(journeys).where((F.col("from_stop_I") == origin) & (F.col("to_stop_I") == target))
    chosen = chosen.where("fastest_path") if fastest else chosen
    return legs.join(chosen.select("journey_id"), "journey_id", "left_semi").groupBy(*OD, "trip_I", "leg_stops").agg(F.array_sort(F.collect_set("departure_time")).alias("departure_times"))


def with_fastest(journeys: DataFrame) -> DataFrame:
    """Journeys with fastest_path: whether they are on the front of departure and arrival of their pair of stops."""
    best = time_front(journeys.select("journey_id", *OD, "departure_time", "arrival_time_target"), OD).select("journey_id", F.lit(True).alias("f"))
    return journeys.join(best, "journey_id", "left").withColumn("fastest_path", F.coalesce("f", F.lit(False))).drop("f")


def with_components(journeys: DataFrame, legs: DataFrame) -> DataFrame:
    """Journeys with journey_duration, in_vehicle_duration, walking_duration and transfer_wait_duration (what remains)."""
    took = F.col("arrival_time_target") - F.col("departure_time")
    parts = legs.groupBy("journey_id").agg(F.sum(F.when(F.col("trip_I") >= 0, took).otherwise(0)).alias("in_vehicle_duration"), F.sum(F.when(F.col("trip_I") < 0, took).otherwise(0)).alias("walking_duration"))
    joined = journeys.join(parts, "journey_id", "left").withColumn("journey_duration", took)
    return joined.withColumn("transfer_wait_duration", F.col("journey_duration") - F.col("in_vehicle_duration") - F.col("walking_duration"))


def with_waits(journeys: DataFrame, start: float) -> DataFrame:
    """Fastest journeys with pre_journey_wait_fp, the time since the one before of the same stops or since the start."""
    order = Window.partitionBy(*OD).orderBy("departure_time")
    return with_fastest(journeys).where("fastest_path").withColumn("pre_journey_wait_fp", F.col("departure_time") - F.coalesce(F.lag("departure_time").over(order), F.lit(start)))


def boardings_of_legs(legs: DataFrame) -> DataFrame:
    """(journey_id, n_boardings, n_transfers): vehicles boarded, a leg of the same trip as the one before being none."""
    order = Window.partitionBy("journey_id").orderBy("seq")
    boards = (F.col("trip_I") >= 0) & ~F.col("trip_I").eqNullSafe(F.lag("trip_I").over(order))
    per = legs.withColumn("b", boards.cast("int")).groupBy("journey_id").agg(F.sum("b").alias("n_boardings"))
    return per.withColumn("n_transfers", F.greatest(F.lit(0), F.col("n_boardings") - 1))


def transfer_stops(legs: DataFrame) -> DataFrame:
    """(journey_id, arrival_stop, departure_stop, wait): where vehicles are changed, and for how long one waits."""
    order = Window.partitionBy("journey_id").orderBy("seq")
    ridden = legs.where("trip_I >= 0").withColumns({"last_trip": F.lag("trip_I").over(order), "last_stop": F.lag("to_stop_I").over(order), "last_time": F.lag("arrival_time_target").over(order)})
    return ridden.where("last_trip is not null and last_trip <> trip_I").select("journey_id", F.col("last_stop").alias("arrival_stop"), F.col("from_stop_I").alias("departure_stop"), (F.col("departure_time") - F.col("last_time")).alias("wait"))


def legs_to_target(journeys: DataFrame, legs: DataFrame, trip_types: DataFrame, target: int, *, fastest: bool = True, all_sections: bool = True, ignore_walk: bool = False) -> DataFrame:
    """(from_stop_I, to_stop_I, type, n_trips): what journeys to a target pass, walks being of type -1; each leg whole or by its stops."""
    chosen = with_fastest(journeys).where(F.col("to_stop_I") == target)
    chosen = chosen.where("fastest_path") if fastest else chosen
    used = legs.join(chosen.select("journey_id"), "journey_id", "left_semi").join(trip_types, "trip_I", "left").withColumn("type", F.coalesce("type", F.lit(-1)))
    used = used.where("trip_I >= 0") if ignore_walk else used
    if all_sections:
        steps = F.transform(F.sequence(F.lit(1), F.size("leg_stops") - 1), lambda i: F.struct(F.element_at("leg_stops", i).alias("a"), F.element_at("leg_stops", i + 1).alias("b")))
        used = used.where("size(leg_stops) > 1").select("type", F.explode(steps).alias("s")).select("type", F.col("s.a").alias("from_stop_I"), F.col("s.b").alias("to_stop_I"))
    return used.groupBy(*OD, "type").agg(F.count("*").alias("n_trips"))


def simpson_alternatives(journeys: DataFrame) -> DataFrame:
    """(from_stop_I, to_stop_I, n_journeys, n_routes, simpson): how likely two journeys of a pair use the same route; 1 with fewer than two journeys."""
    per = journeys.groupBy(*OD, "route").agg(F.count("*").alias("n")).groupBy(*OD).agg(F.sum("n").alias("n_journeys"), F.count("*").alias("n_routes"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    pairs = F.col("n_journeys") * (F.col("n_journeys") - 1)
    return per.withColumn("simpson", F.coalesce(F.try_divide(F.col("same"), pairs), F.lit(1.0))).drop("same")


def simpson_time_weighted(waited: DataFrame) -> DataFrame:
    """(from_stop_I, to_stop_I, simpson): sum of squares of each route's share of the waiting time of a pair's journeys (route, pre_journey_wait_fp)."""
    per = waited.groupBy(*OD, "route").agg(F.sum("pre_journey_wait_fp").alias("w"))
    whole = F.sum("w").over(Window.partitionBy(*OD))
    return per.withColumn("p", F.col("w") / whole).groupBy(*OD).agg(F.sum(F.col("p") * F.col("p")).alias("simpson"))


def upstream_stops(journeys: DataFrame, legs: DataFrame, target: int, through: DataFrame, ratio: float = 0.0) -> DataFrame:
    """(from_stop_I, share): origins of journeys to a target of which at least a share has a leg from one of the given stops."""
    own = journeys.where(F.col("to_stop_I") == target)
    passing = legs.join(through.select(F.col("stop_I").alias("from_stop_I")).distinct(), "from_stop_I", "left_semi").select("journey_id").distinct().withColumn("p", F.lit(1))
    shares = own.join(passing, "journey_id", "left").groupBy("from_stop_I").agg((F.count("p") / F.count("*")).alias("share"), F.count("p").alias("n"))
    return shares.where((F.col("share") >= ratio) & (F.col("n") > 0)).select("from_stop_I", "share")


def new_routes(journeys: DataFrame, others: DataFrame) -> DataFrame:
    """Journeys whose route no journey of the other timetable has."""
    return journeys.join(others.select("route").distinct(), "route", "left_anti")


MEASURES = ("min", "max", "median", "mean")


def measure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_stop_I, to_stop_I, diff_<m>, diff_<m>_relative): after less before; relative to before, null where that is 0."""
    old = before.select(*OD, *[F.col(m).alias(f"old_{m}") for m in MEASURES])
    joined = after.join(old, OD)
    return joined.select(*OD, *[(F.col(m) - F.col(f"old_{m}")).alias(f"diff_{m}") for m in MEASURES], *[F.try_divide(F.col(m) - F.col(f"old_{m}"), F.col(f"old_{m}")).alias(f"diff_{m}_relative") for m in MEASURES])


def changed_pairs(changes: DataFrame, target: int, threshold: float) -> DataFrame:
    return changes.where((F.col("to_stop_I") == target) & (F.abs("diff_mean") >= threshold))


def largest_component(changes: dict[str, DataFrame], threshold: float = 180) -> DataFrame:
    """(from_stop_I, to_stop_I, increase, decrease): the component of the journey whose mean grew, and fell, most; 'none' where none does by the threshold. Ties go to the first name given."""
    names = list(changes)
    joined = None
    for n in names:
        part = changes[n].select(*OD, F.col("diff_mean").alias(n))
        joined = part if joined is None else joined.join(part, OD)
    top, low = F.greatest(*names) if len(names) > 1 else F.col(names[0]), F.least(*names) if len(names) > 1 else F.col(names[0])
    which = lambda value: F.coalesce(*[F.when(F.col(n) == value, n) for n in names])
    return joined.select(*OD, F.when(top >= threshold, which(top)).otherwise("none").alias("increase"), F.when(low <= -threshold, which(low)).otherwise("none").alias("decrease"))
