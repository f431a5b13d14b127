"""Routing on a timetable as rounds of joins: one round is one boarding, so rounds are few whatever the timetable's size.

Connections have departure_stop, arrival_stop, departure_time, arrival_time, trip_id and seq; walks have from_stop_I, to_stop_I and
d_walk in metres, one row for each direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import checkpoint, release
from transloom.operators.pareto import boardings_front, time_front

CONNECTION = ["departure_stop", "arrival_stop", "departure_time", "arrival_time", "trip_id", "seq"]
#: Of a label: the ride that it begins with, the stop and time it goes on from, and the time spent moving.
ROUTE = ["trip_id", "seq", "alight_stop", "alight_time", "alight_seq", "next_stop", "walk_s", "next_departure", "movement"]


def connections(events: DataFrame) -> DataFrame:
    """Transit events as connections."""
    return events.select(
        F.col("from_stop_I").alias("departure_stop"), F.col("to_stop_I").alias("arrival_stop"), F.col("dep_time_ut").alias("departure_time"), F.col("arr_time_ut").alias("arrival_time"), F.col("trip_I").alias("trip_id"), F.col("from_seq").alias("seq")
    )


def _walk_from(arrivals: DataFrame, walks: DataFrame, speed: float) -> DataFrame:
    """(seed, stop, at) a walk after each arrival."""
    return arrivals.join(walks, F.col("stop") == F.col("from_stop_I")).select("seed", F.col("to_stop_I").alias("stop"), (F.col("at") + F.col("d_walk") / speed).alias("at"))


def earliest_arrivals(conns: DataFrame, seeds: DataFrame, walks: DataFrame, *, margin: float = 0, speed: float = 1.5, end_time: float | None = None, chained_walks: bool = False) -> DataFrame:
    """(seed, stop, arrival_time): the earliest arrival from each seed (seed, stop, at) at every stop it reaches.

    A connection is taken by staying in its trip, or from its stop at least ``margin`` after arriving there by trip or walk; trips
    that depart after ``end_time`` are not. Walks start from the seed and from trips, and from walks too if they may be chained.
    Stops that are not reached have no row.
    """
    usable = conns if end_time is None else conns.where(F.col("departure_time") <= end_time)
    start = seeds.select("seed", "stop", F.col("at").cast("double").alias("at"))
    best = start.unionByName(_walk_from(start, walks, speed)).groupBy("seed", "stop").agg(F.min("at").alias("at"))
    best = checkpoint(best.withColumn("new", F.lit(True)))
    while True:
        boarded = best.where("new").join(usable, F.col("stop") == F.col("departure_stop")).where(F.col("at") + margin <= F.col("departure_time")).groupBy("seed", "trip_id").agg(F.min(F.struct("departure_time", "seq")).alias("b"))
        ride = boarded.join(usable, "trip_id").where(F.struct("departure_time", "seq") >= F.col("b"))
        arrived = ride.groupBy("seed", F.col("arrival_stop").alias("stop")).agg(F.min("arrival_time").cast("double").alias("at"))
        found = arrived.unionByName(_walk_from(arrived, walks, speed))
        if chained_walks:
            found = found.unionByName(_walk_from(best.where("new").select("seed", "stop", "at"), walks, speed))
        merged = best.select("seed", "stop", "at", F.lit(False).alias("new")).unionByName(found.withColumn("new", F.lit(True)))
        # of equal times the known one: it is not new again
        best = checkpoint(merged.groupBy("seed", "stop").agg(F.min(F.struct("at", "new")).alias("m")).select("seed", "stop", "m.at", "m.new"))
        if best.where("new").isEmpty():
            return best.select("seed", "stop", F.col("at").alias("arrival_time"))


def next_departures(arrivals: DataFrame, departures: DataFrame, keys: list[str], at: str, departure: str, columns: list[str]) -> DataFrame:
    """arrivals with the columns of the first departure of the same keys at ``at`` or later; null where there is none.

    Both sides go through one sort per key; no pairs are formed.
    """
    a = arrivals.select(*keys, F.col(at).cast("double").alias("time_"), F.lit(0).alias("side_"), F.struct(*arrivals.columns).alias("row_"), F.lit(None).cast(departures.select(F.struct(departure, *columns)).schema[0].dataType).alias("next_"))
    d = departures.select(*keys, F.col(departure).cast("double").alias("time_"), F.lit(1).alias("side_"), F.lit(None).cast(arrivals.select(F.struct(*arrivals.columns)).schema[0].dataType).alias("row_"), F.struct(departure, *columns).alias("next_"))
    # from the last to the first: a frame that ends at the end would be read again for each row
    ahead = Window.partitionBy(*keys).orderBy(F.desc("time_"), F.desc("side_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(d).withColumn("found_", F.last("next_", ignorenulls=True).over(ahead)).where("side_ = 0")
    return found.select("row_.*", *[F.col(f"found_.{c}").alias(f"next_{c}") for c in (departure, *columns)])


def journey_profiles(conns: DataFrame, targets: DataFrame, walks: DataFrame, *, margin: float = 0, speed: float = 1.5, most_boardings: int | None = None) -> DataFrame:
    """The final labels of ``profile_scan``."""
    return profile_scan(conns, targets, walks, margin=margin, speed=speed, most_boardings=most_boardings)[0]


def profile_scan(conns: DataFrame, targets: DataFrame, walks: DataFrame, *, margin: float = 0, speed: float = 1.5, most_boardings: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels (target, stop, departure_time, arrival_time_target, n_boardings, first_walk_s, board_stop, trip_id, seq, alight_stop, alight_time, alight_seq, next_stop, walk_s, next_departure, movement): the Pareto-optimal journeys of every stop to each target (target, stop).

    Round n finds the journeys with n boardings: from a connection one walks on to the target, stays in the trip, or changes with
    ``margin``, at once or after one walk, to the best journey of n-1 boardings that is still caught. Rounds end when one finds
    nothing new, or at ``most_boardings`` if given. Journeys may begin with one walk. What is no better than walking all the way is
    left out. Of equal journeys the one that moves least. The columns from board_stop on say how it begins: which ride, where it goes
    on (null next_departure: at the target), so that ``journeys.unfolded`` can follow it through the second table, the labels that begin
    with a ride.
    """
    legs = checkpoint(conns.select(*CONNECTION))
    paths = walks.select("from_stop_I", "to_stop_I", (F.col("d_walk") / speed).alias("walk_s"))
    on_foot = targets.select("target", "stop", F.lit(0.0).alias("foot"), F.col("stop").alias("end")).unionByName(
        targets.join(paths, F.col("stop") == F.col("to_stop_I")).select("target", F.col("from_stop_I").alias("stop"), F.col("walk_s").alias("foot"), F.col("stop").alias("end"))
    ).groupBy("target", "stop").agg(F.min(F.struct("foot", "end")).alias("f")).select("target", "stop", "f.foot", "f.end")
    # what goes on after a connection: when the target is reached, the moment of alighting and all movement after it, and the way
    onward = lambda reached, after, stop, walk, departure: F.struct(
        reached.cast("double").alias("reached"), (F.col("arrival_time") + after).cast("double").alias("moved"), F.col("arrival_stop").alias("alight_stop"), F.col("arrival_time").cast("double").alias("alight_time"),
        F.col("seq").alias("alight_seq"), stop.alias("next_stop"), walk.cast("double").alias("walk_s"), departure.cast("double").alias("next_departure"),
    ).alias("onward")
    by_foot = legs.join(on_foot, F.col("arrival_stop") == F.col("stop")).select("target", *CONNECTION, onward(F.col("arrival_time") + F.col("foot"), F.col("foot"), F.col("end"), F.col("foot"), F.lit(None)))
    to_go = on_foot.select("target", F.col("stop").alias("departure_stop"), "foot")
    at_once = legs.select(F.col("arrival_stop").alias("stop"), (F.col("arrival_time") + margin).cast("double").alias("ready"), F.lit(0.0).alias("walk_s"), *CONNECTION)
    walked = legs.join(paths, F.col("arrival_stop") == F.col("from_stop_I")).select(F.col("to_stop_I").alias("stop"), (F.col("arrival_time") + F.col("walk_s") + margin).cast("double").alias("ready"), "walk_s", *CONNECTION)
    changes = checkpoint(at_once.unionByName(walked))
    # staying in the trip: the best that this or any later connection of it reaches, by one pass from the trip's end
    later = Window.partitionBy("target", "trip_id").orderBy(F.desc("departure_time"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known: DataFrame | None = None
    fresh: DataFrame | None = None
    boardings = 0
    while most_boardings is None or boardings < most_boardings:
        boardings += 1
        if boardings == 1:
            reached = by_foot
        else:
            # what catches a journey of an earlier round has been followed there, so only stops with a journey of the last one are looked at
            ready = changes.join(known.where(F.col("n_boardings") == boardings - 1).select("target", "stop").distinct(), "stop")
            # with fewer boardings allowed than known, the fastest is all that counts: the first that is caught
            fastest = time_front(known.select("target", "stop", "departure_time", "arrival_time_target", "movement", "n_boardings"), ["target", "stop"])
            caught = next_departures(ready, fastest, ["target", "stop"], "ready", "departure_time", ["arrival_time_target", "movement", "n_boardings"]).where(F.col("next_n_boardings") == boardings - 1)
            reached = caught.select("target", *CONNECTION, onward(F.col("next_arrival_time_target"), F.col("walk_s") + F.col("next_movement"), F.col("stop"), F.col("walk_s"), F.col("next_departure_time")))
        best = reached.groupBy("target", *CONNECTION).agg(F.min("onward").alias("onward"))
        rides = best.select("target", "trip_id").distinct().join(legs, "trip_id").select("target", *CONNECTION)
        passed = rides.join(best, ["target", *CONNECTION], "left").withColumn("onward", F.min("onward").over(later)).where("onward is not null")
        stay = passed.select("target", "departure_stop", F.col("departure_time").cast("double").alias("departure_time"), "trip_id", "seq", "onward.*").join(to_go, ["target", "departure_stop"], "left")
        better = stay.where("foot is null or reached < departure_time + foot")
        made = better.groupBy("target", F.col("departure_stop").alias("stop"), "departure_time").agg(F.min(F.struct("reached", (F.col("moved") - F.col("departure_time")).alias("movement"), *ROUTE[:-1])).alias("m"))
        made = time_front(made.select("target", "stop", "departure_time", F.col("m.reached").alias("arrival_time_target"), F.lit(boardings).alias("n_boardings"), *[f"m.{c}" for c in ROUTE]), ["target", "stop"])
        fresh = checkpoint(boardings_front(made if known is None else known.unionByName(made), ["target", "stop"]))
        if known is not None and fresh.where(F.col("n_boardings") == boardings).isEmpty():
            break
        known = fresh
        release(conns.sparkSession)
    begun = fresh.withColumns({"first_walk_s": F.lit(0.0), "board_stop": F.col("stop")})
    on_way = fresh.join(paths.withColumnRenamed("walk_s", "first_walk_s"), F.col("stop") == F.col("to_stop_I")).select(
        "target", F.col("from_stop_I").alias("stop"), (F.col("departure_time") - F.col("first_walk_s")).alias("departure_time"), "arrival_time_target", "n_boardings", *ROUTE[:-1], (F.col("movement") + F.col("first_walk_s")).alias("movement"), "first_walk_s", F.col("stop").alias("board_stop")
    )
    on_way = on_way.join(targets.select("target", "stop"), ["target", "stop"], "left_anti")
    every = begun.unionByName(on_way).join(on_foot.drop("end"), ["target", "stop"], "left").where("foot is null or arrival_time_target - departure_time < foot").drop("foot")
    # of equal ones the least movement
    first = ["movement", "first_walk_s", "board_stop", *ROUTE[:-1]]
    one = every.groupBy("target", "stop", "departure_time", "arrival_time_target", "n_boardings").agg(F.min(F.struct(*first)).alias("m")).select("target", "stop", "departure_time", "arrival_time_target", "n_boardings", "m.*")
    return boardings_front(one, ["target", "stop"]), fresh


def pseudo_connections(conns: DataFrame, walks: DataFrame, *, margin: float = 0, speed: float = 1.5, start_time: float, end_time: float) -> DataFrame:
    """Walks that end at a connection's stop ``margin`` before it departs, as connections of their own; both departures within the bounds, each walk once."""
    inside = conns.where(F.col("departure_time").between(start_time, end_time)).select(F.col("departure_stop").alias("arrival_stop"), (F.col("departure_time") - margin).alias("arrival_time"))
    walked = inside.join(walks, F.col("arrival_stop") == F.col("to_stop_I")).select(
        F.col("from_stop_I").alias("departure_stop"), "arrival_stop", (F.col("arrival_time") - F.col("d_walk") / speed).alias("departure_time"), "arrival_time", F.lit(-1).alias("trip_id"), F.lit(-1).alias("seq")
    )
    return walked.where(F.col("departure_time").between(start_time, end_time)).distinct()


def spreading(conns: DataFrame, start_stop: int, walks: DataFrame, *, start_time: float, max_duration: float, min_transfer_time: float = 30, walk_speed: float = 0.5) -> DataFrame:
    """(stop, visit_time): when something that starts at a stop and goes on with every vehicle and walk reaches each stop, within the time.

    Changing vehicles takes ``min_transfer_time``; walks may follow each other.
    """
    seeds = conns.sparkSession.createDataFrame([(0, start_stop, float(start_time))], "seed long, stop long, at double")
    limit = start_time + max_duration
    usable = conns.where((F.col("departure_time") >= start_time) & (F.col("arrival_time") <= limit))
    whole = walks.withColumn("d_walk", F.floor(F.col("d_walk") / walk_speed) * walk_speed)
    found = earliest_arrivals(usable, seeds, whole, margin=min_transfer_time, speed=walk_speed, chained_walks=True)
    return found.where(F.col("arrival_time") <= limit).select("stop", F.col("arrival_time").alias("visit_time"))


def spreading_trips(conns: DataFrame, visits: DataFrame, walks: DataFrame, start_stop: int, *, min_transfer_time: float = 30, walk_speed: float = 0.5) -> DataFrame:
    """(from_stop_I, to_stop_I, departure_time, arrival_time, trip_id): of each stop that ``spreading`` visits the move that first reaches it, walks with trip -1; of moves at one time the vehicle with the smallest trip, then the smallest stop.

    A vehicle counts if its stop was visited in time to board, or if it was boarded at a stop before.
    """
    at = visits.select(F.col("stop").alias("departure_stop"), F.col("visit_time").alias("since"))
    ready = F.col("departure_stop") == F.lit(start_stop)
    boarded = conns.join(at, "departure_stop").where(F.when(ready, F.col("since") <= F.col("departure_time")).otherwise(F.col("since") + min_transfer_time <= F.col("departure_time")))
    first = boarded.groupBy("trip_id").agg(F.min(F.struct("departure_time", "seq")).alias("first"))
    ridden = conns.join(first, "trip_id").where(F.struct("departure_time", "seq") >= F.col("first")).select("departure_stop", "arrival_stop", F.col("departure_time").cast("double"), F.col("arrival_time").cast("double"), F.col("trip_id").cast("string").alias("trip_id"))
    on_foot = walks.join(at, F.col("from_stop_I") == F.col("departure_stop")).select("departure_stop", F.col("to_stop_I").alias("arrival_stop"), F.col("since").alias("departure_time"), (F.col("since") + F.floor(F.col("d_walk") / walk_speed)).alias("arrival_time"), F.lit("-1").alias("trip_id"))
    goal = visits.select(F.col("stop").alias("arrival_stop"), F.col("visit_time").alias("arrival_time")).where(F.col("stop") != start_stop)
    moves = ridden.unionByName(on_foot).join(goal, ["arrival_stop", "arrival_time"])
    return moves.groupBy("arrival_stop", "arrival_time").agg(F.min(F.struct((F.col("trip_id") == "-1").alias("w"), "trip_id", "departure_stop", "departure_time")).alias("m")).select(
        F.col("m.departure_stop").alias("from_stop_I"), F.col("arrival_stop").alias("to_stop_I"), "m.departure_time", "arrival_time", "m.trip_id"
    )
