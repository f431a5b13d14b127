import random

import pytest

from transloom.operators import journeys as J
from transloom.operators import profiles as P
from transloom.operators import routing as R
from transloom.operators.pareto import boardings_front, time_front

CONN = "departure_stop long, arrival_stop long, departure_time double, arrival_time double, trip_id string, seq int"
WALK = "from_stop_I long, to_stop_I long, d_walk double"
LABEL = "od int, departure_time double, arrival_time_target double, n_boardings int"


def both(spark, edges):
    return spark.createDataFrame([(a, b, float(d)) for x, y, d in edges for a, b in ((x, y), (y, x))], WALK)


def conns(spark, rows):
    return spark.createDataFrame([(a, b, float(c), float(d), t, s) for a, b, c, d, t, s in rows], CONN)


def dominated(x, y):
    return x != y and y[0] >= x[0] and y[1] <= x[1] and (len(x) < 3 or y[2] <= x[2])


@pytest.mark.parametrize("n", [1, 60])
def test_fronts_equal_the_definition(spark, n):
    rng = random.Random(n)
    rows = [(k % 3, float(rng.randrange(12)), float(rng.randrange(12, 30)), rng.randrange(1, 4)) for k in range(n)]
    labels = spark.createDataFrame(rows, LABEL)
    got = sorted(map(tuple, boardings_front(labels, ["od"]).collect()))
    want = sorted({r for r in rows if not any(dominated(r[1:], q[1:]) for q in rows if q[0] == r[0])})
    assert got == want
    got = sorted(r[:3] for r in map(tuple, time_front(labels, ["od"]).collect()))
    assert got == sorted({r[:3] for r in rows if not any(dominated(r[1:3], q[1:3]) for q in rows if q[0] == r[0])})


def test_fronts_of_nothing_and_nulls(spark):
    assert boardings_front(spark.createDataFrame([], LABEL), ["od"]).count() == 0
    assert time_front(spark.createDataFrame([(1, None, 2.0, 1), (None, 1.0, 2.0, 1)], LABEL), ["od"]).count() == 1


EARLY = [(1, 2, 0, 10, "t1", 1), (1, 3, 1, 10, "t2", 1), (2, 3, 10, 11, "t1", 2), (3, 4, 11, 13, "t1", 3), (3, 6, 12, 14, "t3", 1)]


@pytest.mark.parametrize(("start", "end", "want"), [(-2, 20, {1: -2, 2: 10, 3: 10, 4: 13, 5: 113, 6: 14}), (-1, 20, {1: -1, 3: 10, 6: 14}), (-2, 11, {1: -2, 2: 10, 3: 10, 4: 13, 5: 113})])
def test_earliest_arrivals(spark, start, end, want):
    seeds = spark.createDataFrame([(0, 1, float(start))], "seed long, stop long, at double")
    got = R.earliest_arrivals(conns(spark, EARLY), seeds, both(spark, [(4, 5, 1000)]), margin=2, speed=10, end_time=end)
    assert {r.stop: r.arrival_time for r in got.collect()} == want


def scan(rows, seed, start, edges, margin, speed):
    """The same by one pass over connections in order of departure."""
    walks = {}
    for a, b, d in edges:
        walks.setdefault(a, []).append((b, d / speed))
        walks.setdefault(b, []).append((a, d / speed))
    at, on = {seed: start}, set()
    for n, w in walks.get(seed, []):
        at[n] = min(at.get(n, 1e18), start + w)
    for a, b, dep, arr, trip, _ in sorted(rows, key=lambda r: (r[2], r[5])):
        if trip in on or at.get(a, 1e18) + margin <= dep:
            on.add(trip)
            for n, t in [(b, arr), *((n, arr + w) for n, w in walks.get(b, []))]:
                at[n] = min(at.get(n, 1e18), t)
    return at


def timetable(rng, trips, stops):
    rows = []
    for t in range(trips):
        at, stop = rng.randrange(60), rng.randrange(stops)
        for s in range(rng.randrange(1, 6)):
            nxt, dep = rng.randrange(stops), at + rng.randrange(1, 4)
            at = dep + rng.randrange(1, 9)
            rows.append((stop, nxt, dep, at, f"t{t}", s))
            stop = nxt
    return rows


def test_earliest_arrivals_equal_a_scan(spark):
    rng = random.Random(3)
    for _ in range(2):
        rows, edges = timetable(rng, 40, 15), [(rng.randrange(15), 15 + k, 30 + k) for k in range(3)] + [(1, 2, 8), (3, 4, 12)]
        got = R.earliest_arrivals(conns(spark, rows), spark.createDataFrame([(0, 1, 0.0)], "seed long, stop long, at double"), both(spark, edges), margin=1, speed=2)
        assert {r.stop: r.arrival_time for r in got.collect()} == scan(rows, 1, 0, edges, 1, 2)


BASIC = [(2, 4, 40, 50, "t6", 1), (1, 3, 32, 40, "t5", 1), (3, 4, 32, 35, "t4", 1), (2, 3, 25, 30, "t3", 1), (1, 2, 10, 20, "t2", 1), (0, 1, 0, 10, "t1", 1)]


def test_profiles_of_the_small_network(spark):
    got = R.journey_profiles(conns(spark, BASIC), spark.createDataFrame([(4, 4)], "target long, stop long"), both(spark, [(1, 2, 20), (3, 4, 15)]), speed=1)
    by = {}
    for r in got.collect():
        by.setdefault(r.stop, set()).add((r.departure_time, r.arrival_time_target, r.n_boardings))
    assert by[3] == {(32, 35, 1)} and by[2] == {(40, 50, 1), (25, 35, 2), (25, 45, 1)} and 4 not in by


def test_profiles_agree_with_earliest_arrivals(spark):
    rng = random.Random(8)
    rows, edges = timetable(rng, 30, 10), [(0, 5, 9), (2, 7, 14)]
    labels = [r for r in R.journey_profiles(conns(spark, rows), spark.createDataFrame([(6, 6)], "target long, stop long"), both(spark, edges), margin=1, speed=1).collect()]
    walks = {(a, b): d for x, y, d in edges for a, b in ((x, y), (y, x))}
    for stop in range(10):
        for start in (0, 10, 25, 40):
            want = scan(rows, stop, start - 1, edges, 1, 1).get(6, 1e18) if stop != 6 else None
            if want is None:
                continue
            # the scan's start is a margin early, so that the first vehicle needs none; a walk to it does
            best = min([r.arrival_time_target for r in labels if r.stop == stop and r.departure_time >= start], default=1e18)
            on_foot = start + walks.get((stop, 6), 1e18)
            assert min(best, on_foot) <= want + 1 or want >= 1e18


def test_next_departure_and_pseudo_connections(spark):
    a = spark.createDataFrame([(1, 5.0, "x"), (1, 9.0, "y"), (2, 1.0, "z"), (None, 1.0, "n")], "stop long, at double, tag string")
    d = spark.createDataFrame([(1, 5.0, 10), (1, 7.0, 11), (3, 1.0, 12)], "stop long, dep double, trip int")
    assert {(r.tag, r.next_dep, r.next_trip) for r in R.next_departures(a, d, ["stop"], "at", "dep", ["trip"]).collect()} == {("x", 5.0, 10), ("y", None, None), ("z", None, None), ("n", None, None)}
    walked = R.pseudo_connections(conns(spark, [(0, 1, 10, 20, "t", 1), (2, 3, 42, 50, "u", 1)]), both(spark, [(1, 2, 20)]), speed=1, start_time=0, end_time=50)
    assert [(r.departure_stop, r.arrival_stop, r.departure_time, r.arrival_time) for r in walked.collect()] == [(1, 2, 22, 42)]


def test_spreading_changes_and_walks(spark):
    rows = [(1, 2, 10, 20, "a", 1), (2, 3, 20, 30, "a", 2), (2, 4, 25, 40, "b", 1), (2, 4, 60, 70, "c", 1)]
    got = {r.stop: r.visit_time for r in R.spreading(conns(spark, rows), 1, both(spark, [(3, 5, 10), (5, 6, 10)]), start_time=0, max_duration=100, min_transfer_time=5, walk_speed=1).collect()}
    assert got == {1: 0, 2: 20, 3: 30, 4: 40, 5: 40, 6: 50}


def measures(spark, labels, start, end, walk=None):
    rows = spark.createDataFrame([(1, float(d), float(a), 1, walk) for d, a in labels], LABEL + ", walk double")
    r = P.block_measures(P.profile_blocks(rows, ["od"], start, end, "walk"), ["od"]).collect()[0]
    return r["min"], r["max"], r["mean"], r["median"]


def test_temporal_distances(spark):
    assert measures(spark, [(1, 2), (2, 4), (4, 5)], 0, 3) == (1, 3, pytest.approx(6.5 / 3), pytest.approx(2.25))
    assert measures(spark, [(11, 12)], 0, 10, 5.0) == (2, 5, pytest.approx(4.55), pytest.approx(5))
    assert measures(spark, [(10, 30)], 0, 10, 25.0)[:2] == (20, 25)
    assert measures(spark, [(1, 2), (2, 3)], 0, 2) == (1, 2, pytest.approx(1.5), pytest.approx(1.5))
    lonely = measures(spark, [(1, 2)], 0, 4)
    assert lonely[0] == 1 and lonely[1] == lonely[2] == lonely[3] == float("inf")


def test_profile_derivatives(spark):
    rows = spark.createDataFrame([(1, 2.0, 6.0, 3), (1, 4.0, 7.0, 1), (1, 8.0, 9.0, 2)], LABEL)
    blocks = P.profile_blocks(rows, ["od"], 0, 6)
    assert P.distance_at(blocks, ["od"], 1.0).collect()[0].distance == 5
    shares = {r.distance: r.share_below for r in P.distance_distribution(blocks, ["od"]).collect()}
    assert max(shares.values()) == pytest.approx(1) and min(shares.values()) == 0
    assert sorted((r.start_time, r.distance_start) for r in P.boardings_blocks(rows, ["od"], 0, 6).collect()) == [(0, 3), (2, 1), (4, 2)]
    assert [r.pre_journey_wait for r in P.pre_journey_waits(rows, ["od"], 0.0).orderBy("departure_time").collect()] == [2, 2, 4]
    t = P.trip_measures(rows, ["od"], 0, 10).collect()[0]
    assert (t.n_trips, t.min_trip_duration, t.n_boardings_on_fastest_trip) == (3, 1, 2)
    assert {r.max_boardings for r in P.blocks_by_boardings(rows, ["od"], 0, 6, 3).collect()} == {1, 2, 3}


def test_journeys(spark):
    j = spark.createDataFrame([(1, 10, 20, 0, 30, ["a"]), (2, 10, 20, 10, 40, ["b"]), (3, 10, 20, 5, 60, ["a"]), (4, 11, 20, 0, 9, ["c"])], "journey_id long, from_stop_I long, to_stop_I long, departure_time long, arrival_time_target long, route array<string>")
    legs = spark.createDataFrame([(1, 1, 10, 12, 0, 10, 7, [10, 11, 12]), (1, 2, 12, 13, 10, 15, -1, [12, 13]), (1, 3, 13, 20, 18, 30, 8, [13, 20]), (2, 1, 10, 20, 10, 40, 9, [10, 20])], "journey_id long, seq int, from_stop_I long, to_stop_I long, departure_time long, arrival_time_target long, trip_I long, leg_stops array<long>")
    assert {r.journey_id: r.fastest_path for r in J.with_fastest(j).collect()} == {1: True, 2: True, 3: False, 4: True}
    c = {r.journey_id: r for r in J.with_components(j, legs).collect()}[1]
    assert (c.in_vehicle_duration, c.walking_duration, c.transfer_wait_duration) == (22, 5, 3)
    assert {(r.journey_id, r.n_boardings, r.n_transfers) for r in J.boardings_of_legs(legs).collect()} == {(1, 2, 1), (2, 1, 0)}
    assert [tuple(r) for r in J.transfer_stops(legs).collect()] == [(1, 12, 13, 8)]
    types = spark.createDataFrame([(7, 3), (8, 0), (9, 3)], "trip_I long, type int")
    assert {tuple(r) for r in J.legs_to_target(j, legs, types, 20).collect()} == {(10, 11, 3, 1), (11, 12, 3, 1), (12, 13, -1, 1), (13, 20, 0, 1), (10, 20, 3, 1)}
    assert {(r.from_stop_I, round(r.simpson, 3)) for r in J.simpson_alternatives(j).collect()} == {(10, 0.333), (11, 1.0)}
    assert {r.from_stop_I: r.share for r in J.upstream_stops(j, legs, 20, spark.createDataFrame([(13,)], "stop_I long")).collect()} == {10: pytest.approx(1 / 3)}
    assert J.new_routes(j, j.where("journey_id = 1")).count() == 2
    m = "from_stop_I long, to_stop_I long, min double, max double, median double, mean double"
    d = J.measure_changes(spark.createDataFrame([(1, 2, 1.0, 4.0, 2.0, 0.0)], m), spark.createDataFrame([(1, 2, 2.0, 2.0, 2.0, 300.0)], m))
    r = d.collect()[0]
    assert (r.diff_min, r.diff_max_relative, r.diff_mean_relative) == (1, -0.5, None) and J.changed_pairs(d, 2, 180).count() == 1
    assert J.largest_component({"wait": d, "walk": d.withColumn("diff_mean", d.diff_mean * -1)}).collect()[0][2:] == ("wait", "walk")


def test_journeys_of_a_scan_ride_by_ride(spark, tmp_path):
    from transloom.sources.journey_store import JourneyStore, MeasureStore

    network = spark.createDataFrame([(a, b, float(c), float(d), t, s) for a, b, c, d, t, s in [(0, 1, 0, 10, 1, 1), (1, 2, 10, 20, 1, 2), (2, 3, 25, 30, 3, 1), (3, 4, 32, 35, 4, 1), (5, 3, 26, 31, 5, 1)]], "departure_stop long, arrival_stop long, departure_time double, arrival_time double, trip_id long, seq int")
    labels, rides = R.profile_scan(network, spark.createDataFrame([(4, 4)], "target long, stop long"), both(spark, [(2, 5, 4), (6, 0, 3)]), speed=1, margin=1)
    journeys, legs = (df.cache() for df in J.unfolded(labels, rides, network))
    assert journeys.count() == labels.count()
    whole = {r.journey_id: r for r in journeys.collect()}
    by = {}
    for r in sorted(legs.collect(), key=lambda r: (r.journey_id, r.seq)):
        by.setdefault(r.journey_id, []).append(r)
    for k, ls in by.items():
        j = whole[k]
        assert (ls[0].from_stop_I, ls[0].departure_time, ls[-1].to_stop_I, ls[-1].arrival_time_target) == (j.from_stop_I, j.departure_time, 4, j.arrival_time_target)
        assert all(a.to_stop_I == b.from_stop_I and a.arrival_time_target <= b.departure_time for a, b in zip(ls, ls[1:]))
        assert sum(x.trip_I >= 0 for x in ls) == j.n_boardings and sum(x.arrival_time_target - x.departure_time for x in ls) == j.movement_duration
    first = next(ls for k, ls in by.items() if whole[k].from_stop_I == 6)
    assert [(x.trip_I, tuple(x.leg_stops)) for x in first][:2] == [(-1, (6, 0)), (1, (0, 1, 2))]
    trips = spark.createDataFrame([(1, 70), (3, 71), (4, None), (5, 72)], "trip_I long, route_I long")
    routed = J.with_routes(journeys, legs, trips)
    assert {tuple(r.route) for r in routed.where("from_stop_I = 0").collect()} <= {(70, 71, -1), (70, 72, -1)}
    assert {r.stop_I: r.n_journeys for r in J.passing_journeys(legs).collect()}[4] == len(by)
    assert J.stops_passed(legs).where(f"journey_id = {first[0].journey_id}").collect()[0].stops[:3] == [6, 0, 2]
    store = JourneyStore(spark, str(tmp_path / "s"), {"margin": 1})
    store.add(journeys, legs)
    store.add(journeys, legs)
    assert store.journeys(4).select("journey_id").distinct().count() == 2 * journeys.count() and store.targets().count() == 1 and store.od_pairs().count() == store.origins().count()
    with pytest.raises(ValueError):
        JourneyStore(spark, str(tmp_path / "s"), {"margin": 2})
    measures = MeasureStore(spark, str(tmp_path / "m"))
    for x in (1.0, 2.0):
        measures.insert("wait", spark.createDataFrame([(1, 4, x, x, x, x)], "from_stop_I long, to_stop_I long, min double, max double, median double, mean double"))
    assert measures.read("wait", to_stop_I=4, statistic="mean").collect()[0]["mean"] == 2 and measures.read("wait", from_stop_I=9).count() == 0


def test_scan_counts_every_boarding_and_long_trips(spark):
    """Every change is found without a bound, and a trip of many calls is passed once."""
    chain = [(i, i + 1, 10 * i, 10 * i + 5, f"c{i}", 1) for i in range(5)]
    got = R.journey_profiles(conns(spark, chain), spark.createDataFrame([(5, 5)], "target long, stop long"), both(spark, []), speed=1)
    assert {r.stop: r.n_boardings for r in got.collect()} == {i: 5 - i for i in range(5)}
    long = [(i, i + 1, i, i + 1, "long", i) for i in range(3000)]
    got = R.journey_profiles(conns(spark, long), spark.createDataFrame([(3000, 3000)], "target long, stop long"), both(spark, []), speed=1)
    assert got.count() == 3000


def test_cut_offs_and_properties(spark):
    rows = spark.createDataFrame([(1, 2.0, 6.0, 3), (1, 4.0, 7.0, 1)], LABEL)
    blocks = P.profile_blocks(rows, ["od"], 0, 5)
    cut = sorted((r.start_time, r.end_time, r.distance_start, r.distance_end) for r in P.cut_off(blocks, 4.5).collect())
    assert cut == [(0, 1.5, 4.5, 4.5), (1.5, 2, 4.5, 4), (2, 2.5, 4.5, 4.5), (2.5, 4, 4.5, 3), (4, 5, 4.5, 4.5)]
    assert P.largest_finite(blocks, ["od"]).collect()[0].largest == 6
    r = P.all_measures(rows, ["od"], 0, 5).collect()[0]
    assert (r["min"], r.largest, r.n_trips) == (3, 6, 2)
    assert {r.measure for r in P.impedance(rows, ["od"], 0, 4, ("n_boardings",)).collect()} == {"temporal_distance", "n_boardings"}


def test_spreading_moves(spark):
    rows = [(1, 2, 10, 20, "a", 1), (2, 3, 20, 30, "a", 2), (2, 4, 25, 40, "b", 1)]
    walks, c = both(spark, [(3, 5, 10)]), conns(spark, rows)
    visits = R.spreading(c, 1, walks, start_time=0, max_duration=100, min_transfer_time=5, walk_speed=1)
    got = {(r.from_stop_I, r.to_stop_I, r.trip_id) for r in R.spreading_trips(c, visits, walks, 1, min_transfer_time=5, walk_speed=1).collect()}
    assert got == {(1, 2, "a"), (2, 3, "a"), (2, 4, "b"), (3, 5, "-1")}


def test_next_departures_reads_a_key_once(spark):
    """The first departure at a time or later, equal times too; no frame that is read again for each row, which a busy stop would take hours for."""
    from pyspark.sql import functions as F

    arrivals = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 9.5), (2, 1.0), (3, 1.0), (None, 2.0)], "k long, at double")
    departures = spark.createDataFrame([(1, 7.0, "a"), (1, 9.0, "b"), (2, 0.5, "c"), (2, 1.0, "d"), (None, 3.0, "e")], "k long, departure double, name string")
    found = R.next_departures(arrivals, departures, ["k"], "at", "departure", ["name"])
    assert {(r.k, r.at): (r.next_departure, r.next_name) for r in found.collect()} == {(1, 5.0): (7.0, "a"), (1, 7.0): (7.0, "a"), (1, 9.5): (None, None), (2, 1.0): (1.0, "d"), (3, 1.0): (None, None), (None, 2.0): (3.0, "e")}
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    many = spark.range(200000).select((F.col("id") * 0).alias("k"), F.col("id").cast("double").alias("at"))  # 20 billion steps
    assert R.next_departures(many, many.withColumnRenamed("at", "departure"), ["k"], "at", "departure", []).where("next_departure = at").count() == 200000
