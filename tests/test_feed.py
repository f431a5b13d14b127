import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from transloom.functions import timetable as T
from transloom.common import numbered
from transloom.operators import compare, derive, events, extract, geometry, networks, sequence, shapes, stats, validate, walking
from transloom.sources import export
from transloom.sources.gtfs import read_feed, write_feed
from transloom.streaming.departures import departures_per_window, service_periods

FEED = {
    "agency": " agency_id,agency_name,agency_timezone,agency_url\nag, CompNet,America/Los_Angeles,http://x\n",
    "stops": "﻿stop_id,stop_name,stop_lat,stop_lon,parent_station\nA,\"Mill, north\",36.9,-116.7,P\nB,Church,36.91,-116.71,\nC,Bridge,36.95,-116.75,\nP,Station,36.9001,-116.7001,\nZ,Unused,10,10,\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nR1,ag,1,One,3\nR2,ag,2,Two,701\n",
    "trips": "route_id,service_id,trip_id,shape_id,direction_id\nR1,WD,T1,S1,0\nR2,WD,T2,,1\nR1,ONLY,T3,,\nRX,WD,T4,,\nR1,WD,F1,,\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,8:00:00,8:01:00,A,0\nT1,8:10:00,8:11:00,B,5\nT1,25:20:00,25:20:00,C,9\nT2,09:00:00,09:00:00,B,1\nT2,09:30:00,09:30:00,A,2\nT3,7:00:00,7:00:00,A,1\nT3,7:05:00,7:05:00,B,2\nT4,7:00:00,7:00:00,A,1\nT4,7:05:00,7:05:00,B,2\nF1,0:00:00,0:00:10,A,1\nF1,0:05:00,0:05:10,B,2\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20070305,20070318\n",
    "calendar_dates": "service_id,date,exception_type\nWD,20070306,2\nWD,20070310,1\nONLY,20070312,1\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nF1,14:00:00,16:00:00,600\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nS1,36.9,-116.7,0\nS1,36.905,-116.705,1\nS1,36.91,-116.71,10\nS1,36.95,-116.75,100\n",
    "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nA,B,2,120\nA,P,3,\nP,A,1,\nB,B,2,60\n",
    "feed_info": "feed_publisher_name,feed_publisher_url,feed_lang\npub,http://p,en\n",
}


@pytest.fixture(scope="module")
def feed(spark):
    return read_feed(spark, FEED).materialized()


def test_times(spark):
    row = spark.createDataFrame([("25:59:10", dt.date(2007, 3, 11), 1438300800 + 24299, "20160615", -1)], "t string, d date, u long, n string, neg int")
    got = row.select(
        T.day_seconds(F.col("t")), T.day_time(T.day_seconds(F.col("t"))), T.day_start_ut(F.col("d"), "America/Los_Angeles"), T.utc_text(F.col("u")), T.iso_date(F.col("n")), T.day_time(F.col("neg")), T.day_seconds(F.lit("x")),
        T.next_day_start(T.day_start_ut(F.col("d"), "America/Los_Angeles"), 1, "America/Los_Angeles"), T.day_start_ut(F.col("d")), T.day_start_of_ut(F.lit(1173596400 + 80000), "America/Los_Angeles"), T.day_time(F.lit(0)),
    ).collect()[0]
    assert tuple(got) == (93550, "25:59:10", 1173596400, "Jul 31 2015 06:44:59", dt.date(2016, 6, 15), None, None, 1173682800, 1173571200, 1173596400, "00:00:00")
    assert T.utc_offset("Europe/Helsinki", dt.date(2020, 7, 1)) == "+0300"


def test_import(feed):
    stops = {r.stop_id: r for r in feed["stops"].collect()}
    assert stops["A"].name == "Mill, north" and stops["A"].parent_I == stops["P"].stop_I and stops["A"].self_or_parent_I == stops["P"].stop_I and stops["B"].self_or_parent_I == stops["B"].stop_I
    assert {r.route_id: r.type for r in feed["routes"].collect()} == {"R1": 3, "R2": 3}
    trips = {r.trip_id: r for r in feed["trips"].collect()}
    assert "F1" not in trips and len([t for t in trips if t.startswith("F1_freq_")]) == 12 and trips["T4"].route_I is None
    assert (trips["T1"].start_time_ds, trips["T1"].end_time_ds) == (8 * 3600 + 60, 25 * 3600 + 1200)
    f = trips["F1_freq_50400"]
    assert (f.start_time_ds, f.end_time_ds) == (50400, 50400 + 300)
    calls = [(r.seq, r.dep_time_ds) for r in feed["stop_times"].where(F.col("trip_I") == trips["T1"].trip_I).orderBy("seq").collect()]
    assert [s for s, _ in calls] == [1, 2, 3] and feed["stop_times"].count() == 9 + 24
    assert len({r.trip_I for r in feed["trips"].collect()}) == feed["trips"].count()
    assert {(r.seq, r.d > 0) for r in feed["shapes"].collect()} == {(0, False), (1, True), (2, True), (3, True)}
    d = {(r.from_stop_I, r.to_stop_I): r for r in feed["stop_distances"].collect()}
    a, b, p = stops["A"].stop_I, stops["B"].stop_I, stops["P"].stop_I
    assert d[a, b].min_transfer_time == 120 and (a, p) not in d and d[p, a].timed_transfer == 1 and d[p, a].min_transfer_time == 0 and (b, b) not in d and (b, a) not in d
    assert feed.metadata["timezone"] == "America/Los_Angeles"


def test_days(feed):
    trips = {r.trip_I: r.trip_id for r in feed["trips"].collect()}
    by = {}
    for r in feed["days"].collect():
        by.setdefault(trips[r.trip_I], []).append(r)
    assert len(by["T1"]) == 10 and dt.date(2007, 3, 6) not in [r.date for r in by["T1"]] and dt.date(2007, 3, 10) in [r.date for r in by["T1"]]
    assert [r.date for r in by["T3"]] == [dt.date(2007, 3, 12)]
    assert {r.date: r.day_start_ut for r in by["T1"]}[dt.date(2007, 3, 12)] == 1173682800
    assert feed["day_trips2"].count() == feed["days"].count()


def test_two_feeds_get_prefixes_and_zones_must_agree(spark):
    two = read_feed(spark, [FEED, FEED], stop_distance_m=None)
    assert two["trips"].count() == 32 and two["trips"].select("trip_id").distinct().count() == 32 and two["trips"].where("trip_id like 'feed_1_%'").count() == 16
    other = FEED | {"agency": FEED["agency"].replace("America/Los_Angeles", "Europe/Helsinki")}
    with pytest.raises(ValueError, match="offsets"):
        read_feed(spark, [FEED, other], stop_distance_m=None)
    with pytest.raises(AssertionError):
        read_feed(spark, {k: v for k, v in FEED.items() if k != "routes"})
    with pytest.raises(AssertionError):
        read_feed(spark, FEED | {"stop_times": FEED["stop_times"] + "T1,,,A,12\n"})
    assert read_feed(spark, FEED, ignore=("shapes", "transfers"), stop_distance_m=None).tables.keys() == {"agencies", "stops", "routes", "calendar", "calendar_dates", "trips", "frequencies", "stop_times", "feed_info"}


def test_written_feeds_read_the_same(spark, feed, tmp_path):
    for name in ("out", "out.zip"):
        write_feed(feed, str(tmp_path / name))
        again = read_feed(spark, str(tmp_path / name), stop_distance_m=None).materialized()
        for table in ("stops", "routes", "trips", "stop_times", "calendar", "shapes"):
            assert again[table].count() == feed[table].count(), (name, table)
        ids = lambda x: {(r.trip_id, r.start_time_ds, r.end_time_ds) for r in x["trips"].collect()}
        assert ids(again) == ids(feed)
        assert {(r.stop_id, r.lat) for r in again["stops"].collect()} == {(r.stop_id, r.lat) for r in feed["stops"].collect()}


def test_sql_views_and_lookups(feed, tmp_path):
    assert feed.sql("SELECT count(*) AS n FROM {stops} s JOIN {stop_times} c ON s.stop_I = c.stop_I").collect()[0].n == 33
    feed.register("v_")
    assert feed.spark.sql("SELECT count(*) AS n FROM v_day_stop_times").collect()[0].n > 0
    assert feed.closest_stop(36.9, -116.7).collect()[0].stop_I == 1 and feed.modes().collect()[0].type == 3
    assert feed.add_stop(stop_I=99, stop_id="N", name="New").row_count("stops") == 6
    assert feed.trip_takes_place(1, 1173682800) and not feed.trip_takes_place(3, 1)
    assert feed.schedule_span().collect()[0].start_ut == 1173081600
    feed.save(str(tmp_path))
    assert feed.spark.read.parquet(str(tmp_path / "day_trips2.parquet")).count() == feed["day_trips2"].count()


def test_events_and_links(feed):
    e = feed.events()
    first = e.where("route_id = 'R1' and duration > 3600").collect()[0]
    assert first.arr_time_ut - first.dep_time_ut == first.duration == 25 * 3600 + 1200 - 8 * 3600 - 660
    links = networks.stop_to_stop(e, feed["stops"])
    for r in links.collect():
        assert r.duration_min <= r.duration_avg <= r.duration_max and sum(r.route_I_counts.values()) == r.n_vehicles and r.capacity_estimate == 80 * r.n_vehicles
    assert export.edge_rows(links).select("route_I_counts").dtypes == [("route_I_counts", "string")]


@pytest.mark.parametrize("hot", [5, 10**6])
def test_next_row_also_of_hot_keys(spark, hot):
    rows = [(k % 3 if k % 7 else None, k * 37 % 100, k) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, o int, v int")
    got = {(r.v): r.next_v for r in sequence.with_next(df, ["k"], ["o", "v"], ["v"], hot_rows=hot).collect()}
    for key in (0, 1, 2, None):
        own = sorted((o, v) for k, o, v in rows if k == key)
        for (_, v), (_, n) in zip(own, [*own[1:], (None, None)]):
            assert got[v] == n
    assert len(got) == 100


def tables(feed):
    return {n: feed[n] for n in ("agencies", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates", "shapes", "stop_distances")}


def test_extracts(feed):
    by_date = extract.by_dates(tables(feed), dt.date(2007, 3, 12), dt.date(2007, 3, 13))
    assert {(r.start_date, r.end_date) for r in by_date["calendar"].collect()} == {(dt.date(2007, 3, 12), dt.date(2007, 3, 12))} or by_date["calendar"].count() == 1
    near = extract.by_place(tables(feed), 36.9, -116.7, 2.0)
    ids = {r.trip_id for r in near["trips"].collect()}
    assert "T1" in ids and near["stops"].where("stop_id = 'C'").count() == 0 and near["shapes"].count() == 0
    assert near["stop_times"].join(near["trips"].where("trip_id = 'T1'"), "trip_I").count() == 2
    assert extract.touching_place(tables(feed), 36.95, -116.75, 1.0)["trips"].count() == 1
    assert extract.by_agencies(tables(feed), ["none"])["trips"].count() == 0
    again = extract.rebuilt(near)
    assert again["day_trips2"].count() > 0


def test_split_trips(spark):
    calls = spark.createDataFrame([(1, s, s * 60, s * 60, st) for s, st in enumerate([1, 9, 1, 2, 9, 9, 2, 9, 1, 2], 1)] + [(2, 1, 0, 0, 1), (2, 2, 9, 9, 9)], "trip_I long, seq int, arr_time_ds int, dep_time_ds int, stop_I long")
    cut = extract.cut_calls(calls, spark.createDataFrame([(1,), (2,)], "stop_I long"))
    assert sorted((r.part, r.seq) for r in cut.collect()) == [(0, 3), (0, 4), (1, 9), (1, 10)]


def test_validators(feed):
    counts = {r.warning: r.n_rows for r in validate.danglers(tables(feed) | {"days": feed["days"]}).collect()}
    assert counts["trips without route"] == 1 and counts["stops without calls or children"] == 1 and counts["days without trip"] == 0
    nulls = {(r.table_name, r.severity): r.n_rows for r in validate.null_counts(tables(feed)).collect()}
    assert nulls["trips", "must"] == 1 and nulls["stops", "must"] == 0
    assert validate.frequency_trip_count(feed["frequencies"]).collect()[0].n_trips == 12
    assert {r.reason for r in validate.sequence_violations(feed["stop_times"]).collect()} == set()
    assert validate.spacing_violations(feed["stop_times"], feed["stops"]).count() == 1
    assert validate.misplaced_stops(feed["stops"], 36.9, -116.7, 100).count() == 1
    w = validate.Warnings()
    w.add("a", "r", 3)
    w.add("b", "s")
    w.add("c", "t", 0)
    assert w.counts() == {"a": 3, "b": 1} and w.summary().startswith("3\ta") and len(w.reasons()) == 2
    w.clear()
    assert not w.counts()
    assert validate.row_count_differences({"stops": 5, "routes": 3}, dict(tables(feed))) == [("routes", 3, 2)]


def test_statistics(feed):
    counts = stats.trip_counts_per_day(feed["day_trips2"])
    by = {r.date: r.trip_counts for r in counts.collect()}
    assert by[dt.date(2007, 3, 11)] == 0 and by[dt.date(2007, 3, 6)] == 0 and len(by) == 12
    day = stats.suitable_date(counts)
    assert day.collect()[0].date == dt.date(2007, 3, 5)
    assert {r.route_I: r.frequency for r in stats.route_frequencies(feed["day_trips2"], feed["trips"], feed["routes"], day).collect()} == {1: 13, 2: 1}
    assert stats.busiest_hour(feed["day_trips2"], feed["stop_times"], day).collect()[0].hour in (14, 15)
    assert stats.trip_stats(feed.pairs, feed["trips"], feed["routes"], feed["stops"]).count() == 15
    box = stats.bounding_box(feed["stops"], 0.1).collect()[0]
    assert box.lat_max > 36.95
    assert {r.name: r.value for r in stats.feed_stats(tables(feed)).collect()}["n_stops"] == "5"
    assert stats.extent_km(feed["stops"].where("stop_id <> 'Z'")).collect()[0].height_km > 4
    assert stats.stop_centre(feed["stops"]).count() == 1


def test_comparison(spark, feed):
    a = spark.createDataFrame([("1,2,3,4",), ("5,6",), ("7",)], "stop_sequence string")
    b = spark.createDataFrame([("1,2,3",), ("5,6",)], "stop_sequence string")
    assert {r.stop_sequence for r in compare.route_difference(a, b).collect()} == {"1,2,3,4", "7"}
    assert {r.stop_sequence for r in compare.route_difference(a, b, 0.7).collect()} == {"7"}
    pairs = compare.homogenized_stops(feed["stops"], feed["stops"].where("stop_id <> 'Z'"))
    assert pairs.count() == 5 and pairs.where("other_stop_I is null").collect()[0].stop_id == "Z"
    assert compare.renumbered_stops(feed["stop_times"], pairs, ["stop_I"]).count() == 33
    moved = compare.moved_stops(feed["stops"], spark.createDataFrame([("Z", 1.0, 2.0)], "stop_id string, lat double, lon double"))
    assert moved.where("stop_id = 'Z'").collect()[0].lat == 1.0
    x, y = spark.createDataFrame([(1, None), (2, "a")], "i int, s string"), spark.createDataFrame([(1, None), (3, "b"), (3, "b")], "i int, s string")
    assert compare.rows_not_in(x, y).count() == 2 and compare.rows_not_in(x, y, ["s"]).count() == 2


def test_reachable_counts_without_rows_of_long_trips(spark):
    """As many as the list has, whichever trips are long; long trips of many stops from many origins need no row for each."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    calls = spark.createDataFrame([(rnd.randrange(40), trip) for trip in range(30) for _ in range(rnd.choice((2, 3, 12)))] + [(None, 1), (3, None), (5, -1)], "stop_I long, trip_I long")
    near = spark.createDataFrame([(rnd.randrange(40), rnd.randrange(45), rnd.randrange(150)) for _ in range(120)] + [(None, 3, 5), (None, 4, 5)], "from_stop_I long, to_stop_I long, d int")
    listed = events.reachable_without_change(near, calls, 100).groupBy("origin").agg(F.count("*").alias("n_stops")).collect()
    for long in (0, 3, 8, 1000):
        assert sorted(map(str, events.reachable_counts(near, calls, 100, long).collect())) == sorted(map(str, listed)), long
    every = spark.range(60000).select(F.col("id").alias("stop_I"), (F.col("id") * 0).alias("trip_I"))  # 3.6 billion pairs
    to_self = every.select(F.col("stop_I").alias("from_stop_I"), F.col("stop_I").alias("to_stop_I"), F.lit(0).alias("d"))
    assert {tuple(r) for r in events.reachable_counts(to_self, every, 100).select("n_stops").distinct().collect()} == {(60000,)}


def test_like_sets_by_rare_stops_and_by_frequent_ones(spark):
    """Equal to comparing all with all, also where like sets share frequent stops only or the frequent ones exceed the bits; what is joined stays small."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    sets = [(k, k % 2 == 0, [str(s) for s in range(12) if rnd.random() < 0.6] + [str(rnd.randrange(100, 400)) for _ in range(rnd.randrange(1, 9))]) for k in range(300)]
    sets = [(k, own, list(dict.fromkeys(stops))) for k, own, stops in sets]
    df = spark.createDataFrame(sets, "id long, own boolean, stops array<string>")
    for ratio, frequent in ((0.5, 20), (0.7, 20), (0.5, 1), (0.3, 1000), (1.0, 20), (0.0, 20)):
        like = {k for k, own, x in sets if own for _, other, y in sets if not other and set(x) & set(y) and len(set(x) & set(y)) >= ratio * len(set(x) | set(y))}
        assert {r.id for r in compare._like_sets(df, ratio, frequent).collect()} == like, (ratio, frequent)
    # every sequence calls at one stop: 13 million pairs if sets were joined by each stop
    hub = spark.range(12000).select(F.concat_ws(",", F.lit("7"), (F.col("id") + 100).cast("string"), (F.col("id") + 20000).cast("string")).alias("stop_sequence"))
    observed = compare.route_difference(hub.where("stop_sequence like '%1'"), hub.where("stop_sequence not like '%1'"), 0.5)
    assert observed.count() == 1200


def test_shapes(feed):
    assert shapes.passage_times([0, 2, 5, 10, 20, 100], [0, 2, 5], [0, 1, 20]) == pytest.approx([0, 0.4, 1, 2, 4, 20])
    lines = shapes.shape_lines(feed["shapes"])
    trips = events.trip_lines(feed["stop_times"], feed["stops"]).join(feed["trips"].select("trip_I", "shape_id"), "trip_I")
    breaks = shapes.shape_breaks(trips.where("shape_id is not null"), lines)
    assert [r.breaks for r in breaks.collect()] == [[0, 2, 3]]
    cut = shapes.shape_slices(breaks.join(trips.select("trip_I", "shape_id"), "trip_I"), lines).collect()
    assert {r.leg: len(r.points) for r in cut} == {1: 3, 2: 2}
    assert shapes.match_stops(np.array([0.0, 50.0]), np.array([0.0, 0.0]), np.array([10.0, 20.0]), np.array([5.0, 5.0]))[0] == []


def test_geometry(spark, feed):
    square = spark.createDataFrame([(0.0, 0.0), (0.0, 0.1), (0.1, 0.0), (0.1, 0.1), (0.05, 0.05), (None, 1.0)], "lat double, lon double")
    assert len(geometry.convex_hull(square)) == 4 and geometry.hull_area_km2(square) == pytest.approx(123.9, rel=0.01)
    one = spark.createDataFrame([(60.0, 25.0), (60.0, 25.0)], "lat double, lon double")
    assert geometry.buffered_area_km2(one, 500) == pytest.approx(np.pi * 0.25, rel=0.02) and geometry.hull_area_km2(one) == 0
    assert geometry.hull_area_km2(square.where("lat > 5")) == 0 and geometry.buffered_area_km2(square.where("lat > 5"), 10) == 0


def test_exports(feed, tmp_path):
    export.write_geojson(export.stops_geojson(feed["stops"]), str(tmp_path / "s.json"))
    read = export.read_geojson(str(tmp_path / "s.json"))
    assert len(read["features"]) == 5 and read["features"][0]["geometry"]["type"] == "Point"
    export.write_static_networks(feed, str(tmp_path / "net"))
    assert (tmp_path / "net" / "network=bus").exists()
    export.write_temporal_network(feed, str(tmp_path / "temporal"))
    assert feed.spark.read.option("header", True).csv(str(tmp_path / "temporal")).count() == feed.events().count()
    export.write_csv(export.walk_edges(feed), str(tmp_path / "walk"))
    assert export.located_distances(feed).columns[-4:] == ["from_lat", "from_lon", "to_lat", "to_lon"]
    links = networks.stop_to_stop(feed.events(), feed["stops"])
    line = json.loads(export.sections_geojson(links, feed["stops"]).first().feature)
    assert line["geometry"]["type"] == "LineString"
    lines = events.longest_trip_per_route(feed["trips"]).join(events.trip_lines(feed["stop_times"], feed["stops"]), "trip_I")
    assert export.routes_geojson(lines, feed["routes"]).count() == 2


def test_streams(spark, feed, tmp_path):
    calls = feed.day_stop_times().select("stop_I", F.timestamp_seconds("dep_time_ut").alias("departed_at"))
    calls.write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in departures_per_window(calls).collect()}
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    query = departures_per_window(stream).writeStream.format("memory").queryName("departures").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("departures").collect()} == want
    assert service_periods(calls).agg(F.sum("n")).collect()[0][0] == calls.count()


def test_empty_feed_tables(spark, feed):
    none = {n: t.limit(0) for n, t in tables(feed).items()}
    days_ = derive.days(none["trips"], none["calendar"], none["calendar_dates"])
    dated = derive.day_trips(days_, none["trips"])
    assert events.transit_events(dated, none["trips"], none["routes"], none["stop_times"]).count() == 0
    assert stats.trip_counts_per_day(dated).count() == 0 and stats.suitable_date(stats.trip_counts_per_day(dated)).count() == 0
    assert networks.walk_network(none["stop_distances"]).count() == 0 and validate.danglers(none).agg(F.sum("n_rows")).collect()[0][0] == 0
    assert extract.by_place(none, 0, 0, 1)["trips"].count() == 0


def test_walks_over_streets(spark):
    nodes = spark.createDataFrame([(1, 50.0, 7.0), (2, 50.0, 7.004), (3, 50.002, 7.004), (4, 50.002, 7.0), (5, 50.5, 7.0)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(1, "footway", None, [1, 2, 3]), (2, "path", "ferry", [1, 4]), (3, "rail", None, [3, 4]), (4, "steps", None, [3, 3, 9])], "way_id long, kind string, route string, node_ids array<long>")
    edges = walking.street_edges(ways, nodes)
    assert {(r.a, r.b) for r in edges.collect()} == {(1, 2), (2, 3)}
    stops = spark.createDataFrame([(10, 50.0001, 7.0), (11, 50.002, 7.0041), (12, 50.002, 6.9999), (13, None, None), (14, 51.0, 7.0)], "stop_I long, lat double, lon double")
    assert {(r.stop_I, r.node_id) for r in walking.nearest_nodes(stops, nodes, 100).collect()} == {(10, 1), (11, 3), (12, 4)}
    got = {(r.from_stop_I, r.to_stop_I): r.d_walk for r in walking.walk_distances(stops, nodes, edges, match=100).collect()}
    assert set(got) == {(10, 11), (11, 10)} and got[10, 11] == got[11, 10] and 520 < got[10, 11] < 540
    assert walking.walk_distances(stops, nodes, edges, most=300, match=100).count() == 0
    known = spark.createDataFrame([(10, 11, 400, None), (10, 12, 230, None)], "from_stop_I long, to_stop_I long, d int, d_walk int")
    assert {(r.from_stop_I, r.to_stop_I, r.d) for r in walking.with_walk_distances(known, spark.createDataFrame([(10, 11, 530)], "from_stop_I long, to_stop_I long, d_walk int")).where("d_walk = 530").collect()} == {(10, 11, 400)}


def test_trajectories(spark):
    day = spark.createDataFrame([(1, 0, 100, 200), (2, 0, 500, 600)], "trip_I long, day_start_ut long, start_time_ut long, end_time_ut long")
    calls = spark.createDataFrame([(1, 1, 100, 1), (1, 2, 200, 2), (2, 1, 500, 1)], "trip_I long, stop_I long, dep_time_ds int, seq int")
    stops = spark.createDataFrame([(1, 50.0, 7.0), (2, 50.0, 7.2)], "stop_I long, lat double, lon double")
    trips, routes = spark.createDataFrame([(1, 5, "S"), (2, 5, None)], "trip_I long, route_I long, shape_id string"), spark.createDataFrame([(5, "7", 3)], "route_I long, name string, type int")
    r = events.trajectories(day, calls, stops, trips, routes, 90, 210).collect()
    assert [(x.trip_I, [tuple(p) for p in x.points]) for x in r] == [(1, [(100, 50.0, 7.0), (200, 50.0, 7.2)])]
    lines = spark.createDataFrame([("S", [(0, 50.0, 7.0, 0), (1, 50.0, 7.1, 50), (2, 50.0, 7.2, 100)])], "shape_id string, points array<struct<seq:int,lat:double,lon:double,d:int>>")
    r = events.trajectories(day, calls, stops, trips, routes, 0, 900, shapes=lines, breaks=spark.createDataFrame([(1, [0, 2])], "trip_I long, breaks array<int>")).collect()
    assert {x.trip_I: [p.time for p in x.points] for x in r} == {1: [100, 150, 200], 2: [500]}
    assert events.trajectories(day, calls, stops, trips, routes, 90, 210, route_name="8").count() == 0


def test_validator_runs(spark, feed):
    import io

    names = ("stops", "stop_times", "trips", "routes", "calendar")
    found = validate.check_import({"stops": 99}, {n: feed[n] for n in names})
    assert "rows of stops differ from the source" in found.counts()
    pairs = feed.pairs
    timed = validate.check_timetable({n: feed[n] for n in names}, stats.trip_stats(pairs, feed["trips"], feed["routes"], feed["stops"]), (36.9, -116.7, 50.0))
    assert timed.counts()["stops outside of the place"] == 1
    out = io.StringIO()
    timed.write_summary(out)
    timed.write_details(out)
    assert "stops outside of the place" in out.getvalue() and "Unused" in out.getvalue()


def test_numbers_follow_the_order_over_all_partitions(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") != 7, (F.col("id") * 7919) % 5003)).repartition(7)
    got = [(r.k, r.n) for r in numbered(rows, ["k"], "n").orderBy("n").collect()]
    assert [n for _, n in got] == list(range(1, 5001)) and got[0][0] is None and [k for k, _ in got[1:]] == sorted(k for k, _ in got[1:])


def test_hot_trips_are_numbered_like_others(spark):
    rows = spark.createDataFrame([(t, k, (k * 37) % 101) for t in (1, 2, None) for k in range(60 if t != 2 else 5)], "trip_I long, stop_time_I long, seq int").withColumn("seq", F.when(F.col("seq") != 3, F.col("seq")))
    whole, split = ({(r.trip_I, r.stop_time_I): r.seq for r in derive.resequenced(rows, hot_rows=n).collect()} for n in (1000, 20))
    assert whole == split and len(whole) == 125 and sorted(v for (t, _), v in split.items() if t is None) == list(range(1, 61))


def test_command_line(spark, tmp_path):
    import io

    from transloom.__main__ import main

    source = tmp_path / "text"
    source.mkdir()
    for name, text in FEED.items():
        (source / f"{name}.txt").write_text(text, encoding="utf-8")
    whole, part, out = (str(tmp_path / n) for n in ("whole", "part", "out.zip"))
    assert main(["import", str(source), "--out", whole]) == 0
    assert main(["filter", whole, "--out", part, "--start", "2007-03-07", "--end", "2007-03-10"]) == 0
    said = io.StringIO()
    assert main(["stats", part], said) == 0
    told = dict(line.split("\t", 1) for line in said.getvalue().splitlines())
    assert told["timezone"] == "America/Los_Angeles" and told["copied_from"] == str(source) and (told["first_date"], told["last_date"]) == ("2007-03-07", "2007-03-09")
    assert main(["export", part, "--out", out]) == 0 and (tmp_path / "out.zip").stat().st_size > 0
    assert main(["validate", whole], said) >= 1
