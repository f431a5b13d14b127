import random

from transloom.llm.linkage import link, read_name

SCHEMA = "id long, name string, lat double, lon double, town string, type int, place string"


def test_names():
    towns = frozenset({"aldacre"})
    assert read_name("Aldacre, Grimwick Gdns (request stop)", None, towns)[:3] == ("grimwick", "gardens", "")
    assert read_name("Rathaus Élmby dir. S", "Aldacre", towns)[:3] == ("elmby", "townhall", "s")
    assert read_name("elmby civic hall - bay B", None, towns)[:3] == ("elmby", "townhall", "b")
    assert read_name("Elmby Srteet (out)", None, towns)[:3] == ("elmby", "street", "out")
    assert read_name("Gare de Elmby quai 2", None, towns)[:3] == ("elmby", "station", "2")
    assert read_name(None, None, towns) == ("", "", "", "", "")


def test_sides_stations_neighbours_and_noise(spark):
    left = [
        (1, "Elmby Church (N)", 51.0, 7.0, "Aldacre", 0, ""), (2, "Elmby Church (S)", 51.0002, 7.0, "Aldacre", 0, ""), (3, "Rudford Station", 51.01, 7.0, None, 1, ""), (4, "Rudford Station Platform 1", 51.01005, 7.0, None, 0, ""),
        (5, "Kelgate Mill", 51.02, 7.0, None, None, ""), (6, None, 51.03, 7.0, None, None, ""), (7, "Lost Library", None, None, "Aldacre", 0, ""), (8, "Edge Park", 10.0, 179.9999, None, 0, ""), (9, "Swapped Road", 120.5, 45.1, None, 0, ""), (None, "Elmby Church", 51.0, 7.0, None, 0, ""),
    ]
    right = [
        (101, "elmby ch. southbound", 51.0001, 7.0, "Aldacre", None, ""), (102, "Aldacre - ELMBY CHURCH dir. N *", 51.0001, 7.0, "Aldacre", None, ""), (103, "Rudford Stn", 51.01005, 7.0, None, 1, ""), (104, "Kelgaet Mill", 51.0201, 7.0, None, 0, ""),
        (105, "Kelgate Church", 51.02, 7.0, None, 0, ""), (106, "Lost Lib.", None, 7.0, "Aldacre", 0, ""), (107, "Edge  Park", 10.0, -179.9999, None, 0, ""), (108, "", 51.0, 7.0, None, 0, ""), (109, None, 51.0, 7.0, None, 0, ""),
        (110, "Swapped Rd", 45.1, 120.5, None, 0, ""), (111, "elmby church southbound", 51.0002, 7.0001, None, None, ""), (104, "Kelgaet Mill", 51.0201, 7.0, None, 0, ""),
    ]
    rows = link(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert sorted((r.b_id, r.a_id) for r in rows) == [(101, 2), (102, 1), (103, 3), (104, 5), (106, 7), (107, 8), (110, 9), (111, 2)]
    assert all(0 <= r.confidence <= 1 for r in rows)


def test_held_out_accuracy(spark):
    """Names written again with an abbreviation or one wrong letter, half of them moved: nearly all found, hardly any wrong."""
    rng = random.Random(6)
    kinds = {"Street": "St.", "Church": "Ch.", "Bridge": "Br.", "School": "Sch."}
    first, second = ["Elm", "Rud", "Kel", "Gol", "Zorn", "Wyr", "Nor", "Tarn"], ["by", "ford", "gate", "wick", "holt", "dorf", "sand", "mere"]
    left, right, want = [], [], {}
    for i in range(300):
        name, kind = rng.choice(first) + rng.choice(second), rng.choice(list(kinds))
        lat, lon = 40 + rng.random() * 0.1, 9 + rng.random() * 0.1
        left.append((i, f"{name} {kind}", lat, lon, None, 0, ""))
        if i % 3:
            typo = name if rng.random() < 0.6 else name[:2] + "x" + name[3:]
            right.append((1000 + i, rng.choice([f"{typo} {kinds[kind]}", f"{typo.upper()} {kind}", f"{kind}, {typo}"]), lat + rng.gauss(0, 1e-4), lon + rng.gauss(0, 1e-4), None, None, ""))
            want[1000 + i] = i
    got = {r.b_id: r.a_id for r in link(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()}
    correct = sum(want[b] == a for b, a in got.items())
    assert correct >= 0.95 * len(want) and correct >= 0.98 * len(got)


def test_empty_sides(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "Elmby", 1.0, 1.0, None, 0, "")], SCHEMA)
    assert link(empty, one).count() == 0 and link(one, empty).count() == 0 and link(empty, empty).count() == 0


def test_near_records_of_like_name_do_not_push_out_one_without_position(spark):
    left = [(1, "Elmby Church", None, None, "Aldacre", 0, ""), (2, "Elmford Church", 51.0, 7.0, "Aldacre", 0, ""), (3, "Elmgate Church", 51.0003, 7.0, "Aldacre", 0, ""), (4, "Rudford Mill", 51.01, 7.0, None, 0, "")]
    right = [(101, "Elmby Ch.", 51.0001, 7.0, "Aldacre", 0, ""), (102, "Rudford Mill", None, None, None, 0, ""), (103, "Elmford Ch.", 51.0, 7.0, "Aldacre", 0, "")]
    rows = link(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert sorted((r.b_id, r.a_id) for r in rows) == [(101, 1), (102, 4), (103, 2)]


def test_swapped_positions_that_stay_in_range(spark):
    left = [(1, "Elmby Church", 7.0, 51.0, None, 0, ""), (2, "Rudford Mill", 51.01, 7.01, "Aldacre", 0, ""), (3, "Kelgate Road", 7.02, 51.02, "Aldacre", 0, ""), (4, "Elmby Church", 20.0, 30.0, None, 0, "")]
    right = [(101, "Elmby Ch.", 51.0001, 7.0, "Aldacre", 0, ""), (102, "Rudford Mill", 7.01, 51.0101, "Aldacre", 0, ""), (103, "Kelgate Road", 51.02, 7.02, "Falenport", 0, ""), (104, "Elmby Church", 30.1, 20.1, None, 0, "")]
    rows = link(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert sorted((r.b_id, r.a_id) for r in rows) == [(101, 1), (102, 2)]


def test_neighbours_change_decisions(spark):
    """A record without a side goes to the side that no other record takes, and a stop written twice keeps both."""
    left = [(1, "Elmby Road (N)", 51.0, 7.0, "Aldacre", 0, ""), (2, "Elmby Road (S)", 51.00014, 7.0, "Aldacre", 0, ""), (3, "Rudford Mill", 51.01, 7.0, "Aldacre", 0, "")]
    right = [(101, "Elmby Rd northbound", 51.00005, 7.0, "Aldacre", 0, ""), (102, "elmby road", 51.00006, 7.0, "Aldacre", 0, ""), (103, "Rudford Mill", 51.00999, 7.0, "Aldacre", 0, ""), (104, "Mill, Rudford", 51.01002, 7.0, "Aldacre", 0, "")]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    alone = {(r.b_id, r.a_id) for r in link(a, b, propagate=False).collect()}
    together = {(r.b_id, r.a_id) for r in link(a, b).collect()}
    assert alone == {(101, 1), (102, 1), (103, 3), (104, 3)} and together == {(101, 1), (102, 2), (103, 3), (104, 3)}


def test_towns_are_dropped_whatever_their_number(spark, monkeypatch):
    left = [(i, f"Elmby Church {i}", 51.0 + i / 50, 7.0, f"Town{chr(97 + i)}", 0, "") for i in range(4)]
    right = [(100 + i, f"Town{chr(97 + i)} - ELMBY CH. {i}", 51.0 + i / 50, 7.0, None, 0, "") for i in range(4)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = [sorted((r.b_id, r.a_id) for r in link(a, b).collect())]
    monkeypatch.setattr("transloom.llm.linkage.BROADCAST_TOWNS", 0)
    got.append(sorted((r.b_id, r.a_id) for r in link(a, b).collect()))
    assert got[0] == got[1] == [(100 + i, i) for i in range(4)]
