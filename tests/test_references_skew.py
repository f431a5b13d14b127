import datetime as dt
import random

from transloom.operators.references import Reference, orphan_report, orphan_rows
from transloom.operators.skew import heavy_keys, key_profile, mode, weighted_percentiles

DAY = lambda n: dt.datetime(2025, 1, n)
CHILD = "id long, ref long, loaded_at timestamp_ntz, live string"
PARENT = "pk long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, ref string"


def find(spark, child, parent, **kw):
    ref = Reference("c", spark.createDataFrame(child, CHILD), "id", "ref", spark.createDataFrame(parent, PARENT), "pk")
    return orphan_rows(ref, **kw)


def test_kinds(spark):
    parent = [(1, DAY(1), None, ""), (2, DAY(1), DAY(3), ""), (3, DAY(9), None, ""), (4, None, None, ""), (5, DAY(9), DAY(9), ""), (6, DAY(1), DAY(2), ""), (6, DAY(2), None, ""), (None, DAY(1), None, "")]
    child = [(10, 1, DAY(5), ""), (11, 2, DAY(2), ""), (12, 3, DAY(5), ""), (13, 3, DAY(9), ""), (14, 4, DAY(5), ""), (15, 5, DAY(5), ""), (16, 99, DAY(5), ""), (17, None, DAY(5), ""), (18, 3, None, ""), (19, 6, DAY(5), ""), (16, 99, DAY(5), ""), (None, 98, None, "")]
    for limit in (0, 1000):
        found = find(spark, child, parent, broadcast_rows=limit)
        got = sorted(((r.row_key, r.kind) for r in found.collect()), key=repr)
        assert got == sorted([(11, "deleted"), (12, "late"), (15, "deleted"), (16, "missing"), (16, "missing"), (None, "missing")], key=repr)
    report = {(r.kind, r.month): r.n_rows for r in orphan_report(found).collect()}
    assert report == {("deleted", "2025-01"): 2, ("late", "2025-01"): 1, ("missing", "2025-01"): 2, ("missing", None): 1}


def test_empty_sides(spark):
    assert find(spark, [], [(1, DAY(1), None, "")]).count() == 0
    assert [r.kind for r in find(spark, [(1, 7, DAY(1), "")], []).collect()] == ["missing"]


def test_hot_keys(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 1, 2, None, rng.randrange(50)]), rng.choice([None, *range(9)]), rng.choice([None, *range(100)]), "x") for _ in range(3000)]
    rows = spark.createDataFrame(data, "k long, p long, v int, weight string")
    got = {r.key_value: r for r in key_profile(rows, "k", "p", "v").collect()}
    for key in {d[0] for d in data}:
        own = [d for d in data if d[0] == key]
        partners, values = [d[1] for d in own if d[1] is not None], [d[2] for d in own if d[2] is not None]
        r = got[key]
        assert (r.n_rows, r.n_partners, r.first_measure, r.last_measure) == (len(own), len(set(partners)), min(values, default=None), max(values, default=None))
        top = min(set(partners), key=lambda p: (-partners.count(p), p), default=None)
        assert r.top_partner == top and r.top_partner_rows == (partners.count(top) if partners else None)
    heavy = {r.key_value for r in heavy_keys(key_profile(rows, "k", "p", "v"), rows, 0.01).collect()}
    assert heavy == {k for k in got if k is not None and got[k].n_rows * 100 >= 3000}
    pct = {(r.key_value, r.percent): r.value for r in weighted_percentiles(rows, "k", "v", [0, 10, 50, 100]).collect()}
    for key in got:
        values = sorted(d[2] for d in data if d[0] == key and d[2] is not None)
        if key is None or not values:
            assert (key, 50) not in pct
            continue
        for p in (0, 10, 50, 100):
            assert pct[key, p] == values[max(0, -(-p * len(values) // 100) - 1)], (key, p)
    modes = {r.key_value: (r.value, r.n_rows) for r in mode(rows, "k", "v").collect()}
    own = [d[2] for d in data if d[0] == 1 and d[2] is not None]
    best = min(set(own), key=lambda v: (-own.count(v), v))
    assert modes[1] == (best, own.count(best))


def test_empty_profile(spark):
    rows = spark.createDataFrame([], "k long, p long, v int")
    profile = key_profile(rows, "k", "p", "v")
    assert profile.count() == 0 and heavy_keys(profile, rows, 0.01).count() == 0
    assert weighted_percentiles(rows, "k", "v", [50]).count() == 0 and mode(rows, "k", "v").count() == 0
