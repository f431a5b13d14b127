import numpy as np
import pytest

from transloom.functions.geo import haversine_np, unit_vectors
from transloom.operators.proximity import VoronoiPartition, near_and_containing, points_in_ring, vantage_point_join

POINTS = "stop_I long, lat double, lon double, cell string, home string"
ZONES = "zone_I long, zone_kind string, ring array<struct<seq:int,lat:double,lon:double>>"


def brute(rows, radius):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and not (r[1] == 0 and r[2] == 0) and abs(r[1]) <= 90 and abs(r[2]) <= 180]
    key, lat, lon = (np.array(x) for x in zip(*[r[:3] for r in rows]))
    return {(int(k), int(key[j])) for k, y, x in zip(key, lat, lon) for j in np.flatnonzero((haversine_np(y, x, lat, lon) <= radius) & (key > k))}


def world(seed, n):
    rng = np.random.default_rng(seed)
    towns = [(51.0, 0.0), (-54.7, 179.999), (89.9995, 10.0), (-89.9999, -170.0), (0.0, 0.0), (12.0, -180.0)]
    rows = []
    for i in range(n):
        lat, lon = towns[i % len(towns)]
        lat = float(np.clip(lat + rng.normal(0, 0.004), -90, 90))
        lon = float((lon + rng.normal(0, 0.004) + 180) % 360 - 180)
        rows.append((i, lat, lon, "x", "y"))
    return rows


@pytest.mark.parametrize("block", [7, 2000])
def test_radius_pairs_equal_brute_force_everywhere_on_the_sphere(spark, block):
    rows = world(1, 400)
    rows += [(1000, None, 1.0, None, None), (1001, 0.0, 0.0, "", ""), (1002, 91.0, 5.0, "", ""), (None, 51.0, 0.0, "", ""), (1003, 51.0, 0.0, "", ""), (1004, 51.0, 0.0, "", ""), (1004, 51.0, 0.0, "", "")]
    got = VoronoiPartition(spark.createDataFrame(rows, POINTS), "stop_I", "lat", "lon", 250.0, block_rows=block).near_pairs().collect()
    assert len(got) == len({(r.key_a, r.key_b) for r in got})
    assert {(r.key_a, r.key_b) for r in got} == brute(rows, 250.0)


def test_ties_at_one_place_are_all_near(spark):
    rows = [(i, 48.0, 2.0, None, None) for i in range(120)]
    got = VoronoiPartition(spark.createDataFrame(rows, POINTS), "stop_I", "lat", "lon", 250.0, block_rows=20).near_pairs()
    assert got.count() == 120 * 119 // 2


def town(n, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, float(51 + y), float(7 + x), None, None) for i, (y, x) in enumerate(rng.uniform(0, 0.1, (n, 2)))]


def test_split_cells_find_the_same_with_few_copies(spark):
    copies = []
    for n in (400, 1600):
        rows = town(n) + [(9000 + i, 51.05, 7.05, None, None) for i in range(60)]
        square = [(0, 51.02, 7.02), (1, 51.02, 7.06), (2, 51.06, 7.06), (3, 51.06, 7.02)]
        cells = VoronoiPartition(spark.createDataFrame(rows, POINTS), "stop_I", "lat", "lon", 100.0, max_pivots=3, split_rows=n // 12, block_rows=40, regions=spark.createDataFrame([(1, "a", square)], ZONES), region_key="zone_I")
        assert {(r.key_a, r.key_b) for r in cells.near_pairs().collect()} == brute(rows, 100.0)
        assert {(r.key_a, r.key_b) for r in cells.containing().collect()} == {(1, r[0]) for r in rows if 51.02 < r[1] < 51.06 and 7.02 < r[2] < 7.06}
        assert cells.rows.where("home and not region").count() == len(rows)
        copies.append(cells.rows.where("not region").count() / len(rows))
    assert max(copies) < 3


def test_vantage_points_miss_nothing():
    rng = np.random.default_rng(3)
    lat, lon = rng.uniform(10, 10.05, 900), rng.uniform(20, 20.05, 900)
    v = unit_vectors(lat, lon)
    b, p = vantage_point_join(v, v, 300.0)
    want = {(i, j) for i in range(900) for j in np.flatnonzero(haversine_np(lat[i], lon[i], lat, lon) <= 300)}
    assert want <= set(zip(b.tolist(), p.tolist()))


def test_regions_of_either_orientation_and_degenerate_rings(spark):
    square = [(0, 0.5, 0.5), (1, 0.5, 2.0), (2, 2.0, 2.0), (3, 2.0, 0.5)]
    zones = spark.createDataFrame(
        [(1, "a", square), (2, "b", [(s, y, x) for s, (_, y, x) in enumerate(reversed(square))]), (3, "c", []), (4, "d", None), (5, "e", square[:2]), (6, "f", [*square[:2], (9, None, 1.0)])], ZONES
    )
    points = spark.createDataFrame([(10, 1.0, 1.0, "", ""), (11, 3.0, 1.0, "", ""), (12, None, None, "", "")], POINTS)
    got = near_and_containing(points, zones, point_key="stop_I", region_key="zone_I")
    assert {tuple(r) for r in got.collect()} == {("zone", 1, 10), ("zone", 2, 10)}


def test_concave_ring():
    y, x = np.array([0, 0, 4, 4, 1.0]), np.array([0, 4, 4, 0, 2.0])
    assert points_in_ring(np.array([0.5, 2.0, 3.0]), np.array([2.0, 0.6, 3.5]), y, x).tolist() == [True, False, True]


def test_empty_tables(spark):
    empty = near_and_containing(spark.createDataFrame([], POINTS), spark.createDataFrame([], ZONES), point_key="stop_I", region_key="zone_I")
    assert empty.columns == ["kind", "key_a", "key_b"] and empty.count() == 0
    alone = near_and_containing(spark.createDataFrame([(1, 5.0, 5.0, "", "")], POINTS), spark.createDataFrame([], ZONES), point_key="stop_I", region_key="zone_I")
    assert alone.count() == 0
