"""Complete radius joins and region containment on the sphere.

Points are split by a Voronoi partition around pivots. A point is copied to every cell whose pivot is at most two radii farther
than its own, by the triangle inequality all that a neighbour could live in; within a cell a vantage-point tree finds the pairs by
the exact great-circle metric. A cell with too many points is split by pivots of its own, again and again, so that copies stay at
the rims however many points there are. Only what no pivots can split, points within a few radii of each other and so mostly pairs
themselves, is hashed into blocks of bounded size, each pair of blocks being one task. A region is a point with a radius of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.common import at_most, broadcast_if_small, checkpoint
from transloom.functions.geo import EARTH_RADIUS, haversine_np, unit_vectors, usable_position

#: Pivots are thinned from the positions of lowest hash, so many at most.
PIVOT_SAMPLE = 20_000
#: Pivots of the first level at most; bounds what is broadcast. Larger cells have pivots of their own.
MAX_PIVOTS = 2_048
#: A cell of more points is split; its pivots are so many at most, from so many of its points in expectation.
SPLIT_ROWS, CELL_PIVOTS, CELL_SAMPLE = 8_000, 64, 2_048
#: Rows of a cell that one task assigns to its pivots, in expectation.
ASSIGN_ROWS = 50_000
#: A split must leave no part with more than this share of the cell, and make no more copies than this.
LARGEST_PART, MOST_COPIES = 0.9, 2.5
#: Names of cells that may be broadcast.
BROADCAST_CELLS = 200_000
#: Pivots are so many radii apart at least.
PIVOT_GAP_RADII = 8
#: Rows of one side in one task at most, in expectation.
BLOCK_ROWS = 2_000
#: Metres added to every pruning bound against rounding.
SLACK_M = 1.0


def choose_pivots(points: DataFrame, gap_m: float, max_pivots: int = MAX_PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Unit vectors of pivots at least ``gap_m`` apart: a bounded, deterministic sample of positions, thinned greedily."""
    rows = (
        points.select("lat", "lon", F.xxhash64("lat", "lon").alias("h"))
        .distinct()
        .orderBy("h", "lat", "lon")
        .limit(sample)
        .toPandas()
    )
    if rows.empty:
        return np.zeros((0, 3))
    vectors = unit_vectors(rows.lat.to_numpy(), rows.lon.to_numpy())
    limit = np.cos(min(np.pi, gap_m / EARTH_RADIUS))
    kept, free = [], np.ones(len(vectors), bool)
    for i in range(len(vectors)):
        if free[i]:
            kept.append(i)
            if len(kept) == max_pivots:
                break
            free &= vectors @ vectors[i] < limit
    return vectors[kept]


def _near_cells(lat: np.ndarray, lon: np.ndarray, reach_m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, home): each row's own pivot, and those that are at most twice its reach farther."""
    dots = unit_vectors(lat, lon) @ pivots.T
    every = np.arange(len(lat))
    own = dots.argmax(1)
    far = np.arccos(np.clip(dots[every, own], -1, 1)) + (2 * reach_m + SLACK_M) / EARTH_RADIUS
    near = dots >= np.where(far >= np.pi, -2.0, np.cos(np.minimum(far, np.pi)) - 1e-13)[:, None]
    near[every, own] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == own[row]


ROWS = "pid long, lat double, lon double, reach double, region boolean, cell string, home boolean"


def _assigner(pivots: np.ndarray):
    """mapInPandas function: each row once per cell of the first level, ``home`` marking its own."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 2_000_000 // len(pivots))
        for batch in batches:
            for k in range(0, len(batch), step):
                part = batch.iloc[k : k + step]
                row, cell, home = _near_cells(*(part[c].to_numpy() for c in ("lat", "lon", "reach")), pivots)
                yield part.iloc[row].assign(cell=cell.astype(str), home=home)

    return assign


def _cell_pivots(radius_m: float):
    """A cell's sample to its pivots, none where they would not split it."""

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        lat, lon, reach = (part[c].to_numpy() for c in ("lat", "lon", "reach"))
        vectors = unit_vectors(lat, lon)
        for gap in (8, 4, 2):
            limit = np.cos(min(np.pi, gap * max(radius_m, 1.0) / EARTH_RADIUS))
            kept, free = [], np.ones(len(vectors), bool)
            while free.any() and len(kept) < CELL_PIVOTS:
                kept.append(int(free.argmax()))
                free &= vectors @ vectors[kept[-1]] < limit
            if len(kept) > 1:
                row, cell, _ = _near_cells(lat, lon, reach, vectors[kept])
                if np.bincount(cell).max() <= LARGEST_PART * len(part) and len(row) <= MOST_COPIES * len(part):
                    x, y, z = vectors[kept].T
                    return pd.DataFrame({"cell": [part.cell.iloc[0]], "buckets": [part.buckets.iloc[0]], "x": [x.tolist()], "y": [y.tolist()], "z": [z.tolist()]})
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("cell", "buckets", "x", "y", "z")})

    return choose


def _split(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Members of a cell to the cells of its pivots; only a member at home in both stays at home."""
    if not len(rows) or not len(pivots):
        return rows.iloc[:0][["pid", "lat", "lon", "reach", "region", "cell", "home"]]
    p = pivots.iloc[0]
    row, cell, home = _near_cells(*(rows[c].to_numpy() for c in ("lat", "lon", "reach")), np.column_stack((p.x, p.y, p.z)))
    out = rows.iloc[row]
    return out.assign(cell=out.cell.to_numpy() + "." + cell.astype(str).astype(object), home=out.home.to_numpy() & home)[["pid", "lat", "lon", "reach", "region", "cell", "home"]]


def _metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle metres from unit vectors ``a`` to the one vector ``b``."""
    chord = np.sqrt(((a - b) ** 2).sum(1))
    return 2 * EARTH_RADIUS * np.arcsin(np.minimum(1.0, chord / 2))


def vantage_point_join(build: np.ndarray, probe: np.ndarray, radius_m: float, leaf: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Indices (build, probe) of unit vectors that may be within ``radius_m``: a vantage-point tree built and probed in one descent.

    A superset by less than a metre; the caller verifies with the exact formula. Ties at the median that would leave a side empty
    end in a leaf, which compares block by block.
    """
    reach = radius_m + SLACK_M
    limit = np.cos(min(np.pi, reach / EARTH_RADIUS)) - 1e-13
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(build)), np.arange(len(probe)))]
    while todo:
        b, p = todo.pop()
        if not len(b) or not len(p):
            continue
        outer = None
        if len(b) > leaf and len(p) > 4:
            to_b = _metres(build[b], build[b[len(b) // 2]])
            middle = np.median(to_b)
            outer = to_b > middle
        if outer is None or not outer.any():
            step = max(1, 1_000_000 // len(b))
            for k in range(0, len(p), step):
                i, j = np.nonzero(build[b] @ probe[p[k : k + step]].T >= limit)
                found.append((b[i], p[k : k + step][j]))
            continue
        to_p = _metres(probe[p], build[b[len(b) // 2]])
        todo.append((b[~outer], p[to_p <= middle + reach]))
        todo.append((b[outer], p[to_p >= middle - reach]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _pairs(radius_m: float):
    def join(part: pd.DataFrame) -> pd.DataFrame:
        build, probe = part[~part.probe], part[part.probe]
        b, p = vantage_point_join(
            unit_vectors(build.lat.to_numpy(), build.lon.to_numpy()), unit_vectors(probe.lat.to_numpy(), probe.lon.to_numpy()), radius_m
        )
        x, y = probe.iloc[p], build.iloc[b]
        d = haversine_np(x.lat.to_numpy(), x.lon.to_numpy(), y.lat.to_numpy(), y.lon.to_numpy())
        keep = (d <= radius_m) & (x.pid.to_numpy() < y.pid.to_numpy())
        return pd.DataFrame({"key_a": x.pid.to_numpy()[keep], "key_b": y.pid.to_numpy()[keep], "d": d[keep]})

    return join


def _prepared(points: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    typed = points.select(F.col(key).cast("long").alias("pid"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return typed.where(F.col("pid").isNotNull() & usable_position(F.col("lat"), F.col("lon"))).distinct()


def _placed_regions(regions: DataFrame, key: str, ring: str) -> DataFrame:
    """(rid, ring_lat, ring_lon, lat, lon, reach): regions with usable rings, the middle of their bounds and how far from it they reach at most."""
    shape = regions.select(
        F.col(key).cast("long").alias("rid"),
        F.expr(f"transform(array_sort(filter({ring}, v -> v.lat is not null and v.lon is not null), (a, b) -> cast(coalesce(a.seq, 0) - coalesce(b.seq, 0) as int)), v -> struct(cast(v.lat as double) as lat, cast(v.lon as double) as lon))").alias("ring"),
    ).where("rid is not null and size(ring) > 2")
    # no point lies beyond the range of degrees
    bound = lambda c, most: [F.greatest(F.lit(-most), F.expr(f"array_min(transform(ring, v -> v.{c}))")).alias(f"{c}_lo"), F.least(F.lit(most), F.expr(f"array_max(transform(ring, v -> v.{c}))")).alias(f"{c}_hi")]
    bounds = shape.select("rid", F.expr("transform(ring, v -> v.lat)").alias("ring_lat"), F.expr("transform(ring, v -> v.lon)").alias("ring_lon"), *bound("lat", 90.0), *bound("lon", 180.0)).where("lat_lo <= lat_hi and lon_lo <= lon_hi")
    lat, lon = (F.col("lat_lo") + F.col("lat_hi")) / 2, (F.col("lon_lo") + F.col("lon_hi")) / 2
    # along the middle's parallel, then along a meridian
    reach = F.lit(EARTH_RADIUS) * F.radians((F.col("lat_hi") - F.col("lat_lo")) / 2 + F.cos(F.radians(lat)) * (F.col("lon_hi") - F.col("lon_lo")) / 2) + SLACK_M
    return bounds.select("rid", "ring_lat", "ring_lon", lat.alias("lat"), lon.alias("lon"), reach.alias("reach"))


class VoronoiPartition:
    """Points, and regions if given, assigned to the cells of one radius; shared by the joins so that the assignment is made once."""

    def __init__(
        self, points: DataFrame, key: str, lat: str, lon: str, radius_m: float, *, regions: DataFrame | None = None, region_key: str = "", ring: str = "ring",
        max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS, split_rows: int = SPLIT_ROWS,
    ):
        self.radius_m, self.block_rows, self.split_rows = radius_m, block_rows, split_rows
        located = _prepared(points, key, lat, lon)
        placed = located.select("pid", "lat", "lon", F.lit(float(radius_m)).alias("reach"), F.lit(False).alias("region"))
        if regions is not None:
            self.regions = _placed_regions(regions, region_key, ring)
            placed = placed.unionByName(self.regions.select(F.col("rid").alias("pid"), "lat", "lon", "reach", F.lit(True).alias("region")).distinct())
        pivots = choose_pivots(located, max(PIVOT_GAP_RADII * radius_m, 1.0), max_pivots)
        if len(pivots):
            self.rows, sizes = self._divided(checkpoint(placed.mapInPandas(_assigner(pivots), ROWS)))
        else:
            self.rows = placed.select("*", F.lit("").alias("cell"), F.lit(True).alias("home")).where(F.lit(False))
            sizes = self._sizes(self.rows)
        per_block = lambda n: F.greatest(F.lit(1), F.ceil(n / block_rows)).cast("int")
        #: Cells that are too large for one task, with their blocks.
        self.large = sizes.select(F.col("cell").alias("of_cell"), per_block(F.col("at_home")).alias("probe_blocks"), per_block(F.col("n")).alias("build_blocks")).where("build_blocks > 1")

    @staticmethod
    def _sizes(rows: DataFrame) -> DataFrame:
        """(cell, n, at_home): points of each cell, and those of them that are at home."""
        return checkpoint(rows.where("not region").groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("at_home")))

    def _divided(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cells of more than ``split_rows`` points split by pivots of their own, until none is left that can be split; with the sizes of all cells."""
        done: DataFrame | None = None
        done_sizes: DataFrame | None = None
        join = lambda df, other: other if df is None else df.unionByName(other)
        while True:
            sizes = self._sizes(rows)
            large = sizes.where(F.col("n") > self.split_rows)
            if at_most(large, 0):
                return join(done, rows), join(done_sizes, sizes)
            sized = rows.where("not region").join(broadcast_if_small(large.select("cell", "n"), BROADCAST_CELLS), "cell")
            sample = sized.where(F.pmod(F.xxhash64("pid", "lat", "lon", "cell"), "n") < CELL_SAMPLE).withColumn("buckets", F.ceil(F.col("n") / ASSIGN_ROWS).cast("int"))
            pivots = checkpoint(sample.groupBy("cell").applyInPandas(_cell_pivots(self.radius_m), "cell string, buckets int, x array<double>, y array<double>, z array<double>"))
            names = broadcast_if_small(pivots.select("cell", "buckets"), BROADCAST_CELLS)
            done = join(done, rows.join(names, "cell", "left_anti").select(*rows.columns))
            done_sizes = join(done_sizes, sizes.join(names, "cell", "left_anti"))
            if at_most(pivots, 0):
                return done, done_sizes
            members = rows.join(names, "cell").withColumn("bucket", F.pmod(F.xxhash64("pid", "lat", "lon"), "buckets").cast("int"))
            each = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "x", "y", "z")
            rows = checkpoint(members.groupBy("cell", "bucket").cogroup(each.groupBy("cell", "bucket")).applyInPandas(_split, ROWS))

    def _blocked(self, rows: DataFrame) -> DataFrame:
        joined = rows.join(broadcast_if_small(self.large, BROADCAST_CELLS), F.col("cell") == F.col("of_cell"), "left")
        return joined.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("probe_blocks", "build_blocks")})

    def near_pairs(self) -> DataFrame:
        """(key_a, key_b, d): pairs of different keys, key_a < key_b, within the radius, each once.

        Only the cell of key_a reports a pair. A block pair is a task; a row meets every block of the other side of its cell.
        """
        rows = self._blocked(self.rows.where("not region"))
        block = lambda n: F.pmod(F.xxhash64("pid", "lat", "lon"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        probe = rows.where("home").select("cell", block("probe_blocks").alias("i"), every("build_blocks").alias("j"), F.lit(True).alias("probe"), "pid", "lat", "lon")
        build = rows.select("cell", every("probe_blocks").alias("i"), block("build_blocks").alias("j"), F.lit(False).alias("probe"), "pid", "lat", "lon")
        return probe.unionByName(build).groupBy("cell", "i", "j").applyInPandas(_pairs(self.radius_m), "key_a long, key_b long, d double")

    def containing(self) -> DataFrame:
        """(key_a = region, key_b = point): the point lies in the ring, whose edges are straight in the plane of lon and lat.

        Rings of fewer than three usable vertices hold nothing, and vertices without a position are passed over.
        """
        members = self._blocked(self.rows.where("home and not region")).select("cell", F.pmod(F.xxhash64("pid", "lat", "lon"), "probe_blocks").cast("int").alias("i"), "pid", "lat", "lon")
        met = self._blocked(self.rows.where("region")).select(F.col("cell").alias("cell_no"), F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1)).alias("i_no"), F.col("pid").alias("rid"))
        met = met.distinct().join(self.regions.select("rid", "ring_lat", "ring_lon"), "rid")
        return members.groupBy("cell", "i").cogroup(met.groupBy("cell_no", "i_no")).applyInPandas(_contained, "key_a long, key_b long").distinct()


def points_in_ring(lat: np.ndarray, lon: np.ndarray, ring_lat: np.ndarray, ring_lon: np.ndarray) -> np.ndarray:
    """Even-odd rule in the plane of lon and lat; the ring closes itself, either orientation."""
    inside = np.zeros(len(lat), bool)
    for k in range(len(ring_lat)):
        y1, x1, y2, x2 = ring_lat[k - 1], ring_lon[k - 1], ring_lat[k], ring_lon[k]
        crosses = (y1 > lat) != (y2 > lat)
        if crosses.any():
            inside[crosses] ^= lon[crosses] < (x2 - x1) * (lat[crosses] - y1) / (y2 - y1) + x1
    return inside


def _contained(members: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
    lat, lon, pid = members.lat.to_numpy(), members.lon.to_numpy(), members.pid.to_numpy()
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
    for rid, ring_lat, ring_lon in zip(regions.rid, regions.ring_lat, regions.ring_lon):
        y, x = np.asarray(ring_lat), np.asarray(ring_lon)
        box = np.flatnonzero((lat >= y.min()) & (lat <= y.max()) & (lon >= x.min()) & (lon <= x.max()))
        if len(box):
            hit = pid[box[points_in_ring(lat[box], lon[box], y, x)]]
            found.append((np.full(len(hit), rid, "int64"), hit))
    return pd.DataFrame({"key_a": np.concatenate([a for a, _ in found]), "key_b": np.concatenate([b for _, b in found])})


def near_and_containing(points: DataFrame, regions: DataFrame, *, point_key: str, region_key: str, lat: str = "lat", lon: str = "lon", ring: str = "ring", radius_m: float = 250.0, **settings) -> DataFrame:
    """(kind, key_a, key_b): kind 'near' for two points within ``radius_m`` (rounded up to whole metres), key_a < key_b; kind 'zone' for region key_a that holds point key_b.

    Points without a usable position, and rows with a null key, take part in nothing. Repeated rows count once; several points at
    one place are all near each other. Empty tables give an empty result. Other columns, whatever their names, are not looked at.
    """
    cells = VoronoiPartition(points, point_key, lat, lon, radius_m, regions=regions, region_key=region_key, ring=ring, **settings)
    near = cells.near_pairs().select(F.lit("near").alias("kind"), "key_a", "key_b")
    inside = cells.containing().select(F.lit("zone").alias("kind"), "key_a", "key_b")
    return near.unionByName(inside)
