"""Differences between two feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.common import checkpoint, numbered
from transloom.functions.geo import haversine


def rows_not_in(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``right`` whose key columns no row of ``left`` has, nulls being equal."""
    keys = columns or [c for c in right.columns if c in left.columns]
    return right.exceptAll(left) if keys == right.columns == left.columns else _anti(right, left, keys)


def _anti(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    known = others.select(*[F.col(k).alias(f"known_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"known_{k}"))
    return rows.join(known, same, "left_anti")


def route_difference(routes: DataFrame, others: DataFrame, ratio: float | None = None) -> DataFrame:
    """Stop sequences of ``routes`` that have no like in ``others``: the same set of stops, or sets that share at least ``ratio`` of their union.

    Both have stop_sequence ('1,2,3'). Sets are compared only where ``_like_sets`` says that they may be like; sequences travel as numbers.
    """
    if ratio is None:
        return routes.join(others.select("stop_sequence").distinct(), "stop_sequence", "left_anti")
    of = lambda df, own: df.select("stop_sequence").distinct().withColumn("own", F.lit(own))
    sequences = checkpoint(of(routes, True).unionByName(of(others, False)).withColumn("id", F.monotonically_increasing_id()))
    like = _like_sets(sequences.select("id", "own", F.array_distinct(F.split("stop_sequence", ",")).alias("stops")), ratio)
    return routes.join(sequences.where("own").join(like, "id", "left_semi").select("stop_sequence"), "stop_sequence", "left_anti")


#: Stops in more sets than this are frequent; of these the most frequent, at most 63, are bits of a number.
FREQUENT, BITS = 1000, 63


def _like_sets(sets: DataFrame, ratio: float, frequent: int = FREQUENT) -> DataFrame:
    """(id): of sets (id, own, stops) the own ones that share with one of the others a stop and at least ``ratio`` of the union.

    With stops from the rarest to the most frequent, the first stop that two like sets share is among the first n - ceil(ratio n) + 1
    of either. Where that stop is rare, the pair is found by it and compared. Where it is a bit, all that they share are bits, so the
    bits of the one, those of the other and the sizes decide: bits are compared once each, with the smallest set that has them.
    """
    tokens = sets.select("id", "own", F.size("stops").alias("n"), F.explode("stops").alias("stop"))
    often = tokens.groupBy("stop").agg(F.count("*").alias("often"))
    hot = [r.stop for r in often.where(F.col("often") > frequent).orderBy(F.desc("often"), "stop").limit(BITS).collect()]
    bit = F.coalesce(F.array_position(F.array(*map(F.lit, hot)), F.col("stop")), F.lit(0)) if hot else F.lit(0)
    ranked = F.array_sort(F.collect_list(F.struct(F.when(bit > 0, 1).otherwise(0).alias("hot"), "often", "stop")))
    value = F.get(F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(len(hot))]), bit.cast("int"))
    made = checkpoint(tokens.join(often, "stop").groupBy("id", "own", "n").agg(ranked.alias("ranked"), F.sum(value).alias("bits")))
    least = F.ceil(F.lit(float(ratio)) * F.col("n"))
    # by a rare stop
    rare = made.select("id", "own", "n", F.explode(F.slice("ranked", 1, F.greatest(F.lit(1), F.least(F.col("n"), F.col("n") - least + 1)).cast("int"))).alias("s")).where("s.hot = 0").select("id", "own", "n", "s.stop")
    named = lambda df, own, p: df.where("own" if own else "not own").select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("own", "stop")], *[c for c in df.columns if c == "stop"])
    close = (F.col("a_n") >= ratio * F.col("b_n")) & (F.col("b_n") >= ratio * F.col("a_n"))
    pairs = named(rare, True, "a").join(named(rare, False, "b"), "stop").where(close).select("a_id", "b_id").distinct()
    whole = made.select("id", "own", "n", F.transform("ranked", lambda x: x["stop"]).alias("stops"))
    both = F.size(F.array_intersect("a_stops", "b_stops"))
    compared = pairs.join(named(whole, True, "a"), "a_id").join(named(whole, False, "b"), "b_id").where(both >= ratio * (F.col("a_n") + F.col("b_n") - both))
    found = compared.select(F.col("a_id").alias("id"))
    if not hot:
        return found.distinct()
    # by bits alone: with so many shared the union is so large at most
    union = [0] + [_largest(both, ratio) for both in range(1, len(hot) + 1)]
    enough = made.where((F.bit_count("bits") > 0) & (F.bit_count("bits") >= least))
    own = enough.where("own").select("id", "n", "bits")
    other = enough.where("not own").groupBy(F.col("bits").alias("b_bits")).agg(F.min("n").alias("b_n"))
    shared = F.bit_count(F.col("bits").bitwiseAND(F.col("b_bits")))
    reach = own.select("bits").distinct().crossJoin(other).where(shared > 0).groupBy("bits").agg(F.max(F.element_at(F.array(*[F.lit(u) for u in union]), shared + 1) + shared - F.col("b_n")).alias("reach"))
    return found.unionByName(own.join(reach, "bits").where("n <= reach").select("id")).distinct()


def _largest(both: int, ratio: float) -> int:
    """The largest union of which ``both`` is at least ``ratio``."""
    if ratio <= 0:
        return 1 << 30
    most = min(int(both / ratio) + 1, 1 << 30)
    while most and both < ratio * most:
        most -= 1
    return most


def section_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections (from_stop_I, to_stop_I, trip_I, route_I) of two feeds: trips and routes of each, and their differences, 0 where one has none."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("from_stop_I", "to_stop_I").agg(F.count("trip_I").alias(f"n_trips_{name}"), F.countDistinct("route_I").alias(f"n_routes_{name}"))

    both = counted(old, "old").join(counted(new, "new"), ["from_stop_I", "to_stop_I"], "full").fillna(0, ["n_trips_old", "n_trips_new", "n_routes_old", "n_routes_new"])
    return both.withColumns({"diff_n_trips": F.col("n_trips_new") - F.col("n_trips_old"), "diff_n_routes": F.col("n_routes_new") - F.col("n_routes_old")})


def homogenized_stops(stops: DataFrame, others: DataFrame, metres: float = 50.0) -> DataFrame:
    """(stop_pair_I, stop_I, other_stop_I, stop_id): stops of both feeds under shared numbers; the same stop has the same stop_id and is at most so far apart."""
    a = stops.select("stop_I", "stop_id", "lat", "lon")
    b = others.select(F.col("stop_I").alias("other_stop_I"), F.col("stop_id").alias("other_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    near = haversine(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= metres
    joined = a.join(b, (F.col("stop_id") == F.col("other_id")) & near, "full")
    named = joined.select("stop_I", "other_stop_I", F.coalesce("stop_id", "other_id").alias("stop_id"))
    placed = named.withColumns({"alone": F.col("stop_I").isNull() | F.col("other_stop_I").isNull(), "second": F.col("stop_I").isNull()})
    return numbered(placed, ["alone", "stop_id", "second", "stop_I", "other_stop_I"], "stop_pair_I").select("stop_pair_I", "stop_I", "other_stop_I", "stop_id")


def renumbered_stops(table: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """A table with its stop columns in the shared numbers."""
    for c in columns:
        shared = pairs.where("stop_I is not null").select(F.col("stop_I").alias(c), F.col("stop_pair_I").alias("shared_"))
        table = table.join(shared, c, "left").withColumn(c, F.coalesce("shared_", F.col(c))).drop("shared_")
    return table


def moved_stops(stops: DataFrame, updates: DataFrame) -> DataFrame:
    """stops with the coordinates that updates (stop_id, lat, lon) give."""
    new = updates.select("stop_id", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"))
    return stops.join(new, "stop_id", "left").withColumns({"lat": F.coalesce("new_lat", "lat"), "lon": F.coalesce("new_lon", "lon")}).select(*stops.columns)
