"""The next row of a key in order, also where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import at_most, broadcast_if_small, checkpoint, numbered

#: A key of more rows is not sorted in one task.
HOT_ROWS = 1_000_000
#: Hot keys that may be broadcast.
MOST_HOT = 100_000


def with_next(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with next_<column> of the following row of the same keys, null for the last.

    ``order`` must be total within a key for a defined result. Keys of up to ``hot_rows`` rows use a window. The rows of larger ones
    are range-partitioned by key and order; each partition pairs its own rows, and the last of a partition gets the first of the
    next partition that holds the key, found from one row per key and partition. Null keys are keys like others.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    direct = lambda df: df.withColumns({f"next_{c}": F.lead(c).over(plain) for c in columns})
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).drop("n")
    if at_most(hot, 0):
        return direct(rows)
    hot = broadcast_if_small(hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys]), MOST_HOT)
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"hot_{k}"))
    cold = rows.join(hot, same, "left_anti")
    placed = checkpoint(rows.join(hot, same, "left_semi").repartitionByRange(*keys, *order).withColumn("at_part", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "at_part").orderBy(*order)
    packed = F.struct(*columns)
    local = placed.withColumns({"next_": F.lead(packed).over(within), "place_": F.row_number().over(within)})
    across = Window.partitionBy(*keys).orderBy("at_part")
    firsts = local.where("place_ = 1").select(*keys, "at_part", packed.alias("first_")).withColumn("following_", F.lead("first_").over(across)).select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.col("at_part").alias("of_part"), "following_"
    )
    same = F.col("at_part") == F.col("of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    chosen = F.coalesce("next_", "following_")
    joined = local.join(firsts, same, "left").withColumns({f"next_{c}": chosen[c] for c in columns})
    return direct(cold).unionByName(joined.select(*rows.columns, *[f"next_{c}" for c in columns]))


def with_number(rows: DataFrame, key: str, order: list[str], name: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``name`` = 1, 2, … (int) within each key in an order, nulls first; null is a key like others.

    Keys of up to ``hot_rows`` rows use a window. The rows of larger ones are numbered together over ranges of key and order, and
    each key's first number is taken off.
    """
    ahead = [F.col(c).asc_nulls_first() for c in order]
    direct = lambda df: df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*ahead)))
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(F.col(key).alias("hot_key"))
    if at_most(hot, 0):
        return direct(rows)
    hot = broadcast_if_small(hot, MOST_HOT)
    same = F.col(key).eqNullSafe(F.col("hot_key"))
    counted = numbered(rows.join(hot, same, "left_semi"), [key, *order], "all_")
    first = counted.groupBy(F.col(key).alias("of_key")).agg(F.min("all_").alias("first_"))
    placed = counted.join(F.broadcast(first) if at_most(first, MOST_HOT) else first, F.col(key).eqNullSafe(F.col("of_key"))).withColumn(name, (F.col("all_") - F.col("first_") + 1).cast("int"))
    return direct(rows.join(hot, same, "left_anti")).unionByName(placed.drop("all_", "of_key", "first_"))
