"""Pareto fronts of journey labels: depart late, arrive early, board seldom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_front(labels: DataFrame, keys: list[str], departure: str = "departure_time", arrival: str = "arrival_time_target") -> DataFrame:
    """Labels per key that no other departs no earlier and arrives no later than; of equal ones the first in the table's order of columns.

    A running minimum over later departures: one sort per key, no pair of labels is formed. Null times are dominated by none and dropped.
    """
    rest = [c for c in labels.columns if c not in (*keys, departure, arrival)]
    before = Window.partitionBy(*keys).orderBy(F.desc(departure), F.asc(arrival), *rest).rowsBetween(Window.unboundedPreceding, -1)
    marked = labels.where(F.col(departure).isNotNull() & F.col(arrival).isNotNull()).withColumn("best_", F.min(arrival).over(before))
    return marked.where(F.col("best_").isNull() | (F.col(arrival) < F.col("best_"))).drop("best_")


def boardings_front(labels: DataFrame, keys: list[str], departure: str = "departure_time", arrival: str = "arrival_time_target", boardings: str = "n_boardings") -> DataFrame:
    """Labels per key that are not dominated in departure, arrival and boardings; equal ones collapse to one.

    For each number of boardings that a key has, the running minimum over its labels with no more decides; no pair of labels is formed.
    Labels with a null in one of the three are left out.
    """
    rest = [c for c in labels.columns if c not in (*keys, departure, arrival, boardings)]
    whole = labels.where(F.col(departure).isNotNull() & F.col(arrival).isNotNull() & F.col(boardings).isNotNull())
    few = whole.groupBy(*keys).agg(F.collect_set(boardings).alias("ns_"))
    same = F.lit(True)
    renamed = few.select(*[F.col(k).alias(f"of_{k}") for k in keys], "ns_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    # one row for every number of boardings from its own on: the running minimum within (key, number) then bounds all with that number
    spread = whole.join(renamed, same).select(*labels.columns, F.explode(F.filter("ns_", lambda n: n >= F.col(boardings))).alias("upto_"))
    running = Window.partitionBy(*keys, "upto_").orderBy(F.desc(departure), F.asc(arrival), F.asc(boardings), *rest).rowsBetween(Window.unboundedPreceding, -1)
    marked = spread.withColumn("best_", F.min(arrival).over(running)).where(F.col("upto_") == F.col(boardings))
    return marked.where(F.col("best_").isNull() | (F.col(arrival) < F.col("best_"))).select(*labels.columns)


def merged_fronts(labels: DataFrame, others: DataFrame, keys: list[str], **columns) -> DataFrame:
    return boardings_front(labels.unionByName(others), keys, **columns)
