"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are grouped by key and value before key, so that a hot key is spread over its values and reaches its own group as weighted
values, at most one per value and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import checkpoint


def key_profile(rows: DataFrame, key: str, partner: str, measure: str) -> DataFrame:
    """(key_value, n_rows, n_partners, first_measure, last_measure, top_partner, top_partner_rows) per value of ``key``.

    Null keys form one group of their own; a null partner is no partner but its rows count; null measures are passed over, and a
    key with nothing else has null there. Of equally frequent partners the smallest is the top one. Repeated rows count each.
    """
    compressed = (
        rows.select(F.col(key).alias("key_value"), F.col(partner).alias("partner"), F.col(measure).alias("measure"))
        .groupBy("key_value", "partner")
        .agg(F.count("*").alias("weight"), F.min("measure").alias("lo"), F.max("measure").alias("hi"))
    )
    # of equal weights the smallest partner: min_by over (-weight, partner)
    rank = F.when(F.col("partner").isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col("partner").alias("p")))
    return compressed.groupBy("key_value").agg(
        F.sum("weight").alias("n_rows"),
        F.count("partner").alias("n_partners"),
        F.min("lo").alias("first_measure"),
        F.max("hi").alias("last_measure"),
        F.min(rank).alias("top"),
    ).select("key_value", "n_rows", "n_partners", "first_measure", "last_measure", F.col("top.p").alias("top_partner"), (-F.col("top.w")).alias("top_partner_rows"))


def heavy_keys(profile: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """The non-null keys of a profile of ``rows`` that hold at least ``share`` of all rows, those with a null key included.

    ``share`` counts in millionths, so that the bound is exact in integers; the total is read from the files' footers.
    """
    total = rows.agg(F.count("*")).scalar()
    return profile.where(F.col("key_value").isNotNull() & (F.col("n_rows") * 1_000_000 >= total * round(share * 1_000_000)))


def weighted_percentiles(rows: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """(key_value, percent, value): the exact lower percentiles (the smallest value that at least ``percent`` of the key's non-null values do not exceed).

    Distinct (key, value) pairs with their weights are range-partitioned; a task sums only its own run of a key and adds what
    earlier tasks hold of it, so no task needs a whole key. Null keys or values are left out; empty input gives an empty result.
    """
    compressed = (
        rows.select(F.col(key).alias("key_value"), F.col(value).alias("value"))
        .where("key_value is not null and value is not null")
        .groupBy("key_value", "value")
        .agg(F.count("*").alias("weight"))
    )
    placed = checkpoint(compressed.repartitionByRange("key_value", "value").withColumn("part", F.spark_partition_id()))
    per_part = placed.groupBy("key_value", "part").agg(F.sum("weight").alias("held"))
    upto = Window.partitionBy("key_value").orderBy("part")
    before = per_part.select(
        "key_value", "part", (F.sum("held").over(upto) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy("key_value")).alias("total")
    )
    run = Window.partitionBy("key_value", "part").orderBy("value")
    summed = placed.withColumn("local", F.sum("weight").over(run)).join(before, ["key_value", "part"])
    hi = F.col("before") + F.col("local")
    asked = F.filter(
        F.array(*[F.lit(int(p)) for p in percents]),
        lambda p: (hi * 100 >= p * F.col("total")) & ((hi - F.col("weight")) * 100 < F.greatest(p, F.lit(0)) * F.col("total")) | ((p <= 0) & (hi == F.col("weight"))),
    )
    return summed.select("key_value", F.explode(asked).alias("percent"), "value")


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key_value, value, n_rows): the most frequent non-null value per key, the smallest of equals."""
    weighted = rows.select(F.col(key).alias("key_value"), F.col(value).alias("value")).where("value is not null").groupBy("key_value", "value").agg(F.count("*").alias("weight"))
    best: Column = F.min(F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))).alias("best")
    return weighted.groupBy("key_value").agg(best).select("key_value", F.col("best.v").alias("value"), (-F.col("best.w")).alias("n_rows"))
