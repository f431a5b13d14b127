"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset a local session gets a folder of its own; on a cluster that would be a folder of each machine, so it raises RuntimeError.

    Checkpoints go when the DataFrames built on them are no longer held.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="transloom-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints of rounds that are over: Spark removes them when the driver collects its garbage, which may be long after the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, by one aggregate."""
    return df.count() <= rows


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` = 1, 2, … (long) in a total order of its rows, nulls first.

    Rows are range-partitioned; a task numbers its own and adds the rows of the partitions before, of which there is one count each.
    """
    placed = checkpoint(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part_", F.spark_partition_id()))
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return placed.withColumn("own_", own).join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("own_")).drop("part_", "own_", "before_")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a count of the rows; a larger ``df`` is returned as it is, so its join shuffles and AQE splits skew."""
    return F.broadcast(df) if at_most(df, rows) else df


def might_contain(filter_bytes: bytes, key: Column, spark: SparkSession) -> Column:
    """Test ``key`` against a serialized Spark Bloom filter of ``xxhash64`` values, inside generated code.

    False proves absence. Null keys give null.
    """
    jvm = spark._jvm
    exprs = jvm.org.apache.spark.sql.classic.ExpressionUtils
    bits = spark.createDataFrame([(bytearray(filter_bytes),)], "bits binary").scalar()
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
        exprs.expression(bits._jc), exprs.expression(F.xxhash64(key)._jc)
    )
    return F.when(key.isNotNull(), Column(exprs.column(test)))


def bloom_filter(keys: DataFrame, column: str, expected: int, max_bits: int = 1 << 26) -> bytes:
    """Serialized Bloom filter of ``keys[column]``, built by partial aggregates on the executors.

    Sized for one false positive in a hundred of ``expected`` distinct keys and never above ``max_bits`` (8 MB), so that what is
    broadcast is bounded; beyond that the filter lets more keys through, which costs time but no correctness.
    """
    bits = int(min(max_bits, max(1024, 10 * max(1, expected))))
    # one value besides, since Spark builds no filter of no rows
    hashed = keys.select(F.xxhash64(column).alias("h")).union(keys.sparkSession.range(1))
    made = hashed._jdf.stat().bloomFilter("h", max(1, int(expected)), bits)
    out = keys.sparkSession._jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    return bytes(out.toByteArray())
