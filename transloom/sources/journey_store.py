"""Journeys, legs and measures of travel kept as parquet, by target and by measure."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transloom.operators.events import add_coordinates
from transloom.operators.journeys import OD

STATISTICS = ("min", "max", "median", "mean")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Parameters(dict):
    """Settings of a store; ``save`` and ``load`` keep them beside it."""

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(str(k), json.dumps(v)) for k, v in self.items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Parameters:
        return cls({r.name: json.loads(r.value) for r in spark.read.parquet(path).collect()}) if _exists(spark, path) else cls()


class JourneyStore:
    """Journeys and legs by target. Opening a store with other routing parameters than those it was made with raises ValueError."""

    def __init__(self, spark: SparkSession, folder: str, parameters: dict | None = None):
        self.spark, self.folder = spark, folder
        kept = Parameters.load(spark, f"{folder}/parameters")
        if kept and parameters and any(kept.get(str(k)) != v for k, v in parameters.items()):
            raise ValueError("the journeys of this store were made with other parameters")
        self.parameters = kept or Parameters(parameters or {})
        if self.parameters and not kept:
            self.parameters.save(spark, f"{folder}/parameters")

    def add(self, journeys: DataFrame, legs: DataFrame | None = None) -> None:
        """Append journeys and their legs. Ids go on from those of the store."""
        top = self.journeys().agg(F.coalesce(F.max("journey_id"), F.lit(0)).alias("m")).head().m if _exists(self.spark, f"{self.folder}/journeys") else 0
        moved = lambda df: df.withColumn("journey_id", F.col("journey_id") + F.lit(top))
        moved(journeys).repartition("to_stop_I").write.mode("append").partitionBy("to_stop_I").parquet(f"{self.folder}/journeys")
        if legs is not None:
            moved(legs).write.mode("append").parquet(f"{self.folder}/legs")

    def table(self, name: str, target: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        return df if target is None else df.where(F.col("to_stop_I") == target)

    def journeys(self, target: int | None = None) -> DataFrame:
        return self.table("journeys", target)

    def legs(self) -> DataFrame:
        return self.table("legs")

    def od_pairs(self) -> DataFrame:
        return self.journeys().select(*OD).distinct()

    def targets(self) -> DataFrame:
        return self.journeys().select("to_stop_I").distinct()

    def origins(self) -> DataFrame:
        return self.journeys().select("from_stop_I").distinct()

    def with_coordinates(self, stops: DataFrame, name: str = "journeys", target: int | None = None) -> DataFrame:
        return add_coordinates(self.table(name, target), stops, "from_stop_I", "from_")


class MeasureStore:
    """A table per measure (from_stop_I, to_stop_I, min, max, median, mean), one row for a pair of stops: the last one written holds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def insert(self, measure: str, rows: DataFrame) -> None:
        batch = 0
        if _exists(self.spark, f"{self.folder}/{measure}"):
            batch = self.spark.read.parquet(f"{self.folder}/{measure}").agg(F.max("batch").alias("b")).head().b + 1
        rows.select(*OD, *STATISTICS).dropDuplicates(OD).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/{measure}")

    def read(self, measure: str, from_stop_I: int | None = None, to_stop_I: int | None = None, statistic: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{measure}")
        for column, value in (("from_stop_I", from_stop_I), ("to_stop_I", to_stop_I)):
            df = df if value is None else df.where(F.col(column) == value)
        last = Window.partitionBy(*OD).orderBy(F.desc("batch"))
        kept = df.withColumn("r", F.row_number().over(last)).where("r = 1")
        return kept.select(*OD, *((statistic,) if statistic else STATISTICS))
