"""A feed: its tables by name, and the views and lookups on them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.common import checkpoint, table
from transloom.functions.geo import haversine
from transloom.operators import derive, events, networks


class Feed(Mapping):
    """Tables of a feed as lazy DataFrames; days, day_trips2 and stop pairs are derived when asked for. Metadata is a plain dict."""

    NAMES = ("stops", "routes", "calendar", "trips", "stop_times", "stop_distances")

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], tz: str = "UTC", metadata: dict | None = None):
        self.spark, self.tables, self.tz, self.metadata = spark, dict(tables), tz, dict(metadata or {})

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Feed:
        """The tables that a folder holds as parquet."""
        return cls(spark, {name: table(spark, folder, name) for name in cls.NAMES})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Feed:
        """A feed that ``save`` wrote, with its metadata."""
        from transloom.sources.journey_store import Parameters

        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
        metadata = dict(Parameters.load(spark, f"{folder}/metadata"))
        return cls(spark, {n.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{n}") for n in sorted(found) if n.endswith(".parquet")}, metadata.get("timezone", "UTC"), metadata)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables and name in ("days", "day_trips2"):
            self.tables[name] = getattr(self, name)
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    @cached_property
    def days(self) -> DataFrame:
        return derive.days(self.tables["trips"], self.tables["calendar"], self.tables.get("calendar_dates"), self.tz)

    @cached_property
    def day_trips2(self) -> DataFrame:
        return derive.day_trips(self.days, self.tables["trips"])

    @cached_property
    def pairs(self) -> DataFrame:
        return events.stop_pairs(self.tables["stop_times"])

    def events(self, start_ut: int | None = None, end_ut: int | None = None, route_type: int | None = None) -> DataFrame:
        return events.transit_events(self["day_trips2"], self["trips"], self["routes"], self["stop_times"], start_ut, end_ut, route_type)

    def sql(self, query: str) -> DataFrame:
        """Any SQL over the feed's tables, given as {stops}, {trips} and so on."""
        return self.spark.sql(query, **{name: self[name] for name in (*self.tables, "days", "day_trips2") if "{" + name + "}" in query})

    def register(self, prefix: str = "") -> None:
        """Temporary views of all tables, with the dated views of trips and calls."""
        for name in (*self.tables, "days", "day_trips2"):
            self[name].createOrReplaceTempView(prefix + name)
        self.day_stop_times().createOrReplaceTempView(prefix + "day_stop_times")

    def day_stop_times(self) -> DataFrame:
        dated = self["day_trips2"].select("trip_I", "date", "day_start_ut")
        return self["stop_times"].join(dated, "trip_I").select("date", "trip_I", "stop_I", "seq", (F.col("day_start_ut") + F.col("dep_time_ds")).alias("dep_time_ut"), (F.col("day_start_ut") + F.col("arr_time_ds")).alias("arr_time_ut"))

    def row_count(self, name: str) -> int:
        return self[name].count()

    def modes(self) -> DataFrame:
        return self["routes"].select("type").distinct()

    def stop(self, stop_I: int) -> DataFrame:
        return self["stops"].where(F.col("stop_I") == stop_I)

    def closest_stop(self, lat: float, lon: float) -> DataFrame:
        """(stop_I, metres) of the stop nearest to a point, the smallest id of equals."""
        located = self["stops"].where("lat is not null and lon is not null").select("stop_I", haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)).alias("metres"))
        return located.agg(F.min(F.struct("metres", "stop_I")).alias("n")).where("n is not null").select("n.stop_I", "n.metres")

    def stops_within(self, stop_I: int, metres: int) -> DataFrame:
        return self["stop_distances"].where((F.col("from_stop_I") == stop_I) & (F.col("d") < metres)).select(F.col("to_stop_I").alias("stop_I"), "d", "d_walk")

    def stop_distance(self, from_stop_I: int, to_stop_I: int) -> DataFrame:
        return self["stop_distances"].where((F.col("from_stop_I") == from_stop_I) & (F.col("to_stop_I") == to_stop_I)).select("d", "d_walk")

    def route_of_trip(self, trip_I: int) -> DataFrame:
        return self["trips"].where(F.col("trip_I") == trip_I).join(self["routes"], "route_I").select("route_I", "name", "type")

    def trip_takes_place(self, trip_I: int, day_start: int) -> bool:
        return not self["days"].where((F.col("trip_I") == trip_I) & (F.col("day_start_ut") == day_start)).isEmpty()

    def schedule_span(self) -> DataFrame:
        """(start_ut, end_ut): first day's beginning, last day's beginning and 28 hours."""
        return self["days"].agg(F.min("day_start_ut").alias("start_ut"), (F.max("day_start_ut") + 28 * 3600).alias("end_ut"))

    def date_span(self) -> DataFrame:
        return self["days"].agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))

    def walk_network(self, max_metres: float = 1000.0) -> DataFrame:
        return networks.walk_network(self["stop_distances"], max_metres)

    @property
    def location_name(self) -> str | None:
        return self.metadata.get("location_name")

    def stats(self) -> dict[str, str]:
        """Counts, bounds and spans of the tables, and the dates of the timetable."""
        from transloom.operators.stats import feed_stats

        made = {r.name: r.value for r in feed_stats({n: self[n] for n in sorted(self.tables)}).collect()}
        span = self.date_span().head()
        return made | {"first_date": str(span.first_date), "last_date": str(span.last_date)}

    def update_stats(self) -> None:
        """Keep the statistics in the metadata."""
        self.metadata |= self.stats()

    def extract(self, tables: dict[str, DataFrame]) -> Feed:
        """A feed of tables taken from this one, with metadata that says so: this feed's own under orig_, and the time."""
        import datetime as dt

        kept = {f"orig_{k}": v for k, v in self.metadata.items() if not k.startswith("orig_")}
        return Feed(self.spark, tables, self.tz, self.metadata | kept | {"copied_from": self.metadata.get("name", ""), "copy_time_ut": int(dt.datetime.now(dt.UTC).timestamp())})

    def add_stop(self, **values) -> Feed:
        schema = ", ".join(f"{name} {kind}" for name, kind in self["stops"].dtypes)
        row = self.spark.createDataFrame([tuple(values.get(c) for c in self["stops"].columns)], schema)
        return Feed(self.spark, self.tables | {"stops": self["stops"].unionByName(row)}, self.tz, self.metadata)

    def materialized(self) -> Feed:
        """The same feed with its tables written to the checkpoint folder, so that what is built on them has short plans."""
        return Feed(self.spark, {name: checkpoint(df) for name, df in self.tables.items()}, self.tz, self.metadata)

    def save(self, folder: str) -> None:
        """All tables as parquet, dated trips by date, and the metadata."""
        from transloom.sources.journey_store import Parameters

        Parameters(self.metadata | {"timezone": self.tz}).save(self.spark, f"{folder}/metadata")
        for name in self.tables:
            writer = self[name].write.mode("overwrite")
            (writer.partitionBy("date") if name == "day_trips2" else writer).parquet(f"{folder}/{name}.parquet")
