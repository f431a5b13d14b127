"""Feeds of text tables: from folders, zip files or texts in memory to typed tables with shared numbers, and back."""

from __future__ import annotations

import csv
import datetime as dt
import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.common import numbered as numbered_rows
from transloom.feed import Feed
from transloom.functions.timetable import day_seconds, iso_date
from transloom.operators import derive
from transloom.schema import BASIC_ROUTE_TYPE, REQUIRED

Source = str | dict


class _Reader:
    """The files of several sources as one table of texts each, with feed number and line number."""

    def __init__(self, spark: SparkSession, sources: list[Source]):
        self.spark, self.sources = spark, sources

    def _text(self, source: Source, name: str) -> str | None:
        """A file's text where it must go through the driver: from memory or out of a zip."""
        if isinstance(source, dict):
            value = source.get(name, source.get(f"{name}.txt"))
            return value if value is None or isinstance(value, str) else value.read()
        with zipfile.ZipFile(source) as archive:
            found = [n for n in archive.namelist() if Path(n).name == f"{name}.txt"]
            return archive.read(found[0]).decode("utf-8-sig") if found else None

    def _breaks_lines(self, path: str) -> bool:
        """Whether a quoted value holds a line break: some line has an odd number of quotes. Only then a file is one task's."""
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        return not self.spark.read.text(path).where(quotes % 2 == 1).isEmpty()

    def exists(self, source: Source, name: str) -> bool:
        if isinstance(source, str) and os.path.isdir(source):
            return os.path.exists(f"{source}/{name}.txt")
        return self._text(source, name) is not None

    def table(self, name: str) -> DataFrame | None:
        """All sources' rows with columns as they are named, feed_no and line_no; null if no source has the file."""
        parts = []
        for number, source in enumerate(self.sources):
            if not self.exists(source, name):
                continue
            if isinstance(source, str) and os.path.isdir(source):
                raw = self.spark.read.option("header", True).option("multiLine", self._breaks_lines(f"{source}/{name}.txt")).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"').csv(f"{source}/{name}.txt")
                raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
                rows = raw.withColumn("line_no", F.monotonically_increasing_id())
            else:
                read = csv.reader(io.StringIO(self._text(source, name).lstrip("﻿")))
                header = [c.strip() for c in next(read, [])]
                data = [tuple((v.strip() or None) for v in (line + [""] * len(header))[: len(header)]) + (k,) for k, line in enumerate(read) if any(v.strip() for v in line)]
                rows = self.spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in header) + ", line_no long")
            parts.append(rows.withColumn("feed_no", F.lit(number)))
        if not parts:
            return None
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        return whole


def read_feed(spark: SparkSession, sources: Source | list[Source], *, ignore: tuple[str, ...] = (), stop_distance_m: float | None = 1000.0) -> Feed:
    """A feed of one or several sources (folder, zip file, or dict of file name to text).

    With several, every text id gets its feed's prefix (feed_0_, feed_1_, …). Numbers follow feed and line. References that do not
    resolve are null. Trips with headways are expanded; services that only calendar_dates knows get an empty calendar row. Raises
    AssertionError if a source lacks a required file or a call lacks a stop, trip, number or time, and ValueError if the agencies have
    no zone or zones of different offsets.
    """
    sources = sources if isinstance(sources, list) else [sources]
    reader = _Reader(spark, sources)
    for source in sources:
        for name in REQUIRED:
            assert reader.exists(source, name), f"{name}.txt is missing in {source if isinstance(source, str) else 'a source'}"
    several = len(sources) > 1

    def raw(name: str) -> DataFrame | None:
        return None if name in ignore else reader.table(name)

    def col(df: DataFrame, name: str, default: str | None = None) -> Column:
        value = F.nullif(F.trim(F.col(name)), F.lit("")) if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default)) if default is not None else value

    def ident(df: DataFrame, name: str, default: str | None = None) -> Column:
        return F.concat(F.format_string("feed_%d_", "feed_no"), col(df, name, default)) if several else col(df, name, default)

    def numbered(df: DataFrame, key: str) -> DataFrame:
        return numbered_rows(df, ["feed_no", "line_no"], key).drop("feed_no", "line_no")

    def resolved(df: DataFrame, text: str, number: str, to: DataFrame, to_text: str, to_number: str) -> DataFrame:
        return df.join(to.select(F.col(to_text).alias(text), F.col(to_number).alias(number)), text, "left")

    tables: dict[str, DataFrame] = {}
    a = raw("agency")
    tables["agencies"] = numbered(a.select("feed_no", "line_no", ident(a, "agency_id", "1").alias("agency_id"), col(a, "agency_name").alias("name"), col(a, "agency_url").alias("url"), col(a, "agency_timezone").alias("timezone"), col(a, "agency_lang").alias("lang"), col(a, "agency_phone").alias("phone")), "agency_I")
    zones = sorted({r.timezone for r in tables["agencies"].select("timezone").where("timezone is not null").distinct().collect()})
    tz = _one_zone(zones)

    s = raw("stops")
    stops = numbered(s.select("feed_no", "line_no", ident(s, "stop_id").alias("stop_id"), col(s, "stop_code").alias("code"), col(s, "stop_name").alias("name"), col(s, "stop_desc").alias("stop_desc"), col(s, "stop_lat").cast("double").alias("lat"), col(s, "stop_lon").cast("double").alias("lon"), ident(s, "parent_station").alias("parent"), col(s, "location_type").cast("int").alias("location_type"), col(s, "wheelchair_boarding").cast("int").alias("wheelchair_boarding")), "stop_I")
    tables["stops"] = resolved(stops, "parent", "parent_I", stops, "stop_id", "stop_I").drop("parent").withColumn("self_or_parent_I", F.coalesce("parent_I", "stop_I"))

    r = raw("routes")
    basic = F.create_map(*[F.lit(x) for pair in BASIC_ROUTE_TYPE.items() for x in pair])[col(r, "route_type").cast("int")]
    known = F.coalesce(basic, F.raise_error(F.concat(F.lit("unknown route type "), col(r, "route_type", "none"))).cast("int"))
    routes = numbered(r.select("feed_no", "line_no", ident(r, "route_id").alias("route_id"), ident(r, "agency_id", "1").alias("agency"), col(r, "route_short_name").alias("name"), col(r, "route_long_name").alias("long_name"), col(r, "route_desc").alias("route_desc"), known.alias("type"), col(r, "route_url").alias("url"), col(r, "route_color").alias("color"), col(r, "route_text_color").alias("text_color")), "route_I")
    tables["routes"] = resolved(routes, "agency", "agency_I", tables["agencies"], "agency_id", "agency_I").drop("agency")

    flags = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    empty_cal = "feed_no int, line_no long, service_id string, m int, t int, w int, th int, f int, s int, su int, start_date date, end_date date"
    c = raw("calendar")
    cal = spark.createDataFrame([], empty_cal) if c is None else c.select("feed_no", "line_no", ident(c, "service_id").alias("service_id"), *[col(c, d).cast("int").alias(k) for d, k in zip(flags, derive.WEEKDAYS)], iso_date(col(c, "start_date")).alias("start_date"), iso_date(col(c, "end_date")).alias("end_date"))
    d = raw("calendar_dates")
    dates = None
    if d is not None:
        dates = d.select("feed_no", "line_no", ident(d, "service_id").alias("service_id"), iso_date(col(d, "date")).alias("date"), col(d, "exception_type").cast("int").alias("exception_type"))
        only = dates.join(cal.select("service_id"), "service_id", "left_anti").groupBy("service_id").agg(F.min(F.struct("feed_no", "line_no", "date")).alias("x"))
        cal = cal.unionByName(only.select((F.col("x.feed_no") + F.lit(1_000_000)).cast("int").alias("feed_no"), "x.line_no", "service_id", *[F.lit(0).alias(k) for k in derive.WEEKDAYS], F.col("x.date").alias("start_date"), F.col("x.date").alias("end_date")))
    tables["calendar"] = numbered(cal, "service_I")
    if dates is not None:
        tables["calendar_dates"] = resolved(dates, "service_id", "service_I", tables["calendar"], "service_id", "service_I").select("service_I", "date", "exception_type")

    t = raw("trips")
    trips = numbered(t.select("feed_no", "line_no", ident(t, "trip_id").alias("trip_id"), ident(t, "route_id").alias("route"), ident(t, "service_id").alias("service"), col(t, "direction_id").alias("direction_id"), ident(t, "shape_id").alias("shape_id"), col(t, "trip_headsign").alias("headsign"), F.lit(None).cast("int").alias("start_time_ds"), F.lit(None).cast("int").alias("end_time_ds")), "trip_I")
    trips = resolved(resolved(trips, "route", "route_I", tables["routes"], "route_id", "route_I"), "service", "service_I", tables["calendar"], "service_id", "service_I").drop("route", "service")

    k = raw("stop_times")
    calls = k.select("feed_no", "line_no", ident(k, "trip_id").alias("trip"), ident(k, "stop_id").alias("stop"), col(k, "arrival_time").alias("arr_time"), col(k, "departure_time").alias("dep_time"), col(k, "stop_sequence").cast("int").alias("seq"))
    broken = calls.where("trip is null or stop is null or arr_time is null or dep_time is null or seq is null")
    assert broken.isEmpty(), "a call lacks its trip, stop, number or a time"
    calls = calls.withColumns({"arr_time_ds": day_seconds(F.col("arr_time")), "dep_time_ds": day_seconds(F.col("dep_time"))}).withColumns({"arr_time_hour": F.floor(F.col("arr_time_ds") / 3600).cast("int"), "shape_break": F.lit(None).cast("int"), "stop_time_I": F.col("feed_no") * F.lit(1 << 50) + F.col("line_no")})
    calls = resolved(resolved(calls, "trip", "trip_I", trips, "trip_id", "trip_I"), "stop", "stop_I", tables["stops"], "stop_id", "stop_I").drop("trip", "stop", "feed_no", "line_no")

    f = raw("frequencies")
    if f is not None:
        freq = f.select("feed_no", ident(f, "trip_id").alias("trip"), col(f, "start_time").alias("start_time"), col(f, "end_time").alias("end_time"), col(f, "headway_secs").cast("int").alias("headway_secs"), col(f, "exact_times", "0").cast("int").alias("exact_times"))
        freq = freq.withColumns({"start_time_ds": day_seconds(F.col("start_time")), "end_time_ds": day_seconds(F.col("end_time"))})
        tables["frequencies"] = resolved(freq, "trip", "trip_I", trips, "trip_id", "trip_I").drop("trip", "feed_no")
        trips, calls = derive.expand_frequencies(trips, calls, tables["frequencies"])
    tables["stop_times"] = derive.resequenced(calls)
    tables["trips"] = derive.trip_times(trips, tables["stop_times"])

    p = raw("shapes")
    if p is not None:
        tables["shapes"] = derive.shape_distances(p.select(ident(p, "shape_id").alias("shape_id"), col(p, "shape_pt_lat").cast("double").alias("lat"), col(p, "shape_pt_lon").cast("double").alias("lon"), col(p, "shape_pt_sequence").cast("int").alias("seq")))
    x = raw("transfers")
    transfers = None
    if x is not None:
        pairs = x.select(ident(x, "from_stop_id").alias("a"), ident(x, "to_stop_id").alias("b"), col(x, "transfer_type", "0").cast("int").alias("transfer_type"), col(x, "min_transfer_time").cast("int").alias("min_transfer_time"))
        transfers = tables["transfers"] = resolved(resolved(pairs, "a", "from_stop_I", tables["stops"], "stop_id", "stop_I"), "b", "to_stop_I", tables["stops"], "stop_id", "stop_I").drop("a", "b")
    i = raw("feed_info")
    if i is not None:
        names = ("feed_publisher_name", "feed_publisher_url", "feed_lang", "feed_start_date", "feed_end_date", "feed_version")
        tables["feed_info"] = i.select(*[col(i, n).alias(n) for n in names], (F.format_string("feed_%d", "feed_no") if several else F.lit("")).alias("feed_id"))
    if stop_distance_m is not None:
        tables["stop_distances"] = derive.stop_distances(tables["stops"], stop_distance_m, transfers)
    downloads = [m[-1] for m in (re.findall(r"\d{4}-\d{2}-\d{2}", x) for x in sources if isinstance(x, str)) if m]
    metadata = {"n_gtfs_sources": len(sources), "timezone": tz, "gen_time_ut": int(dt.datetime.now(dt.UTC).timestamp())} | ({"download_date": downloads[0]} if downloads else {})
    return Feed(spark, tables, tz, metadata)


def _one_zone(zones: list[str]) -> str:
    """The zone of a feed: several are fine while their offsets agree in summer and winter."""
    import zoneinfo

    if not zones:
        raise ValueError("no agency has a time zone")
    offset = lambda z, month: dt.datetime(2009, month, 1, 12, tzinfo=zoneinfo.ZoneInfo(z)).utcoffset()
    if len({(offset(z, 1), offset(z, 9)) for z in zones}) > 1:
        raise ValueError(f"time zones with different offsets: {', '.join(zones)}")
    return zones[0]


def _natural(df: DataFrame, column: str, tables: dict[str, DataFrame], table: str, key: str, text: str, name: str) -> DataFrame:
    return df.join(tables[table].select(F.col(key).alias(column), F.col(text).alias(name)), column, "left")


def text_tables(feed: Feed) -> dict[str, DataFrame]:
    """The tables under the columns of text feeds, with text ids for numbers; headways are written out as trips."""
    t = feed
    out = {
        "agency": t["agencies"].select("agency_id", F.col("name").alias("agency_name"), F.col("url").alias("agency_url"), F.col("timezone").alias("agency_timezone"), F.col("lang").alias("agency_lang"), F.col("phone").alias("agency_phone")),
        "stops": _natural(t["stops"], "parent_I", t, "stops", "stop_I", "stop_id", "parent_station").select("stop_id", F.col("code").alias("stop_code"), F.col("name").alias("stop_name"), "stop_desc", F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"), "location_type", "wheelchair_boarding", "parent_station"),
        "routes": _natural(t["routes"], "agency_I", t, "agencies", "agency_I", "agency_id", "agency_id").select("route_id", "agency_id", F.col("name").alias("route_short_name"), F.col("long_name").alias("route_long_name"), "route_desc", F.col("type").alias("route_type"), F.col("url").alias("route_url"), F.col("color").alias("route_color"), F.col("text_color").alias("route_text_color")),
        "trips": _natural(_natural(t["trips"], "route_I", t, "routes", "route_I", "route_id", "route_id"), "service_I", t, "calendar", "service_I", "service_id", "service_id").select("route_id", "service_id", "trip_id", F.col("headsign").alias("trip_headsign"), "direction_id", "shape_id"),
        "stop_times": _natural(_natural(t["stop_times"], "trip_I", t, "trips", "trip_I", "trip_id", "trip_id"), "stop_I", t, "stops", "stop_I", "stop_id", "stop_id").select("trip_id", F.coalesce(_clock("arr_time_ds"), "arr_time").alias("arrival_time"), F.coalesce(_clock("dep_time_ds"), "dep_time").alias("departure_time"), "stop_id", F.col("seq").alias("stop_sequence")),
        "calendar": t["calendar"].select("service_id", *[F.col(k).alias(d) for d, k in zip(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"), derive.WEEKDAYS)], *[F.date_format(c, "yyyyMMdd").alias(c) for c in ("start_date", "end_date")]),
    }
    if "calendar_dates" in t.tables:
        out["calendar_dates"] = _natural(t["calendar_dates"], "service_I", t, "calendar", "service_I", "service_id", "service_id").select("service_id", F.date_format("date", "yyyyMMdd").alias("date"), "exception_type")
    if "shapes" in t.tables:
        out["shapes"] = t["shapes"].select("shape_id", F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"), F.col("seq").alias("shape_pt_sequence"))
    if "transfers" in t.tables:
        out["transfers"] = _natural(_natural(t["transfers"], "from_stop_I", t, "stops", "stop_I", "stop_id", "from_stop_id"), "to_stop_I", t, "stops", "stop_I", "stop_id", "to_stop_id").select("from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time")
    if "stop_distances" in t.tables:
        out["stop_distances"] = _natural(_natural(t["stop_distances"], "from_stop_I", t, "stops", "stop_I", "stop_id", "from_stop_id"), "to_stop_I", t, "stops", "stop_I", "stop_id", "to_stop_id").select("from_stop_id", "to_stop_id", "d", "d_walk")
    if "feed_info" in t.tables:
        out["feed_info"] = t["feed_info"].drop("feed_id")
    return out


def _clock(column: str) -> Column:
    from transloom.functions.timetable import day_time

    return day_time(F.col(column))


def write_feed(feed: Feed, path: str) -> None:
    """The feed as text files in a folder, or in a zip file if the path ends so.

    Rows stream through the driver in partitions, since each of these files is one; the target appears whole or not at all.
    """
    parent = os.path.dirname(os.path.abspath(path))
    os.makedirs(parent, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=parent) as scratch:
        folder = Path(scratch, "feed")
        folder.mkdir()
        for name, table in text_tables(feed).items():
            with open(folder / f"{name}.txt", "w", newline="", encoding="utf-8") as file:
                writer = csv.writer(file)
                writer.writerow(table.columns)
                writer.writerows(table.toLocalIterator())
        if path.endswith(".zip"):
            packed = Path(scratch, "feed.zip")
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                for file in sorted(folder.iterdir()):
                    archive.write(file, file.name)
            os.replace(packed, path)
        else:
            os.replace(folder, path)
