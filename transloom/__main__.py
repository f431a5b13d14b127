"""Feeds from the command line: ``python -m transloom import feed.zip --out folder`` and so on."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from transloom.feed import Feed
from transloom.operators import extract, stats, validate
from transloom.sources import export
from transloom.sources.gtfs import read_feed, write_feed


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="transloom", description="Scheduled public transport as tables.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, out: bool = True) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=text)
        made.add_argument("feed", nargs="+" if name == "import" else None)
        if out:
            made.add_argument("--out", required=True)
        return made

    command("import", "text feeds to tables")
    command("export", "tables to a text feed, a zip file if the name ends so")
    command("networks", "links of every type, a folder each")
    command("views", "SQL over the tables, its result as CSV").add_argument("--sql", required=True)
    command("validate", "warnings of the timetable", out=False)
    command("stats", "statistics, one a line", out=False)
    cut = command("filter", "a part of a feed")
    cut.add_argument("--start", type=dt.date.fromisoformat)
    cut.add_argument("--end", type=dt.date.fromisoformat)
    cut.add_argument("--agency", nargs="*")
    for name in ("lat", "lon", "km"):
        cut.add_argument(f"--{name}", type=float)
    return parser.parse_args(argv)


def _filtered(feed: Feed, args: argparse.Namespace) -> Feed:
    tables = dict(feed.tables)
    if args.start and args.end:
        tables = extract.by_dates(tables, args.start, args.end)
    if args.agency:
        tables = extract.by_agencies(tables, args.agency)
    if args.km is not None:
        tables = extract.by_place(tables, args.lat, args.lon, args.km)
    return feed.extract(tables)


def main(argv: list[str] | None = None, stream=sys.stdout) -> int:
    """Run one command; the number of kinds of warnings for ``validate``, else 0."""
    args = _arguments(argv)
    spark = SparkSession.builder.appName("transloom").getOrCreate()
    if args.command == "import":
        feed = read_feed(spark, args.feed)
        feed.metadata["name"] = args.feed[0]
        feed.save(args.out)
        return 0
    feed = Feed.load(spark, args.feed)
    if args.command == "export":
        write_feed(feed, args.out)
    elif args.command == "networks":
        export.write_static_networks(feed, args.out)
    elif args.command == "views":
        feed.register()
        export.write_csv(spark.sql(args.sql), args.out)
    elif args.command == "filter":
        _filtered(feed, args).save(args.out)
    elif args.command == "stats":
        feed.update_stats()
        for name, value in sorted(feed.metadata.items()):
            stream.write(f"{name}\t{value}\n")
    else:
        timed = stats.trip_stats(feed.pairs, feed["trips"], feed["routes"], feed["stops"])
        found = validate.check_timetable({n: feed[n] for n in ("stops", "stop_times")}, timed)
        found.write_summary(stream)
        return len(found.counts())
    return 0


if __name__ == "__main__":
    sys.exit(main())
