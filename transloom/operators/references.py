"""References to records that do not exist, are withdrawn or arrive later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.common import at_most, bloom_filter, checkpoint, might_contain

#: A side of at most so many (key, two timestamps) rows, about 50 MB, may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Reference:
    """``child.field`` should name a row of ``parent`` by ``parent_key``."""

    child_table: str
    child: DataFrame
    row_key: str
    field: str
    parent: DataFrame
    parent_key: str
    loaded_at: str = "loaded_at"
    deleted_at: str = "deleted_at"


def orphan_rows(ref: Reference, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(child_table, child_field, row_key, kind, loaded_at): each child row whose reference is not usable.

    kind is 'missing' (no such parent), else 'deleted' (the parent was withdrawn, whenever), else 'late' (the parent came after the
    child). A Bloom filter of the parent's keys proves the definite orphans. The values that pass are reduced to one row each with
    the child's earliest arrival (partial aggregates, so a hot value moves once per task) and joined exactly; only values that this
    finds doubtful go back to the child's rows.

    A null reference is no reference, a null row key is reported as it stands, a null loaded_at on either side is never late. Of
    repeated parent keys one usable record suffices: the key counts as deleted only if all its records are, and as loaded with the
    first of those left. Repeated child rows count each; empty tables are fine; further columns are not read.
    """
    spark = ref.child.sparkSession
    child = ref.child.select(F.col(ref.row_key).alias("row_key"), F.col(ref.field).alias("ref"), F.col(ref.loaded_at).alias("at")).where("ref is not null")
    live = F.col(ref.deleted_at).isNull()
    parent = (
        ref.parent.select(F.col(ref.parent_key).alias("ref"), F.col(ref.loaded_at), F.col(ref.deleted_at))
        .where("ref is not null")
        .groupBy("ref")
        .agg(F.max(live).alias("live"), F.min(F.when(live, F.col(ref.loaded_at))).alias("since"))
    )
    held = bloom_filter(ref.parent.where(F.col(ref.parent_key).isNotNull()), ref.parent_key, ref.parent.count())
    maybe = might_contain(held, F.col("ref"), spark)
    values = child.where(maybe).groupBy("ref").agg(F.min("at").alias("first"))
    verified = values.join(parent, "ref", "left").select(
        "ref", "first", "since", F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").alias("kind")
    )
    doubtful = checkpoint(verified.where("kind is not null or since > first").select("ref", "since", "kind"))
    kind = F.coalesce("kind", F.when(F.col("since") > F.col("at"), "late"))
    if at_most(doubtful, broadcast_rows):
        rows = child.join(F.broadcast(doubtful), "ref", "left").select("row_key", F.when(~maybe, "missing").otherwise(kind).alias("kind"), "at").where("kind is not null")
    else:
        certain = child.where(~maybe).select("row_key", F.lit("missing").alias("kind"), "at")
        rows = certain.unionByName(child.join(doubtful, "ref").select("row_key", kind.alias("kind"), "at").where("kind is not null"))
    return rows.select(F.lit(ref.child_table).alias("child_table"), F.lit(ref.field).alias("child_field"), "row_key", "kind", F.col("at").alias("loaded_at"))


def orphans(refs: list[Reference], **settings) -> DataFrame:
    """The orphans of several references together."""
    first, *rest = [orphan_rows(r, **settings) for r in refs]
    for other in rest:
        first = first.unionByName(other)
    return first


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, field, kind and month of arrival (null where the row has none)."""
    return found.groupBy("child_table", "child_field", "kind", F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_rows"))


def feed_references(tables: dict[str, DataFrame]) -> list[Reference]:
    """The references of a timetable feed."""
    return [
        Reference("stop_times", tables["stop_times"], "stop_time_I", "stop_I", tables["stops"], "stop_I"),
        Reference("stop_times", tables["stop_times"], "stop_time_I", "trip_I", tables["trips"], "trip_I"),
        Reference("trips", tables["trips"], "trip_I", "route_I", tables["routes"], "route_I"),
        Reference("trips", tables["trips"], "trip_I", "service_I", tables["calendar"], "service_I"),
    ]
