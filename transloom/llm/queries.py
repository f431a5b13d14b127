"""Driver queries of the text-corpus problems (p2, p6, p7, p8) over whole tables; SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.common import table
from transloom.llm.leakage import find_leaks
from transloom.llm.linkage import link
from transloom.llm.packing import pack
from transloom.llm.residue import residue


def _town_of_description(text) -> F.Column:
    """The town that a stop's description names."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)[,\n].*$", ""), r"^(?:in |municipality: )", ""), r"\s+", " ")), F.lit(""))


def p2_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops, others = table(spark, sf_dir, "stops"), table(spark, sf_dir, "other_stops")
    left = stops.select(F.col("stop_I").alias("id"), "name", "lat", "lon", _town_of_description(F.col("stop_desc")).alias("town"), F.col("location_type").alias("type"))
    right = others.select(F.col("other_stop_I").alias("id"), "name", "lat", "lon", F.col("municipality").alias("town"), F.col("location_type").alias("type"))
    return link(left, right).select(F.col("a_id").alias("stop_I"), F.col("b_id").alias("other_stop_I"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_linked(spark, sf_dir).select("stop_I", "other_stop_I")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


SQL: dict[str, str] = {}

QUERIES = {f.__name__: f for f in (p2_found, p2_linked, p6_packed, p7_found, p8_found)}
