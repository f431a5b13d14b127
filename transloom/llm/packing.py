"""Texts into containers of fixed capacity: configuration linear program by multiplicative weights, then rounded.

Only the histogram of sizes, as many numbers as a container has tokens, comes to the driver. The program's columns are patterns of
sizes that fit a container; each round prices the sizes by how much of their demand is still uncovered, finds the best pattern by
knapsack dynamic programming and gives it its share of the containers, until all demand is covered. Patterns are rounded to whole
containers as far as the supply goes, and the program is solved again for what is left, until nothing is. Texts are then matched to
the patterns' places by their number among the texts of their size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import checkpoint

CAPACITY = 2048
#: Vocabulary of the public tokenizer that measures the texts: a byte-level BPE, its ranks in a file of this name.
TOKENIZER = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the expression that splits a text before that vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How steeply a size's price falls as it is covered.
STEEPNESS = 8.0
#: Sizes that a round prices at first: the least covered and, for half as many, the smallest; what fits the room that is left comes
#: from all. A pattern that still leaves more than this share of a container empty is sought again among all sizes.
PRICED, EMPTY = 48, 0.002
#: Share of containers beyond the volume's need at which a solution is rounded though some size is not covered yet; those left over are in the next one's demand.
SPARE = 0.05
#: Texts in a bucket in which texts of one size are numbered, in expectation.
BUCKET_ROWS = 200_000


@cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, doc_key: str, text: str, path: str) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null counts as empty."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "n_tokens": np.fromiter((len(encode(t)) if t else 0 for t in batch.text), "int64", len(batch))})

    return documents.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(measure, "doc_id long, n_tokens long")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, supply: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the most valuable pattern that the supply allows: bounded knapsack by dynamic programming.

    A size's repeats are split into powers of two, each taken or not.
    """
    most = np.minimum(supply, capacity // sizes)
    parts: list[tuple[int, int]] = []
    for k in np.flatnonzero(most).tolist():
        left, n = int(most[k]), 1
        while left > 0:
            parts.append((k, min(n, left)))
            left -= n
            n *= 2
    value, better = np.zeros(capacity + 1, "float32"), np.empty(capacity + 1, "float32")
    taken = np.zeros((len(parts), capacity + 1), bool)
    for row, (k, n) in enumerate(parts):
        w = int(sizes[k]) * n
        with_it, without = better[w:], value[w:]
        np.add(value[: capacity + 1 - w], np.float32(prices[k] * n), out=with_it)
        np.greater(with_it, without, out=taken[row, w:])
        np.maximum(with_it, without, out=without)
    counts = np.zeros(len(sizes), "int64")
    c = int(value.argmax())
    for row in range(len(parts) - 1, -1, -1):
        if taken[row, c]:
            k, n = parts[row]
            counts[k] += n
            c -= int(sizes[k]) * n
    return counts


def solve_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how many containers, in fractions, each is given: the configuration program by multiplicative weights.

    No step covers a size beyond its demand.
    """
    need = float((sizes * demand).sum()) / capacity
    share = max(2 * need / len(sizes), 1e-3)
    covered = np.zeros(len(sizes))
    smallest = np.arange(min(PRICED // 2, len(sizes)))
    given: dict[bytes, tuple[np.ndarray, float]] = {}
    spent, short = 0.0, 0
    while covered.min() < 1 - 1e-9 and spent < (1 + SPARE) * need + 1:
        prices = sizes * np.exp(-STEEPNESS * (covered - covered.min()))
        order = np.argsort(covered, kind="stable")
        counts = np.zeros(len(sizes), "int64")
        some = np.union1d(order[:PRICED], smallest)
        counts[some] = best_pattern(prices[some], sizes[some], demand[some], capacity)
        room = capacity - int((counts * sizes).sum())
        fitting = np.flatnonzero(sizes <= room)
        if len(fitting):
            counts[fitting] += best_pattern(prices[fitting], sizes[fitting], (demand - counts)[fitting], room)
        if capacity - (counts * sizes).sum() > EMPTY * capacity and len(some) < len(sizes):
            # where nothing fills a container, it is tried ever less often
            short += 1
            if short.bit_count() == 1:
                counts = best_pattern(prices, sizes, demand, capacity)
                short = 0 if capacity - (counts * sizes).sum() <= EMPTY * capacity else short
        used = np.flatnonzero(counts)
        step = min(share, float((demand[used] / counts[used]).min()))
        covered[used] += step * counts[used] / demand[used]
        key = counts.tobytes()
        given[key] = (counts, given[key][1] + step if key in given else step)
        spent += step
    return sorted(given.values(), key=lambda g: -g[1])


@dataclass
class Plan:
    """Places of each size: place ``start`` and on go to container ``base`` and on, ``each`` places a container."""

    keys: np.ndarray
    each: np.ndarray
    base: np.ndarray
    starts: np.ndarray
    containers: int
    lower_bound: int

    SHIFT = 1 << 44

    def container(self, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.keys, size * self.SHIFT + place, "right") - 1
        return self.base[k] + (place - self.starts[k]) // self.each[k]


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns and their numbers for items of sizes 1 to capacity; every container is of a pattern of the program."""
    demand = {int(s): int(n) for s, n in histogram.items() if s > 0 and n > 0}
    volume = sum(s * n for s, n in demand.items())
    bound = -(-volume // capacity)
    patterns: list[tuple[np.ndarray, np.ndarray, int]] = []
    if full := demand.pop(capacity, 0):
        patterns.append((np.array([capacity]), np.array([1]), full))
    sizes = np.array(sorted(demand), "int64")
    left = np.array([demand[s] for s in sizes.tolist()], "int64")
    while left.any():
        some = np.flatnonzero(left)
        for counts, x in solve_program(sizes[some], left[some], capacity):
            held = counts > 0
            used, each = some[held], counts[held]
            n = min(max(1, int(x)), int((left[used] // each).min()))
            if n > 0:
                left[used] -= n * each
                patterns.append((sizes[used], each, n))
    keys, each_, base, starts = [], [], [], []
    at: dict[int, int] = {}
    number = 0
    for used, each, n in patterns:
        for s, e in zip(used.tolist(), each.tolist()):
            start = at.get(s, 0)
            keys.append(s * Plan.SHIFT + start)
            each_.append(e)
            base.append(number)
            starts.append(start)
            at[s] = start + n * e
        number += n
    order = np.argsort(np.array(keys, "int64"), kind="stable")
    pick = lambda x: np.array(x, "int64")[order]
    return Plan(pick(keys), pick(each_), pick(base), pick(starts), number, int(bound))


def pack(documents: DataFrame, *, doc_key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, tokenizer_dir: str = TOKENIZER_DIR, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(container, doc_id, offset, size): where each text's tokens lie, containers from 0 on, sizes adding to the capacity at most.

    A text longer than a container is cut at multiples of the capacity, any other is one piece. A null or empty text is one piece of
    size 0 in container 0, so that no document is lost. Repeated rows are packed each; a null key is kept. Among texts of one size
    the order is by hash bucket and key.
    """
    measured = checkpoint(token_sizes(documents, doc_key, text, os.path.join(tokenizer_dir, tokenizer)))
    return pack_sizes(measured, capacity=capacity, bucket_rows=bucket_rows)


def pack_sizes(measured: DataFrame, *, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The same from (doc_id, n_tokens)."""
    cut = F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("long"))
    pieces = measured.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), cut)).alias("part")).select(
        "doc_id", (F.col("part") * capacity).alias("offset"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("part") * capacity).alias("size")
    )
    histogram = {r.size_: r.n for r in pieces.groupBy(F.col("size").alias("size_")).agg(F.count("*").alias("n")).collect()}
    plan = plan_containers(histogram, capacity)
    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "offset"), F.lit(buckets)))
    counts = placed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("number", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "offset")))
    at = measured.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("long")
    def container(size: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(at.value.container(size.to_numpy("int64"), place.to_numpy("int64")))

    found = numbered.join(before, ["size", "bucket"]).withColumn("place", F.col("before") + F.col("number") - 1)
    some = found.where("size > 0").select(container("size", "place").alias("container"), "doc_id", "offset", "size")
    none = pieces.where("size = 0").select(F.lit(0).cast("long").alias("container"), "doc_id", "offset", "size")
    return some.unionByName(none)
