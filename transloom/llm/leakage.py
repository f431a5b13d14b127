"""Held-out passages inside a corpus: CGK embedding, bit-sampling LSH and edit verification.

Texts become words without case, accents, punctuation, markup, numbering and bracketed interruptions. A CGK random walk over an
item-sized window of words repeats or passes each word by a shared random bit, so that a changed, dropped or inserted word moves only
few outputs: edit distance becomes Hamming distance. Samples of a few outputs are the LSH keys, over several walks and samples.
Windows of a document that meet an item's key are compared by all their outputs, and the pairs that stay are decided by the exact
best local alignment of the item with the document around that place.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a window: within two fifths of the shortest passage (20 words), with room for the stride.
WINDOW = 14
#: Words between the windows of a document; every word of an item begins one.
STRIDE = 3
#: Outputs kept of a walk; it goes on to the next word at every second step on average.
STEPS = 24
#: Independent walks, LSH samples of each walk, and outputs in a sample.
WALKS, SAMPLES, PICKED = 4, 3, 8
#: Outputs of a walk that a window pair must share to be verified.
AGREE = 12
#: Share of an item's words that an unbroken stretch has at least, and the part of it that may be lost to errors.
STRETCH, LOSS = 0.4, 0.25
#: Alignment score that stock formulas of procedure reach at most.
FORMULA = 16
#: Score along one diagonal from which a pair is aligned: of twenty words less two dropped ones, some run between them has as many.
SEED = 6
#: Words to either side of the diagonal that the alignment may use for dropped and inserted words.
BAND = 16
#: Words of items handled in one pass over the corpus; bounds what is broadcast (about 30 MB). More items take more passes.
PASS_WORDS = 100_000

_TAG = re.compile(r"<[^<>]*>")
#: An interruption is up to about sixty words long; what is longer may hold a passage itself and stays text.
_BRACKETS = re.compile(r"\([^()]{0,400}\)|\[[^\[\]]{0,400}\]")
_HYPHEN = re.compile(r"(?<=\w)[-\u00ad\u2010]\s*\n\s*(?=\w)")
_OTHER = re.compile(r"[^\x00-\x7f]")
_TO_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: Letters that have no decomposition to a base letter, and characters that vanish inside a word.
_LETTERS = {"ß": "ss", "ẞ": "ss", "œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "ı": "i", "\u00ad": "", "\u200b": ""}


class _Ascii(dict):
    """A character beyond ASCII as base letters, as nothing (a combining mark), as its code point (other scripts) or as a blank."""

    def __missing__(self, c: str) -> str:
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        self[c] = base if base.isascii() else f"u{ord(c):x}" if c.isalnum() else " "
        return self[c]


_ascii = _Ascii(_LETTERS)


def plain_words(text: str | None) -> list[bytes]:
    """The words of a text by which passages are compared."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "(" in text or "[" in text:
        text = _BRACKETS.sub(" ", text)
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if not text.isascii():
        text = _OTHER.sub(lambda m: _ascii[m[0]], text)
    return text.encode("ascii").translate(_TO_WORD).split()


def _mixed(tokens: np.ndarray, walk: int) -> np.ndarray:
    """A well-mixed 32-bit value per token and walk (splitmix), with a tail to read past the last token."""
    x = tokens + np.uint64((walk + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.append((x >> np.uint64(32)).astype("uint32"), np.zeros(STEPS, "uint32"))


def _walk(values: np.ndarray, starts: np.ndarray, take) -> None:
    """Call ``take(step, outputs)`` along the walk from each start: the word's value is put out, and its bit of that step says whether to go on to the next."""
    at = starts.astype("int32") if len(values) < 2**31 else starts.copy()
    for step in range(STEPS):
        out = values.take(at)
        take(step, out)
        at += ((out >> np.uint32(step)) & np.uint32(1)).astype(at.dtype)


def _samples() -> list[list[np.ndarray]]:
    """Steps of each LSH sample of each walk: fixed by rule, spread over the walk."""
    rng = np.random.default_rng(20240229)
    return [[np.sort(rng.choice(STEPS, PICKED, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]


def _keys(values: np.ndarray, starts: np.ndarray, samples: list[np.ndarray]) -> list[np.ndarray]:
    keys = [np.zeros(len(starts), "uint64") for _ in samples]
    wanted = {s: [k for k, picked in enumerate(samples) if s in picked] for s in range(STEPS)}

    def take(step: int, out: np.ndarray) -> None:
        for k in wanted[step]:
            keys[k] += out
            keys[k] *= np.uint64(0x9E3779B97F4A7C15)
            keys[k] ^= keys[k] >> np.uint64(32)

    _walk(values, starts, take)
    return keys


def _embedding(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), STEPS), "uint32")

    def take(step: int, o: np.ndarray) -> None:
        out[:, step] = o

    _walk(values, starts, take)
    return out


class Vocabulary(dict):
    """Words to 63-bit tokens, the same on every worker."""

    MOST = 2_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        token = self[word] = zlib.crc32(word) << 31 | zlib.adler32(word[::-1]) & 0x7FFFFFFF
        return token

    def tokens(self, words: list[bytes]) -> list[int]:
        return [self[w] for w in words]


@dataclass
class ItemIndex:
    """What the workers need of the items of one pass."""

    ids: np.ndarray
    offsets: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    tables: list
    embeddings: list

    FILTER_BITS = 22

    @classmethod
    def build(cls, ids: list[int], passages: list[str]) -> ItemIndex:
        vocabulary = Vocabulary()
        lists = [vocabulary.tokens(plain_words(p)) for p in passages]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("int64")
        tokens = np.array([t for x in lists for t in x], "uint64")
        starts, owner = [], []
        for i, x in enumerate(lists):
            n = max(1, len(x) - WINDOW + 1) if x else 0
            starts.append(offsets[i] + np.arange(n))
            owner.append(np.full(n, i))
        starts = np.concatenate([*starts, np.zeros(0, "int64")]).astype("int64")
        owner = np.concatenate([*owner, np.zeros(0, "int64")]).astype("int64")
        tables, embeddings = [], []
        for walk, samples in enumerate(_samples()):
            values = _mixed(tokens, walk)
            embeddings.append(_embedding(values, starts))
            for keys in _keys(values, starts, samples):
                order = np.argsort(keys, kind="stable")
                found = np.zeros(1 << cls.FILTER_BITS, bool)
                found[(keys >> np.uint64(64 - cls.FILTER_BITS)).astype("int64")] = True
                tables.append((keys[order], order, np.packbits(found)))
        return cls(np.array(ids, "int64"), offsets, tokens, starts, owner, tables, embeddings)


def _candidates(index: ItemIndex, filters: list[np.ndarray], tokens: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unique rows (document, item, diagonal) of window pairs that share a key and enough outputs."""
    n = len(tokens)
    within = np.arange(n) - begin[doc]
    # every STRIDE-th word that a whole window follows, and the first word of shorter texts
    starts = np.flatnonzero((within % STRIDE == 0) & ((np.arange(n) + WINDOW <= end[doc]) | (within == 0)))
    rows = []
    k = 0
    for walk, samples in enumerate(_samples()):
        values = _mixed(tokens, walk)
        met_window, met_item = [], []
        for keys in _keys(values, starts, samples):
            known, order, _ = index.tables[k]
            maybe = np.flatnonzero(filters[k][(keys >> np.uint64(64 - ItemIndex.FILTER_BITS)).astype("int64")])
            lo, hi = np.searchsorted(known, keys[maybe], "left"), np.searchsorted(known, keys[maybe], "right")
            count = hi - lo
            if count.any():
                met_window.append(np.repeat(maybe, count))
                base = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                met_item.append(order[base + np.arange(count.sum())])
            k += 1
        if not met_window:
            continue
        pair = np.unique(np.concatenate(met_window) * len(index.starts) + np.concatenate(met_item))
        windows, items = pair // len(index.starts), pair % len(index.starts)
        places, inverse = np.unique(windows, return_inverse=True)
        step = 500_000
        own = _embedding(values, starts[places])
        for a in range(0, len(pair), step):
            w, i = inverse[a : a + step], items[a : a + step]
            near = (own[w] == index.embeddings[walk][i]).sum(1) >= AGREE
            at, item = starts[places[w[near]]], i[near]
            owner = index.owner[item]
            diagonal = at - (index.starts[item] - index.offsets[owner])
            rows.append(np.column_stack((doc[at], owner, diagonal)))
    return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), "int64")


def _laid_out(index: ItemIndex, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray, shift: int, size: int):
    """Item words, and the document's words that begin ``shift`` off each row's diagonal, as matrices; unequal numbers where there is none."""
    doc, item, diagonal = rows.T
    k = np.arange(size)
    at = index.offsets[item][:, None] + k
    words = np.where(at < index.offsets[item + 1][:, None], index.tokens.take(at, mode="clip"), np.uint64(1 << 63))
    k = np.arange(size + 2 * abs(shift))
    at = diagonal[:, None] + shift + k
    here = (at >= begin[doc][:, None]) & (at < end[doc][:, None])
    return words, np.where(here, tokens.take(at, mode="clip"), np.uint64(1 << 62))


def _by_length(index: ItemIndex, rows: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """Row numbers in groups of like item length, and the longest length of each."""
    sizes = np.diff(index.offsets)[rows[:, 1]]
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        part = order[a : a + most]
        # a group's matrices stay bounded whatever the items' length
        part = part[: max(1, most * 100 // max(1, int(sizes[part].max())))]
        yield part, int(sizes[part].max())
        a += len(part)


def straight_scores(index: ItemIndex, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Best run along each row's diagonal alone: 1 for a shared word, -1 for another."""
    out = np.zeros(len(rows), "int32")
    for part, size in _by_length(index, rows, 8192):
        x, y = _laid_out(index, tokens, begin, end, rows[part], 0, size)
        total = np.cumsum(np.where(x == y, 1, -1).astype("int32"), axis=1)
        before = np.concatenate([np.zeros((len(part), 1), "int32"), total[:, :-1]], axis=1)
        out[part] = (total - np.minimum.accumulate(np.minimum(before, 0), axis=1)).max(1)
    return out


def local_scores(index: ItemIndex, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Best local alignment of item and document within BAND words of each row's diagonal: 1 for a shared word, -1 for a changed, dropped or inserted one."""
    out = np.zeros(len(rows), "int32")
    wide = 2 * BAND + 1
    ramp = np.arange(wide, dtype="int32")
    for part, size in _by_length(index, rows, 4096):
        x, y = _laid_out(index, tokens, begin, end, rows[part], -BAND, size)
        before = np.zeros((len(part), wide + 1), "int32")  # one column besides, which stays 0
        best = np.zeros(len(part), "int32")
        for i in range(size):
            cell = np.where(x[:, i, None] == y[:, i : i + wide], 1, -1).astype("int32") + before[:, :-1]
            np.maximum(cell, before[:, 1:] - 1, out=cell)
            np.maximum(cell, 0, out=cell)
            cell = np.maximum.accumulate(cell + ramp, axis=1) - ramp
            before[:, :-1] = cell
            np.maximum(best, cell.max(1), out=best)
        out[part] = best
    return out


def needed_score(words: int) -> int:
    """Alignment score from which a document holds an item of so many words: its shortest stretch less what errors may take.

    A score that stock formulas alone reach is not enough, unless the item is hardly longer itself.
    """
    return max(1, int(np.ceil(STRETCH * (1 - LOSS) * words)), min(FORMULA, int(np.ceil(0.8 * words))))


def leaks(index: ItemIndex, filters: list[np.ndarray], vocabulary: Vocabulary, doc_ids: list[int], texts: list[str | None]) -> list[tuple[int, int, int]]:
    """(item_id, doc_id, score) of the items found in a batch of texts."""
    lists = [vocabulary.tokens(plain_words(t)) for t in texts]
    sizes = np.array([len(x) for x in lists], "int64")
    if not sizes.sum() or not len(index.starts):
        return []
    end = np.cumsum(sizes)
    begin = end - sizes
    tokens = np.fromiter((t for x in lists for t in x), "uint64", int(sizes.sum()))
    rows = _candidates(index, filters, tokens, np.repeat(np.arange(len(lists)), sizes), begin, end)
    if not len(rows):
        return []
    straight = straight_scores(index, tokens, begin, end, rows)
    words = np.diff(index.offsets)
    needed = np.array([needed_score(int(w)) for w in words])
    kept = straight >= np.minimum(SEED, needed[rows[:, 1]])
    rows, straight = rows[kept], straight[kept]
    if not len(rows):
        return []
    # of neighbouring diagonals the best one stands for all
    run = np.cumsum(np.concatenate([[0], (np.diff(rows[:, :2], axis=0) != 0).any(1) | (np.diff(rows[:, 2]) > BAND // 2)]))
    order = np.lexsort((-straight, run))
    rows = rows[order[np.concatenate([[True], np.diff(run[order]) != 0])]]
    best: dict[tuple[int, int], int] = {}
    for (d, i, _), score in zip(rows.tolist(), local_scores(index, tokens, begin, end, rows).tolist()):
        if score >= needed[i]:
            key = (int(index.ids[i]), d)
            best[key] = max(best.get(key, 0), score)
    return [(i, int(doc_ids[d]), s) for (i, d), s in best.items()]


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", pass_words: int = PASS_WORDS) -> DataFrame:
    """(item_id, doc_id, score): each document that holds a passage or an unbroken stretch of at least two fifths of its words.

    One pass over the documents without a shuffle per block of items. Null or empty texts and passages take part in nothing; a
    passage shorter than a window is one window. Rows with a null key are left out; a key given several times is reported once for
    each of its rows. Texts are read whole, whatever their length. Score is the alignment score (shared less changed words).
    """
    spark = documents.sparkSession
    sized = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(passage).alias("passage")).where("item_id is not null and passage is not null")
    total = sized.agg(F.sum(F.size(F.split("passage", r"\s+"))).alias("n")).head().n or 0
    blocks = max(1, -(-total // pass_words))
    source = documents.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    made = None
    for block in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "passage").collect() if blocks > 1 else sized.orderBy("item_id", "passage").collect()
        shared = spark.sparkContext.broadcast(ItemIndex.build([r.item_id for r in rows], [r.passage for r in rows]))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, vocabulary = shared.value, Vocabulary()
            filters = [np.unpackbits(packed).astype(bool) for _, _, packed in index.tables]
            for batch in batches:
                # so many characters at a time
                cuts = np.flatnonzero(np.diff(batch.text.str.len().cumsum().to_numpy() // 2_000_000)) + 1
                for part in np.split(np.arange(len(batch)), cuts):
                    rows = batch.iloc[part]
                    yield pd.DataFrame(leaks(index, filters, vocabulary, rows.doc_id.tolist(), rows.text.tolist()), columns=["item_id", "doc_id", "score"]).astype("int64")

        found = source.mapInPandas(search, "item_id long, doc_id long, score long")
        made = found if made is None else made.unionByName(found)
    return made
