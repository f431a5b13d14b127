"""Entities of two sources without a common key: collective graph linkage.

Records of both sides become nodes of a candidate graph; an edge weighs the rarity of the attributes that its ends share, and
meta-blocking drops the edges that are weak for a node. Each edge that stays is scored by that weight, name, kind, designation (side,
direction, platform), place and town. Then scores are refined: a pair gains by the other pairs of the same place that hold, and loses
by the other records that its stop is taken by, as much as such double takings are rare; this is propagated until scores are stable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.common import broadcast_if_small, checkpoint
from transloom.functions.geo import haversine

#: Metres that two surveys of a stop may be apart.
REACH_M = 300.0
#: Height of a grid cell in degrees; more than REACH_M.
CELL = 0.003
#: Meta-blocking keeps the edges of a node that weigh at least this part of its heaviest one.
KEEP = 0.5
#: The largest change of a score that counts as stable.
STABLE = 0.05
#: What a pair gains at most by its neighbours.
SUPPORT = 1.0
#: Evidence of the graph's weight: its unit, and the weight that says nothing.
RARITY_UNIT, RARITY_MIDDLE = 30.0, 30.0
#: Towns that may be broadcast to the join with words; more are joined by a shuffle.
BROADCAST_TOWNS = 200_000

#: Kinds of place by their spellings in English, German and French, without accents.
KINDS = {
    "street": "street st str strasse rue r", "road": "road rd", "avenue": "avenue ave av", "boulevard": "boulevard bd blvd", "square": "square sq", "place": "place platz pl",
    "gardens": "gardens gdns gdn", "park": "park parc", "bridge": "bridge br brucke pont", "church": "church ch kirche ki eglise egl", "school": "school sch schule ecole",
    "hospital": "hospital hosp krankenhaus kh hopital hop", "library": "library lib bucherei", "market": "market mkt markt marche", "mill": "mill muhle moulin", "harbour": "harbour harbor hbr hafen port",
    "cemetery": "cemetery friedhof cimetiere", "gate": "gate tor porte", "townhall": "townhall rathaus mairie", "station": "station stn bahnhof bf bhf gare", "saint": "saint sankt",
}
_KIND = {word: kind for kind, words in KINDS.items() for word in words.split()}
_LONG_KINDS = [w for w in _KIND if len(w) >= 4]
#: What names say beside the place.
_NOISE = re.compile(r"\(?request stop\)?|\[bus\]|\*")
_PHRASES = ((re.compile(r"\bhotel de ville\b"), " townhall "), (re.compile(r",\s*st\.?\s*$"), " saint "), (re.compile(r"^st\.?,"), " street "), (re.compile(r"\bst-(?=\w)"), "saint "))
_SIDES = (
    (re.compile(r"(?:->\s*centre|\(in\)|\binbound\b|\bstadteinwarts\b)"), "in"), (re.compile(r"(?:<-\s*centre|\(out\)|\boutbound\b|\bstadtauswarts\b)"), "out"),
    (re.compile(r"(?:\bdir\.?\s*n\b|\bnorthbound\b|\(n\))"), "n"), (re.compile(r"(?:\bdir\.?\s*s\b|\bsouthbound\b|\(s\))"), "s"),
    (re.compile(r"(?:\bdir\.?\s*e\b|\beastbound\b|\(e\))"), "e"), (re.compile(r"(?:\bdir\.?\s*w\b|\bwestbound\b|\(w\))"), "w"),
    (re.compile(r"(?:-\s*)?(?:\bstop|\bbay|/)\s*([a-d])\b|\(([a-d])\)"), None),
    (re.compile(r"\(?(?:#|\bsteig|\bquai|\bplatform|\bplat\.?|\bgleis|\bgl\.?|\bvoie|\bv\.)\s*(\d{1,2})\)?|\s(\d{1,2})\s*$"), None),
)
#: A civic or town hall with one letter wrong in either word, and with the place between.
_CIVIC, _HALL = ("civic", "town"), re.compile(r"\b(?:civic|town)[ ,]+hall\b")
_WORD = re.compile(r"[a-z]+")
_SUFFIX = re.compile(r"^(\w{3,})(str|pl)$")


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("’", "'"))
    return "".join(c for c in text if not unicodedata.combining(c))


def _near(a: str, b: str) -> bool:
    """At most one letter changed, dropped, added or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def read_name(name: str | None, town: str | None, towns: frozenset[str]) -> tuple[str, str, str, str, str]:
    """(place, kind, side, whole, written) of a stop's name: its proper words in order of the alphabet, the kind of place or '', the designation or '', place and kind without blanks, and all words as they are written, without blanks.

    A kind word of four letters and more is known with one letter wrong. Names of towns are dropped if anything is left.
    """
    text = _NOISE.sub(" ", _plain(name or ""))
    side = ""
    for pattern, value in _SIDES:
        if m := pattern.search(text):
            side = value or next(g for g in m.groups() if g)
            text = text[: m.start()] + " " + text[m.end() :]
            break
    text = re.sub(r"\s+", " ", text).strip()
    for pattern, by in _PHRASES:
        text = pattern.sub(by, text)
    own = _plain(town) if town else ""
    text = _HALL.sub(" townhall ", text)
    words = [w for w in _WORD.findall(text) if w not in ("de", "du", "des", "la", "le", "am", "an", "der", "the", "of", "d", "l")]
    first, second = (next((k for k, w in enumerate(words) if any(_near(w, x) for x in names)), None) for names in (_CIVIC, ("hall",)))
    if first is not None and second is not None and len(words) > 2:
        words = ["townhall", *(w for k, w in enumerate(words) if k not in (first, second))]
    proper = [w for w in words if _KIND.get(w) is None]
    left = [w for w in proper if w != own and w not in towns and not (own and len(own) > 5 and _near(w, own))]
    dropped = set(proper) - set(left) if left else set()
    place, kind = [], ""
    written = "".join(w for w in words if w not in dropped)
    for w in words:
        if w in dropped:
            continue
        # after the place it is a street, before it a saint or a street
        known = _KIND.get(w) if w != "st" or place else "st"
        if known is None and len(left) > 1 and len(w) >= 4:
            known = next((_KIND[k] for k in _LONG_KINDS if _near(w, k)), None)
        if known is not None and not kind:
            kind = known
        elif known is None or known != kind:
            place.append(_SUFFIX.sub(lambda m: m[1] + {"str": "strasse", "pl": "platz"}[m[2]], w))
    place = sorted(place)
    # one order for both sources; a missing blank then changes nothing
    return " ".join(place), kind, side, "".join(sorted([*place, *([kind] if kind else [])])), written


def _plain_words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(_WORD.findall(_plain(t)))) if t else [] for t in texts], dtype=object)


def _town_words(rows: DataFrame, towns: DataFrame) -> DataFrame:
    """rows with town_words: the words of their names that are names of towns, found by a join."""
    words = F.pandas_udf(_plain_words, "array<string>")
    plain = F.pandas_udf(lambda texts: texts.map(_plain), "string")
    known = towns.select(plain("town").alias("word")).distinct()
    spelt = rows.where("name is not null").select("id", F.explode(words("name")).alias("word"))
    found = spelt.join(broadcast_if_small(checkpoint(known), BROADCAST_TOWNS), "word").groupBy("id").agg(F.collect_set("word").alias("town_words"))
    return rows.join(found, "id", "left")


def _named(rows: DataFrame) -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name not in ("name", "town_words")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", place string, kind string, side string, whole string, written string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [read_name(n, t, frozenset(w) if w is not None else frozenset()) for n, t, w in zip(batch.name, batch.town, batch.town_words)]
            out = batch.drop(columns=["name", "town_words"])
            for k, column in enumerate(("place", "kind", "side", "whole", "written")):
                out[column] = [p[k] for p in parts]
            yield out

    return rows.mapInPandas(read, schema)


def _located(rows: DataFrame) -> DataFrame:
    """Positions mended where they can be (millionths of degrees, latitude and longitude swapped), else null."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    scaled = lambda c, most: F.when(F.abs(c) > 1000, c / 1_000_000).otherwise(c)
    lat, lon = scaled(lat, 90), scaled(lon, 180)
    swapped = (F.abs(lat) > 90) & (F.abs(lat) <= 180) & (F.abs(lon) <= 90)
    y, x = F.when(swapped, lon).otherwise(lat), F.when(swapped, lat).otherwise(lon)
    ok = ~((y == 0) & (x == 0)) & (F.abs(y) <= 90) & (F.abs(x) <= 180)
    return rows.withColumns({"lat": F.when(ok, y), "lon": F.when(ok, x)})


def _columns_at(row: Column) -> Column:
    """Cells around the globe in a row of the grid."""
    return F.greatest(F.lit(1), F.floor(F.lit(360 / CELL) * F.cos(F.radians(F.least(F.lit(89.99), F.abs((row + 0.5) * CELL)))))).cast("long")


def _cell(row: Column, lon: Column, step: int = 0) -> Column:
    n = _columns_at(row)
    return F.pmod(F.floor((lon + 180) / 360 * n) + step, n) + row * 10_000_000


def _attributes(rows: DataFrame) -> DataFrame:
    """Each row once for every attribute: letter triples of its place, and its place. Kinds are too common to be keys."""
    padded = F.concat(F.lit("^"), F.regexp_replace("place", " ", ""), F.lit("$"))
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - 2)), lambda i: F.substring(padded, i, F.lit(3)))
    every = F.array_distinct(F.concat(triples, F.array(F.concat(F.lit("p:"), "place"))))
    return rows.select("*", F.explode(every).alias("attribute"))


def _rarity(left: DataFrame) -> DataFrame:
    """(attribute, rarity) by the records of the first source."""
    return _attributes(left.select("a_id", "place")).groupBy("attribute").agg(F.count("*").alias("df")).select("attribute", F.log1p(left.agg(F.count("*")).scalar() / F.col("df")).alias("rarity"))


def _edges(left: DataFrame, right: DataFrame, rarity: DataFrame) -> DataFrame:
    """(a_id, b_id, weight): pairs within reach by the grid; weight is the rarity of what they share."""
    row = F.floor(F.col("lat") / CELL).cast("long")
    a = _attributes(left.where("lat is not null and place <> ''").select("a_id", "place", _cell(row, F.col("lon")).alias("cell"))).drop("place").join(rarity, "attribute")
    around = F.array_distinct(F.flatten(F.array(*[F.array(*[_cell(row + dr, F.col("lon"), dc) for dc in (-1, 0, 1)]) for dr in (-1, 0, 1)])))
    b = _attributes(right.where("lat is not null and place <> ''").select("b_id", "place", around.alias("cells"))).select("b_id", "attribute", F.explode("cells").alias("cell"))
    return a.join(b, ["cell", "attribute"]).groupBy("a_id", "b_id").agg(F.sum("rarity").alias("weight"))


def _unplaced(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_id, b_id): pairs where either has no position; such a place is known by its whole name, in the same town where both name one.

    Keys are the name with the town. A record that names none has a key of the name alone, which the other side's records have too.
    """
    key = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *parts)
    a_keys = F.when(F.col("town").isNull(), F.array(key("a", "whole"))).otherwise(F.array(key("t", "whole", "town"), key("b", "whole")))
    b_keys = F.when(F.col("town").isNull(), F.array(key("a", "whole"), key("b", "whole"))).otherwise(F.array(key("t", "whole", "town"), key("a", "whole")))
    a = left.where("whole <> ''").select("a_id", F.col("lat").isNull().alias("lost"), F.explode(a_keys).alias("key"))
    b = right.where("whole <> ''").select("b_id", F.col("lat").isNull().alias("lost"), F.explode(b_keys).alias("key"))
    return a.where("lost").drop("lost").join(b.drop("lost"), "key").unionByName(a.where("not lost").drop("lost").join(b.where("lost").drop("lost"), "key")).select("a_id", "b_id")


def _crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_id, b_id): pairs of one whole name, in the same town where both name one, that are near only with latitude and longitude of either swapped."""

    def placed(rows: DataFrame, prefix: str, lat: str, lon: str, steps: tuple[int, ...]) -> DataFrame:
        row = F.floor(F.col(lat) / CELL).cast("long")
        cells = F.array_distinct(F.array(*[_cell(row + dr, F.col(lon), dc) for dr in steps for dc in steps]))
        named = rows.where(f"lat is not null and abs({lat}) <= 90 and whole <> ''")
        return named.select(f"{prefix}_id", "whole", *[F.col(c).alias(f"{prefix}_{c}") for c in ("town", "lat", "lon")], F.col(lat).alias(f"{prefix}_y"), F.col(lon).alias(f"{prefix}_x"), F.explode(cells).alias("cell"))

    def metres(y: str, x: str) -> Column:
        return haversine(F.col(f"a_{y}"), F.col(f"a_{x}"), F.col(f"b_{y}"), F.col(f"b_{x}"))

    either = placed(left, "a", "lon", "lat", (0,)).join(placed(right, "b", "lat", "lon", (-1, 0, 1)), ["whole", "cell"]).unionByName(
        placed(left, "a", "lat", "lon", (0,)).join(placed(right, "b", "lon", "lat", (-1, 0, 1)), ["whole", "cell"])
    )
    return either.where((metres("y", "x") <= REACH_M) & (metres("lat", "lon") > REACH_M) & F.expr("coalesce(a_town = b_town, true)")).select("a_id", "b_id").distinct()


def _pruned(edges: DataFrame) -> DataFrame:
    """(a_id, b_id) by weighted node pruning: an edge stays if it is strong for its record of the second source."""
    best = edges.groupBy("b_id").agg(F.max("weight").alias("best"))
    return edges.join(best, "b_id").where(F.col("weight") >= KEEP * F.col("best")).select("a_id", "b_id", "weight")


def _scored(pairs: DataFrame) -> DataFrame:
    """Log odds of each pair by itself, and its distance in metres."""
    whole = 1 - F.levenshtein("a_whole", "b_whole") / F.greatest(F.length("a_whole"), F.length("b_whole"), F.lit(1))
    place = 1 - F.levenshtein("a_place", "b_place") / F.greatest(F.length("a_place"), F.length("b_place"), F.lit(1))
    written = 1 - F.levenshtein("a_written", "b_written") / F.greatest(F.length("a_written"), F.length("b_written"), F.lit(1))
    either = (F.col("b_kind") == "st") & F.col("a_kind").isin("saint", "street")
    # a kind that cannot be read leaves a word besides the place
    unread = F.when((F.col("b_kind") == "") & (F.col("a_place") != "") & F.array_contains(F.split("b_place", " "), F.col("a_place")), 0.93)
    alike = F.greatest(whole, written, unread, F.when((F.col("a_kind") == F.col("b_kind")) | either, place))
    kinds = F.when(F.col("a_kind") == F.col("b_kind"), 1.0).when(either, 0.0).when((F.col("a_kind") == "") | (F.col("b_kind") == ""), -1.0).otherwise(-8.0)
    sides = (
        F.when((F.col("a_side") == "") & (F.col("b_side") == ""), 0.5).when(F.col("a_side") == F.col("b_side"), 2.0)
        .when((F.col("b_side") == "") & (F.col("a_kind") == "station"), -4.0).when(F.col("b_side") == "", -0.5).when(F.col("a_side") == "", -1.5).otherwise(-14.0)
    )
    types = F.when((F.col("a_type") == 1) & (F.col("b_type") == 1), 1.5).when(F.coalesce(F.col("a_type") != F.col("b_type"), F.lit(False)), -1.5).otherwise(0.0)
    town = F.when(F.col("a_town") == F.col("b_town"), 0.5).when(F.coalesce(F.col("a_town") != F.col("b_town"), F.lit(False)), -2.0).otherwise(0.0)
    metres = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    distance = F.when(metres.isNull(), -2.0).when(metres > REACH_M, -12.0).otherwise(F.greatest(F.lit(-1.9), 4.5 - 2.2 * F.log1p(metres / 2)))
    rare = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("weight") - RARITY_MIDDLE) / RARITY_UNIT))
    return pairs.withColumns({"metres": metres, "own": 40 * (alike - 0.8) + kinds + sides + types + town + distance + rare})


def _chance(score: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))


def _refined(state: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id, own, metres, place, score) with the scores that no round changes any more.

    Only pairs whose record or stop has another candidate take part. Steps shrink from round to round, so that scores that would
    swing come to rest; then the loop ends.
    """
    held = lambda df: df.withColumn("held", _chance(F.col("score")) * F.exp(F.least(F.lit(30.0), F.col("score"))) / F.sum(F.exp(F.least(F.lit(30.0), F.col("score")))).over(Window.partitionBy("b_id")))
    shared = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    # a stop that is taken counts against a record only as far as it has another one to go to
    elsewhere = F.least(F.lit(1.0), F.sum(_chance(F.col("own"))).over(Window.partitionBy("b_id")) - _chance(F.col("own")))
    counted = checkpoint(state.withColumns({"contested": shared("a_id"), "open": shared("b_id"), "sited": shared("place"), "elsewhere": elsewhere}))
    fixed = counted.where("not (contested or open or sited)").select(*state.columns)
    state = counted.where("contested or open or sited").select(*state.columns, "elsewhere")
    # how rare it is that a stop is taken twice
    taken = held(state).groupBy("a_id").agg(F.sum("held").alias("n")).agg(F.count(F.when(F.col("n") > 0.5, 1)).alias("once"), F.count(F.when(F.col("n") > 1.5, 1)).alias("twice")).head()
    penalty = float(np.log((taken.once + 2) / (taken.twice + 1)))
    round_ = 0
    while True:
        round_ += 1
        weighted = held(state)
        in_place = weighted.groupBy("place").agg(F.sum("held").alias("p_held"))
        of_stop = weighted.groupBy("a_id").agg(F.sum("held").alias("a_held"))
        joined = weighted.join(in_place, "place").join(of_stop, "a_id")
        others = F.col("p_held") - F.col("a_held")
        support = SUPPORT * F.least(F.lit(1.0), F.greatest(F.lit(0.0), others))
        claimed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("a_held") - F.col("held")))
        step = min(0.8, 3 / (round_ + 2))
        new = F.col("score") + step * (F.col("own") + support - penalty * claimed * F.col("elsewhere") - F.col("score"))
        moved = checkpoint(joined.select("a_id", "b_id", "own", "metres", "place", "elsewhere", new.alias("score"), F.abs(new - F.col("score")).alias("moved")))
        most = moved.agg(F.max("moved").alias("m")).head().m
        state = moved.drop("moved")
        if most is None or most <= STABLE:
            return fixed.unionByName(state.drop("elsewhere"))


def link(left: DataFrame, right: DataFrame, *, propagate: bool = True) -> DataFrame:
    """(a_id, b_id, confidence): of each record of ``right`` the record of ``left`` that describes the same entity, if there is one.

    Both sides have id (long, unique), name, lat, lon, town and type. Null or empty names match nothing; a missing or impossible
    position leaves the whole name, with the town where both name one, as does one that is near only with its latitude and longitude
    swapped. Several records of ``right`` may match one of ``left``. Of
    equal scores the nearer, then the smaller id wins. Repeated rows of an id count once; an empty side gives no match. Confidence
    lies between 0 and 1. Without ``propagate`` each pair is judged by itself.
    """
    columns = ("id", "name", "lat", "lon", "town", "type")
    towns = right.select("town").union(left.select("town")).where("town is not null").distinct()
    sides = []
    for rows, prefix in ((left, "a"), (right, "b")):
        once = checkpoint(rows.select(*columns).where("id is not null").dropDuplicates(["id"]))
        named = _named(_located(_town_words(once, towns)))
        sides.append(checkpoint(named.select(F.col("id").alias(f"{prefix}_id"), "lat", "lon", "town", "type", "place", "kind", "side", "whole", "written")))
    a, b = sides
    rarity = checkpoint(_rarity(a))
    # a whole name is evidence enough that no near record may push it out; what such a pair shares is all that its stop has
    near = _pruned(_edges(a, b, rarity)).withColumn("crossed", F.lit(False))
    named = _unplaced(a, b).withColumn("crossed", F.lit(False)).unionByName(_crossed(a, b).withColumn("crossed", F.lit(True)))
    full = _attributes(a.select("a_id", "place")).join(rarity, "attribute").groupBy("a_id").agg(F.sum("rarity").alias("weight"))
    known = near.unionByName(named.join(full, "a_id"))
    edges = known.groupBy("a_id", "b_id").agg(F.max("crossed").alias("crossed"), F.max("weight").alias("weight"))
    with_a = edges.join(a.select("a_id", *[F.col(c).alias(f"a_{c}") for c in ("lat", "lon", "town", "type", "place", "kind", "side", "whole", "written")]), "a_id")
    pairs = with_a.join(b.select("b_id", *[F.col(c).alias(f"b_{c}") for c in ("lat", "lon", "town", "type", "place", "kind", "side", "whole", "written")]), "b_id")
    # which of two swapped positions is right is not known: such a pair is scored as one without
    pairs = pairs.withColumns({c: F.when(~F.col("crossed"), F.col(c)) for c in ("a_lat", "a_lon")})
    row = F.floor(F.col("a_lat") / (4 * CELL)).cast("long")
    state = _scored(pairs).where("own > -8").select(
        "a_id", "b_id", "own", "metres", F.xxhash64("a_place", "a_kind", row, F.floor(F.col("a_lon") / (4 * CELL))).alias("place"), F.col("own").alias("score")
    )
    state = checkpoint(state)
    if propagate:
        state = _refined(state)
    best = state.groupBy("b_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.coalesce("metres", F.lit(1e9)).alias("m"), F.col("a_id").alias("a_id"))).alias("top"), F.sum(F.exp(F.least(F.lit(30.0), F.col("score")))).alias("every")
    )
    score = -F.col("top.s")
    return best.where(score > 0).select(F.col("top.a_id").alias("a_id"), "b_id", (_chance(score) * F.exp(F.least(F.lit(30.0), score)) / F.col("every")).alias("confidence"))
