"""Template residue, filler, error pages and script notices: positive-unlabelled naive Bayes by expectation-maximization.

Passages are sentences, and every piece of a text in unusual characters (a field is one, but so is a remark in brackets). Those in the
unmistakable form of an unfilled field, filler text, an error message or a script notice are trusted: they are the positives to learn
from and nothing else. All other passages are unlabelled. Exact counts of each feature over every passage of the corpus give the first
model; passages that it does not rule out keep their features and are re-weighted by expectation-maximization until stable. Only
features of trusted passages, then of kept ones, are sent to the workers. A record is left out if the model takes any of its passages,
trusted or not, for residue rather than speech.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.common import checkpoint
from transloom.llm.leakage import _OTHER, _TO_WORD, _ascii

#: Features that a task holds before it counts them; bounds its memory, not the model.
HELD = 1 << 22
#: Weight of the corpus' own distribution in either class, against that of the class's counts.
BACKGROUND = 0.25
#: Share of a feature's passages that must be residue for it to be evidence of that.
PURITY = 0.2
#: Log odds, at most, under the first model below which a passage counts as speech for good: its weight is under a billionth.
FLOOR = -20.0
#: Chance below which a passage counts as speech in a round; the many small chances of a repeated sentence would outweigh the smoothing.
DOUBT = 0.1
#: Change of the share of residue that ends expectation-maximization.
STABLE = 0.002
#: Evidence that one feature, and all features of a passage per feature, may give; features of a passage are far from independent.
CLIP = 4.0

#: Tags of formatting, which are no words of a text.
_FORMAT = re.compile(r"</?(?:p|br|b|i|u|em|strong|div|span|li|ul|ol|a|blockquote|sup|sub)\b[^<>]*>", re.I)
TAG = r"</?(?:html|head|title|body|center|h[1-6]|noscript|script|meta|!doctype)\b[^<>]*>"

#: The usual notations of a field that a template leaves open.
FIELDS = (
    r"\{\{[^{}]+\}\}", r"\{%[^{}%]+%\}", r"<%[^<>%]+%>", r"[$#]\{[^{}]+\}", r"%\([A-Za-z][\w. ]*\)[sd]", r"<<[A-Za-z][\w. ]*>>", r"\[\[[A-Za-z][\w. ]*\]\]",
    r"__[A-Z][A-Z0-9_]*__", r"@@[A-Za-z][\w.]*@@", r"\$[A-Z][A-Z0-9_]*\$", r"%[A-Z][A-Z0-9_]+%", r"\{[A-Za-z][A-Za-z_.]+\}",
    r"<(?:insert|add|enter|put|your|name of)\s[^<>]+>", r"\[(?:INSERT|ADD|ENTER|YOUR|NAME OF|TO BE|TBD)\b[^\[\]]*\]", r"\[[A-Z][A-Z ]+ HERE\]",
    r"\[[^\[\]]*\b(?:einfügen|eintragen|ergänzen|ausfüllen|à compléter|à remplir|à insérer|à ajouter|goes here|to be filled in|placeholder)\b[^\[\]]*\]",
)
#: What stands between unusual characters: in brackets of any kind but round ones, or between the same signs.
_ODD = re.compile(r"[$#%@]?\{+[^{}]*\}+|<+[^<>]*>+|\[+[^\[\]]*\]+|%\([^()\s]*\)[a-z]|(?P<sign>[%@#$|~^*=_]{1,3})\w[\w.-]*(?P=sign)")
_SIGNS = re.compile(r"[^\w\s.,;:!?'’-]+|_{2,}")
_QUOTED = re.compile(r'"[^"]+"|“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»|‘[^‘’]{3,}’(?!\w)')
_BRACKETS = re.compile(r"\([^()]*\)")

#: How passages begin, or read as a whole, that nobody speaks.
FORMS = (
    r"lorem ipsum\b", r"(?:x{2,}[\s.]*){3,}", r"(?:asdf|qwert)", r"(?:(?:test|blah|bla|tk)[ ,.]+){2,}",
    r"(?:dies(?:er text)? ist (?:ein |nur )?)?(?:blindtext|platzhaltertext|mustertext)\b", r"hier steht (?:später|demnächst|bald)\b",
    r"(?:ceci est un )?faux texte\b", r"texte (?:à venir|provisoire|de remplissage)\b",
    r"(?:this is )?(?:a )?(?:sample|dummy|placeholder|filler) (?:paragraph|text|copy)\b", r"(?:\w+ ){0,2}(?:text|copy) (?:goes here|to follow|to come)\b",
    r"(?:http )?(?:error|fehler|erreur)\s*:?\s*[1-5]\d\d\b", r"[45]\d\d\s*[-–:]?\s*(?:not found|forbidden|unauthorized|bad request|bad gateway|internal server|service unavailable|gateway time)",
    r'\{\s*"(?:status|error|errors|code|message)"\s*:', r"traceback \(most recent call last\)",
    r"(?:page not found|page introuvable|(?:die )?seite (?:wurde )?nicht gefunden|access denied|accès refusé|zugriff verweigert|service unavailable)[.!]?$",
    r"die angeforderte seite\b", r"la page demandée\b", r"(?:oops!? )?we can[’']?t find the page\b", r"the page you (?:are looking for|requested)\b",
    r"the server (?:could not|cannot|encountered|is temporarily)\b", r"(?:database|sql) (?:query|error|connection)\b", r"your session (?:has )?expired\b", r"you do not have permission to (?:view|access)\b",
    r"this [\w ]{2,30} is (?:temporarily|currently) unavailable\b", r"der dienst steht (?:zurzeit|derzeit) nicht\b",
    r"(?:please|you need to|you must|bitte|veuillez|merci d[’'])\s?(?:enable|turn on|allow|activate|activer|autoriser|aktivieren sie|erlauben sie)\b.{0,40}\b(?:java ?script|cookies|scripts?|skripte)\b",
    r"java ?script is (?:disabled|required|not enabled|turned off)\b", r"if nothing happens, (?:turn on|enable) java ?script\b", r"(?:java ?)?scripts? (?:are|is) required\b",
    r"(?:gateway|upstream|proxy|connection)\b.{0,60}\b(?:headers|timed out|timeout|refused|reset|dropped)\b", r"checking your browser\b", r"(?:ihr browser unterstützt|votre navigateur ne prend)\b", r"(?:les scripts|javascript) (?:sont|est) (?:bloqués|désactivés?)\b", r"javascript ist (?:deaktiviert|abgeschaltet|erforderlich)\b",
)

#: Where a passage needs a closer look before its words are taken.
_SPECIAL = re.compile(r'["“„«‘{\[(<%$@#|~^*=]|__')
#: The first three letters of what _TRUSTED begins with; its other forms are known by _ENDING.
_BEGINNINGS = frozenset("lor xxx asd bla gat ups pro con qwe die bli pla mus hie cec fau tex thi sam dum fil htt err feh 400 401 403 404 405 408 410 429 500 501 502 503 504 pag sei acc zug ser oop we’ we' the dat sql you der ple bit veu mer jav scr che ihr vot les tes".split(" ")) | {"la ", "if ", "we ", "a s", "a d", "a p", "a f", "tk ", "tk,", "tk."}
_ENDING = re.compile(r"\b(?:text|copy) (?:goes here|to follow|to come)\b", re.I)

_BREAK = re.compile(r"\n[ \t\r]*\n|(?<=[.!?…])[\s]+(?=\S)")
_HYPHEN = re.compile(r"(?<=\w)[-­]\n\s*(?=\w)")
_NUMBER = re.compile(rb"\d+")


def passages(text: str | None) -> list[str]:
    """Paragraphs and sentences of a text, without formatting tags and line breaks."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _FORMAT.sub("\n\n", text)
    if "-\n" in text:
        text = _HYPHEN.sub("", text)
    return [x for p in _BREAK.split(text) if (x := " ".join(p.split()))]


class _Tokens(dict):
    """Words to 32-bit tokens; a number is known by its length only."""

    MOST = 2_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        known = word if word.isalpha() else _NUMBER.sub(lambda m: b"%d#" % min(4, len(m[0])), word)
        token = self[word] = zlib.crc32(known)
        return token


def _words(text: str) -> list[bytes]:
    if not text.isascii():
        text = _OTHER.sub(lambda m: _ascii[m[0]], text)
    return text.encode("ascii").translate(_TO_WORD).split()


class Trusted:
    """The forms whose passages are positives, by sentence (from its beginning) and by piece."""

    def __init__(self, forms: tuple[str, ...] = FORMS, fields: tuple[str, ...] = FIELDS, tag: str = TAG):
        never = r"(?!)"
        self.sentence = re.compile("|".join(forms) or never, re.I)
        self.piece = re.compile("|".join(fields) or never)
        self.tag = re.compile(tag or never, re.I)

    def is_piece(self, piece: str) -> bool:
        return self.piece.match(piece) is not None or self.tag.match(piece) is not None


def _of_piece(piece: str) -> list[bytes]:
    """Words of a piece in unusual characters: its signs, the shape of what they hold, and that. Numbers and single square brackets, as of remarks, are no sign of anything."""
    inner = _SIGNS.sub(" ", piece).strip()
    plain = [b"zb" + w for w in _words(inner.replace("_", " "))]
    if not any(c.isalpha() for c in inner):
        return [b"zznumber", *plain]
    shape = b"zzupper" if inner.isupper() else b"zzjoined" if "_" in inner or "." in inner[:-1] else b"zztext"
    if piece.startswith("[") and not piece.startswith("[["):
        return [shape, *plain] if shape == b"zzupper" else plain
    return [*(b"zs%xn%d" % (ord(x[0]), len(x)) for x in _SIGNS.findall(piece)), b"zzodd", shape, *plain]


def words(passage: str, trusted: Trusted) -> list[tuple[list[bytes], bool]]:
    """(words, whether trusted) of a passage, then of each of its pieces in unusual characters.

    A piece is one word of its passage. What is quoted is not said, so quoted words are other words; remarks in round brackets are
    left out.
    """
    quoted: list[str] = []
    pieces: list[str] = []
    said, sure = passage, False
    if _SPECIAL.search(said):
        if not said.startswith('{"'):
            said = _QUOTED.sub(lambda m: quoted.append(m[0][1:-1]) or " zzquote ", said)
        sure = trusted.sentence.match(said) is not None
        said = _ODD.sub(lambda m: pieces.append(m[0]) or " zzpiece ", said)
        said = _BRACKETS.sub(" ", said)
        sure = sure or trusted.sentence.match(said.strip()) is not None
    elif said[:3].lower() in _BEGINNINGS or _ENDING.search(said):
        sure = trusted.sentence.match(said) is not None
    found = _words(said)
    for q in quoted:
        found += [b"q" + w for w in _words(_ODD.sub(" zzpiece ", q))]
    return [(found, sure), *((_of_piece(p), trusted.is_piece(p)) for p in pieces)]


def features(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, feature as a hash of 63 bits) of passages laid end to end: words, pairs of words, first and last word, size."""
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(size)), size)
    t = tokens.astype("uint64")

    def hashed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype("int64")

    pair = np.flatnonzero(of[:-1] == of[1:])
    salt = lambda n: np.uint64(n << 40)
    every = np.arange(len(size))
    return (
        np.concatenate([of, of[pair], every, every, every]),
        np.concatenate([hashed(t), hashed(t[pair] * np.uint64(0x9E3779B97F4A7C15) + t[pair + 1]), hashed(t[offsets[:-1]] + salt(1)), hashed(t[offsets[1:] - 1] + salt(2)), hashed(np.minimum(5, np.log2(size).astype("uint64") + np.uint64(1)) + salt(3))]),
    )


def _encoded(texts: list[str | None], known: _Tokens, forms: Trusted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, trusted) of each passage with words, all tokens and offsets; so many words at a time."""
    rows: list[int] = []
    trusted: list[bool] = []
    tokens: list[int] = []
    ends = [0]
    for row, text in enumerate(texts):
        for passage in passages(text):
            for found, sure in words(passage, forms):
                if found:
                    tokens += [known[w] for w in found]
                    ends.append(len(tokens))
                    rows.append(row)
                    trusted.append(sure)
        if rows and (len(tokens) > 400_000 or row == len(texts) - 1):
            yield np.array(rows), np.array(trusted), np.array(tokens, "int64"), np.array(ends)
            rows, trusted, tokens, ends = [], [], [], [0]
    if rows:
        yield np.array(rows), np.array(trusted), np.array(tokens, "int64"), np.array(ends)


def _counted(batches: Iterator[pd.DataFrame], forms: Trusted) -> Iterator[pd.DataFrame]:
    """Counts of each feature in all and in trusted passages, in parts; feature -1 counts the passages."""
    known, held, n, n_sure = _Tokens(), [], 0, 0

    def counts() -> Iterator[pd.DataFrame]:
        for k, column in enumerate(("n", "sure")):
            feature, times = np.unique(np.concatenate([h[k] for h in held]), return_counts=True)
            yield pd.DataFrame({"feature": feature, "n": 0, "sure": 0}).assign(**{column: times})
        held.clear()

    for batch in batches:
        for _, trusted, tokens, offsets in _encoded(batch.text.tolist(), known, forms):
            of, f = features(tokens, offsets)
            held.append((f, f[trusted[of]]))
            n += len(trusted)
            n_sure += int(trusted.sum())
            if sum(len(f) for f, _ in held) > HELD:
                yield from counts()
    if held:
        yield from counts()
    yield pd.DataFrame({"feature": [-1], "n": [n], "sure": [n_sure]})


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"feature": np.unique(features(*_laid_out(batch.tokens.tolist()))[1])})


def _places(keys: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Place of each feature in the sorted ``keys``; their number where it is not among them."""
    at = np.searchsorted(keys, f)
    return np.where(np.append(keys, -1)[at] == f, at, len(keys))


def _weights(every: np.ndarray, positive: np.ndarray, mass: float, distinct: int) -> np.ndarray:
    """Log odds that each feature gives, clipped, and last the most that one without positives gives.

    ``mass`` and ``distinct`` are of all features of the corpus, of which those given hold all positives.

    Both classes are smoothed by the corpus itself, so that a feature that residue never had speaks against it by the same small
    amount however rare it is. A feature that is mostly spoken never speaks for residue: words of one passage depend on each other,
    and the small preferences of many would add up.
    """
    every, positive = np.append(every, 1.0), np.append(positive, 0.0)  # without positives the rarest feature speaks least against residue
    background = (every + 1) / (mass + distinct)
    p_mass, n_mass = positive.sum(), mass - positive.sum()
    p = (positive + BACKGROUND * p_mass * background) / (p_mass * (1 + BACKGROUND) + 1e-12)
    n = (every - positive + BACKGROUND * n_mass * background) / (n_mass * (1 + BACKGROUND) + 1e-12)
    odds = np.clip(np.log(p + 1e-300) - np.log(n + 1e-300), -CLIP, CLIP)
    return np.where(positive >= PURITY * every, odds, np.minimum(odds, 0.0)).astype("float32")


def _prior(share: float) -> float:
    share = min(max(share, 1e-6), 0.5)
    return float(np.log(share / (1 - share)))


def _laid_out(lists) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def _odds(keys: np.ndarray, weights: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    of, f = features(tokens, offsets)
    return np.bincount(of, weights[_places(keys, f)], minlength=len(offsets) - 1)


def fit_and_score(documents: DataFrame, *, doc_key: str = "doc_id", text: str = "text", forms: Trusted | None = None) -> DataFrame:
    """(doc_id, log_odds, n_passages): records with any passage that is not ruled out, by the log odds of the most suspicious one.

    Positive log odds mean residue. ``forms`` are the trusted ones. Null, empty and word-less texts have no passages and so no row, as have rows with a null key; a
    key with several rows is judged by all of them. Repeated texts count and are reported each. Texts are read whole. Without any
    trusted passage nothing is learnt and nothing returned.
    """
    spark = documents.sparkSession
    forms = forms or Trusted()
    source = documents.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null and text <> ''")
    counts = checkpoint(source.mapInPandas(lambda batches: _counted(batches, forms), "feature long, n long, sure long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure")))
    seen = counts.where("feature < 0").head()
    total, trusted = (seen.n, seen.sure) if seen else (0, 0)
    schema = "doc_id long, tokens array<long>, trusted boolean"
    if not trusted:
        return spark.createDataFrame([], "doc_id long, log_odds double, n_passages long")
    mass, distinct = counts.where("feature >= 0").agg(F.sum("n"), F.count("*")).head()
    sure = counts.where("feature >= 0 and sure > 0").toPandas().sort_values("feature")
    prior = _prior(trusted / total)
    model = spark.sparkContext.broadcast((sure.feature.to_numpy(), _weights(sure.n.to_numpy("float64"), sure.sure.to_numpy("float64"), mass, distinct)))

    def suspicious(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, (keys, weights) = _Tokens(), model.value
        for batch in batches:
            ids = batch.doc_id.to_numpy()
            for rows, trusted_, tokens, offsets in _encoded(batch.text.tolist(), known, forms):
                keep = np.flatnonzero(trusted_ | (_odds(keys, weights, tokens, offsets) + prior >= FLOOR))
                yield pd.DataFrame({"doc_id": ids[rows[keep]], "tokens": pd.Series([tokens[offsets[k] : offsets[k + 1]].tolist() for k in keep], dtype=object), "trusted": trusted_[keep]})

    kept = checkpoint(source.mapInPandas(suspicious, schema))
    vocabulary = kept.mapInPandas(_distinct, "feature long").distinct().join(counts, "feature").toPandas().sort_values("feature")
    keys, every, share = vocabulary.feature.to_numpy(), vocabulary.n.to_numpy("float64"), trusted / total
    weights = _weights(every, vocabulary.sure.to_numpy("float64"), mass, distinct)
    known_keys = spark.sparkContext.broadcast(keys)
    while True:
        at = spark.sparkContext.broadcast((weights, _prior(share)))

        def expected(batches: Iterator[pd.DataFrame], at=at) -> Iterator[pd.DataFrame]:
            (w, base), keys = at.value, known_keys.value
            sums, n = np.zeros(len(keys)), 0.0
            for batch in batches:
                if len(batch):
                    tokens, offsets = _laid_out(batch.tokens.tolist())
                    of, f = features(tokens, offsets)
                    f = _places(keys, f)
                    odds = np.clip(np.bincount(of, w[f], minlength=len(batch)) + base, -50, 50)
                    chance = np.where(batch.trusted, 1.0, 1 / (1 + np.exp(-odds)))
                    chance[chance < DOUBT] = 0.0
                    n += chance.sum()
                    sums += np.bincount(f, chance[of], minlength=len(keys))
            used = np.flatnonzero(sums > 1e-9)
            yield pd.DataFrame({"feature": np.append(used, -1), "n": np.append(sums[used], n)})

        new = kept.mapInPandas(expected, "feature int, n double").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
        positive = np.zeros(len(keys))
        body = new[new.feature >= 0]
        positive[body.feature] = body.n
        last, share = share, float(new.loc[new.feature < 0, "n"].sum()) / total
        weights = _weights(every, np.minimum(positive, every), mass, distinct)
        if abs(share - last) <= STABLE * last:
            break
    final = spark.sparkContext.broadcast((weights, _prior(share)))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (w, base), keys = final.value, known_keys.value
        for batch in batches:
            if len(batch):
                odds = _odds(keys, w, *_laid_out(batch.tokens.tolist())) + base
                yield pd.DataFrame({"doc_id": batch.doc_id, "log_odds": odds})

    return kept.mapInPandas(scored, "doc_id long, log_odds double").groupBy("doc_id").agg(F.max("log_odds").alias("log_odds"), F.count("*").alias("n_passages"))


def residue(documents: DataFrame, **settings) -> DataFrame:
    """(doc_id, log_odds) of the records to leave out."""
    return fit_and_score(documents, **settings).where("log_odds > 0").select("doc_id", "log_odds")
