import random

from transloom.llm.residue import FIELDS, FORMS, Trusted, fit_and_score, passages, residue, words

SCHEMA = "doc_id long, text string, tokens string"
rng = random.Random(4)
NOUNS = "budget road bridge harbour school tax report tender clinic licence charter audit".split()


def sentence():
    a, b, c = rng.sample(NOUNS, 3)
    return rng.choice([f"The {a} limits the {b} near the {c}.", f"I ask the Minister to fund the {a} and to review the {b}.", f"Who will defend the {c} if the {a} replaces the {b}?"])


def speech():
    return " ".join(sentence() for _ in range(rng.randrange(2, 9)))


RESIDUE = [
    "Error 503: Service Unavailable. Please try again later.", "<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1></body></html>", "Please enable JavaScript to view this page.",
    "I thank {{ speaker.name }} for the question.", "The vote was %VOTE_RESULT% to nil.", "[INSERT DATE] the House met.", "Lorem ipsum dolor sit amet elitar.", "Page introuvable.", "Bitte aktivieren Sie JavaScript, um die Seite zu sehen.", "On ${date} we met <insert name>.",
]
TALK = ['My constituent saw only "404 Not Found" on the site.', "An internal error cost the office a day of work.", 'A letter that begins "Dear {{name}}" is an insult.', "See {1} in the annex list {1, 2}.", "[Laughter] (Applause)", "<p>Caf&eacute;</p> was served.", "Officials sent out placeholder text, lorem ipsum and all."]


def corpus():
    docs, bad = [], set()
    for i in range(600):
        text = speech()
        if i % 10 == 0:
            text = rng.choice([RESIDUE[i // 10 % len(RESIDUE)], text + " " + RESIDUE[i // 10 % len(RESIDUE)]])
            bad.add(i)
        elif i % 10 == 5:
            text += " " + TALK[i // 10 % len(TALK)]
        docs.append((i, text, "z"))
    return docs, bad


def test_residue_and_talk_about_it(spark):
    docs, bad = corpus()
    docs += [(700, None, ""), (701, "", ""), (None, RESIDUE[0], ""), (702, "... --- !!", ""), (703, speech() * 3000 + " " + RESIDUE[3], ""), (704, RESIDUE[0], ""), (704, RESIDUE[0], "")]
    got = [r.doc_id for r in residue(spark.createDataFrame(docs, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == bad | {703, 704}, (set(got) - bad, [docs[i] for i in bad - set(got)])


def test_what_is_like_trusted_text_is_learnt(spark):
    docs, bad = corpus()
    docs += [(800 + i, "Lorem ipsum " + " ".join(rng.choices("magnum porta velum dolor nisi".split(), k=9)), "") for i in range(30)]
    docs += [(900, "Velum nisi porta magnum dolor porta velum magnum.", "")]
    assert 900 in {r.doc_id for r in residue(spark.createDataFrame(docs, SCHEMA)).collect()}


def test_empty_corpus_and_corpus_without_residue(spark):
    assert fit_and_score(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fit_and_score(spark.createDataFrame([(1, "The bridge is closed.", "")], SCHEMA)).count() == 0


def test_forms_that_the_list_lacks_are_found_by_the_model(spark):
    """Fields in notations, and pages in words, of which the trusted forms hold none: what they share with trusted ones decides."""
    docs, bad = [], set()
    kinds = ["We thank {{ name }} here.", "On {{ date }} we met.", "Error 503: Service Unavailable. Please try again later.", "The page you requested was moved, please try again later.", "Please enable JavaScript to view this page.", "<<speaker>> rose.", "Then @@vote@@ followed.", "Sorry, this page was moved, please try again later.", "JavaScript to view this page was moved, please enable."]
    withheld = {5, 6, 7, 8}
    for i in range(900):
        text = speech()
        if i % 10 == 0:
            text += " " + kinds[i // 10 % len(kinds)]
            bad.add(i)
        docs.append((i, text, ""))
    forms = Trusted(tuple(f for f in FORMS if "page you" in f or "error|" in f or "enable|turn on" in f), tuple(f for f in FIELDS if f.startswith(r"\{\{")), "")
    for i in sorted(bad):
        sure = any(s for p in passages(docs[i][1]) for _, s in words(p, forms))
        assert sure == (i // 10 % len(kinds) not in withheld)
    got = {r.doc_id for r in residue(spark.createDataFrame(docs, SCHEMA), forms=forms).collect()}
    assert got <= bad and len(got) >= 0.9 * len(bad)


def test_trust_alone_decides_nothing(spark):
    """A trusted form that the corpus uses as speech all over is not residue."""
    docs = [(i, speech() + " Test test and back.", "") for i in range(300)] + [(500 + i, RESIDUE[0], "") for i in range(5)]
    forms = Trusted((r"error\b", r"test test and back\b"), (), "")
    got = {r.doc_id for r in residue(spark.createDataFrame(docs, SCHEMA), forms=forms).collect()}
    assert {500, 504} <= got


def test_fields_are_one_word_and_quotes_are_apart():
    known = Trusted()
    said, field = words("The vote was {{ x.y }} to nil.", known)
    assert said == ([b"the", b"vote", b"was", b"zzpiece", b"to", b"nil"], False) and field[1] and b"zzodd" in field[0]
    assert words('He read "Dear {{name}}" out.', known) == [([b"he", b"read", b"zzquote", b"out", b"qdear", b"qzzpiece"], False)]
    assert [t for _, t in words("[Laughter] he said.", known)] == [False, False]
    assert passages(None) == [] and passages("A b.\n\nC d! E") == ["A b.", "C d!", "E"]


def test_what_is_learnt_does_not_depend_on_the_size_of_the_corpus(spark):
    """Words that one trusted passage each holds stay evidence among 600,000 features of speech."""
    docs, _ = corpus()
    letters = "abcdefghijklmnopqrstuvwxyz"
    latin = ["v" + "".join(rng.choices(letters, k=9)) for _ in range(100)]
    docs += [(800 + i, "Lorem ipsum " + " ".join(latin[5 * i : 5 * i + 5]), "") for i in range(20)] + [(900, " ".join(latin[::5]) + ".", "")]
    more = [(1000 + i, " ".join("".join(rng.choices(letters, k=8)) for _ in range(100)) + ".", "") for i in range(3000)]
    for every in (docs, docs + more):
        got = {r.doc_id for r in residue(spark.createDataFrame(every, SCHEMA)).collect()}
        assert 900 in got and not any(i >= 1000 for i in got)
