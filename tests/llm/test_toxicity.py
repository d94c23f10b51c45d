"""Deobfuscation against all paths of small lattices; held-out labels; rows without text."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.toxicity import OTHER, SIGN, SPACE, SYMBOLS, Characters, Reader, Sieve, ToxicityModel, ambiguous, features, fit, kind, language_model, \
    lattice, op8_toxicity, restore, score

SF = "/root/testdata/sf0.01"


def plain_counts(texts):
    """Triples of characters, with one sign and one gap for all, gaps that follow each other as one."""
    counts = Counter()
    for text in texts:
        chars = [(c, "0", " ")[kind(c)] for c in (text or "").lower()]
        chars = [c for i, c in enumerate(chars) if c != " " or i == 0 or chars[i - 1] != " "]
        counts.update(zip(chars, chars[1:], chars[2:], strict=False))
    return counts


@pytest.mark.parametrize("texts", [["Ab, cd!", None, "", "é 1x", "a  b", "xyz", "x\0\0y z", "…word… “x”", "日本語 текст"] * 3,
                                   ["".join(map(chr, range(0x4E00, 0x4F00))) + " abc abc"]])
def test_model_of_the_real_characters(spark, texts):
    counts = plain_counts(texts)
    common = Counter()
    for (_, _, c), n in counts.items():
        common[c] += n
    common = sorted((c for c in common if c not in "0 "), key=lambda c: (-common[c], c))[:93]
    model = language_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model.letters == {c: i for i, c in enumerate(common)}
    number = {"0": SIGN, " ": SPACE} | model.letters
    want = np.full((SYMBOLS, SYMBOLS, SYMBOLS), 0.1)
    for triple, n in counts.items():
        want[tuple(number.get(c, OTHER) for c in triple)] += n
    assert np.allclose(model.costs, -np.log(want / want.sum(2, keepdims=True)))


def cost(text, model):
    a = b = SPACE
    total = 0.0
    for char in text + " ":
        c = model.symbol(char)
        if c == SPACE and b == SPACE:
            continue
        total += model.costs[a, b, c]
        a, b = b, c
    return total


@pytest.mark.parametrize("span", ["l0s3r", "a b c", "m.o.r", "sooon", "1d10t", "x", "$+@", "a_b-c", "iii1", "id-iot", "mo.ron", "id i ot", "a  b c"])
def test_viterbi_is_the_cheapest_path(span):
    rng = np.random.default_rng(len(span))
    costs = Characters({c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}, rng.random((SYMBOLS, SYMBOLS, SYMBOLS)))
    best = min(((cost("".join(t for t, _ in path), costs) + sum(e for _, e in path)) for path in itertools.product(*lattice(span))))
    got = restore(span, costs)
    # the cost of what was found, by the cheapest way to write it
    ways = [sum(e for _, e in path) for path in itertools.product(*lattice(span)) if "".join(t for t, _ in path).rstrip(" ") == got]
    assert cost(got, costs) + min(ways) == pytest.approx(best)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    words = ["the", "house", "green", "river", "walks", "under", "seven", "stone", "bridge", "lamp", "winter", "sea"]
    bad = ["loser", "idiot", "pathetic", "moron"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(20)]
        if toxic:
            text.insert(rng.randrange(20), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    costs = language_model(docs)
    return fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), costs)


@pytest.mark.parametrize("text", ["what a l0ser", "i d i o t", "p.a.t.h.e.t.i.c", "M0R0N", "1d10t", "looooser", "p@thet1c", "m-o-r-o-n here", "id-iot", "mo.ron",
                                  "idi*ot", "idiiot", "id i ot", "i  d  i  o  t", "an idiot, he", "(moron)"])
def test_disguises(model, text):
    assert model.score(Reader(model.characters, model.weights)(text)) > 0.5


@pytest.mark.parametrize("text", ["the green house", "s t o n e", "br1dge", "", None, "call 555 1234", "a b c"])
def test_clean_texts(model, text):
    assert model.score(Reader(model.characters, model.weights)(text)) < 0.5


def test_words_with_several_paths():
    assert all(map(ambiguous, ["id-iot", "mo.ron", "idi*ot", "idiiot", "l0ser", "well-known", "1d10t", "h@llo"]))
    assert not any(map(ambiguous, ["house", "1234", "don't", "(555)", "-", "..."]))


def test_long_texts_take_time_in_proportion(spark):
    """Spans are found in one go along the text, whatever it consists of."""
    model = language_model(spark.createDataFrame([("to be or not to be",)], "text string"))
    for word in ("to ", "a ", "to be x ", "a.b ", "aa bb "):
        start = time.perf_counter()
        Reader(model)(word * (200_000 // len(word)) + "end.")
        assert time.perf_counter() - start < 20


def test_usual_words_stay_as_they_are(spark):
    text = "a well-known house, the green hills and a deep pool in it. The well-known river flows off to the sea"
    model = language_model(spark.createDataFrame([(text,)] * 30, "text string"))
    assert Reader(model).restored(text) == text.lower()


def every_feature(word):
    """Of all paths through a word, and not of the cheapest alone."""
    return {f for path in itertools.product(*lattice(word)) for f in features("".join(t for t, _ in path))}


@pytest.mark.parametrize("seed", range(4))
def test_sieve_lets_every_path_through(model, seed):
    """A text of which any path gives a feature of the model is decoded."""
    rng = random.Random(seed)
    for _ in range(1500):
        word = rng.choice(["loser", "idiot", "moron", "stone", "bloom", "x"])
        span = "".join(rng.choice({"o": "o0", "i": "i1!|", "l": "l1|£", "s": "s$5", "e": "e3€"}.get(c, c)) * rng.choice([1, 1, 2, 3])
                       + rng.choice(["", "", "", ".", "-", " ", "  "]) for c in word).strip()
        if 3 ** sum(len(w) > 1 for w in lattice(span)) > 3000:
            continue
        wanted = {f for f in every_feature(span) if rng.random() < 0.2}
        for f in wanted:
            assert Sieve({f})("so " + span + " they say")
    assert not Sieve(model.weights)("the green house") and not Sieve({})("idiot") and not Sieve(model.weights)(None)


def test_score_is_that_of_decoding_every_text(spark, model):
    """Brute force: no sieve, no looking up of words that were seen before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 200")
    learned = fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"),
                  language_model(spark.read.parquet(f"{SF}/documents.parquet")))
    assert learned.weights
    reader = Reader(learned.characters)
    for r in score(docs, learned).collect():
        found = {f for w in reader.restored(r.row.text or "").split() for f in features(w)}
        assert r.score == learned.score(found & set(learned.weights))


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (3, "you idiot", "c"), (3, "you idiot", "c"), (None, "you idiot", "d"), (4, "idiot " + "stone " * 60_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = score(docs, model).collect()
    assert len(got) == len(rows) and sorted(r.row.score for r in got) == sorted(r[2] for r in rows)
    assert all((r.score >= 0.5) == ("idiot" in (r.row.text or "")) and 0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "text"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (9, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        learned = fit(docs, marks, language_model(docs))
        assert isinstance(learned, ToxicityModel) and all(0 <= r.score <= 1 for r in score(docs, learned).collect())


@pytest.mark.parametrize("of_twenty", [0, 1, 8, 10, 15, 18, 20])
def test_any_share_of_toxic_labels(spark, of_twenty):
    rng = random.Random(of_twenty)
    words = ["the", "house", "green", "river", "walks", "under", "seven", "stone", "bridge", "lamp", "winter", "sea"]
    texts = [[rng.choice(words) for _ in range(12)] + ["idiot", "moron"][:i % 20 < of_twenty] for i in range(800)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    got = {r.row.doc_id: r.score for r in score(docs, fit(docs, labels, language_model(docs))).collect()}
    clean = [i for i, t in enumerate(texts) if "idiot" not in t]
    assert all(got[i] < 0.5 for i in clean)
    # Nothing can be told from labels that are all alike: nothing is rejected.
    assert {i for i in got if got[i] < 0.5} == set(clean if 0 < of_twenty < 20 else got)


@pytest.mark.parametrize("marks", [[], [(99, 1)], [(1, 1)], [(1, None)]])
def test_labels_of_no_use_reject_nothing(spark, marks):
    docs = spark.createDataFrame([(1, "text"), (2, "another"), (None, None)], "doc_id long, text string")
    learned = fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), language_model(docs))
    assert all(0 <= r.score < 0.5 for r in score(docs, learned).collect())


def test_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op8_toxicity(spark, SF).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    clean = [r for r in got if not r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.03
    caught = [r.predicted for r in got if r.toxic]
    assert np.mean(caught) > 0.5
    every = op8_toxicity(spark, SF).agg(F.count("score"), F.min("score"), F.max("score"), F.sum((F.col("predicted") != (F.col("score") >= 0.5)
                                                                                               .cast("int")).cast("int"))).first()
    assert every[0] == spark.read.parquet(f"{SF}/documents.parquet").count() and 0 <= every[1] <= every[2] <= 1 and every[3] == 0
