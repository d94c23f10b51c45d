"""Phrase mining against plain Python, and the trie against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import phrases
from llm.phrases import mine_phrases
from llm.trie import DoubleArray


def plain(rows, least, longest=4, most=2000, cover=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and b * 100 >= a * cover and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most])]
    return sorted(out)


def texts(seed, rows, vocabulary=12):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary - 4)] + ["Éa", "THE", "x\x1cy", "#"]
    marks = [" ", "  ", "\t", ", ", ".", "\n", " ! ", "\x0b", " "]
    out = []
    for _ in range(rows):
        words = [names[min(int(rng.expovariate(0.3)), len(names) - 1)] for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.3:
            words += ["the", "w1", "fixed", "phrase"]
        out.append((rng.choice(["en", "en", "en", "de", None]), "".join(w + rng.choice(marks) for w in words)))
    return out


ODD = [(None, None), ("en", ""), ("und", "a b a b a b"), ("en", "z q " * 70_000), ("fr", " ,.;\n"), ("en", "one two"), ("en", "one two")]


def found(spark, rows, **settings):
    # The last column has the name of a result.
    docs = spark.createDataFrame([(*r, 7) for r in rows], "lang string, text string, n int")
    return sorted(tuple(r) for r in mine_phrases(docs, **settings).collect())


@pytest.mark.parametrize("seed, least", [(1, 30), (2, 5)])
def test_equals_plain_python(spark, seed, least):
    rows = texts(seed, 120) + ODD
    assert found(spark, rows, least=least) == plain(rows, least)


def test_blocks_of_words_and_tries(spark, monkeypatch):
    """Words and candidates that do not fit into one broadcast go in several, with the same rows."""
    monkeypatch.setattr(phrases, "WORD_BLOCK", 5)
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 8)
    monkeypatch.setattr(phrases, "CHUNK", 4)
    monkeypatch.setattr(phrases, "RUN_BYTES", 40)
    monkeypatch.setattr(phrases, "GATHERED", 10)
    rows = texts(3, 60)
    assert found(spark, rows, least=4, most=9) == plain(rows, 4, most=9)


def test_nothing_frequent(spark):
    assert found(spark, [("en", "a b c"), (None, None)]) == []
    assert found(spark, []) == []


def test_sums_beyond_64_bits(spark):
    """Scores of very frequent phrases are exact."""
    many = 9 * 10**18
    words = spark.createDataFrame([("en", "a", many, 0), ("en", "b", many - 1, 1)], "lang string, word string, n long, nth long")
    pairs = spark.createDataFrame([("en", ["a", "b"], many - 3)], "lang string, words array<string>, a long")
    sizes = spark.createDataFrame([("en", many)], "lang string, n long")
    row = phrases._chosen(pairs, words, sizes, 10, 80).first()
    assert row.score == 2_000_000 * (many - 3) // (2 * many - 1)


@pytest.mark.parametrize("seed", range(8))
def test_trie_equals_dictionary(seed):
    rng = random.Random(seed)
    symbols = rng.choice([3, 20, 300, 70_000])
    sequences = sorted({tuple(rng.randrange(symbols) for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([1, 40, 900]))})
    matrix = np.array([[*s, *[-1] * (4 - len(s))] for s in sequences], np.int32)
    trie = DoubleArray.of(matrix, symbols + 3)
    text = np.array([*[rng.randrange(-1, symbols + 3) for _ in range(2000)], *matrix.ravel()], np.int32)
    number = {s: i for i, s in enumerate(sequences)}
    want = {(i, m, number[t]) for m in range(1, 5) for i in range(len(text) - m + 1) if (t := tuple(text[i:i + m].tolist())) in number}
    got = set()
    for m, (at, state) in enumerate(trie.walk(text), 1):
        ends = trie.accept[state]
        got |= {(i, m, e) for i, e in zip(at[ends >= 0].tolist(), ends[ends >= 0].tolist())}
    assert got == want
