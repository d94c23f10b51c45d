"""Substring dedup against all windows in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm.common import texts_as_bytes
from llm.substring import WINDOW, dedup_substrings, windows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    least = {}
    words = [WORD.findall(t or "") for _, t, _ in rows]
    for (i, _, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - WINDOW + 1):
            k = tuple(w[s:s + WINDOW])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    out = []
    for (i, t, x), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - WINDOW + 1):
            first = least.get(tuple(w[s:s + WINDOW]))
            if first is not None and (i is None or first < i):
                gone |= set(range(s, s + WINDOW))
        kept = [v for n, v in enumerate(w) if n not in gone]
        out.append((i, x, None if t is None else " ".join(kept), len(w), len(gone)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "x" * 300, "日本語"]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    shared = [prose(n) for n in (49, 50, 51, 80, 200)]
    copy = prose(150)
    rows = []
    for i in range(40):
        text = prose(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(shared)
            cut = rng.randrange(0, 20)
            text += part[cut:] + prose(rng.randrange(0, 30))
        if i % 4 == 0:  # near copies
            text = [rng.choice(vocabulary) if rng.random() < 0.01 else w for w in copy] + text[:5]
        white = rng.choice([" ", "  ", "\n", "\t "])
        rows.append((i, white.join(text), "x"))
    rows += [(100, None, "a"), (101, "", "b"), (102, "a " * 500, "c"), (103, "a " * 60, "d"), (None, " ".join(shared[3]), "e"),
             (None, " ".join(shared[3]), "f"), (5, " ".join(copy), "g"), (5, " ".join(copy), "g"), (5, " ".join(shared[4] * 2), "h"),
             (104, " ".join(shared[4] + prose(30_000) + copy), "i")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = dedup_substrings(docs).collect()
    assert sorted(((r.row.doc_id, r.row.n_words, r.text, r[2], r.n_removed) for r in got), key=repr) == plain(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(docs).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    part = " ".join(f"v{rng.randrange(99)}" for _ in range(70))
    texts = [f"a b c {part} d", part, "q " * 20 + part, "q " * 49, None, part[:-1]]
    rows, nth, anchors, content, at = windows_of(*texts_as_bytes(pa.array(texts, pa.string())))
    hashes = list(zip(*(half.to_pylist() for half in content(at, WINDOW)), strict=True))
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for r, s, a, h in zip(rows, nth, anchors, hashes, strict=True):
        assert seen.setdefault(tuple(words[r][s:s + WINDOW]), (a, h)) == (a, h)
    assert len(rows) == sum(max(0, len(w) - WINDOW + 1) for w in words)
    assert len(seen) == len({h for _, h in seen.values()})
    assert np.all(nth < np.array([len(w) for w in words])[rows])


def thue_morse(n):
    """Two different long words that every polynomial hash modulo 2^64 with an odd base takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_different_words_are_never_taken_for_one(spark):
    one, two = thue_morse(4096)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*words[:30], one, *words[30:]]), "x"), (2, " ".join([*words[:30], two, *words[30:]]), "x")]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, n_words string"))
    assert sorted((r.row.doc_id, r.n_removed) for r in got.select("row", "n_removed").collect()) == [(1, 0), (2, 0)]


def test_borders_between_words_count(spark):
    """The same letters cut into words in another way are other words."""
    rows = [(1, " ".join(["ab", "c"] * 40), "x"), (2, " ".join(["a", "bc"] * 40), "x"), (3, " ".join(["ab", "c"] * 30), "x")]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, n_words string"))
    assert sorted((r.row.doc_id, r.n_removed) for r in got.select("row", "n_removed").collect()) == [(1, 0), (2, 0), (3, 60)]
