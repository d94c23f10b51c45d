"""SimHash near copies against plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from llm.simhash import fingerprint, links, near_copies


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for white in "\t\n\x0b\x0c\r":
        words = words.replace(white, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(found):
    """component of each distinct value by all pairs."""
    values = sorted(set(found))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


TEXTS = [None, "", " \t\n", "one", "One", "one two", "ONE  two\tthree", "one two three four", "é É   x", "a a a a a a", "x" * 5000,
         " ".join(f"w{i % 97}" for i in range(40_000))]


def test_fingerprint():
    for text in TEXTS:
        assert fingerprint(text.encode() if text is not None else None) % 2**64 == plain(text)


def test_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64(b"one two three", seed=42).intdigest()


@pytest.mark.parametrize("crowd", [0, 400])
def test_components(spark, crowd):
    rng = random.Random(crowd)
    base = rng.getrandbits(64)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):  # chains of near values
        v = rng.choice(values)
        values.append(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    # a crowd in which buckets exceed the bound, with flips on a few bits alone
    values += [base ^ sum(1 << b for b in rng.sample(range(14), rng.randint(0, 7))) for _ in range(crowd)]
    values += [0, 1, 2**63, 2**64 - 1]
    values = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    from llm.components import components
    got = {r.node: r.component for r in components(links(df), "a", "b").collect()}
    want = classes(values)
    assert {v: got.get(v, v) for v in want} == want


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "one", "y"), (None, "no other has this text", "y"), (3, "one two", "z"),
                                                          (3, "one two", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_copies(docs).select("doc_id", "fp", "component_id").collect()
    assert len(got) == len(rows)
    fps = [plain(t) for _, t, _ in rows]
    fps = [f - 2**64 if f >> 63 else f for f in fps]
    root = classes(fps)
    least = {}
    for (i, _, _), f in zip(rows, fps, strict=True):
        least[root[f]] = min([x for x in (least.get(root[f]), i) if x is not None], default=None)
    want = sorted(((i, f, least[root[f]]) for (i, _, _), f in zip(rows, fps, strict=True)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert near_copies(docs.limit(0)).count() == 0
