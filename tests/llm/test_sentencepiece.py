"""Pieces against the library and plain merging, and the round trip."""

import os
import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from llm.sentencepiece import BLANK, MODEL, Encoder, Pieces, _merge, decode, encode, pieces, round_trip  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(seed):
    rng = random.Random(seed)
    chars = list("abcdefghijklmnopqrstuvwxyz ABC   \n\t.,;0123456789éß漢字😀") + ["the", "ing", "tion", " of"]
    parts = ["the", "hello", " world", "  ", "   ", "aaaa", "aaaaaaaa", "\n\n", "    indent", "abababab", "1234", "==", "-----", "mmmmmmm", "日本語"]
    out = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return out + [" " * n + x for n in range(40) for x in ("", "a", "é", "日x", " z")] + ["z" * 3000, "ab" * 3000, "x y " * 20_000, "\0", " "]


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_the_librarys(library, seed):
    some = texts(seed)
    ids, borders = Encoder(pieces()).encode(some)
    assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:], strict=True)] == library.encode(some)


def test_cache_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr("llm.sentencepiece.CACHE", 10)
    encoder = Encoder(pieces())
    for text in texts(3)[:50]:
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_borders_by_plain_merging(library):
    model = pieces()
    rng = random.Random(5)
    names = [library.id_to_piece(int(i)) for i in model.ids]
    rank = {n: r for r, n in enumerate(names[i] for i in range(len(names)) if model.left[i] != i)}
    number = {n: i for i, n in enumerate(names)}
    pool = [names[i] for i in np.flatnonzero(model.left != np.arange(len(names))) if len(names[i]) < 8 and names[i].isascii()]
    some = [(rng.choice(pool), rng.choice(pool)) for _ in range(1500)] + [("in", "g"), ("t", "he"), ("a", "a"), ("aa", "a"), ("a", "aa")]
    got = model.at_home(np.array([number[a] for a, _ in some]), np.array([number[b] for _, b in some]))
    for (a, b), ok in zip(some, got, strict=True):
        assert ok == (_merge([*a, *b], rank)[-1] == [a, b])


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "plain text", "c"), (3, "plain text", "c"), (None, f"é\n\t{' ' * 9}x", "d"), (4, "long " * 50_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = decode(encode(docs)).collect()
    assert sorted(((r.row.doc_id, r.text, r.row.ids) for r in back), key=repr) == sorted(rows, key=repr)
    assert [r.ids for r in back if r.text is None] == [None] and [list(r.ids) for r in back if r.text == ""] == [[]]
    assert {r.doc_id: r.n_tokens for r in round_trip(docs).collect()}[1] == 0
    assert round_trip(docs.limit(0)).count() == 0


def test_blank_character_is_a_blank(spark):
    docs = spark.createDataFrame([(1, f"a{BLANK}b")], "doc_id long, text string")
    assert round_trip(docs).first().text == "a b"


def test_broken_bytes(spark):
    model = pieces()
    ids = [int(model.bytes[0xC3]), int(model.bytes[0x41])]
    df = spark.createDataFrame([((1,), ids), ((2,), None)], "row struct<doc_id:long>, ids array<int>")
    assert {r.row.doc_id: r.text for r in decode(df).collect()} == {1: "�A", 2: None}


def test_other_kinds_of_models_are_refused(monkeypatch):
    real = sentencepiece.SentencePieceProcessor.get_score
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "get_score", lambda self, i: real(self, i) * 0.37 - 0.1)
    with pytest.raises(ValueError, match="byte-pair"):
        Pieces()
