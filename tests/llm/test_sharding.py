"""Byte-balanced shards against running sums in plain Python."""

import zlib

from llm.sharding import shard_by_bytes


def test_shards(spark):
    rows = [(i, "x" * (i * 37 % 101), "clash") for i in range(200)] + [(None, "no id", "a"), (None, None, "b"), (7, "again", "c"),
                                                                      (7, "again", "c"), (300, "é" * 4000, "d"), (301, "", "e")]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 6).collect()
    assert len(got) == len(rows)

    def size(text):
        return len((text or "").encode()) + 8

    def crc(text):
        return None if text is None else zlib.crc32(text.encode())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, crc(r[1]) or 0, size(r[1])))
    total, at, want, slots = sum(size(r[1]) for r in rows), 0, [], {}
    for i, text, _ in order:
        shard = at * 6 // total
        want.append((i, size(text), crc(text), "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        at += size(text)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    sums = [sum(r.size for r in got if r.shard == s) for s in range(6)]
    assert max(abs(s - total / 6) for s in sums) < 8008 + 8


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert [r.slot for r in shard_by_bytes(docs, 24).collect()] == [0, 0]
    assert shard_by_bytes(docs.limit(0)).count() == 0
