"""Exact substring dedup over words: winnowed anchors as seeds, extended as far as they repeat."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, stored, table, texts_as_bytes
from .cuckoo import mixed

#: Words of a window, and of the grams of which each window's least is its anchor.
WINDOW, GRAM = 50, 12
#: Multipliers of the polynomial hashes modulo 2^64 that choose anchors: of bytes in a word, of words in a gram.  They only bring
#: equal windows together; whether contents are equal is decided by 128-bit hashes of the words.
BYTES, WORDS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes hashed at a time.
RUN_BYTES = 1 << 20

#: What is equal where contents are.
CONTENT = ["anchor", "block", "more"]
WORD_BLOCKS = "anchor long, block long, more long, first integer, n integer"


@lru_cache(8)
def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below ``count``."""
    def row(b):
        out = np.full(count, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return row(base), row(pow(base, -1, 1 << 64))


def _table(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, int(count).bit_length()))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of several texts, and the number of words before each text (n + 1 values)."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~white
    starts = np.flatnonzero(inside & (np.concatenate(([True], white[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate((white[1:], [True])) | edge[1:])) + 1 if len(data) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + RUN_BYTES, "right")))
        low, high = starts[at], ends[to - 1]
        power, inverse = _table(base, high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[:high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


class Sequences:
    """Hashes of any runs of consecutive words."""

    def __init__(self, hashes: np.ndarray, base: int):
        power, self.inverse = _table(base, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[:len(hashes)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, count) -> np.ndarray:
        return mixed((self.sums[first + count] - self.sums[first]) * self.inverse[first] + np.asarray(count).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` values that follow each other."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:len(values) - (width - reach)], values[width - reach:]) if reach < width else values


class Contents:
    """128-bit hashes of any runs of consecutive words, each over the 128-bit hashes of its words, which tell where a word ends."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        whole = data.tobytes()
        words = [whole[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        digests = dict.fromkeys(words)
        for word in digests:
            digests[word] = xxhash.xxh3_128_digest(word)
        self.digests = b"".join(map(digests.__getitem__, words))

    def __call__(self, first: np.ndarray, count) -> tuple[pa.Array, pa.Array]:
        size, digests = 16, self.digests
        ends = first + count
        out = b"".join([xxhash.xxh3_128_digest(digests[a * size:b * size]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)])
        pairs = np.frombuffer(out, np.int64).reshape(-1, 2)
        return pa.array(pairs[:, 0]), pa.array(pairs[:, 1])


def windows_of(data: np.ndarray, offsets: np.ndarray):
    """Every window of the texts: its text's number, its first word in the text, its anchor; a hash of any run of words; the window's first
    word among all.

    The anchor of a window is the least hash among its grams.  It depends on the
    window's words alone, so equal windows have the same anchor.
    """
    starts, ends, before = words_of(data, offsets)
    count = np.diff(before)
    rows = np.repeat(np.arange(len(count)), np.maximum(count - WINDOW + 1, 0))
    if not len(rows):
        return rows, rows, rows.astype(np.uint64), None, rows
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(count - WINDOW + 1, 0)) - np.maximum(count - WINDOW + 1, 0),
                                           np.maximum(count - WINDOW + 1, 0))
    at = before[rows] + nth
    grams = Sequences(word_hashes(data, starts, ends, BYTES), WORDS)
    anchors = _least(grams(np.arange(len(starts) - GRAM + 1), GRAM), WINDOW - GRAM + 1)[at]
    return rows, nth, anchors, Contents(data, starts, ends), at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(docs: DataFrame) -> DataFrame:
    """Seeds: runs of windows with the same anchor, with a hash of all their words."""
    def read(batches):
        for batch in slices(batches, "text"):
            rows, nth, anchors, content, at = windows_of(*texts_as_bytes(batch.column("text")))
            if not len(rows):
                continue
            cut = np.concatenate(([True], (rows[1:] != rows[:-1]) | (anchors[1:] != anchors[:-1])))
            first = np.flatnonzero(cut)
            n = np.diff(np.append(first, len(rows)))
            whose = pa.array(rows[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(whose), batch.column("mark").take(whose), _signed(anchors[first]),
                 *content(at[first], n + WINDOW - 1), pa.array(nth[first].astype(np.int32)), pa.array(n.astype(np.int32))],
                ["doc_id", "mark", *CONTENT, "first", "n"])

    return mapped(docs, read, _with(docs, WORD_BLOCKS))


def _with(docs: DataFrame, more: str):
    schema = docs.select("doc_id", "mark").schema
    for name, kind in (x.split() for x in more.split(", ")):
        schema = schema.add(name, kind)
    return schema


def _windows(docs: DataFrame) -> DataFrame:
    """One by one, the windows of the blocks named in ``open``."""
    def read(batches):
        for batch in slices(batches, "text"):
            rows, nth, anchors, content, at = windows_of(*texts_as_bytes(batch.column("text")))
            lists = batch.column("open")
            pairs, whose = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            n = pairs.field("n").to_numpy()
            # The first window of a text in this batch, plus the place of each wanted one.
            picked = np.repeat(np.searchsorted(rows, whose) + pairs.field("first").to_numpy(), n) + \
                np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if not len(picked):
                continue
            owner = pa.array(rows[picked])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(owner), batch.column("mark").take(owner), _signed(anchors[picked]),
                 *content(at[picked], WINDOW), pa.array(nth[picked].astype(np.int32)),
                 pa.array(np.ones(len(picked), np.int32))], ["doc_id", "mark", *CONTENT, "first", "n"])

    return mapped(docs, read, _with(docs, WORD_BLOCKS))


#: Some id is smaller than another one; null is larger than any other.
SHARED = "least < most OR (unnamed AND least IS NOT NULL)"


def _ids():
    return F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("unnamed")


def _by_content(runs: DataFrame, *more) -> DataFrame:
    """The runs with ``earlier``: whether a smaller id has the same words.

    Ids are added up with a combine before the shuffle, written and joined back:
    so adaptive execution can split the runs of a passage that very many
    documents share, which it cannot beside an aggregate.
    """
    least = stored(runs.groupBy(*CONTENT).agg(*_ids()).where(SHARED).select(*CONTENT, "least"))
    return runs.join(least, CONTENT, "left") \
        .select("doc_id", "mark", "first", "n", F.expr("coalesce(least < doc_id, least IS NOT NULL)").alias("earlier"), *more)


def _matched_blocks(blocks: DataFrame) -> DataFrame:
    """Of the blocks whose anchor more than one id has: ``earlier``, and ``open`` if their windows are to be matched one by one."""
    shared = blocks.groupBy("anchor").agg(*_ids(), F.min("block").alias("low"), F.max("block").alias("high"),
                                           F.min("more").alias("low2"), F.max("more").alias("high2")).where(SHARED)
    # Where all blocks of an anchor are equal there is nothing left to match.
    runs = stored(blocks.join(shared.select("anchor", ((F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2"))).alias("differ")), "anchor"))
    return _by_content(runs, "differ").withColumn("open", F.expr("differ AND NOT earlier")).drop("differ")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take out of every text the passages of ``WINDOW`` words or more that a text with a smaller id has too.

    Seeds: each window of 50 words is anchored at its gram of 12 words with the
    least hash, so a passage that repeats has the same anchors wherever it
    stands, one in about twenty words; only anchors that more than one id has
    go on.  Extension: the neighbouring windows that share an anchor form a
    block, which is matched as a whole first; a block that a smaller id has is
    done.  Where the blocks of an anchor differ, at the ends of what repeats,
    the windows of those that are not done are matched one by one.  So the maximal
    repeats come out exactly, and no two documents are ever paired, however many
    share a passage.  Contents are compared by 128-bit hashes of the 128-bit
    hashes of their words.

    A window is judged on the texts as they come.  Returns ``row`` (a struct of
    all columns but the text), ``text`` (kept words joined by one space),
    ``n_words`` and ``n_removed``.

    A null text stays null and has no words, like an empty one.  Rows with equal
    ids take nothing from each other.  A null id is larger than any other, and
    rows without an id take nothing from each other.  An empty table gives no
    rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    # The mark tells rows of the same id apart; rows equal in both have the same result.
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    blocks = stored(_matched_blocks(stored(_blocks(keyed))))
    pending = blocks.where("open").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "n")).alias("open")) \
        .select(F.col("doc_id").alias("open_id"), F.col("mark").alias("open_mark"), "open")
    mine = F.col("doc_id").eqNullSafe(F.col("open_id")) & (F.col("mark") == F.col("open_mark"))
    single = stored(_windows(keyed.join(pending, mine).select("doc_id", "mark", "text", "open")))
    found = blocks.where("earlier").drop("open").unionByName(_by_content(single).where("earlier")) \
        .groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "n")).alias("gone")) \
        .select(F.col("doc_id").alias("open_id"), F.col("mark").alias("open_mark"), "gone")
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    joined = rows.join(found, mine, "left").select("row", "text", "gone")

    def clean(batches):
        for batch in slices(batches, "text"):
            texts, total, removed = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                words = (text or b"").split()
                kept = words
                if gone:
                    change = np.zeros(len(words) + 1, np.int64)
                    first = np.array([g["first"] for g in gone])
                    np.add.at(change, first, 1)
                    np.add.at(change, first + [g["n"] + WINDOW - 1 for g in gone], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                texts.append(None if text is None else b" ".join(kept))
                total.append(len(words))
                removed.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
                 pa.array(removed, pa.int64())], ["row", "text", "n_words", "n_removed"])

    return mapped(joined, clean, rows.select("row", "text").schema.add("n_words", "long").add("n_removed", "long"))


def op2_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH cut AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
windows AS (SELECT doc_id, s, hash(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS h, md5_number_lower(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS m
    FROM cut, LATERAL unnest(range(1, len(w) - {WINDOW} + 2)) u(s)),
earlier AS (SELECT h, m, min(doc_id) AS least FROM windows GROUP BY h, m HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT doc_id, s FROM windows JOIN earlier USING (h, m) WHERE least < doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM cut, LATERAL unnest(range(1, len(w) + 1)) u(i)),
judged AS (SELECT w.doc_id, i, word, coalesce(i - max(s.s) OVER (PARTITION BY w.doc_id ORDER BY i) < {WINDOW}, false) AS gone
    FROM words w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.i = s.s),
digests AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT c.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut c LEFT JOIN digests d ON c.doc_id = d.doc_id"""
