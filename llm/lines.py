"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cuckoo
from .common import mapped, slices, stored, table

#: Characters of a key and documents that hold it, from which it counts as repeated.
MIN_CHARS, MIN_DOCS = 20, 3
#: Repeated keys in one shard's filter, about.
SHARD_KEYS = 1 << 18
#: References of one shard that are looked up in its filter together.
LOOKED_UP = 1 << 19

WHITE = b" \t\n\x0b\x0c\r"
KEY = "hi long, lo long"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # of bytes: A-Z alone


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars)


def _hashed(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype(np.int64).reshape(-1, 2)


def _references(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each row of ``docs`` and each different key in it."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def read(batches):
        for batch in slices(batches, "text"):
            keys, rows = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    own = {k for k in map(line_key, text.split(b"\n")) if _counts(k, min_chars)}
                    keys += own
                    rows += [at] * len(own)
            if keys:
                pairs = _hashed(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column("doc_id").take(pa.array(rows))],
                    ["hi", "lo", "doc_id"])

    return mapped(docs, read, f"{KEY}, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


@dataclass(frozen=True)
class LineIndex:
    """Which lines the documents of a collection hold, and how many documents hold each.

    ``refs`` has a row for each document and key, ``counts`` the exact number of
    documents of each key and the largest id among them.  ``filters`` has for
    each shard of the keys a cuckoo filter of those that ``min_docs`` documents
    or more hold.  Inserting documents adds to the counts and puts keys that
    have become repeated into their filter; deleting documents takes both back,
    so the index is the same as if they had never been there.  A filter may
    take a key for repeated that is not; the counts decide.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index of a first lot of documents; without ``shards`` their number follows from the number of repeated keys."""
        refs = stored(_references(docs, id_col, text_col, min_chars))
        counts = stored(refs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")))
        if shards is None:
            shards = 16 + counts.where(F.col("n") >= min_docs).count() // SHARD_KEYS
        index = cls(refs, counts, docs.sparkSession.createDataFrame([], "shard int, cells binary"), shards, min_chars, min_docs)
        return index._refiltered(counts.where(F.col("n") >= min_docs).select("hi", F.lit(1).alias("turn")))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        new = stored(_references(docs, id_col, text_col, self.min_chars))
        more = new.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("keep2"))
        merged = stored(self.counts.join(more, ["hi", "lo"], "full").select(
            "hi", "lo", F.coalesce("n", F.lit(0)).alias("was"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("keep", "keep2").alias("keep")))
        return replace(self, refs=self.refs.unionByName(new), counts=merged.drop("was"))._refiltered(self._turns(merged))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents whose ids are in ``ids`` (all rows of each id; null is an id like any other)."""
        ids = ids.select(F.col(id_col).alias("gone")).distinct()
        gone = F.col("doc_id").eqNullSafe(F.col("gone"))
        refs = stored(self.refs.join(ids, gone, "left_anti"))
        touched = self.refs.join(ids, gone, "left_semi").select("hi", "lo").distinct()
        after = refs.join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo") \
            .agg(F.count(F.lit(1)).alias("n2"), F.max("doc_id").alias("keep2"))
        merged = stored(self.counts.join(touched.withColumn("touched", F.lit(True)), ["hi", "lo"], "left")
                        .join(after, ["hi", "lo"], "left").select(
            "hi", "lo", F.col("n").alias("was"),
            F.when(F.col("touched"), F.coalesce("n2", F.lit(0))).otherwise(F.col("n")).alias("n"),
            F.when(F.col("touched"), F.col("keep2")).otherwise(F.col("keep")).alias("keep")))
        return replace(self, refs=refs, counts=merged.where("n > 0").drop("was"))._refiltered(self._turns(merged))

    def _turns(self, merged: DataFrame) -> DataFrame:
        """Repeated keys, now (1: newly so, 0: as before) or no longer (-1)."""
        was, now = F.col("was") >= self.min_docs, F.col("n") >= self.min_docs
        return merged.where(was | now).select("hi", F.when(was & now, 0).when(now, 1).otherwise(-1).alias("turn"))

    def _refiltered(self, turns: DataFrame) -> LineIndex:
        """Bring each shard's filter up to date; a group has only different keys, so a frequent line weighs no more than any other."""
        def update(changes, old):
            turn, keys = changes["turn"].to_numpy(), changes["hi"].to_numpy()
            cells = cuckoo.unpacked(old["cells"].iloc[0]) if len(old) else None
            if cells is not None:
                cuckoo.delete(cells, keys[turn < 0])
            if cells is None or not cuckoo.insert(cells, keys[turn > 0]):
                cells = cuckoo.made(keys[turn >= 0])
            shard = changes["shard"].iloc[0] if len(changes) else old["shard"].iloc[0]
            return changes.head(0)[["shard"]].reindex([0]).assign(shard=shard, cells=cuckoo.packed(cells))

        turns = turns.withColumn("shard", F.expr(f"CAST(pmod(hi, {self.shards}) AS int)"))
        return replace(self, filters=stored(turns.groupBy("shard").cogroup(self.filters.groupBy("shard"))
                                            .applyInPandas(update, "shard int, cells binary")))

    def _maybe_repeated(self, refs: DataFrame) -> DataFrame:
        """Without the references whose key the filter of its shard has not.

        References meet the one filter of their shard, those of a large shard
        (by its exact counts, so with the references of a very frequent line) in
        as many lots as it takes, each with a copy of the filter.
        """
        shard = F.expr(f"CAST(pmod(hi, {self.shards}) AS int)").alias("shard")
        # One row for each shard.
        lots = F.broadcast(self.counts.groupBy(shard).agg((F.sum("n") / LOOKED_UP + 1).cast("int").alias("lots")))
        left = refs.select("*", shard).join(lots, "shard").withColumn("lot", F.pmod(F.xxhash64("doc_id", "lo"), "lots").cast("int"))
        right = self.filters.join(lots, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "cells")
        schema = refs.schema

        def look(rows, filters):
            if not filters.num_rows or not rows.num_rows:
                return rows.select(names).slice(0, 0)
            cells = cuckoo.unpacked(filters.column("cells")[0].as_py())
            return rows.select(names).filter(pa.array(cuckoo.holds(cells, rows.column("hi").to_numpy())))

        names = refs.columns
        return left.drop("lots").groupBy("shard", "lot").cogroup(right.groupBy("shard", "lot")).applyInArrow(look, schema)

    def dropped(self) -> DataFrame:
        """For each document that loses lines, their keys: repeated ones, but not in the document of the largest id."""
        repeated = self.counts.where(F.col("n") >= self.min_docs).select("hi", "lo", "keep")
        return self._maybe_repeated(self.refs).join(repeated, ["hi", "lo"]) \
            .where(~F.col("doc_id").eqNullSafe(F.col("keep"))) \
            .groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text",
                **settings) -> DataFrame:
    """Take out of every text the lines that many documents hold, but for the document with the largest id.

    A line's key is the line without ASCII white space at its ends and with
    A-Z in lower case; keys are compared by a 128-bit hash.  Keys of at least
    ``min_chars`` code points that ``min_docs`` rows or more hold (a row counts
    once for a key, however often it has it) lose all their lines except in
    the largest id.  ``index`` is the index of the collection that ``docs``
    belongs to; without one it is made from ``docs`` with ``settings``.

    Returns ``row`` (a struct of all columns but the text), ``text`` without
    the lines dropped, ``n_lines`` before dropping and ``n_dropped``.

    A null text stays null and counts as one empty line, as an empty text does.
    Rows are counted as documents even where ids repeat (in the SQL too); all
    rows of the largest id keep the line.  A null id is smaller than any other, so where only rows
    without an id hold a key it is kept in all of them.  An empty table gives
    no rows.
    """
    index = index or LineIndex.of(docs, id_col=id_col, text_col=text_col, **settings)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    gone = index.dropped()
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")), "left").select("row", "text", "keys")

    def clean(batches):
        for batch in slices(batches, "text"):
            texts, before, lost = [], [], []
            for text, keys in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("keys").to_pylist(),
                                  strict=True):
                n = text.count(b"\n") + 1 if text else 1
                if keys and text:
                    drop = {(k["hi"], k["lo"]) for k in keys}
                    lines = text.split(b"\n")
                    hashes = map(tuple, _hashed([line_key(x) for x in lines]).tolist())
                    kept = [x for x, h in zip(lines, hashes, strict=True) if h not in drop]
                    lost.append(n - len(kept))
                    text = b"\n".join(kept)
                else:
                    lost.append(0)
                texts.append(text)
                before.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()),
                 pa.array(lost, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    return mapped(joined, clean, rows.select("row", "text").schema.add("n_lines", "long").add("n_dropped", "long"))


def op6_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP6_SQL = f"""
WITH docs AS (SELECT *, row_number() OVER () AS d FROM documents),
lines AS (SELECT d, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM docs),
keyed AS (SELECT *, translate(trim(line, {WHITE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= {MIN_CHARS}
    GROUP BY key HAVING count(DISTINCT d) >= {MIN_DOCS}),
judged AS (SELECT k.*, keep IS NOT NULL AND k.doc_id IS DISTINCT FROM keep AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY d, doc_id"""
