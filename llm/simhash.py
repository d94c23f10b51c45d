"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, stored, table
from .components import components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
#: Two segments of 32 bits: of two differing bits, one segment has at most one.
SEGMENTS, SEGMENT_BITS = 2, 32
#: Different fingerprints that share a signature up to which their pairs are compared.  Larger buckets go another way.
BUCKET = 32
#: Shingles hashed at a time.
RUN = 1 << 15


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of the hashes of all shingles, as a signed integer; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle_words, len(words))
    firsts = [0, *(ends[:len(words) - k] + 1).tolist()]
    lasts = ends[k - 1:].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(lasts), RUN):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED)
                           for a, b in zip(firsts[at:at + RUN], lasts[at:at + RUN], strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(lasts)).view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text) and ``fp`` of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"),
                       F.col(text_col).cast("binary").alias("text"))

    def hashed(batches):
        for batch in slices(batches, "text"):
            found = [fingerprint(x, shingle_words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(found, pa.int64())],
                                             ["doc_id", "mark", "fp"])

    return mapped(docs, hashed, docs.select("doc_id", "mark").schema.add("fp", "long"))


def links(fps: DataFrame) -> DataFrame:
    """Enough links (``a``, ``b``) between different values of ``fp`` at two or fewer differing bits to connect all of them.

    Each fingerprint has 64 signatures: a segment with one of its bits left
    out, and which bit that is.  Fingerprints within two bits share one.  In a
    bucket of up to ``BUCKET`` fingerprints each pair is verified.  The members
    of larger buckets (a large group of near copies) are not compared with each
    other: two fingerprints are within two bits just if some value is within
    one bit of both, so each is listed under itself and its 64 neighbours, and
    all those under one value, at most 65, are linked to the least of them.
    That takes 65 rows for each such fingerprint however large the group.
    """
    # Signatures are 64 times as many as fingerprints: made in as many tasks as a shuffle has, however small their input.  Dealt
    # without a key, since by one Spark would find the rows dealt already and put their small partitions together.
    fps = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = fps.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).select("fp", F.expr(
        "shiftleft(CAST(bit AS bigint), 32) | (shiftrightunsigned(fp, bit - bit % 32) & 4294967295 & ~shiftleft(1L, bit % 32))")
        .alias("signature"))
    shared = stored(signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                    .where("n > 1"))
    # What is shared grows with the table, so it is not to be broadcast even where it happens to be small.
    members = signed.join(shared.where("n > 2").select("signature", "n").hint("merge"), "signature")
    within = f"bit_count({{0}} ^ {{1}}) <= {MAX_BITS}"
    twos = shared.where("n = 2").where(within.format("a", "b")).select("a", "b")
    some = members.where(f"n <= {BUCKET}").groupBy("signature").agg(F.collect_list("fp").alias("m")) \
        .select(F.explode(F.expr(
            "flatten(transform(m, x -> transform(filter(m, y -> x < y AND " + within.format("x", "y") +
            "), y -> named_struct('a', x, 'b', y))))")).alias("p")).select("p.a", "p.b")
    crowd = members.where(f"n > {BUCKET}").select("fp").distinct()
    many = crowd.withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(63)))) \
        .groupBy(F.expr("IF(bit < 0, fp, fp ^ shiftleft(1L, greatest(bit, 0)))").alias("near")).agg(F.collect_list("fp").alias("m")) \
        .where("size(m) > 1").select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return twos.union(some).union(many).distinct()


def near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near copies of every row: ``doc_id``, ``mark``, ``fp``, ``component`` and ``component_id``.

    Two rows are linked if their fingerprints differ in two bits or fewer;
    ``component_id`` is the smallest id reachable over links and ``component``
    the smallest fingerprint; ``mark`` is a hash of the text that tells rows of
    one id apart.  Rows of equal fingerprint are one node, so copies are never
    expanded into pairs.

    A null text, an empty one and one of white space have fingerprint zero and
    are linked like any other; texts shorter than a shingle are hashed whole.
    Rows with equal ids are judged each by its text.  A null id is never the
    smallest: a class that has no other has a null ``component_id``.  An empty
    table gives no rows.  Other columns are not looked at.
    """
    rows = stored(fingerprints(docs, shingle_words, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(rows), "a", "b")
    classed = nodes.join(linked, nodes["fp"] == linked["node"], "left") \
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(classed.join(ids, "component").select("fp", "component", "component_id"), "fp") \
        .select("doc_id", "mark", "fp", "component", "component_id")


def op4_simhash(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
