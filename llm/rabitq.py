"""Approximate nearest neighbours with randomly rotated one-bit codes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import answers, blocks, classes, queries_of, usable

#: Bits of a code for each dimension of the vectors.
BITS = 8
#: Width of the error bounds in standard deviations.
SURE = 3.0
#: Codes and queries that meet in one task.
CODES, QUERIES = 16_384, 1024
#: Queries that are estimated at a time.
STEP = 128


@lru_cache(8)
def rotation(dimensions: int) -> np.ndarray:
    """Orthonormal columns in random directions, the same wherever they are made."""
    gauss = np.random.default_rng(dimensions).standard_normal((BITS * dimensions, dimensions))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the inner product of each unit vector with its code."""
    turned = vectors @ rotation(vectors.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def bounds(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the cosines of codes (rows) with unit queries (columns), and the half width of the bounds of each row."""
    turned = (queries @ rotation(queries.shape[1]).T).astype(np.float32)
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    estimate = (signs @ turned.T) / (np.sqrt(bits) * factors[:, None].astype(np.float32))
    spread = np.sqrt(np.maximum(1 - factors ** 2, 0)) / factors / np.sqrt(max(bits - 1, 1))
    return estimate, (SURE * spread).astype(np.float32)


def _codes(found: DataFrame) -> DataFrame:
    def read(batches):
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = batch.column("v").flatten().to_numpy(), np.cumsum(lengths)
            codes, factors = np.empty(batch.num_rows, object), np.zeros(batch.num_rows)
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                v = flat[(ends[own] - d)[:, None] + np.arange(d)]
                v = v / np.abs(v).max(1, keepdims=True)
                packed, factors[own] = encode(v / np.linalg.norm(v, axis=1, keepdims=True))
                codes[own] = [bytes(c) for c in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(factors)],
                                             [*batch.schema.names, "code", "factor"])

    return found.mapInArrow(read, found.select("*").schema.add("code", "binary").add("factor", "double"))


def _unit(rows) -> np.ndarray:
    v = np.stack(rows.to_list())
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def reranked(codes: np.ndarray, factors: np.ndarray, vectors: np.ndarray, queries: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and queries (their numbers) of which the rows are among the query's ``need`` best of this block.

    Only rows whose upper bound reaches the ``need``-th lower bound are scored
    with the vectors themselves.  Rows that are level with the last one, but for
    rounding, stay as well.
    """
    rows, whose = [], []
    for at in range(0, len(queries), STEP):
        estimate, reach = bounds(codes, factors, queries[at:at + STEP])
        low = estimate - reach[:, None]
        bar = np.partition(low, -need, axis=0)[-need] if len(codes) >= need else np.full(low.shape[1], -np.inf)
        maybe = (estimate + reach[:, None] >= bar).T
        for q, among in enumerate(maybe):
            place = np.flatnonzero(among)
            exact = vectors[place] @ queries[at + q]
            if len(place) > need:
                place = place[exact >= np.partition(exact, -need)[-need] - 1e-12]
            rows.append(place)
            whose.append(np.full(len(place), at + q))
    return np.concatenate(rows), np.concatenate(whose)


def _candidates(found: DataFrame, asked: DataFrame, need: int) -> DataFrame:
    """The pairs of query and row that may be among the ``need`` best: each block of queries meets each block of codes once."""
    codes, m = blocks(found.select(F.size("v").alias("d"), "rep", "code", "factor", "v"), "rep", CODES, "chunk")
    queries, n = blocks(asked.select(F.size("v").alias("d"), F.col("rep").alias("qrep"), F.col("v").alias("w")), "qrep", QUERIES, "block")
    left = codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def meet(c, q):
        if not len(c) or not len(q):
            return pd.DataFrame({"qrep": [], "rep": []})
        codes = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
        i, j = reranked(codes, c["factor"].to_numpy(), _unit(c["v"]), _unit(q["w"]), need)
        return pd.DataFrame({"qrep": q["qrep"].to_numpy()[j], "rep": c["rep"].to_numpy()[i]})

    return left.groupBy("d", "block", "chunk").cogroup(right.groupBy("d", "block", "chunk")).applyInPandas(meet, "qrep long, rep long")


def nearest(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by cosine to each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Every vector is turned by one random rotation (into a space of ``BITS``
    times its dimensions) and keeps the signs as packed bits, with the one
    scalar that corrects the estimate of an inner product made from them.
    Blocks of queries meet blocks of codes; each estimate has an error bound of
    ``SURE`` standard deviations, and only rows whose upper bound reaches the
    lower bounds of the best are reranked with the vectors themselves.  The best
    of each block are scored in double precision and put together, about k + 1
    rows for each query and block.  All codes are looked at; what is
    approximate is that a bound may be missed, with a chance of about one in
    seven hundred for a neighbour at the very edge of it.

    Rows of equal vectors are searched as one.  Rows that are null in id or
    vector, or hold a null, a NaN, an infinity or nothing but zeros, take no
    part; vectors are compared with those of their own length only.  All rows
    of a query's id are its own; an id with several vectors asks with the
    least of them.  Ties go to the smaller id.  An empty table gives no rows.
    """
    # Zero vectors point nowhere.
    vectors = usable(rows, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    found = stored(_codes(classes(vectors, "v", k)))
    queries = queries_of(vectors, "v", found, every)
    asked = found.join(queries.select("qrep").distinct(), F.col("rep") == F.col("qrep"), "left_semi")
    pairs = _candidates(found, asked, k + 1)
    root = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sides = found.select("rep", "v", root.alias("size"))
    scored = pairs.join(sides, "rep").join(sides.select(F.col("rep").alias("qrep"), F.col("v").alias("w"), F.col("size").alias("qsize")), "qrep") \
        .select("qrep", "rep", (F.aggregate(F.zip_with("w", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
                                / (F.col("qsize") * F.col("size"))).alias("score"))
    return answers(scored, found, queries, k)


def op5_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (q.size * c.size) AS score
    FROM sized q JOIN sized c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""
