"""Exact top-k inner products by the threshold algorithm over sorted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import answers, blocks, classes, queries_of, usable

#: Components become floor(SCALE * x).
SCALE = 256
#: Vectors in a shard with lists of its own, and queries that are answered on it in one task.
VECTORS, QUERIES = 16_384, 1024
#: Entries read from every list before the first look at the bound.
DEPTH = 64


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id, in that order."""
    place = np.arange(len(scores))
    if len(scores) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def exact_floats(vectors: np.ndarray, queries: np.ndarray) -> bool:
    """Whether all sums of products are whole numbers that doubles hold exactly."""
    size = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (vectors, queries)]
    return size[0] * size[1] * max(1, vectors.shape[1]) < 1 << 53


def threshold_search(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the ``k`` best rows of a shard, ties to the smaller id; no list is read much deeper than needed.

    ``lists`` has the row numbers in ascending order of each component.  For a
    positive component of the query its list is read from the end, for a
    negative one from the start.  Rows seen for the first time in any list are
    scored whole.  What is still unseen scores at most the inner product of the
    query with the components last read; once that is below the k-th score,
    nothing can change.  The bound is looked at after ever twice as many entries.
    """
    used = np.flatnonzero(query)
    n = len(vectors)
    if not len(used):
        best = _best(ids, np.zeros(n, vectors.dtype), k)
        return best, np.zeros(len(best), np.int64)
    down = query[used] > 0
    seen, rows, scores, at, depth = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, vectors.dtype), 0, DEPTH
    while at < n:
        to = min(at + depth, n)
        before = seen.copy()
        seen[lists[used[down], n - to:n - at].ravel()] = True
        seen[lists[used[~down], at:to].ravel()] = True
        new = np.flatnonzero(seen & ~before)
        found = (vectors @ query)[new] if 2 * len(new) > n else vectors[new] @ query
        rows, scores = np.append(rows, new), np.append(scores, found)
        best = _best(ids[rows], scores, k)
        rows, scores = rows[best], scores[best]
        last = np.where(down, lists[used, n - to], lists[used, to - 1])
        if seen.all() or len(rows) == k and vectors[last, used] @ query[used] < scores[-1]:
            break
        at, depth = to, 2 * depth
    return rows, scores.astype(np.int64)


def top_products(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest inner products with each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Components are made whole numbers, floor(256 x), and all arithmetic is on
    those, so scores and the algorithm's bound are exact.  Vectors are dealt
    into shards; each shard sorts its vectors once for each dimension, and the
    threshold algorithm answers a block of queries on it.  The best of each
    shard are put together, k + 1 rows for each query and shard.

    Rows of equal whole vectors are searched as one.  Rows that are null in id
    or vector, or hold a null, a NaN or an infinity, take no part; zero and
    empty vectors do.  Vectors are compared with those of their own length
    only.  Components are expected below 2^28 or so: scores are longs.  All rows
    of a query's id are its own; an id with several vectors asks with the least
    of them.  Ties go to the smaller id.  An empty table gives no rows.
    """
    whole = usable(rows, id_col, vector_col).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))
    found = stored(classes(whole, "v", k))
    queries = queries_of(whole, "v", found, every)
    asked = found.join(queries.select("qrep").distinct(), F.col("rep") == F.col("qrep"), "left_semi")
    sides, m = blocks(found.select(F.size("v").alias("d"), "rep", F.col("ids")[0].alias("first"), "v"), "rep", VECTORS, "shard")
    asking, n = blocks(asked.select(F.size("v").alias("d"), F.col("rep").alias("qrep"), F.col("v").alias("w")), "qrep", QUERIES, "block")
    left = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    need = k + 1

    def search(shard, block):
        if not len(shard) or not len(block):
            return pd.DataFrame({"qrep": [], "rep": [], "score": []})
        vectors, ids, reps = np.stack(shard["v"].to_list()).astype(np.int64), shard["first"].to_numpy(), shard["rep"].to_numpy()
        asked = np.stack(block["w"].to_list()).astype(np.int64)
        lists = np.argsort(vectors, axis=0, kind="stable").T.copy()
        if exact_floats(vectors, asked):
            vectors, asked = vectors.astype(np.float64), asked.astype(np.float64)
        found = [threshold_search(vectors, ids, lists, q, need) for q in asked]
        counts = [len(rows) for rows, _ in found]
        return pd.DataFrame({"qrep": np.repeat(block["qrep"].to_numpy(), counts), "rep": reps[np.concatenate([r for r, _ in found])],
                             "score": np.concatenate([x for _, x in found])})

    scored = left.groupBy("d", "shard", "block").cogroup(right.groupBy("d", "shard", "block")) \
        .applyInPandas(search, "qrep long, rep long, score long")
    return answers(scored, found, queries, k)


def op9_topk(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)::bigint) AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""
