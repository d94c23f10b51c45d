"""What the two vector searches share: taking rows in, and results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows with an id and a vector of finite components only."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite) \
        .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def classes(vectors: DataFrame, value: str, k: int) -> DataFrame:
    """One row for each different ``value``: a number ``rep``, to be stored, and the smallest k + 1 ids with it.

    More than k + 1 rows with the same vector never get into one answer.  The
    rows are limited where they are read, before the shuffle, so a vector that
    very many rows hold is no heavier than others.
    """
    least = Window.partitionBy(value).orderBy("vec_id")
    return vectors.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1).groupBy(value) \
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.monotonically_increasing_id())


def queries_of(vectors: DataFrame, value: str, found: DataFrame, every: int) -> DataFrame:
    """``query_id`` and the class ``qrep`` of each id that is divisible by ``every``; an id with several vectors has its least."""
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(value).alias(value))
    return stored(asked.join(found.select(value, "rep"), value).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("qrep")))


def blocks(df: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Deal rows by a hash of ``key`` into blocks of about ``size``."""
    count = max(1, -(-df.count() // size))
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(count)).cast("int")), count


def answers(scored: DataFrame, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """From scores between classes (``qrep``, ``rep``, ``score``) the ``k`` best other rows of every query; ties to the smaller id."""
    by_class = Window.partitionBy("qrep").orderBy(F.desc("score"), F.col("ids")[0])
    best = scored.join(found.select("rep", "ids"), "rep").withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1)
    rows = best.select("qrep", "score", F.explode("ids").alias("vec_id"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.join(queries, "qrep").where(F.col("vec_id") != F.col("query_id")) \
        .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
