"""Contiguous shards of equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, table

#: Bytes counted for a row besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of ``shards`` contiguous ranges of the id order with near equal bytes.

    The rows (id, size and checksum only) are dealt into ranges of the id.  One
    total per range gives the global prefix sum at its start, a running sum
    inside the range gives it for each row, and a row that starts at byte p of
    ``total`` belongs to shard ``p * shards div total``.  So a shard's size
    differs from ``total / shards`` by less than its longest row.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law (``bytes``),
    shard, slot (gapless from 0 within a shard) and grown_shard (null).

    Null ids come first; rows with equal ids are ordered by checksum and size,
    and rows equal in these too in any order.  A null text has no bytes and a
    null checksum, an empty text has checksum 0.  An empty table gives no rows;
    where there are fewer rows than shards some shards stay empty.  Columns
    other than the id and the text are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.col(text_col)
    rows, run = ranked(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")), "doc_id", "text_crc32", "size")
    # One row for each range: bounded by the number of partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(upto)).withColumn("nth", F.row_number().over(run)) \
        .join(F.broadcast(starts), "part") \
        .select("doc_id", "size", "text_crc32",
                F.expr(f"CAST((bytes_before + upto - size) * {shards} DIV total AS int)").alias("shard"),
                (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))


#: The checksum is taken byte by byte with a 256-entry table that is made from its polynomial.
OP10_SQL = """
WITH RECURSIVE steps(n, c, k) AS (
    SELECT n, n, 0 FROM range(256) r(n)
    UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
lookup AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
hexed AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents),
bytes AS (SELECT doc_id, text, list_transform(range(0, length(h) // 2),
        lambda i: ascii(h[2*i+1]) * 16 + ascii(h[2*i+2])
            - CASE WHEN h[2*i+1] > '9' THEN 55 ELSE 48 END * 16 - CASE WHEN h[2*i+2] > '9' THEN 55 ELSE 48 END) AS b FROM hexed),
sized AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size,
        CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::bigint, b::bigint[]),
            lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) END AS text_crc32
    FROM bytes, lookup),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - size AS p, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, (p * 24 // total)::int AS shard FROM summed)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'bytes' AS law, shard,
    (row_number() OVER (PARTITION BY shard ORDER BY p) - 1)::bigint AS slot, NULL::int AS grown_shard
FROM cut"""
