"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymatch.session import checkpoint_folder

#: Whole texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

#: Bytes of an Arrow batch between JVM and Python, and the setting that holds them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder of ``spark.checkpoint.dir`` and go on from the written copy.

    Unlike a checkpoint of rows the copy is compressed and read by column.  The
    folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` for rows with texts: the session's Arrow batches are held to ``BATCH_BYTES``.

    By default a batch takes up to 64 MB, which JVM and Python each hold more than once for each task.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) in (None, "67108864b"):
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def in_training_part(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(True))


def _borders(column: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a column of texts or bytes in its data, which is not copied."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its values; a null has no bytes."""
    offsets = _borders(column)
    if column.null_count and np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
        column = column.fill_null("")
        offsets = _borders(column)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or a single row."""
    for batch in batches:
        ends, first = _borders(batch.column(text)), 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(ends, ends[first] + most, "right")) - 1, first + 1)
            yield batch.slice(first, last - first)
            first = last


def ranked(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into contiguous ranges of ``order`` and, for each range, what lies before it.

    The first frame has the columns of ``df`` plus ``part`` and ``tie``; it is
    stored, since the borders of ranges are sampled anew each time they are
    computed.  ``tie`` lets the ranges split rows that are equal in ``order``.
    """
    rows = stored(df.withColumn("tie", F.rand(11)).repartitionByRange(*order, "tie")
                  .withColumn("part", F.spark_partition_id()))
    return rows, Window.partitionBy("part").orderBy(*order, "tie")
