"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def quoted(name: str):
    """A column name made safe for expressions (dots, spaces, back-ticks)."""
    return "`" + name.replace("`", "``") + "`"


def all_of(tests) -> Column:
    """Conjunction of conditions; true if there are none."""
    return reduce(and_, tests) if tests else F.lit(True)


def case_sensitive(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="waymatch-checkpoint-")
            _removed_at_exit(spark, folder)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _removed_at_exit(spark: SparkSession, folder: str) -> None:
    """Folders of intermediate tables go when the JVM of the session ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from the copy.

    Later reads take only the columns they need.  The copy's columns are
    numbered, so any names will do, and columns without a type come back.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    empty = [f.name for f in plain.schema if isinstance(f.dataType, NullType)]
    typed = plain.drop(*empty)
    typed.write.parquet(folder)
    _removed_at_exit(spark, folder)
    back = spark.read.schema(typed.schema).parquet(folder)
    return back.withColumns({c: F.lit(None) for c in empty}).select(*plain.columns).toDF(*df.columns)


def saved_both(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``saved`` for two frames at a time: neither has to wait for the other."""
    with ThreadPoolExecutor(2) as pool:
        second = pool.submit(inheritable_thread_target(one.sparkSession)(saved), other)
        return saved(one), second.result()


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows written down in order, and numbered from 0 without gaps.

    Each part numbers its rows by itself; what lies before it comes from the
    parts' counts, one row each.
    """
    rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    before = Window.orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("in_part")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first")).select(
        "in_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(starts), part == F.col("in_part")).select(
        *[F.col(quoted(c)) for c in rows.columns if c != name], (F.col(name) + F.col("shift")).alias(name))
