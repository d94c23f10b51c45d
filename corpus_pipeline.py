"""Clean, deduplicate, mix and tokenise ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table
from llm.lines import dedup_lines
from llm.mixing import mix
from llm.sentencepiece import round_trip
from llm.simhash import near_copies
from llm.toxicity import score, trained
from waymatch.session import checkpoint_folder

#: A document with at least this score is rejected.
TOXIC = 0.5
#: Stands for a null id among keys.
NO_ID = -1 << 63


def _as_documents(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents in their order, from ``row``; a text that was changed and its length come from ``text``."""
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")} if "text" in rows.columns else {}
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in like.columns])


def _in_file_order(docs: DataFrame) -> DataFrame:
    """Rows by file name and place in the file, as Spark reads large files first; rows that are not read from files as they come."""
    place = ["place.file_name", "place.row_index"]
    try:
        placed = docs.select(F.struct("*").alias("row"), F.col("_metadata").alias("place"))
    except AnalysisException:
        return docs
    return placed.repartitionByRange(*place).sortWithinPartitions(*place).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic.  Labels are learned from those that may be learned from."""
    kept = score(docs, trained(spark, docs, sf_dir)).where(F.col("score") < TOXIC)
    return _as_documents(kept, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that three or more documents hold, but for one place each."""
    return _as_documents(dedup_lines(docs), docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Of rows that share that id, and in a group without any id, the one whose
    text has the smallest hash stays, and of rows equal in both any one.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    # No id stands for itself here, so that keys are plain ones; the hash then still tells its text from others.
    kept = near_copies(docs).groupBy("component").agg(least.alias("kept")).select(
        F.coalesce("kept.doc_id", F.lit(NO_ID)).alias("kept_id"), F.col("kept.mark").alias("kept_mark")).distinct()
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("kept_id"), F.xxhash64("text").alias("kept_mark"),
                       F.struct("*").alias("row"))
    return _as_documents(rows.join(kept, ["kept_id", "kept_mark"], "left_semi").dropDuplicates(["kept_id", "kept_mark"]), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in a stream that keeps to the weights of the sources: those of small sources come more than once.

    The stream's order is that of the written files by name and of the rows in them.
    """
    return _as_documents(mix(docs).repartitionByRange("position").sortWithinPartitions("position"), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text, and the text they decode to, in the order of the files that are read."""
    return round_trip(_in_file_order(docs))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("simhash near dedup", simhash), ("mixing", mixing),
          ("sentencepiece", sentencepiece)]

#: SQL has neither the hashes of the fingerprints nor the models of the first and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; what lies between them is written to the shared folder."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
