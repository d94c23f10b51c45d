"""CSV in and out."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymatch import config as C
from waymatch.config import HELPERS
from waymatch.operators.assemble import public_columns
from waymatch.session import quoted

# Quotes inside a value are doubled, and blanks around a value are part of it.
_DIALECT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False}


def read_survey(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with a header; every column stays text.

    ``multi_line`` allows line breaks inside quoted values, but then a file
    can no longer be split between tasks.
    """
    return spark.read.options(**_DIALECT, multiLine=multi_line).csv(path, inferSchema=False)


# Holds the text of a row that does not fit the header.
DAMAGED = "_damaged_row"


def read_checked(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``read_survey`` with one more column, ``DAMAGED``: the whole text of rows with too many or too few fields, else null.

    The header of the first file gives the columns.  All columns are parsed, as
    a row could not be judged otherwise.
    """
    names = read_survey(spark, path, multi_line).columns
    if DAMAGED in names:
        raise ValueError(f"the column name {DAMAGED} is reserved")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, DAMAGED]])
    return spark.read.options(**_DIALECT, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=DAMAGED,
                              columnPruning=False).schema(schema).csv(path)


def _damaged(checked: DataFrame) -> Column:
    """The text of a damaged row.  Spark refuses to read that column alone, so another one takes part with nothing."""
    return F.concat(DAMAGED, F.substring(F.coalesce(F.col(quoted(checked.columns[0])), F.lit("")), 1, 0))


def kept_rows(checked: DataFrame) -> DataFrame:
    """The rows that fit the header."""
    return checked.where(_damaged(checked).isNull()).drop(DAMAGED)


def rejects(checked: DataFrame) -> DataFrame:
    """The text of each row that does not fit the header, and the file it is in."""
    return checked.select(F.input_file_name().alias("file"), _damaged(checked).alias("row")).where(F.col("row").isNotNull())


def preview(df: DataFrame, rows: int = C.PREVIEW_ROWS) -> DataFrame:
    """The first rows of a source, for a look at it."""
    return df.limit(rows)


def supp_catalogue(prepared: DataFrame) -> list[str]:
    """Columns of a prepared supplement a caller may ask for (no job runs)."""
    return [c for c in public_columns(prepared) if c not in HELPERS]


def file_version(path: str) -> str:
    hit = re.search(C.VERSION_PATTERN, path)
    return hit.group(1) if hit else "unknown"


def output_path(base_path: str, supp_path: str, output_dir: str | None = None) -> str:
    name = C.OUTPUT_NAME.format(version=file_version(supp_path))
    folder = output_dir or os.path.join(os.path.dirname(base_path), C.OUTPUT_SUBFOLDER)
    return os.path.join(folder, name)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, for values a CSV file cannot hold otherwise."""
    return df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in df.columns])


def _plain(df: DataFrame) -> bool:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return not any(isinstance(f.dataType, nested) for f in df.schema.fields)


def write_merged(result: DataFrame, path: str) -> str:
    """Write a folder of CSV part files with headers, replacing what is there."""
    out = result if _plain(result) else as_text(result)
    out.write.mode("overwrite").options(**_DIALECT).csv(path)
    return path
