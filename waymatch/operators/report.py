"""Summary figures, each from one pass over its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymatch.session import quoted


def report_columns(result: DataFrame) -> list[Column]:
    """Aggregates of a merge result.  A matched row has a chainage difference."""
    matched = F.count("chainage_diff_meters")
    rows = F.count(F.lit(1))
    rate = F.when(rows > 0, matched * 100.0 / rows)
    columns = [rows.alias("base_rows"), matched.alias("matched_rows"), rate.alias("match_rate_pct")]
    for name, short in (("time_diff_seconds", "time_diff_s"), ("chainage_diff_meters", "chainage_diff_m")):
        if name in result.columns:
            value = F.col(name)
        else:
            value = F.lit(None).cast("double")
        columns += [F.min(value).alias(f"min_{short}"), F.avg(value).alias(f"avg_{short}"),
                    F.max(value).alias(f"max_{short}")]
    return columns


def match_report(result: DataFrame) -> DataFrame:
    """One row: rows, matched rows, match rate, and both differences."""
    return result.agg(*report_columns(result))


def null_counts(result: DataFrame) -> DataFrame:
    """One row per column of the result: its name and how many nulls it has."""
    names = result.columns
    counts = result.agg(*[F.count_if(F.col(quoted(n)).isNull()).alias(f"n{i}")
                          for i, n in enumerate(names)])
    entries = [F.struct(F.lit(n).alias("column_name"), F.col(f"n{i}").alias("nulls"))
               for i, n in enumerate(names)]
    return counts.select(F.inline(F.array(*entries)))


def coverage(base: DataFrame, supp: DataFrame) -> DataFrame:
    """One row per prepared side: rows, and rows that carry a coordinate."""
    def side(df, name):
        return df.agg(
            F.count(F.lit(1)).alias("rows"), F.count("_m_lat").alias("with_lat"),
            F.count("_m_lon").alias("with_lon"),
        ).select(F.lit(name).alias("side"), "*")
    return side(base, "base").unionByName(side(supp, "supplement"))
