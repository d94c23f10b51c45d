"""The merge as a DataFrame, and as a job from files to files."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from waymatch import config as C
from waymatch.config import MatchConfig
from waymatch.operators.assemble import assemble
from waymatch.operators.prepare import prepare_base, prepare_supp
from waymatch.operators.report import report_columns
from waymatch.operators.rules import both_timed, check_columns, rules_for
from waymatch.operators.search import find_best
from waymatch.plans.strategy import choose_strategy
from waymatch.session import numbered, quoted, saved
from waymatch.sources.csv import DAMAGED, kept_rows, output_path, read_checked, write_merged

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class MergeSummary:
    """What a job did.  ``counts`` has the rows read, kept after cleaning, and matched, ``rejected`` those that were damaged, ``nulls``
    the nulls of each column of the output."""

    path: str
    strategy: str
    report: dict
    counts: dict
    nulls: dict
    rejected: dict


def merge(base_df: DataFrame, supp_df: DataFrame, cfg: MatchConfig = MatchConfig(),
          sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every base row once, with the chosen columns of its best match or nulls.

    Calling it runs Spark jobs: each side is cleaned and written down, buckets
    are counted, and crowded ones searched.  The last joins run with the result.
    ``sides`` are both tables as ``prepare_sides`` returns them, for several merges
    of the same tables that differ in their limits only.
    """
    base, supp = sides or prepare_sides(base_df, supp_df, cfg)
    rules = _rules(base, supp, cfg, choose_strategy(base, supp, cfg))
    return assemble(base, supp, find_best(base, supp, rules, cfg), rules, cfg)


def prepare_sides(base_df: DataFrame, supp_df: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides cleaned, in one read of each; of the supplement only the columns that may be used."""
    used = {*cfg.requested_columns, "road_id", "region_id", C.START_KM, C.END_KM, C.RANGE_LANES, C.TIME_COLUMN}

    def base():
        return prepare_base(base_df, cfg.base_key, cfg.base_map, lambda df: _stored(df, cfg.base_key, df.columns))

    def supp():
        return prepare_supp(supp_df, cfg.supp_key, cfg.supp_map, lambda df: _stored(
            df, cfg.supp_key, [c for c in df.columns if c.startswith("_m_") or c in used], plain=True))

    with ThreadPoolExecutor(2) as pool:
        other = pool.submit(inheritable_thread_target(base_df.sparkSession)(supp))
        return base(), other.result()


def _stored(df: DataFrame, key: str | None, columns: list[str], plain: bool = False) -> DataFrame:
    """The columns wanted, written down, with ``_m_id`` made unique; ``plain`` makes it one number.

    A key gives the order, numbers first, and a generated number tells equal ones
    apart.  Without one the line in the files does, by file name: what a split
    holds before a row plus what all splits before it hold.
    """
    columns = [F.col(quoted(c)) for c in columns if c not in ("_m_id", "_m_place")]
    if key:
        number = F.struct(F.col("_m_id").isNull().alias("last"), F.col("_m_id").alias("number"),
                          F.col(quoted(key)).cast("string").alias("text"), F.col("_m_place.at").alias("row"))
        rows = saved(df.select(*columns, number.alias("_m_id")))
        # The search compares and joins ids of the supplement all the time.
        return numbered(rows.withColumnRenamed("_m_id", "_m_order"), ["_m_order"], "_m_id").drop("_m_order") if plain else rows
    rows = saved(df.select(*columns, "_m_place.*"))
    before = Window.orderBy("in_file", "in_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(F.col("file").alias("in_file"), F.col("split").alias("in_split")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select(
        "in_file", "in_split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(splits, (F.col("file") == F.col("in_file")) & (F.col("split") == F.col("in_split"))) \
        .select(*columns, (F.col("at") + F.col("shift")).alias("_m_id"))


def _rules(base, supp, cfg, strategy):
    rules = rules_for(strategy, cfg, both_timed(base, supp))
    check_columns(base, supp, rules)
    return rules


def run_merge_job(spark: SparkSession, base_path: str, supp_path: str,
                  output_dir: str | None = None, cfg: MatchConfig = MatchConfig()) -> MergeSummary | None:
    """Read two CSV sources, write the merged CSV in base order.

    Rows with too many or too few fields are rejected and counted, see
    ``read_checked``.  Nothing is written and ``None`` returned when no base row
    has a match.  Report, null counts and row counts are gathered by the write
    itself and by the cleaning, without another pass.
    """
    read = Observation("base"), Observation("supplement")
    damaged = F.count_if(F.col(quoted(DAMAGED)).isNotNull()).alias("rejected")
    base, supp = prepare_sides(*[kept_rows(read_checked(spark, path).observe(seen, F.count(F.lit(1)).alias("rows"), damaged))
                                 for path, seen in zip((base_path, supp_path), read, strict=True)], cfg)
    strategy = choose_strategy(base, supp, cfg)
    rules = _rules(base, supp, cfg, strategy)
    best = saved(find_best(base, supp, rules, cfg))
    if best.isEmpty():
        log.warning("no matches, nothing written")
        return None
    result = assemble(base, supp, best, rules, replace(cfg), keep_id=True)
    result = result.orderBy("_m_id").drop("_m_id")
    seen = Observation("merge")
    nulls = [F.count_if(F.col(quoted(c)).isNull()).alias(f"nulls {i}") for i, c in enumerate(result.columns)]
    path = write_merged(
        result.observe(seen, *report_columns(result), *nulls),
        output_path(base_path, supp_path, output_dir))
    report = dict(seen.get)
    nulls = {c: report.pop(f"nulls {i}") for i, c in enumerate(result.columns)}
    counts = {"base_read": read[0].get["rows"], "base_kept": report["base_rows"], "supp_read": read[1].get["rows"],
              "supp_kept": supp.count(), "matched": report["matched_rows"]}
    rejected = {side: seen.get["rejected"] for side, seen in zip(("base", "supp"), read, strict=True)}
    return MergeSummary(path, strategy, report, counts, nulls, rejected)
