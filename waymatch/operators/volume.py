"""How many pairs a merge looks at and lets through, without forming them.

A limit on one number lets through, for each base value, the supplement values
up to the upper end of a band less those below its lower end.  An interval lets
through the base values up to its end less those before its start.  Both are
differences of ranks, which a sorted line of all values gives: its parts are
counted by themselves, and what earlier parts hold is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymatch.config import MatchConfig
from waymatch.operators.pairs import blocked_pair_counts, cross_pair_count
from waymatch.operators.rules import MatchRules, base_fields, both_timed, check_columns, interval_lane, rules_for, supp_fields
from waymatch.session import all_of, saved

_PAIRS = "decimal(38,0)"


def _marks(df: DataFrame, prefix: str, keys, *marks: tuple[Column, int, int, int]) -> DataFrame:
    """Value, turn, mark and question of each; ``turn`` puts questions for "below" before and for "up to" after the marks of the same value."""
    each = F.inline(F.array(*[F.struct(value.alias("value"), F.lit(turn).alias("turn"), F.lit(mark).alias("mark"), F.lit(ask).alias("ask"))
                              for value, turn, mark, ask in marks]))
    return df.select(*[F.col(prefix + k).alias(k) for k in keys], each)


def _asked(marks: DataFrame, keys) -> DataFrame:
    """One row: the marks before each question, added up with the question's sign."""
    line = [*keys, "value", "turn"]
    rows = saved(marks.groupBy(*line).agg(F.sum("mark").alias("mark"), F.sum("ask").alias("ask"))
                 .repartitionByRange(*line).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part", *keys).agg(F.sum("mark").alias("marks")).select(
        F.col("part").alias("in_part"), *[F.col(k).alias(f"in_{k}") for k in keys],
        F.coalesce(F.sum("marks").over(earlier), F.lit(0)).alias("start"))
    along = Window.partitionBy("part", *keys).orderBy("value", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("upto", F.sum("mark").over(along)).where("ask != 0").join(
        starts, all_of([F.col("part") == F.col("in_part"), *[F.col(k).eqNullSafe(F.col(f"in_{k}")) for k in keys]]))
    before = (F.col("start") + F.col("upto")).cast("decimal(19,0)") * F.col("ask").cast("decimal(19,0)")
    return here.agg(F.coalesce(F.sum(before), F.lit(0)).cast(_PAIRS).alias("pairs"))


def band_pairs(base: DataFrame, supp: DataFrame, rules: MatchRules) -> DataFrame:
    """Pairs that agree on the keys and are within the limit of the one number the rules compare."""
    limit = rules.max_time_us if rules.rank == "time" else rules.max_chain_m
    if not rules.on_a_line or limit is None:
        raise ValueError("the rules compare more than one limited number")
    value, keys = rules.rank, rules.keys
    points, others = base_fields(base, rules), supp_fields(supp, rules)
    at = F.col(f"b_{value}")
    return _asked(_marks(others, "s_", keys, (F.col(f"s_{value}"), 0, 1, 0))
                  .unionByName(_marks(points, "b_", keys, (at + limit, 1, 0, 1), (at - limit, -1, 0, -1))), keys)


def interval_pairs(base: DataFrame, supp: DataFrame, rules: MatchRules) -> DataFrame:
    """Pairs that agree on the keys and whose base chainage lies in the interval, both ends included."""
    keys = rules.keys
    points = base_fields(base, rules)
    intervals = supp_fields(supp, rules).where(F.col("s_start") <= F.col("s_end"))
    return _asked(_marks(points, "b_", keys, (F.col("b_chain"), 0, 1, 0))
                  .unionByName(_marks(intervals, "s_", keys, (F.col("s_end"), 1, 0, 1), (F.col("s_start"), -1, 0, -1))), keys)


def _same_key_pairs(base: DataFrame, supp: DataFrame, rules: MatchRules) -> DataFrame:
    def count(df, prefix, name):
        return df.groupBy(*[F.col(prefix + k).alias(f"{name}_{k}") for k in rules.keys]).agg(F.count(F.lit(1)).alias(name))
    same = [F.col(f"b_{k}").eqNullSafe(F.col(f"s_{k}")) for k in rules.keys]
    product = F.col("b").cast("decimal(19,0)") * F.col("s").cast("decimal(19,0)")
    return count(base_fields(base, rules), "b_", "b").join(count(supp_fields(supp, rules), "s_", "s"), all_of(same)) \
        .agg(F.coalesce(F.sum(product), F.lit(0)).cast(_PAIRS).alias("pairs"))


def pair_volume(base: DataFrame, supp: DataFrame, cfg: MatchConfig) -> DataFrame:
    """One row: ``candidates`` of the strategy's generator, and ``filtered``, those that pass all tests.

    For ``cross``, ``blocked`` and ``range``.  ``filtered`` is null where several
    numbers are limited at once, and the distance strategy is an error: there
    only the pairs themselves (``match_pairs``) can be counted.
    """
    if cfg.strategy not in ("cross", "blocked", "range"):
        raise ValueError(f"pairs of the {cfg.strategy} strategy are not counted without forming them")
    rules = rules_for(cfg.strategy, cfg, both_timed(base, supp))
    check_columns(base, supp, rules)
    if cfg.strategy == "cross":
        candidates = cross_pair_count(base, supp).select("pairs")
    elif cfg.strategy == "blocked":
        candidates = blocked_pair_counts(base, supp).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    else:
        placed = MatchRules(equal=(), same=("road_id", "region_id"), inside_interval=True)
        candidates = interval_pairs(base, supp.withColumn("_m_lane", interval_lane(supp)), placed)
    limited = rules.max_time_s is not None or rules.max_chain_m is not None
    if rules.on_a_line and limited:
        filtered = band_pairs(base, supp, rules)
    elif rules.inside_interval and not limited:
        filtered = interval_pairs(base, supp, rules)
    elif not rules.inside_interval and not limited:
        filtered = _same_key_pairs(base, supp, rules)
    else:
        filtered = candidates.select(F.lit(None).alias("pairs"))
    one = [df.select(F.lit(1).alias("one"), F.col("pairs").cast(_PAIRS).alias(name))
           for df, name in ((candidates, "candidates"), (filtered, "filtered"))]
    return one[0].join(one[1], "one").drop("one")
