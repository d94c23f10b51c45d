"""Candidate pairs, for callers who want every partner and not just the best.

Each result holds only pairs that pass a distance, interval or tolerance test;
its size is what those tests let through.  The unfiltered products of the cross
and blocked strategies are never formed, only counted.  A merge does not use
these operators, see ``search``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymatch.operators import buckets
from waymatch.operators.rules import (
    MatchRules,
    base_fields,
    chain_gap,
    check_columns,
    distance,
    interval_lane,
    key_condition,
    residual_condition,
    supp_fields,
    time_gap,
)
from waymatch.session import all_of

# Attributes of both sides that travel with a pair.
CARRIED = ("road", "lane", "time", "chain")


def match_pairs(base: DataFrame, supp: DataFrame, rules: MatchRules) -> DataFrame:
    """Every pair that satisfies all rules, with both sides' attributes."""
    if not (rules.values and (rules.inside_interval or _limited(rules))):
        raise ValueError("rules without a tolerance pair up whole groups; use find_best")
    check_columns(base, supp, rules)
    carried = tuple(f for f in CARRIED if f"_m_{f}" in base.columns and f"_m_{f}" in supp.columns)
    left = base_fields(base, rules, extra=("id", *carried))
    right = supp_fields(supp, rules, extra=carried)
    left, right, names = buckets.place(left, right, rules, buckets.usual(rules))
    tests = [residual_condition(rules), *buckets.bucket_condition(names)]
    if rules.keys:
        tests.append(key_condition(rules))
    pairs = left.join(right, all_of(tests))
    columns = {"base_id": F.col("b_id"), "supp_id": F.col("s_id")}
    for field in carried:
        columns[f"{field}_base"] = F.col(f"b_{field}")
        columns[f"{field}_supp"] = F.col(f"s_{field}")
    columns["time_diff_us"] = time_gap()
    columns["chainage_diff_m"] = chain_gap()
    if rules.max_dist_m is not None:
        columns["spatial_dist_m"] = distance()
    if rules.inside_interval:
        for field in rules.same:
            columns[f"{field}_base"] = F.col(f"b_{field}")
            columns[f"{field}_supp"] = F.col(f"s_{field}")
        columns["start_m"], columns["end_m"] = F.col("s_start"), F.col("s_end")
    return pairs.select(*[value.alias(name) for name, value in columns.items()])


def _limited(rules: MatchRules) -> bool:
    limits = (rules.max_time_s, rules.max_chain_m, rules.max_dist_m)
    return any(limit is not None for limit in limits)


def radius_join(base: DataFrame, supp: DataFrame,
                max_distance_m: float = 100) -> DataFrame:
    """All pairs no further apart than ``max_distance_m``, the limit included."""
    return match_pairs(base, supp, MatchRules(equal=(), max_dist_m=max_distance_m, rank="dist"))


def range_join(base: DataFrame, supp: DataFrame) -> DataFrame:
    """All pairs with the same road and region whose base chainage lies in the
    supplement's interval, both ends included; missing keys equal each other."""
    rules = MatchRules(equal=(), same=("road_id", "region_id"), inside_interval=True)
    check_columns(base, supp, rules)
    return match_pairs(base, supp.withColumn("_m_lane", interval_lane(supp)), rules)


def blocked_pair_counts(base: DataFrame, supp: DataFrame) -> DataFrame:
    """How many pairs share each road and lane, without forming them."""
    count = lambda df, p: df.groupBy(
        F.col("_m_road").alias(f"{p}road"), F.col("_m_lane").alias(f"{p}lane")
    ).agg(F.count(F.lit(1)).alias(f"{p}rows"))
    same = [F.col(f"b_{k}").eqNullSafe(F.col(f"s_{k}")) for k in ("road", "lane")]
    return count(base, "b_").join(count(supp, "s_"), all_of(same)).select(
        F.col("b_road").alias("road"), F.col("b_lane").alias("lane"),
        F.col("b_rows").alias("base_rows"), F.col("s_rows").alias("supp_rows"),
        _product("b_rows", "s_rows").alias("pairs"))


def cross_pair_count(base: DataFrame, supp: DataFrame) -> DataFrame:
    """Size of the full product, from one count per side."""
    sides = base.select(F.lit(1).alias("b"), F.lit(0).alias("s")).unionByName(
        supp.select(F.lit(0).alias("b"), F.lit(1).alias("s")))
    return sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("base_rows"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("supp_rows"),
    ).withColumn("pairs", _product("base_rows", "supp_rows"))


def _product(left: str, right: str):
    """Counts of this size may outgrow a long."""
    return F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(19,0)")
