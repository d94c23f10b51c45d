"""Turn a tolerance into join keys.

A base row is placed in the one bucket it lies in; a supplement row is copied
into every bucket its tolerance reaches.  Rows that can match therefore share a
bucket, and a pair shares exactly one, so an equality join on the buckets
followed by the exact test finds each match once.

Buckets are wider than the tolerance: fewer copies are shuffled, at the price
of a few more comparisons inside the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymatch.functions import geo
from waymatch.operators.rules import MatchRules

WIDTH = 4    # bucket width in tolerances: 1.5 copies of a supplement row


def _slot(value: Column, width: float) -> Column:
    return F.floor(value / width)


def _time(base: DataFrame, supp: DataFrame, rules: MatchRules):
    reach = max(rules.max_time_us, 1)
    width = F.lit(reach * WIDTH)
    # Whole microseconds throughout: the bucket is named by its first moment.
    begin = lambda t: t - F.pmod(t, width)
    base = base.withColumn("b_time_bucket", begin(F.col("b_time")))
    first, last = begin(F.col("s_time") - reach), begin(F.col("s_time") + reach)
    supp = supp.withColumn("s_time_bucket", F.explode(F.sequence(first, last, width)))
    return base, supp


def _chain(base: DataFrame, supp: DataFrame, rules: MatchRules):
    width = max(rules.max_chain_m, 1e-6) * WIDTH
    base = base.withColumn("b_chain_bucket", _slot(F.col("b_chain"), width))
    chain = F.col("s_chain")
    reach = F.abs(chain) * 1e-12 + rules.max_chain_m * geo.PAD
    spread = F.sequence(_slot(chain - reach, width), _slot(chain + reach, width))
    return base, supp.withColumn("s_chain_bucket", F.explode(spread))


def _cell(base: DataFrame, supp: DataFrame, rules: MatchRules):
    radius = rules.max_dist_m
    base = geo.with_cell(base, "b_lat", "b_lon", radius, "b_band", "b_cell")
    supp = geo.with_cells_near(supp, "s_lat", "s_lon", radius, "s_band", "s_cell")
    return base, supp


def _interval(base: DataFrame, supp: DataFrame, rules: MatchRules):
    """Bins sized to each interval, so that none is copied more than twice.

    An interval goes to the level whose bin is at least as long as itself.  Base
    rows look into every level that occurs, at most one per power of two.  A
    reversed interval contains nothing; it just must not fill many bins.
    """
    length = F.greatest(F.abs(F.col("s_end") - F.col("s_start")), F.lit(1.0))
    level = (F.ceil(F.log2(length)) + 1).cast("int")
    width = F.pow(F.lit(2.0), F.col("s_level"))
    supp = supp.withColumn("s_level", level)
    levels = supp.agg(F.collect_set("s_level")).scalar()
    bins = F.sequence(F.floor(F.col("s_start") / width), F.floor(F.col("s_end") / width))
    supp = supp.withColumn("s_bin", F.explode(bins))
    base = base.withColumn("b_level", F.explode(levels))
    base = base.withColumn("b_bin", F.floor(F.col("b_chain") / F.pow(F.lit(2.0), F.col("b_level"))))
    return base, supp


_PLACERS = {
    "time": (_time, ("time_bucket",)),
    "chain": (_chain, ("chain_bucket",)),
    "cell": (_cell, ("band", "cell")),
    "interval": (_interval, ("level", "bin")),
}


def available(rules: MatchRules) -> list[str]:
    """Every kind of bucket the rules allow."""
    kinds = []
    if rules.max_time_s is not None:
        kinds.append("time")
    if rules.max_chain_m is not None:
        kinds.append("chain")
    if rules.max_dist_m is not None:
        kinds.append("cell")
    return kinds or ["interval"]


def usual(rules: MatchRules) -> list[str]:
    """The kinds worth their copies on ordinary data.

    Along a road, time and chainage pin a row down already; the grid on top of
    both would only multiply the copies.
    """
    kinds = available(rules)
    return ["time", "chain"] if kinds == ["time", "chain", "cell"] else kinds


def place(base: DataFrame, supp: DataFrame, rules: MatchRules, kinds: list[str]):
    """Both sides with bucket columns, and the bucket names without prefix."""
    names: list[str] = []
    for kind in kinds:
        placer, columns = _PLACERS[kind]
        base, supp = placer(base, supp, rules)
        names += columns
    return base, supp, names


def bucket_condition(names: list[str]) -> list[Column]:
    return [F.col(f"b_{n}") == F.col(f"s_{n}") for n in names]


# --- parts of buckets --------------------------------------------------------
# A crowded bucket is cut in two along each limited number, and its parts again:
# a base row lies in one part, a supplement row is copied to those it reaches.

def refined(base: DataFrame, supp: DataFrame, rules: MatchRules, kinds: list[str], level: int):
    """Both sides with the parts of level ``level`` (2 ** level along each number) and the parts' names.

    Expects the parts of the level before, except for the first one.
    """
    parts, names = 2 ** level, []
    for kind in kinds:
        if kind == "time":
            width = max(rules.max_time_us, 1) * WIDTH
            reach = max(rules.max_time_us, 1)
            at = lambda t: F.floor((t - F.col("s_time_bucket")) * parts / width)
            mine = F.floor((F.col("b_time") - F.col("b_time_bucket")) * parts / width)
            lines = [("time_part", mine, at(F.col("s_time") - reach), at(F.col("s_time") + reach))]
        elif kind == "chain":
            width = max(rules.max_chain_m, 1e-6) * WIDTH
            chain = F.col("s_chain")
            reach = F.abs(chain) * 1e-12 + rules.max_chain_m * geo.PAD
            at = lambda c: F.floor((c - F.col("s_chain_bucket") * width) * (parts / width))
            # The base row's own part is found with the same rounding slack on the other side.
            mine = F.floor((F.col("b_chain") - F.col("b_chain_bucket") * width) * (parts / width))
            lines = [("chain_part", mine, at(chain - reach), at(chain + reach))]
        elif kind == "cell":
            up, along = geo.within_cell(base, "b_lat", "b_lon", rules.max_dist_m, "b_band", "b_cell", parts, False)
            ups, alongs = geo.within_cell(supp, "s_lat", "s_lon", rules.max_dist_m, "s_band", "s_cell", parts, True)
            lines = [("band_part", up, *ups), ("cell_part", along, *alongs)]
        else:
            raise ValueError(f"{kind} buckets have no parts")
        for name, mine, first, last in lines:
            inside = lambda x: F.greatest(F.least(x, F.lit(parts - 1)), F.lit(0)).cast("long")
            base = base.withColumn(f"b_{name}", inside(mine))
            first, last = inside(first), inside(last)
            if level > 1:
                # Of the two halves of the part before.
                half = F.col(f"s_{name}") * 2
                first, last = F.greatest(first, half), F.least(last, half + 1)
            supp = supp.withColumn(f"s_{name}", F.explode(F.when(first <= last, F.sequence(first, last))))
            names.append(name)
    return base, supp, names
