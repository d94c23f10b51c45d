"""Best interval per point without forming pairs: a segment tree spread over the cluster.

The ends of all intervals, the chainages by which they rank and the points are
the leaves of the line of each key, numbered through in order.  An interval is
taken apart where its own chainage lies: for the points before it a smaller
chainage is nearer, for those from there on a larger one.  Each part covers a run of leaves, which a few dyadic cells make
up.  Of all intervals that cover a cell only the best of either kind can be an
answer, so a cell holds two rows however many intervals overlap.  A leaf asks the
cells it lies in, one on each level, and all points of a leaf have its answer.

An interval's rank is one number, made of the leaf of its chainage and its id:
the best of a cell is a plain minimum, found while rows pass and without a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymatch.operators.rules import MatchRules
from waymatch.session import all_of, numbered, saved

# Dyadic cells that make up the leaves from low to high: on each level the cells inside whose parent is not.
_CELLS = """
flatten(transform(sequence(0, CAST(floor(log2(high - low + 1)) AS int)), level -> transform(
    array(named_struct('a', shiftright(low + shiftleft(1L, level) - 1, level), 'b', shiftright(high + 1, level) - 1)), r ->
    filter(array(IF(r.a <= r.b AND r.a % 2 = 1, named_struct('level', level, 'cell', r.a), NULL),
                 IF(r.a <= r.b AND r.b % 2 = 0, named_struct('level', level, 'cell', r.b), NULL)), c -> c IS NOT NULL))[0]))
"""


def _same(keys, rules: MatchRules, left: str, right: str) -> list:
    return [F.col(left + k).eqNullSafe(F.col(right + k)) if k in rules.same else F.col(left + k) == F.col(right + k) for k in keys]


def _leaves(points: DataFrame, intervals: DataFrame, rules: MatchRules) -> DataFrame:
    """The number of the leaf of every value that occurs, as ``l_…`` columns; ``wanted`` where a point lies."""
    keys = list(rules.keys)
    line = [*[f"l_{k}" for k in keys], "l_value"]
    rows = points.select(*[F.col(f"b_{k}").alias(f"l_{k}") for k in keys], F.col("b_chain").alias("l_value"), F.lit(True).alias("wanted"))
    cuts = F.explode(F.array_distinct(F.array("s_start", "s_end", "s_chain")))
    rows = rows.unionByName(intervals.select(*[F.col(f"s_{k}").alias(f"l_{k}") for k in keys], cuts.alias("l_value"), F.lit(False).alias("wanted")))
    # One row a value, so that no key is too large for its parts.
    return numbered(rows.groupBy(*line).agg(F.max("wanted").alias("wanted")), line, "leaf")


def best_interval(base_keys: DataFrame, supp_keys: DataFrame, rules: MatchRules) -> DataFrame:
    """For each base point the covering interval whose chainage is nearest; ties go to the lower id, a number."""
    keys = list(rules.keys)
    # Reversed intervals contain nothing.
    intervals = saved(supp_keys.where(F.col("s_start") <= F.col("s_end")).withColumn("nth", F.monotonically_increasing_id()))
    leaves = _leaves(base_keys, intervals, rules)

    marks = intervals.select("nth", "s_id", *[f"s_{k}" for k in keys], F.posexplode(F.array("s_start", "s_end", "s_chain")).alias("what", "value"))
    placed = saved(marks.join(leaves, all_of([*_same(keys, rules, "s_", "l_"), F.col("value") == F.col("l_value")]))
                   .groupBy("nth").agg(*[F.max(F.when(F.col("what") == i, F.col("leaf"))).alias(name) for i, name in enumerate(("first", "last", "own"))],
                                       F.max(F.when(F.col("what") == 2, F.col("value"))).alias("chain"), F.max("s_id").alias("id")).drop("nth"))
    lowest, highest, longest, farthest = placed.agg(
        F.min("id"), F.max("id"), F.max(F.col("last") - F.col("first") + 1), F.max("own")).first()
    if longest is None:
        return base_keys.select(*[f"b_{k}" for k in keys], "b_chain", F.lit(None).cast(supp_keys.schema["s_id"].dataType).alias("s_id")).where("false")
    lowest, highest = lowest or 0, highest or 0
    # A missing id comes before all others.
    ids, kind = highest - lowest + 2, "decimal(38,0)"
    if (farthest + 1) * ids < 1 << 62:
        kind = "long"
    number = F.coalesce(F.col("id").cast(kind) - F.lit(lowest).cast(kind) + F.lit(1).cast(kind), F.lit(0).cast(kind)).cast(kind)

    # From its own chainage on an interval ranks by the largest, before it by the smallest.  Intervals that lie close together are
    # dealt to one task, which then writes few rows for the cells they share.
    spread = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = placed.repartitionByRange(spread, "first").withColumn("number", number).select("own", "chain", "number", F.explode(F.array(
        F.struct(F.lit(True).alias("behind"), F.greatest("first", "own").alias("low"), F.col("last").alias("high")),
        F.struct(F.lit(False).alias("behind"), F.col("first").alias("low"), F.least("last", F.col("own") - 1).alias("high")))).alias("part")) \
        .select("own", "chain", "number", "part.*").where("low <= high")
    sign = F.when(F.col("behind"), F.lit(-1)).otherwise(F.lit(1))
    rank = ((sign * F.col("own")).cast(kind) * F.lit(ids).cast(kind) + F.col("number")).cast(kind)
    sides = {"low": F.col("behind"), "high": ~F.col("behind")}
    cells = parts.select("behind", rank.alias("rank"), (sign * F.col("chain")).alias("order"), F.explode(F.expr(_CELLS)).alias("c")) \
        .groupBy(F.col("c.level").alias("level"), F.col("c.cell").alias("cell")) \
        .agg(*[F.min(F.when(side, F.col(c))).alias(f"{name}_{c}") for name, side in sides.items() for c in ("rank", "order")])

    # No more levels than the longest run of leaves has, one for each power of two.
    levels = F.sequence(F.lit(0), F.lit(longest.bit_length() - 1))
    asked = leaves.where("wanted").select("leaf", F.explode(levels).alias("level")).withColumn("cell", F.expr("shiftright(leaf, level)"))
    answers = asked.join(cells, ["level", "cell"]).groupBy("leaf").agg(*[
        F.min(f"{name}_{c}").alias(f"{name}_{c}") for name in sides for c in ("rank", "order")])

    def option(name, sign):
        # Chainages stand in the order of their leaves, so the least order is that of the least rank.
        nth = F.pmod(F.col(f"{name}_rank"), F.lit(ids).cast(kind))
        s_id = F.when(nth > 0, (nth - F.lit(1).cast(kind) + F.lit(lowest).cast(kind)).cast("long"))
        return F.when(F.col(f"{name}_rank").isNotNull(), F.struct(F.abs(F.col("l_value") - sign * F.col(f"{name}_order")).alias("gap"), s_id.alias("s_id")))

    return leaves.where("wanted").join(answers, "leaf").select(
        *[F.col(f"l_{k}").alias(f"b_{k}") for k in keys], F.col("l_value").alias("b_chain"),
        F.least(option("low", -1), option("high", 1))["s_id"].alias("s_id"))
