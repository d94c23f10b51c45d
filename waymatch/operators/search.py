"""Best supplement row per base point.

The result maps each distinct base point (``b_…`` columns) that has a match to
the id of its best supplement row, ``s_id``.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymatch.config import EARTH_RADIUS_M, MatchConfig
from waymatch.operators import buckets
from waymatch.operators.intervals import best_interval
from waymatch.operators.rules import (
    MatchRules,
    base_points,
    key_condition,
    order_columns,
    residual_condition,
    supp_points,
)
from waymatch.session import all_of, saved, saved_both

# Pairs of rows that one task compares in a crowded bucket.  A bucket with more
# is cut into parts, PARTS times in two along each limited number; a part that
# still has more is shared by as many tasks as that takes.
PAIRS = 1 << 22
PARTS = 3

# A first step into a crowd is narrow enough to leave no more than CROWD points
# in a bucket; the next steps widen the limit by STRIDE (in area or length) until
# the last one takes the full limit.
CROWD = 64
STRIDE = 16
# Steps finer than this (metres, seconds) part nothing that matters.
FINEST = {"dist": 1e-3, "chain": 1e-5, "time": 1e-6}

# Narrowest band in which neighbours are looked for: microseconds, metres.
NARROWEST = {"time": 16, "chain": 1e-3}

# Reach (metres) of the steps where the rank has no limit of its own.
OPEN_REACH_M = 64.0


def find_best(base: DataFrame, supp: DataFrame, rules: MatchRules, cfg: MatchConfig) -> DataFrame:
    """Choose the search that fits the rules; all give the same kind of result."""
    if rules.rank is None:
        return _lowest_id(supp, rules)
    base_keys, supp_keys = base_points(base, rules), supp_points(supp, rules)
    if rules.on_a_line:
        return nearest_on_line(base_keys, supp_keys, rules)
    if buckets.available(rules) == ["interval"]:
        return best_interval(base_keys, supp_keys, rules)
    return _in_buckets(base_keys, supp_keys, rules, cfg)


def _lowest_id(supp: DataFrame, rules: MatchRules) -> DataFrame:
    """Nothing to rank by: the first supplement row of each key serves all."""
    return supp_points(supp, rules).select(
        *[F.col(f"s_{f}").alias(f"b_{f}") for f in rules.keys], "s_id")


def base_columns(rules: MatchRules) -> list[str]:
    return [f"b_{f}" for f in rules.fields]


def same_fields(rules: MatchRules, names, left: str, right: str) -> list:
    """Equality of fields under two prefixes.

    Only keys that may be missing need the null-safe form; plain equality lets
    a join reuse the partitioning its input already has.
    """
    return [
        F.col(left + n).eqNullSafe(F.col(right + n)) if n in rules.same
        else F.col(left + n) == F.col(right + n)
        for n in names
    ]


def without(points: DataFrame, settled: DataFrame, rules: MatchRules) -> DataFrame:
    """Base points that are not among the settled ones."""
    done = settled.select(*[F.col(f"b_{f}").alias(f"done_{f}") for f in rules.fields])
    return points.join(done, all_of(same_fields(rules, rules.fields, "b_", "done_")), "left_anti")


# --- one number: nearest neighbour on a line --------------------------------

def nearest_on_line(base_keys: DataFrame, supp_keys: DataFrame, rules: MatchRules, gap: bool = False) -> DataFrame:
    """Nearest value per key without forming pairs; with ``gap`` how near it is, too.

    All points are range-partitioned by key and value, so even a single key
    that holds most rows is cut into even parts.  The nearest neighbours are
    then the last supplement point before and the first one after, inside the
    part or, failing that, from the closest part that has one.  Only one line
    per part and key travels between parts.
    """
    keys, value = list(rules.keys), rules.rank
    line = [*keys, "value"]
    points = base_keys.select(
        *[F.col(f"b_{k}").alias(k) for k in keys], F.col(f"b_{value}").alias("value"),
        F.lit(None).cast(supp_keys.schema["s_id"].dataType).alias("s_id"), F.lit(True).alias("wanted"),
    ).unionByName(supp_keys.select(
        *[F.col(f"s_{k}").alias(k) for k in keys], F.col(f"s_{value}").alias("value"),
        "s_id", F.lit(False).alias("wanted"),
    )).groupBy(*line).agg(F.min("s_id").alias("s_id"), F.max("wanted").alias("wanted"))
    # The part number is written down, so it stays the same in both uses below.
    points = saved(
        points.repartitionByRange(*line).withColumn("part", F.spark_partition_id())
    )

    found = F.when(F.col("s_id").isNotNull(), F.struct("value", "s_id"))
    ends = points.groupBy("part", *keys).agg(F.min(found).alias("first"), F.max(found).alias("last"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        F.col("part").alias("end_part"), *[F.col(k).alias(f"end_{k}") for k in keys],
        F.last("last", ignorenulls=True).over(before).alias("far_low"),
        F.last("first", ignorenulls=True).over(after).alias("far_high"),
    )

    part = Window.partitionBy("part", *keys)
    up = part.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = part.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = points.withColumns({
        "low": F.last(found, ignorenulls=True).over(up),
        "high": F.last(found, ignorenulls=True).over(down),
    }).where("wanted")
    near = near.join(
        ends,
        all_of([F.col("part") == F.col("end_part"), *same_fields(rules, keys, "", "end_")]),
        "left",
    )

    def option(low_or_high):
        return F.when(low_or_high.isNotNull(), F.struct(
            F.abs(F.col("value") - low_or_high["value"]).alias("gap"),
            low_or_high["s_id"].alias("s_id")))

    best = F.least(option(F.coalesce("low", "far_low")), option(F.coalesce("high", "far_high")))
    near = near.withColumn("best", best).where(F.col("best").isNotNull())
    limit = rules.max_time_us if value == "time" else rules.max_chain_m
    if limit is not None:
        near = near.where(F.col("best.gap") <= limit)
    return near.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("value").alias(f"b_{value}"), F.col("best.s_id").alias("s_id"),
                       *([F.col("best.gap").alias("gap")] if gap else []))


# --- several numbers: bucket join -------------------------------------------

def _in_buckets(base_keys, supp_keys, rules: MatchRules, cfg: MatchConfig) -> DataFrame:
    watch = cfg.hot_bucket_rows is not None
    if watch:
        # Read twice, by the count of the buckets and by the search.
        base_keys, supp_keys = saved_both(base_keys, supp_keys)
    base, supp, names = buckets.place(base_keys, supp_keys, rules, buckets.usual(rules))
    if not watch:
        return _top(base, supp, rules, names)
    hot = saved(_hot_buckets(base, supp, rules, names, cfg.hot_bucket_rows))
    if hot.isEmpty():
        return _top(base, supp, rules, names)
    hot_base = _among(base, "b_", hot, rules, names, "left_semi")
    hot_supp = _among(supp, "s_", hot, rules, names, "left_semi")
    crowd = _climb(hot_base.select(*base_columns(rules)).distinct(),
                   hot_supp.drop(*[f"s_{n}" for n in names]).distinct(), rules, hot)
    cold = _among(base, "b_", hot, rules, names, "left_anti")
    return _top(cold, _among(supp, "s_", hot, rules, names, "left_anti"), rules, names).unionByName(crowd)


def _counted(base, supp, rules, names) -> DataFrame:
    """Rows of either side in each bucket that holds both."""
    columns = [*rules.keys, *names]
    sides = [df.select(*[F.col(p + c).alias(c) for c in columns], F.lit(b).alias("b"), F.lit(1 - b).alias("s"))
             for df, p, b in ((base, "b_", 1), (supp, "s_", 0))]
    return sides[0].unionByName(sides[1]).groupBy(*columns) \
        .agg(F.sum("b").alias("b_rows"), F.sum("s").alias("s_rows")).where("b_rows > 0 AND s_rows > 0")


def _hot_buckets(base, supp, rules, names, limit) -> DataFrame:
    """Buckets of more than ``limit`` rows from both sides together, counted
    before any pair is formed.  They stay a table, however many there are."""
    return _counted(base, supp, rules, names).where(F.col("b_rows") + F.col("s_rows") > limit)


def _among(df: DataFrame, prefix: str, listed: DataFrame, rules: MatchRules, names, how: str) -> DataFrame:
    """Rows whose bucket is (``left_semi``) or is not (``left_anti``) listed."""
    columns = [*rules.keys, *names]
    listed = listed.select(*[F.col(c).alias(f"hot_{c}") for c in columns])
    return df.join(listed, all_of(same_fields(rules, columns, prefix, "hot_")), how)


def _top(base: DataFrame, supp: DataFrame, rules: MatchRules, names: list[str]) -> DataFrame:
    """Join on keys and buckets, test exactly, keep the best per base point.

    A base point lies in one bucket, so grouping by bucket and point reuses the
    join's partitioning: no second shuffle.
    """
    condition = key_condition(rules) & all_of(buckets.bucket_condition(names))
    pairs = base.join(supp, condition & residual_condition(rules))
    columns = base_columns(rules)
    extra = [f"b_{n}" for n in names]
    # Numbers lead the sort of the aggregate: they tell points apart at once.
    numbers_first = columns[len(rules.keys):] + columns[:len(rules.keys)]
    best = F.min(F.struct(*order_columns(rules))).alias("best")
    return pairs.groupBy(*numbers_first, *extra).agg(best).select(
        *columns, F.col("best.s_id").alias("s_id"))


def _shares(first: float, stride: float = STRIDE) -> list[float]:
    """Shares of a limit from the first to nearly all."""
    shares = []
    while first < 0.5:
        shares.append(first)
        first *= stride
    return shares


def _first_share(supp_keys: DataFrame, rules: MatchRules, limited, size: int,
                 power: float, lowest: float) -> float:
    """A share of the limit small enough to break up the largest bucket.

    Points may crowd in a small part of a bucket, so the guess made from the
    bucket's size is checked and made again.  Equal points cannot be parted;
    the guesses end at the ``lowest`` share.
    """
    share = 1.0
    while size > CROWD and share > lowest:
        share = max(share * (CROWD / 4 / size) ** power, lowest)
        step = limited(share)
        # Only the supplement side is of interest, so it stands in for both.
        mirror = supp_keys.select(*[F.col(f"s_{f}").alias(f"b_{f}") for f in rules.fields])
        placed, _, names = buckets.place(mirror, supp_keys, step, buckets.available(step))
        size = _largest(placed, [f"b_{c}" for c in [*rules.keys, *names]])
    return share


def _largest(df: DataFrame, columns: list[str]) -> int:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    return counts.agg(F.max("rows")).first()[0] or 0


def _steps(supp_keys: DataFrame, rules: MatchRules, crowd: int) -> list[MatchRules]:
    """Ever larger limits, all below the real ones."""
    steps = []
    if rules.max_dist_m is not None:
        # Distances are ranked in whole micrometres, so a step ends between two.
        near = lambda share: round(rules.max_dist_m * share, 6) + 5e-7
        if rules.rank == "dist":
            limited = lambda share: rules.with_rank_limit(near(share))
            size = crowd
        else:
            # A crowd at one moment (or chainage) is told apart by distance.
            still = rules.with_rank_limit(0)
            limited = lambda share: replace(still, max_dist_m=near(share))
            size = _largest(supp_keys, [*[f"s_{k}" for k in rules.keys], f"s_{rules.rank}"])
        lowest = FINEST["dist"] / rules.max_dist_m
        first = _first_share(supp_keys, rules, limited, size, 0.5, lowest)
        steps = [limited(share) for share in _shares(first, STRIDE ** 0.5)]
        if rules.rank == "dist":
            return steps
    whole = OPEN_REACH_M if rules.rank_limit is None else rules.rank_limit
    limited = lambda share: rules.with_rank_limit(whole * share)
    first = _first_share(supp_keys, rules, limited, crowd, 1.0, FINEST[rules.rank] / whole)
    steps += [limited(share) for share in _shares(first)]
    return [*steps, limited(1.0)] if rules.rank_limit is None else steps


def _fine_cells(base: DataFrame, supp: DataFrame, rules: MatchRules):
    """Cells of the limited numbers beside the rank, such that rows in the same cell are within those limits for sure.

    A base row lies in one, a supplement row in its own and those next to it: two
    rows that share a cell are less than two cell widths apart.
    """
    names, just_below = [], 1 - 1e-9
    spans = []
    if rules.rank != "chain" and rules.max_chain_m is not None:
        spans.append(("fine_chain", "chain", max(rules.max_chain_m, 1e-9) / 2 * just_below))
    if rules.max_dist_m is not None:
        # Two thirds of the limit either way at most; degrees of longitude are never longer than those of latitude.
        degrees = math.degrees(max(rules.max_dist_m, 1e-6) / 3 / EARTH_RADIUS_M)
        spans += [("fine_lat", "lat", degrees), ("fine_lon", "lon", degrees)]
    for name, field, width in spans:
        base = base.withColumn(f"b_{name}", F.floor(F.col(f"b_{field}") / width))
        supp = supp.withColumn(f"s_{name}", F.floor(F.col(f"s_{field}") / width))
        names.append(name)
    # Rows of one cell and rank are alike but for the id: the lowest is copied for them all.
    line = [f"s_{f}" for f in (*rules.keys, *names, rules.rank)]
    supp = supp.repartition(_parts(supp), *line).groupBy(*line).agg(F.min("s_id").alias("s_id"))
    for name in names:
        at = F.col(f"s_{name}")
        supp = supp.withColumn(f"s_{name}", F.explode(F.sequence(at - 1, at + 1)))
    return base, supp, names


def _bounded(base_keys: DataFrame, supp_keys: DataFrame, rules: MatchRules, hot: DataFrame) -> DataFrame:
    """Search a crowd in a fixed number of jobs.

    The nearest row of the rank in a cell where all other limits hold for sure
    is a match, so nothing farther away can be the best one.  It is found without
    pairs.  Each base row is then compared with what lies within a power of four
    of that bound only.  Rows without such a bound, and those whose neighbours
    all tie, go the longer way.
    """
    base_keys, supp_keys = saved_both(base_keys, supp_keys)
    rank = rules.rank
    base, near, fine = _fine_cells(base_keys, supp_keys, rules)
    line = MatchRules(equal=(*rules.equal, *fine), same=rules.same, rank=rank,
                      max_time_s=rules.max_time_s if rank == "time" else None, max_chain_m=rules.max_chain_m if rank == "chain" else None)
    found = nearest_on_line(base.select(*[f"b_{f}" for f in line.fields]).distinct(), near.select(*[f"s_{f}" for f in line.fields], "s_id"), line, gap=True)
    found = found.select(*[F.col(f"b_{f}").alias(f"f_{f}") for f in line.fields], "gap")
    bounds = base.join(found, all_of(same_fields(line, line.fields, "b_", "f_")), "left").select(*base_columns(rules), "gap")
    bounds = saved(bounds)

    unit = NARROWEST[rank]
    level = F.greatest(F.ceil(F.log(F.greatest(F.col("gap") / unit, F.lit(1.0))) / math.log(4) + 1e-6), F.lit(0)).cast("int")
    base = bounds.where("gap IS NOT NULL").withColumn("b_level", level).drop("gap")
    width = lambda side: F.pow(F.lit(4.0), F.col(f"{side}_level")) * unit
    slot = lambda value, side: F.floor(value / width(side))
    levels = base.agg(F.array_sort(F.collect_set("b_level"))).scalar()
    base = base.withColumn("b_slot", slot(F.col(f"b_{rank}"), "b"))
    value = F.col(f"s_{rank}")
    reach = width("s") * (1 + 1e-9)
    supp = supp_keys.withColumn("s_level", F.explode(levels)).withColumn("s_slot", F.explode(F.sequence(slot(value - reach, "s"), slot(value + reach, "s"))))
    others = [kind for kind in buckets.usual(rules) if kind != rank][:1] or [k for k in buckets.available(rules) if k != rank][:1]
    base, supp, names = buckets.place(base, supp, rules, others)
    names = ["level", "slot", *names]
    cells = saved(_counted(base, supp, rules, names))
    big = cells.where(F.col("b_rows") * F.col("s_rows") > PAIRS)
    alone = saved(bounds.where("gap IS NULL").drop("gap"))
    settled = []
    if big.isEmpty():
        settled.append(_even_top(base, supp, rules, names, cells))
    else:
        settled.append(_even_top(_among(base, "b_", big, rules, names, "left_anti"), _among(supp, "s_", big, rules, names, "left_anti"), rules, names, cells))
        settled.append(_in_steps(_among(base, "b_", big, rules, names, "left_semi").select(*base_columns(rules)).distinct(), supp_keys, rules, hot))
    if not alone.isEmpty():
        settled.append(_split_top(alone, supp_keys, rules))
    return reduce(DataFrame.unionByName, settled)


def _climb(base_keys: DataFrame, supp_keys: DataFrame, rules: MatchRules, hot: DataFrame) -> DataFrame:
    """The best matches in crowded places."""
    # Distances have no line to look along, and a neighbour in a cell need not lie in an interval too, so it bounds nothing there.
    search = _in_steps if rules.rank == "dist" or rules.inside_interval else _bounded
    return search(base_keys, supp_keys, rules, hot)


def _in_steps(base_keys: DataFrame, supp_keys: DataFrame, rules: MatchRules, hot: DataFrame) -> DataFrame:
    """Search crowded places with a small limit first, then a larger one.

    A match within a small limit of the rank beats everything outside it, so
    rows settled on one step need no further one.  In a crowd nearly all rows
    that match settle on the first steps, where buckets are small; every row not
    settled goes on, up to the full limit, so nothing is lost.  Rows that match
    nothing are told apart by the parts of their buckets on each step.
    """
    left, supp_keys = saved_both(base_keys, supp_keys)
    crowd = hot.agg(F.max(F.col("b_rows") + F.col("s_rows"))).first()[0]
    settled = []
    for step in _steps(supp_keys, rules, crowd):
        found = saved(_split_top(left, supp_keys, step))
        settled.append(found)
        left = saved(without(left, found, rules))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    settled.append(_split_top(left, supp_keys, rules))
    return reduce(DataFrame.unionByName, settled)


def _split_top(base_keys: DataFrame, supp_keys: DataFrame, rules: MatchRules) -> DataFrame:
    """``_top`` in which buckets with too many pairs are cut into parts.

    Parts are narrower than the limits in every limited number, so rows that
    cannot match part ways, and supplement rows are copied only to parts of
    buckets that are still too large and hold base rows.
    """
    base, supp, names = buckets.place(base_keys, supp_keys, rules, buckets.available(rules))
    kinds = buckets.usual(rules)    # parts of the grid on top of time and chainage would only multiply copies
    done = []
    for level in range(1, PARTS + 2):
        cells = saved(_counted(base, supp, rules, names))
        big = cells.where(F.col("b_rows") * F.col("s_rows") > PAIRS)
        if big.isEmpty():
            done.append(_even_top(base, supp, rules, names, cells))
            break
        if level > PARTS:
            done.append(_shared_top(base, supp, rules, names, cells))
            break
        done.append(_even_top(_among(base, "b_", big, rules, names, "left_anti"),
                              _among(supp, "s_", big, rules, names, "left_anti"), rules, names, cells))
        base, supp = saved_both(_among(base, "b_", big, rules, names, "left_semi"),
                                _among(supp, "s_", big, rules, names, "left_semi"))
        base, supp, parts = buckets.refined(base, supp, rules, kinds, level)
        names = list(dict.fromkeys([*names, *parts]))
    return reduce(DataFrame.unionByName, done)


def _even_top(base, supp, rules, names, cells) -> DataFrame:
    """``_top`` of the buckets up to ``PAIRS`` pairs, in as many tasks as their pairs take: a task sorts what it lets through."""
    product = F.col("b_rows") * F.col("s_rows")
    pairs = cells.where(product <= PAIRS).agg(F.sum(product)).first()[0] or 0
    if pairs > PAIRS:
        base = _spread(base, rules, names, math.ceil(2 * pairs / PAIRS))
    return _top(base, supp, rules, names)


def _shared_top(base, supp, rules, names, cells) -> DataFrame:
    """``_top`` with each bucket shared by as many tasks as its pairs take.

    Supplement rows of buckets without base rows are left out, the others copied
    once for each task of their bucket.
    """
    columns = [*rules.keys, *names]
    cells = cells.select(*[F.col(c).alias(f"hot_{c}") for c in columns],
                         F.ceil(F.col("b_rows") * F.col("s_rows") / PAIRS).cast("int").alias("tasks"))

    def tasks(df, prefix):
        return df.join(cells, all_of(same_fields(rules, columns, prefix, "hot_"))).drop(*[f"hot_{c}" for c in columns])
    base = tasks(base, "b_").withColumn("b_salt", F.pmod(F.xxhash64(*base_columns(rules)), "tasks")).drop("tasks")
    supp = tasks(supp, "s_").withColumn("s_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).drop("tasks")
    return _top(_spread(base, rules, [*names, "salt"]), supp, rules, [*names, "salt"])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _spread(base: DataFrame, rules: MatchRules, names: list[str], tasks: int = 0) -> DataFrame:
    """Partition for the coming join by a fixed number.

    The work in a crowd is far larger than its bytes, by which adaptive
    execution would merge the partitions.
    """
    return base.repartition(max(_parts(base), tasks), *[f"b_{c}" for c in [*rules.keys, *names]])
