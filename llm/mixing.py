"""Interleave sources by target weight with Pfair scheduling."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Weights are whole numbers of parts of the stream, one in this many.
PARTS = 1 << 40
#: Rows in a block.
BLOCK_ROWS = 8
#: A source's default weight grows as its number of rows to this power.
TEMPERING = 0.8
#: Slots that are scheduled together: at least so many; more, up to the second number, where there would be more stretches than the third.
STRETCH, LONGEST, STRETCHES = 4096, 1 << 20, 4096
#: Slots whose turns are gathered before they are put to the others.
GATHERED = 64

# Of the sources of one weight ("class": ``m`` sources of ``q`` parts, in their order) block j of the first comes before block j
# of the second and so on, so the class's n-th turn is block n DIV m of its source n % m.  It is released at slot
# floor(j * PARTS / q) and due by slot ceil((j + 1) * PARTS / q).  A stretch counts both from its first slot: ``e`` is the
# first block that is released in the stretch, ``rho`` its release time times q, less whole slots before.
_RELEASE = "((d DIV m[i] - e[i]) * {parts} + rho[i]) DIV q[i]"
_DUE = "((d DIV m[i] - e[i] + 1) * {parts} + rho[i] + q[i] - 1) DIV q[i]"
#: The class that runs in slot t: of the released blocks the one due first, ties to the first class.
_TURN = f"array_min(transform(s.done, (d, i) -> IF(d < ends[i] AND {_RELEASE} <= t, named_struct('due', {_DUE}, 'i', i), NULL))).i"
#: Turns of all classes after a stretch in which only blocks that it releases may run.
LATE = f"""
aggregate(sequence(0, {{stretch}} - 1), named_struct('done', transform(e, (v, i) -> v * m[i])), (s, t) -> named_struct('done',
    transform(array({_TURN}), turn -> transform(s.done, (d, i) -> IF(i = turn, d + 1, d)))[0]), s -> s.done)"""
#: Class and number of the turn in each slot of a stretch that begins after the turns ``x``.
TURNS = f"""
flatten(aggregate(sequence(0, {{stretch}} - 1, {GATHERED}),
    named_struct('done', x, 'turns', CAST(array() AS array<array<struct<i: int, n: bigint>>>)), (outer, first) ->
    transform(array(aggregate(sequence(first, least(first + {GATHERED}, {{stretch}}) - 1),
        named_struct('done', outer.done, 'turns', CAST(array() AS array<struct<i: int, n: bigint>>)), (s, t) ->
        transform(array({_TURN}), turn -> named_struct('done', transform(s.done, (d, i) -> IF(i = turn, d + 1, d)),
            'turns', concat(s.turns, array(named_struct('i', turn, 'n', s.done[turn])))))[0])),
        r -> named_struct('done', r.done, 'turns', concat(outer.turns, array(r.turns))))[0], s -> s.turns))"""
#: Turns of all classes at each border, from those at the border before.  At a border a class has had all blocks that are due;
#: of the block that is released but not due yet so many of its sources as there is room for, the one due first first.
BORDERS = """
aggregate(borders, named_struct('x', transform(m, v -> 0L), 'all', array(transform(m, v -> 0L))), (s, b) ->
    transform(transform(array(zip_with(s.x, b.due_turns, (x, v) -> greatest(x, v))), y -> zip_with(y, array_sort(aggregate(
        array_sort(transform(y, (v, i) -> named_struct('due', b.due[i], 'i', i, 'n', IF(b.room[i] < 0, b.due_turns[i] + m[i] - v, b.room[i])))),
        named_struct('left', (b.k + 1) * {stretch} - aggregate(y, 0L, (a, v) -> a + v),
                     'took', CAST(array() AS array<struct<i: int, n: bigint>>)),
        (a, o) -> named_struct('left', a.left - least(a.left, o.n),
                               'took', concat(a.took, array(named_struct('i', o.i, 'n', least(a.left, o.n))))), a -> a.took)),
        (v, t) -> v + t.n)), x -> named_struct('x', x, 'all', concat(s.all, array(x))))[0], s -> s.all)"""


def _parts(counts: DataFrame) -> DataFrame:
    """Whole parts ``q`` of the stream for each source, at least one; the first of the largest takes what rounding left."""
    total = counts.agg(F.sum("w").alias("total"))
    rounded = counts.join(F.broadcast(total)).withColumn(
        "q", F.greatest(F.rint(F.col("w") / F.col("total") * PARTS).cast("long"), F.lit(1)))
    every = Window.partitionBy()
    first = F.row_number().over(Window.orderBy(F.desc("q"), F.asc_nulls_first("source"))) == 1
    return rounded.withColumn("q", F.col("q") + F.when(first, PARTS - F.sum("q").over(every)).otherwise(0)).drop("w", "total")


def _at_border(k: str, stretch: int) -> tuple[str, str]:
    """For each class the blocks due by the first slot of stretch ``k``, and parts of the next one that are past then."""
    parts = f"CAST(v AS decimal(20, 0)) * {k} * {stretch}"
    due = f"transform(q, v -> CAST({parts} DIV {PARTS} AS bigint))"
    return due, f"transform(q, v -> CAST({parts} % {PARTS} AS bigint))"


def _slots(counts: DataFrame, block: int, least_stretch: int) -> DataFrame:
    """The block that runs in each slot, until every source has given all its rows once.

    Earliest deadline first, with all of it in columns.  The slots are cut into
    stretches.  First each stretch finds out, by itself, how many turns each
    class could have of the blocks that the stretch releases.  From that the
    turns at the borders follow one after the other, a few numbers for each
    class and border.  Then the stretches are scheduled beside each other
    between their borders.  The result is the schedule of all slots in a row.
    """
    sources = stored(_parts(counts).withColumn("rank", (F.row_number().over(
        Window.partitionBy("q").orderBy(F.asc_nulls_first("source"))) - 1).cast("long"))
        .withColumn("blocks", F.expr(f"(n + {block} - 1) DIV {block}")))
    end = sources.agg(F.max(F.expr(f"CAST(CAST(blocks + 1 AS decimal(20, 0)) * {PARTS} DIV q AS bigint)")).alias("end")).first().end or 0
    stretch = min(max(least_stretch, -(-end // STRETCHES)), max(least_stretch, LONGEST))
    one = sources.groupBy("q").agg(F.count(F.lit(1)).alias("m")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("order"), "q", "m"))).alias("all")).select("all.q", "all.m")
    (due, past), (due_next, past_next) = _at_border("k", stretch), _at_border("(k + 1)", stretch)
    lengths = {"stretch": stretch, "parts": PARTS}
    stretches = counts.sparkSession.range(-(-end // stretch)).select(F.col("id").alias("k")) \
        .withColumns({name: one.select(name).scalar() for name in ("q", "m")}) \
        .withColumns({"before": F.expr(due), "past": F.expr(past)}) \
        .withColumns({"e": F.expr("transform(before, (v, i) -> IF(past[i] > 0, v + 1, v))"),
                      "rho": F.expr(f"transform(past, v -> IF(v > 0, {PARTS} - v, 0L))")}).drop("before", "past")
    turned = stored(stretches.repartition("k").withColumn("ends", F.expr("transform(m, v -> 9223372036854775807L)"))
                    .withColumns({"late": F.expr(LATE.format(**lengths)), "blocks": F.expr(due_next), "past": F.expr(past_next)})
                    .select("k", "m", F.expr("transform(blocks, (v, i) -> v * m[i])").alias("due_turns"), F.expr(
                        "transform(blocks, (v, i) -> IF(past[i] = 0, 0L, IF(v < e[i], -1L, greatest(late[i] - v * m[i], 0L))))").alias("room"),
                        F.expr(f"transform(blocks, (v, i) -> ((v - e[i] + 1) * {PARTS} + rho[i] + q[i] - 1) DIV q[i])").alias("due")))
    # A few numbers for each class and stretch, and no more stretches than there may be.
    borders = turned.agg(F.any_value("m").alias("m"), F.array_sort(F.collect_list(F.struct("k", "due_turns", "room", "due"))).alias("borders")) \
        .where("m IS NOT NULL").select(F.expr(BORDERS.format(stretch=stretch)).alias("x")) \
        .select(F.posexplode(F.expr("arrays_zip(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1))")).alias("k", "pair")) \
        .select(F.col("k").cast("long").alias("k"), F.col("pair.0").alias("x"), F.col("pair.1").alias("ends"))
    turns = stretches.join(borders, "k").repartition("k").select("k", "q", "m", F.posexplode(F.expr(TURNS.format(**lengths))).alias("t", "turn"))
    slots = turns.select(F.expr("q[turn.i]").alias("q"), F.expr("turn.n % m[turn.i]").alias("rank"), F.expr("turn.n DIV m[turn.i]").alias("block"),
                         (F.col("k") * stretch + F.col("t")).alias("slot")) \
        .join(sources.select("q", "rank", "source", "n", "blocks"), ["q", "rank"])
    slots = stored(slots.select("source", "n", "blocks", (F.col("q") / F.lit(PARTS)).alias("weight"), "block", "slot"))
    last = slots.where(F.col("block") == F.col("blocks") - 1).agg(F.max("slot"))
    return slots.where(F.col("slot") <= last.scalar()).drop("blocks")


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, stretch: int = STRETCH,
        tempering: float = TEMPERING, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Put the rows of all sources into one stream that keeps to the target weights everywhere.

    A source of weight w gives blocks of ``block_rows`` rows; its block j may
    run from slot floor(j / w) and must have run by slot ceil((j + 1) / w).
    Earliest deadline first meets every window, so at each slot border each
    source is less than one block away from its share.  Ties go to the larger
    weight, then to the source that comes first.  Weights (default: rows to the
    power ``tempering``) are taken to 40 bits.  Slots are scheduled in stretches
    of at least ``stretch``, beside each other; their length changes no row.

    The stream goes on until every row has been in it once.  Sources that run
    out earlier start anew, so their rows come more than once, numbered by
    ``epoch``.  No row is left out.

    Returns ``row`` (a struct of all columns of ``docs``, whatever their
    names), ``source``, ``weight``, ``epoch``, ``block`` (within the source)
    and ``position`` (gapless from 0).

    A null source is a source of its own; null ids come first in their source;
    rows with equal ids are put in any order.  An empty table gives no rows.  A
    source without a weight in ``weights`` is an error.  There may be any
    number of sources; those of equal weight are scheduled as one class, and a
    slot looks at each class.
    """
    if block_rows < 1 or stretch < 1:
        raise ValueError("block_rows and stretch must be positive")
    if weights is not None and not all(isfinite(v) and v > 0 for v in weights.values()):
        raise ValueError("weights must be positive")
    # Contiguous ranges of (source, id): even if one source holds most rows.  "at" has the range in its upper bits and the
    # place within it below; ranges are stored as their borders are sampled anew each time.
    ranges = ["source", "id", "tie"]
    rows = stored(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.struct("*").alias("row"))
                  .withColumn("tie", F.rand(7)).repartitionByRange(*ranges).sortWithinPartitions(*ranges)
                  .select("source", "row", F.monotonically_increasing_id().alias("at"))) \
        .withColumn("part", F.shiftright("at", 33))
    # At most one row for each range and source that meet: their numbers added up.
    runs = rows.groupBy("part", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("part").alias("run_part"), F.col("source").alias("run_source"), "first",
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # The rows themselves, which may be long, only join once it is known where they go.
    ranks = rows.select("source", "part", "at") \
        .hint("merge").join(runs, (F.col("part") == F.col("run_part")) & F.col("source").eqNullSafe(F.col("run_source"))) \
        .select(F.col("source").alias("rank_source"), (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "at")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(tempering)))
    else:
        given = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        weighed = counts.withColumn("w", F.coalesce(*given, F.raise_error(F.concat(
            F.lit("no weight is given for source "), F.coalesce(F.col("source").cast("string"), F.lit("null"))))))
    slots = _slots(weighed, block_rows, stretch)
    # Rows meet by sorting: no side is small enough to be sent.
    copies = slots.repartition("slot") \
        .withColumn("k", F.explode(F.expr(f"sequence(block * {block_rows}, (block + 1) * {block_rows} - 1)"))) \
        .select("source", "weight", F.expr("k DIV n").alias("epoch"), "block", F.expr("k % n").alias("turn"),
                F.expr(f"slot * {block_rows} + k % {block_rows}").alias("position"))
    placed = copies.hint("merge").join(ranks, F.col("source").eqNullSafe(F.col("rank_source")) & (F.col("turn") == F.col("rank"))) \
        .select("source", "weight", "epoch", "block", "position", "at")
    return placed.hint("merge").join(rows.select("at", "row"), "at").select("row", "source", "weight", "epoch", "block", "position")


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")) \
        .select("row.doc_id", "source", "weight", "epoch", "block", "position")


#: Slot by slot, with a number for each source: the schedule as its definition has it.
OP3_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*), {TEMPERING}) AS w FROM documents GROUP BY source),
rounded AS (SELECT *, greatest(round_even(w / sum(w) OVER () * {PARTS}, 0), 1)::bigint AS p FROM counts),
sources AS (SELECT source, n, (n + {BLOCK_ROWS} - 1) // {BLOCK_ROWS} AS blocks, (p + CASE WHEN row_number() OVER (ORDER BY p DESC, source NULLS FIRST) = 1
    THEN {PARTS} - sum(p) OVER () ELSE 0 END)::bigint AS q FROM rounded),
numbered AS (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS FIRST) AS i FROM sources),
listed AS (SELECT list(q ORDER BY i) AS qs, list(blocks ORDER BY i) AS bs FROM numbered),
edf(t, done, turn) AS (
    SELECT -1::bigint, list_transform((SELECT qs FROM listed), lambda x: 0::bigint), 0::bigint
    UNION ALL
    SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = nxt THEN d + 1 ELSE d END), nxt
    FROM (SELECT t, done, list_min(list_filter(list_transform(done, lambda d, i: CASE WHEN d * {PARTS} // qs[i] <= t + 1
            THEN ((d + 1) * {PARTS} + qs[i] - 1) // qs[i] * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS nxt
        FROM edf, listed WHERE len(list_filter(list_transform(done, lambda d, i: d < bs[i]), lambda x: x)) > 0)),
turns AS (SELECT turn AS i, t AS slot, row_number() OVER (PARTITION BY turn ORDER BY t) - 1 AS block FROM edf WHERE t >= 0),
given AS (SELECT source, n, q, block, slot * {BLOCK_ROWS} + o AS position, block * {BLOCK_ROWS} + o AS k
    FROM turns JOIN numbered USING (i), range({BLOCK_ROWS}) r(o)),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS r FROM documents)
SELECT doc_id, g.source, q / {PARTS} AS weight, k // n AS epoch, block, position
FROM given g JOIN ranked d ON d.source IS NOT DISTINCT FROM g.source AND d.r = k % n"""
