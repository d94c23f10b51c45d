"""Target weights: less than a block of deviation, and no row left out."""

import random
from collections import Counter

import pytest

from llm.mixing import PARTS, mix


def docs_of(spark, sizes):
    rows = [(i, source, "z") for source, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, position string")


def check(found, sizes, block):
    found = sorted(found, key=lambda r: r.position)
    assert [r.position for r in found] == list(range(len(found)))
    weights = {r.source: r.weight for r in found}
    assert abs(sum(weights.values()) - 1) < 1e-9
    seen = Counter()
    for slot in range(len(found) // block):
        turn = {r.source for r in found[slot * block:(slot + 1) * block]}
        assert len(turn) == 1
        seen[turn.pop()] += 1
        for source, w in weights.items():
            assert abs(seen[source] - w * (slot + 1)) < 1
    times = Counter((r.source, r.row.doc_id) for r in found)
    assert set(times) == {(s, i) for s, n in sizes.items() for i in range(n)}
    assert Counter((r.source, r.row.doc_id) for r in found if r.epoch == 0) == Counter(dict.fromkeys(times, 1))
    for source, n in sizes.items():  # rows of a source by rank, epoch after epoch
        own = [r.epoch * n + r.row.doc_id for r in found if r.source == source]
        assert own == list(range(len(own)))


@pytest.mark.parametrize("sizes", [{"a": 200, "b": 90, "c": 10, None: 5}, {"one": 30}, {f"s{i}": 1 + i for i in range(25)}])
def test_default_weights(spark, sizes):
    check(mix(docs_of(spark, sizes), block_rows=4).collect(), sizes, 4)


def test_given_weights(spark):
    sizes = {"a": 100, "b": 40, "c": 7}
    found = mix(docs_of(spark, sizes), {"a": 1, "b": 1, "c": 2}, block_rows=2).collect()
    check(found, sizes, 2)
    assert {r.source: round(r.weight, 3) for r in found} == {"a": 0.25, "b": 0.25, "c": 0.5}


@pytest.mark.parametrize("sizes, weights", [({"a": 9, "b": 2400}, {"a": 1, "b": 3}), ({"a": 700, "b": 800, "tail": 1}, None),
                                            ({"hot": 2000} | {f"s{i}": 1 for i in range(300)}, {"hot": 300} | {f"s{i}": 2 for i in range(300)})])
def test_deviation_from_the_weights_given(spark, sizes, weights):
    found = mix(docs_of(spark, sizes), weights, block_rows=2).collect()
    check(found, sizes, 2)
    target = weights or {s: n ** 0.8 for s, n in sizes.items()}
    every, seen = sum(target.values()), Counter()
    for slot, first in enumerate(sorted(found, key=lambda r: r.position)[::2], 1):
        seen[first.source] += 1
        assert all(abs(seen[s] - slot * w / every) < 1 for s, w in target.items())


def plain_schedule(sizes, parts, block):
    """(source, its block) slot by slot by earliest deadline first, ties to the larger weight and then the first source."""
    order = sorted(sizes, key=lambda s: (-parts[s], s is not None, s or ""))
    done, slot = dict.fromkeys(order, 0), 0
    while any(done[s] * block < sizes[s] for s in order):
        ready = [s for s in order if done[s] * PARTS // parts[s] <= slot]
        turn = min(ready, key=lambda s: -(-(done[s] + 1) * PARTS // parts[s]))
        yield turn, done[turn]
        done[turn] += 1
        slot += 1


@pytest.mark.parametrize("seed", range(6))
def test_stretches_beside_each_other_make_one_schedule(spark, seed):
    """However short the stretches are, and with many sources of equal weight, the schedule is that of all slots in a row."""
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([1, 2, 3, 40, rng.randrange(1, 90)]) for i in range(rng.choice([2, 7, 25]))} | {None: 5}
    weights = {s: rng.choice([1, 1, 2, 3.7, 50]) for s in sizes}
    found = mix(docs_of(spark, sizes), weights, block_rows=2, stretch=rng.choice([1, 3, 10, 37])).collect()
    check(found, sizes, 2)
    parts = {r.source: round(r.weight * PARTS) for r in found}
    assert sum(parts.values()) == PARTS
    turns = [(r.source, r.block) for r in sorted(found, key=lambda r: r.position)[::2]]
    assert turns == list(plain_schedule(sizes, parts, 2))


def test_one_row_beside_very_many(spark):
    """The row of a small source comes by its weight, and one that is wanted all the time comes again and again."""
    docs = spark.range(40_001).selectExpr("id AS doc_id", "IF(id = 0, 'one', 'many') AS source")
    default = Counter(r.source for r in mix(docs, block_rows=1).select("source").collect())
    assert abs(default["one"] - sum(default.values()) / (1 + 40_000 ** 0.8)) < 1
    half = mix(docs, {"one": 1, "many": 2}, block_rows=1, stretch=5000).select("row.doc_id", "source", "position").collect()
    seen = 0
    for slot, r in enumerate(sorted(half, key=lambda r: r.position), 1):
        seen += r.source == "one"
        assert r.position == slot - 1 and abs(seen - slot / 3) < 1
    assert len({r.doc_id for r in half}) == 40_001


@pytest.mark.parametrize("sources", [5000, 0])
def test_many_sources(spark, sources):
    docs = spark.range(2 * sources).selectExpr("id AS doc_id", f"concat('s', id % {sources or 1}) AS source")
    found = mix(docs, block_rows=1).select("row.doc_id", "source", "weight", "position").collect()
    assert sorted(r.position for r in found) == list(range(len(found))) and {r.doc_id for r in found} == set(range(2 * sources))
    assert len({r.source for r in found}) == sources and all(abs(r.weight - 1 / sources) < 1e-8 for r in found)
    firsts = {r.source for r in found if r.position < sources}
    assert len(firsts) == sources


def test_many_sources_of_different_weights(spark):
    sizes = {f"s{i}": 1 + i % 40 for i in range(400)}
    check(mix(docs_of(spark, sizes), block_rows=4).collect(), sizes, 4)


def test_no_python_on_the_executors(spark):
    plan = mix(docs_of(spark, {"a": 20, "b": 3}))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "BroadcastHashJoin" not in plan.split("== Physical Plan ==")[0]


def test_weights_that_leave_rows_out(spark):
    with pytest.raises(ValueError):
        mix(docs_of(spark, {"a": 1}), {"a": 0})


def test_other_cases(spark):
    repeated = spark.createDataFrame([(1, "a", "x")] * 5 + [(None, "a", None), (2, None, "y")], "doc_id long, source string, epoch string")
    found = mix(repeated, block_rows=1).collect()
    assert Counter((r.row.doc_id, r.row.epoch) for r in found if r.epoch == 0) == Counter({(1, "x"): 5, (None, None): 1, (2, "y"): 1})
    assert mix(repeated.limit(0)).count() == 0
    with pytest.raises(Exception, match="no weight is given"):
        mix(repeated, {"a": 1.0}).collect()
