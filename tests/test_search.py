"""Every search against the plain-Python matcher, with copies and crowds."""

import random

import pytest

from tests import brute
from waymatch import (
    MatchConfig, blocked_pair_counts, cross_pair_count, match_pairs, merge, pair_volume, prepare_base,
    prepare_supp, range_join, rules_for,
)
from waymatch.operators import search
from waymatch.operators.intervals import best_interval
from waymatch.operators.rules import MatchRules

KEYS = {"base_key": "rec_id", "supp_key": "rec_id", "supp_columns": ("rec_id",)}

CASES = {
    "all rules": ("spatial", {}),
    "no road": ("spatial", {"enable_road": False}),
    "no time": ("spatial", {"enable_time": False}),
    "distance only": ("spatial", {"enable_road": False, "enable_time": False}),
    "road and time": ("blocked", {}),
    "road only": ("blocked", {"enable_time": False}),
    "forced road, time": ("blocked", {"enable_road": False}),
    "forced road": ("blocked", {"enable_road": False, "enable_time": False}),
    "lane and time": ("cross", {"enable_road": False}),
    "lane only": ("cross", {"enable_road": False, "enable_time": False}),
}


def matches(result):
    return {r["rec_id"]: r["rec_id_lmd"] for r in result.collect() if r["rec_id_lmd"] is not None}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("crowd", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, case, crowd):
    strategy, flags = CASES[case]
    monkeypatch.setattr(search, "CROWD", 8)     # so that small crowds are stepped into
    monkeypatch.setattr(search, "PAIRS", 30)    # and cut into parts
    base = brute.survey(120, f"b{case}", crowd=crowd)
    supp = brute.survey(150, f"s{case}", crowd=crowd)
    # A threshold of 20 rows makes nearly every bucket a hot one.
    cfg = MatchConfig(strategy=strategy, max_time_diff_s=3 if crowd else 60, max_chainage_diff_m=5,
                      hot_bucket_rows=20 if crowd else 2_000, **KEYS, **flags)
    result = merge(brute.as_base(spark, base), brute.as_supp(spark, supp), cfg)
    expected = brute.best(base, supp, rules_for(strategy, cfg, True))
    assert result.count() == len(base)
    assert matches(result) == expected
    assert expected


def test_buckets_are_cut_into_parts_and_shared(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 8)
    base, supp = brute.survey(100, 1), brute.survey(100, 2)
    cfg = MatchConfig(max_time_diff_s=60, hot_bucket_rows=2, **KEYS)
    result = merge(brute.as_base(spark, base), brute.as_supp(spark, supp), cfg)
    assert matches(result) == brute.best(base, supp, rules_for("spatial", cfg, True))


def test_one_moment_for_all_is_told_apart_by_distance(spark, monkeypatch):
    monkeypatch.setattr(search, "CROWD", 8)
    rng = random.Random(5)

    def rows(count):
        return [(i, "A", "L1", -27 + rng.uniform(0, 0.0005), 153 + rng.uniform(0, 0.0005), 7.0, 0)
                for i in range(count)]
    base, supp = rows(80), rows(90)
    cfg = MatchConfig(hot_bucket_rows=10, **KEYS)
    result = merge(brute.as_base(spark, base), brute.as_supp(spark, supp), cfg)
    assert matches(result) == brute.best(base, supp, rules_for("spatial", cfg, True))


def test_check_for_hot_buckets_can_be_skipped(spark):
    base, supp = brute.survey(60, 3), brute.survey(60, 4)
    cfg = MatchConfig(max_time_diff_s=60, hot_bucket_rows=None, **KEYS)
    result = merge(brute.as_base(spark, base), brute.as_supp(spark, supp), cfg)
    assert matches(result) == brute.best(base, supp, rules_for("spatial", cfg, True))


def test_generated_ids_give_the_same_partners(spark):
    base, supp = brute.survey(60, 3), brute.survey(60, 4)
    cfg = MatchConfig(max_time_diff_s=60, supp_columns=("rec_id",))
    result = merge(brute.as_base(spark, base), brute.as_supp(spark, supp), cfg)
    assert matches(result) == brute.best(base, supp, rules_for("spatial", cfg, True))


def test_limits_are_inclusive(spark):
    at = brute.stamp
    base = spark.createDataFrame([(1, "A", "L1", "0", "0", "10", "", "", at(0))], brute.BASE_SCHEMA)
    for seconds, chain, hit in ((10, "15", True), (10, "15.0001", False), (10.000001, "15", False)):
        supp = spark.createDataFrame(
            [(2, "A", "L1", "0", "0", chain, at(int(seconds * 1_000_000)))], brute.SUPP_SCHEMA)
        result = merge(base, supp, MatchConfig(**KEYS))
        assert (matches(result) == {1: 2}) is hit


def test_ties_go_to_the_nearer_then_the_lower_id(spark):
    at = brute.stamp(0)
    base = spark.createDataFrame([(1, "A", "L1", "0", "0", "10", "", "", at)], brute.BASE_SCHEMA)
    supp = [(5, "A", "L1", "0.0001", "0", "10", at), (9, "A", "L1", "0", "0", "10", at),
            (7, "A", "L1", "0", "0", "10", at)]
    result = merge(base, spark.createDataFrame(supp, brute.SUPP_SCHEMA), MatchConfig(**KEYS))
    assert matches(result) == {1: 7}


# --- intervals --------------------------------------------------------------

def intervals(count, seed, crowd=False):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        start = rng.uniform(0, 0.01 if crowd else 0.4)
        length = 0.02 if crowd else rng.choice([0.0, 0.01, 0.05, 0.3, 50.0, -0.01])
        road = "A" if crowd else rng.choice(["A", "B"])
        lanes = rng.choice(["ALL", "L1", "L1", "R1", "1"])
        first = "tbc" if rng.random() < 0.05 else f"{start:.4f}"
        rows.append((i, f"R{road}", rng.choice([None, "G"]), road, lanes, first, f"{start + length:.4f}"))
    return rows


@pytest.mark.parametrize("crowd", [False, True])
@pytest.mark.parametrize("strategy", ["range", "auto"])
def test_interval_search_equals_brute_force(spark, strategy, crowd):
    base_df = brute.as_base(spark, brute.survey(120, "i", crowd=crowd))
    rows = intervals(120, strategy, crowd)
    cfg = MatchConfig(strategy=strategy, hot_bucket_rows=20 if crowd else 2_000, **KEYS)
    result = merge(base_df, spark.createDataFrame(rows, brute.RANGE_SCHEMA), cfg)
    expected = brute.best_interval(base_df.collect(), rows, None if strategy == "range" else 5.0)
    assert matches(result) == expected
    assert expected
    assert "time_diff_seconds" not in result.columns


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_intervals_with_a_chainage_of_their_own(spark, seed):
    """The nearest chainage may lie inside, before or behind the interval; keys may be missing and ends may be equal or reversed."""
    rng = random.Random(seed)
    places = [round(rng.uniform(0, 50), 1) for _ in range(25)]
    some = lambda *values: rng.choice(values)
    base = [(i, some("A", "A", "B"), some("L1", "R1"), "-27", "153", repr(rng.choice(places)), some("1", None), some("G", None), brute.stamp(i))
            for i in range(150)]
    supp = []
    for j in range(300):
        low, high = rng.choice(places), rng.choice(places)
        if rng.random() < 0.8:
            low, high = min(low, high), max(low, high)
        supp.append((j, some("1", None), some("G", None), some("A", "A", "B"), some("ALL", "L1"), repr(low / 1000), repr(high / 1000),
                     repr(rng.choice([low, round(rng.uniform(-10, 60), 1)]))))
    frames = (spark.createDataFrame(base, brute.BASE_SCHEMA), spark.createDataFrame(supp, brute.RANGE_SCHEMA + ", chainage string"))
    found = matches(merge(*frames, MatchConfig(strategy="range", **KEYS)))
    want = {}
    for i, road, lane, _, _, c, road_id, region, _ in base:
        options = [(abs(float(c) - float(own)), j) for j, road_id2, region2, road2, lanes, low, high, own in supp
                   if (road_id, region, road) == (road_id2, region2, road2) and lanes in ("ALL", lane)
                   and float(low) * 1000 <= float(c) <= float(high) * 1000]
        if options:
            want[i] = min(options)[1]
    assert found == want and len(want) > 100


def test_overlap_makes_no_pairs(spark):
    """Intervals that all lie over each other leave as many rows as ones that lie apart: a few a cell."""
    def cells(length):
        points = spark.range(2_000).selectExpr("'A' AS b_road", "double(id) AS b_chain")
        intervals = spark.range(2_000).selectExpr("'A' AS s_road", "double(id) AS s_chain", "double(id) AS s_start", f"double(id + {length}) AS s_end", "id AS s_id")
        rules = MatchRules(equal=("road",), inside_interval=True, rank="chain")
        best = best_interval(points, intervals, rules)
        joins = best._jdf.queryExecution().toString()
        assert "Inequality" not in joins and "NestedLoop" not in joins and "Cartesian" not in joins
        return {r.b_chain: r.s_id for r in best.collect()}
    assert cells(0.5) == cells(100_000) == {float(i): i for i in range(2_000)}


def test_interval_ends_and_spellings(spark):
    base = spark.createDataFrame(
        [(c, "A", "L1", "0", "0", str(c), "R", "G", brute.stamp(0)) for c in (999, 1000, 2000, 2001)],
        brute.BASE_SCHEMA)
    rows = [(1, "R", "G", "A", "ALL", "1", " 0_2.0 "), (2, "R", "G", "A", "L1", "2", "1"),
            (3, "R", "G", "A", "L1", "nan", "5"), (4, "R", "G", "A", " L1", "0", "9")]
    result = merge(base, spark.createDataFrame(rows, brute.RANGE_SCHEMA), MatchConfig(strategy="range", **KEYS))
    assert matches(result) == {1000: 1, 2000: 1}


def test_range_join_pairs_missing_keys(spark):
    base = prepare_base(spark.createDataFrame(
        [(1, "A", "L1", "0", "0", "1500", None, None, brute.stamp(0))], brute.BASE_SCHEMA), "rec_id")
    supp = prepare_supp(spark.createDataFrame(
        [(1, None, None, "A", "ALL", "1", "2"), (2, "R", None, "A", "ALL", "1", "2")],
        brute.RANGE_SCHEMA), "rec_id")
    rows = range_join(base, supp).collect()
    assert [(r["supp_id"], r["lane_supp"], r["start_m"], r["end_m"]) for r in rows] == [(1, "ALL", 1000.0, 2000.0)]


def test_intervals_without_their_own_lane_use_the_lane_column(spark):
    base = spark.createDataFrame(
        [(1, "A", "L1", "0", "0", "1500", "R", "G", brute.stamp(0))], brute.BASE_SCHEMA)
    supp = spark.createDataFrame(
        [(1, "R", "G", "A", "L1", "1", "2")],
        "rec_id long, road_id string, region_id string, roadname string, lane string, "
        "`Start Chainage (km)` string, `End Chainage (km)` string")
    assert matches(merge(base, supp, MatchConfig(strategy="range", **KEYS))) == {1: 1}


# --- pairs ------------------------------------------------------------------

def test_pair_counts_without_pairs(spark):
    base, supp = brute.survey(50, 7), brute.survey(40, 8)
    b = prepare_base(brute.as_base(spark, base), "rec_id")
    s = prepare_supp(brute.as_supp(spark, supp), "rec_id")
    row = cross_pair_count(b, s).first()
    assert (row["base_rows"], row["supp_rows"], int(row["pairs"])) == (50, 40, 2000)
    expected = sum((r[1], r[2]) == (q[1], q[2]) for r in base for q in supp)
    assert sum(int(r["pairs"]) for r in blocked_pair_counts(b, s).collect()) == expected


@pytest.mark.parametrize("crowd", [False, True])
@pytest.mark.parametrize("strategy, flags", [("cross", {"enable_road": False}), ("cross", {"enable_road": False, "enable_time": False}),
                                             ("blocked", {"enable_road": False}), ("blocked", {"enable_time": False}), ("blocked", {})])
def test_pair_volume_equals_all_pairs(spark, strategy, flags, crowd):
    """Copies count as often as they come, limits include their ends, and a crowd in one key is spread over parts."""
    base, supp = brute.survey(90, 5, crowd=crowd), brute.survey(110, 6, crowd=crowd)
    cfg = MatchConfig(strategy=strategy, max_time_diff_s=2, **flags)
    rules = rules_for(strategy, cfg, True)
    frames = prepare_base(brute.as_base(spark, base)), prepare_supp(brute.as_supp(spark, supp))
    got = pair_volume(*frames, cfg).first()
    block = lambda b, s: strategy == "cross" or b[1:3] == s[1:3]
    assert got.candidates == sum(block(b, s) for b in base for s in supp)
    if len(rules.values) > 1:
        assert got.filtered is None
        return
    passed = 0
    for b in base:
        for s in supp:
            road = b[1] == s[1] and ("road" in rules.same or b[1] is not None) or "road" not in rules.keys
            time = rules.max_time_s is None or abs(b[6] - s[6]) <= rules.max_time_s * 1_000_000
            passed += b[2] == s[2] and road and time
    assert got.filtered == passed


def test_pair_volume_of_intervals(spark):
    rng = random.Random(3)
    base = [(i, "A", "L1", "-27", "153", repr(rng.randrange(60) / 2), "1", rng.choice(["G", None]), brute.stamp(i)) for i in range(100)]
    supp = [(j, "1", rng.choice(["G", None]), "A", rng.choice(["ALL", "L1", "R1"]), repr(rng.randrange(30) / 1000), repr(rng.randrange(30) / 1000))
            for j in range(100)]
    frames = prepare_base(spark.createDataFrame(base, brute.BASE_SCHEMA)), prepare_supp(spark.createDataFrame(supp, brute.RANGE_SCHEMA))
    got = pair_volume(*frames, MatchConfig(strategy="range")).first()
    inside = [(b, s) for b in base for s in supp if b[7] == s[2] and float(s[5]) * 1000 <= float(b[5]) <= float(s[6]) * 1000]
    assert got.candidates == len(inside) and got.filtered == sum(s[4] != "R1" for _, s in inside)
    with pytest.raises(ValueError, match="spatial"):
        pair_volume(*frames, MatchConfig())


def test_unlimited_pairs_are_refused(spark):
    b = prepare_base(brute.as_base(spark, brute.survey(3, 7)), "rec_id")
    s = prepare_supp(brute.as_supp(spark, brute.survey(3, 8)), "rec_id")
    for strategy, flags in (("blocked", {"enable_time": False}), ("cross", {"enable_road": False, "enable_time": False})):
        rules = rules_for(strategy, MatchConfig(strategy=strategy, **flags), True)
        with pytest.raises(ValueError, match="tolerance"):
            match_pairs(b, s, rules)


def crowd(n, low, high, seed):
    """Rows on one road and lane within half a minute and a metre, between two chainages."""
    rng = random.Random(seed)
    return [(i, "A", "L1", -27 + rng.uniform(0, 1e-5), 153 + rng.uniform(0, 1e-5), rng.uniform(low, high), rng.randrange(30_000_000))
            for i in range(n)]


@pytest.mark.parametrize("lows", [(0, 10), (0, 6), (0, 0)])
def test_crowds_that_match_nothing_in_part_or_wholly(spark, monkeypatch, lows):
    monkeypatch.setattr(search, "PAIRS", 200)
    base, supp = crowd(150, lows[0], lows[0] + 4, 1), crowd(160, lows[1], lows[1] + 9, 2)
    cfg = MatchConfig(hot_bucket_rows=20, **KEYS)
    result = merge(brute.as_base(spark, base), brute.as_supp(spark, supp), cfg)
    assert matches(result) == brute.best(base, supp, rules_for("spatial", cfg, True))


def test_only_hot_buckets_leave_the_plain_path(spark, monkeypatch):
    seen = []
    climb = search._climb
    monkeypatch.setattr(search, "_climb", lambda base, supp, rules, hot: seen.append(base.count()) or climb(base, supp, rules, hot))
    base, supp = brute.survey(100, 1), brute.survey(100, 2)
    hot_base, hot_supp = crowd(60, 50_000, 50_004, 3), crowd(60, 50_000, 50_004, 4)
    base += [(1000 + x[0], "Z", *x[2:]) for x in hot_base]
    supp += [(1000 + x[0], "Z", *x[2:]) for x in hot_supp]
    cfg = MatchConfig(hot_bucket_rows=40, **KEYS)
    result = merge(brute.as_base(spark, base), brute.as_supp(spark, supp), cfg)
    assert matches(result) == brute.best(base, supp, rules_for("spatial", cfg, True))
    assert seen == [60]
