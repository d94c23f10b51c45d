"""Crowds and long intervals leave no more rows than they must, and nothing is cleaned twice."""

import os

import pytest

import __spark_entry__ as entry
from tests import brute
from waymatch import MatchConfig, prepare_sides, rules_for
from waymatch.operators import search
from waymatch.operators.intervals import best_interval
from waymatch.operators.rules import MatchRules, base_points, supp_points
from waymatch.plans import merge as plan

SF = "/root/testdata/sf0.001"
KEYS = {"base_key": "rec_id", "supp_key": "rec_id", "supp_columns": ("rec_id",)}


def crowd(n):
    """Rows at one moment within a metre of each other."""
    return [(i, "A", "L1", -27.0 + i * 1e-9, 153.0, i * 1e-6, 1_000_000) for i in range(n)]


def test_copies_to_fine_cells_do_not_grow_with_a_crowd(spark):
    """A crowd in one cell and at one moment is copied to the cells around it as one row."""
    rules = rules_for("spatial", MatchConfig(), True)

    def copies(n):
        base, supp = prepare_sides(brute.as_base(spark, crowd(n)), brute.as_supp(spark, crowd(n)), MatchConfig(**KEYS))
        _, near, _ = search._fine_cells(base_points(base, rules), supp_points(supp, rules), rules)
        return near.count()
    assert copies(40) == copies(4) == 27


def test_tasks_of_a_crowd_follow_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 100)
    rules = MatchRules(equal=("lane",), rank="time", max_time_s=1, max_dist_m=10)
    base = spark.range(64).selectExpr("IF(id % 16 < 8, 'L1', 'R1') AS b_lane", "id AS b_time", "0D AS b_lat", "0D AS b_lon", "id % 8 AS b_slot")
    supp = spark.range(64).selectExpr("IF(id % 16 < 8, 'L1', 'R1') AS s_lane", "id AS s_time", "0D AS s_lat", "0D AS s_lon", "id AS s_id", "id % 8 AS s_slot")
    cells = search._counted(base, supp, rules, ["slot"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = search._even_top(base, supp, rules, ["slot"], cells)
        assert best.rdd.getNumPartitions() == 6     # sixteen cells of 16 pairs, 50 a task
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.b_time: r.s_id for r in best.collect()} == {i: i for i in range(64)}


def test_ids_of_the_supplement_are_numbers_in_the_order_of_their_keys(spark):
    rows = [(k, "A", "L1", "-27", "153", "5", brute.stamp(0)) for k in ("b", "10", "9", None, "a", "9")]
    supp = spark.createDataFrame(rows, "rec_id string, roadname string, lane string, lat string, lon string, chainage string, TestDateUTC string")
    _, kept = prepare_sides(brute.as_base(spark, crowd(1)), supp, MatchConfig(**KEYS))
    assert dict(kept.dtypes)["_m_id"] == "bigint"
    assert [(r["_m_id"], r["rec_id"]) for r in kept.orderBy("_m_id").collect()] == list(enumerate(["9", "9", "10", None, "a", "b"]))


@pytest.mark.parametrize("shift", [0, -(1 << 40), 1 << 62])
def test_best_intervals_without_a_sort(spark, shift):
    """Equal chainages go to the lower id, a missing one first, whatever the size of the ids."""
    points = spark.createDataFrame([("A", 5.0), ("A", 20.0), ("A", 50.0), (None, 5.0)], "b_road string, b_chain double")
    rows = [("A", 4.0, 0.0, 10.0, 2), ("A", 4.0, 4.0, 30.0, 3), ("A", 6.0, 0.0, 5.0, 1), ("A", 30.0, 20.0, 25.0, 5), ("A", 30.0, 0.0, 30.0, 4), (None, 5.0, 0.0, 9.0, None)]
    intervals = spark.createDataFrame([(*r[:4], r[4] if r[4] is None else r[4] + shift) for r in rows],
                                      "s_road string, s_chain double, s_start double, s_end double, s_id long")
    best = best_interval(points, intervals, MatchRules(equal=(), same=("road",), inside_interval=True, rank="chain"))
    assert "SortAggregate" not in best._jdf.queryExecution().toString()
    assert {(r.b_road, r.b_chain): r.s_id for r in best.collect()} == {("A", 5.0): 1 + shift, ("A", 20.0): 4 + shift, (None, 5.0): None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_limits_share_one_cleaning(spark, monkeypatch):
    cleaned, merged = [], []
    clean, whole = plan.prepare_base, entry.merge
    monkeypatch.setattr(plan, "prepare_base", lambda *a, **k: cleaned.append(1) or clean(*a, **k))
    monkeypatch.setattr(entry, "merge", lambda *a, **k: merged.append(1) or whole(*a, **k))
    entry.parameter_ranges(spark, SF)
    assert (len(cleaned), len(merged)) == (1, 5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_volumes_read_cleaned_tables(spark):
    """No kind of volume cleans the raw tables again."""
    assert not [f for f in entry.pair_volumes(spark, SF).inputFiles() if "/survey-" in f]
