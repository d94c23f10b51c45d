"""Result columns, reports, strategy choice and the job on files."""

import csv
import glob
import warnings

import pytest

from tests import brute
from waymatch import (
    DEFAULT_SUPP_COLUMNS, ESSENTIAL_SUPP_COLUMNS, MatchConfig, coverage, match_report, merge,
    null_counts, plan_names, prepare_base, prepare_supp, preview, read_survey, run_merge_job,
    write_merged,
)
from waymatch.operators.rules import rules_for
from waymatch.plans.strategy import decide
from waymatch.sources.csv import as_text, file_version, output_path

AT = brute.stamp(0)


def one_each(spark, base_extra="", supp_extra="", base_values=(), supp_values=()):
    base = spark.createDataFrame(
        [(1, "A", "L1", "0", "0", "10", "R", "G", AT, *base_values),
         (2, "B", "L1", "0", "0", "10", "R", "G", AT, *base_values)], brute.BASE_SCHEMA + base_extra)
    supp = spark.createDataFrame([(7, "A", "1", "0", "0", "12.5", AT, *supp_values)],
                                 brute.SUPP_SCHEMA + supp_extra)
    return base, supp


# --- names ------------------------------------------------------------------

def test_names_without_conflict_stay():
    assert plan_names(["a", "b"], {"a", "b"}, ["x"], "_lmd") == {"a": "a", "b": "b"}


def test_conflicts_count_up_until_free():
    assert plan_names(["x"], {"x"}, ["x", "x_lmd", "x_lmd2"], "_lmd") == {"x": "x_lmd3"}


def test_repeats_and_unknown_names():
    assert plan_names(["a", "a", "nosuch"], {"a"}, [], "_lmd") == {"a": "a"}


def test_names_chosen_earlier_are_taken():
    assert plan_names(["x", "x_lmd"], {"x", "x_lmd"}, ["x"], "_lmd") == {"x": "x_lmd", "x_lmd": "x_lmd_lmd"}


def test_letter_case_matters_only_where_it_does_in_spark():
    assert plan_names(["lane"], {"lane"}, ["Lane"], "_s", sensitive=False) == {"lane": "lane_s"}
    assert plan_names(["lane"], {"lane"}, ["Lane"], "_s", sensitive=True) == {"lane": "lane"}


def test_default_lists():
    assert len(DEFAULT_SUPP_COLUMNS) == len(set(DEFAULT_SUPP_COLUMNS)) == 102
    assert len(ESSENTIAL_SUPP_COLUMNS) == 7


# --- assembly ---------------------------------------------------------------

def test_every_base_row_is_kept_and_unmatched_ones_have_nulls(spark):
    base, supp = one_each(spark, supp_extra=", Filename string", supp_values=("f",))
    cfg = MatchConfig(supp_columns=("Filename", "Lane"), base_key="rec_id", supp_key="rec_id")
    out = merge(base, supp, cfg)
    assert out.columns == ["rec_id", "RoadName", "Lane", "latitude", "longitude", "chainage", "road_id",
                           "region_id", "TestDateUTC", "Filename", "Lane_lmd", "time_diff_seconds",
                           "chainage_diff_meters"]
    rows = {r["rec_id"]: r for r in out.collect()}
    assert (rows[1]["Filename"], rows[1]["Lane_lmd"], rows[1]["time_diff_seconds"],
            rows[1]["chainage_diff_meters"]) == ("f", "L1", 0, 2.5)
    assert rows[2][-4:] == (None, None, None, None)


def test_copies_of_a_base_row_all_get_the_match(spark):
    base, supp = one_each(spark)
    cfg = MatchConfig(supp_columns=("rec_id",), base_key="rec_id", supp_key="rec_id")
    out = merge(base.union(base).union(base), supp, cfg)
    assert sorted(r["rec_id_lmd"] or 0 for r in out.collect()) == [0, 0, 0, 7, 7, 7]


def test_case_sensitive_sessions_keep_raw_and_cleaned_columns(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        base, supp = one_each(spark, ", Lat string", ", Lat string", ("raw",), ("other",))
        cfg = MatchConfig(supp_columns=("Lane", "Lat"), base_key="rec_id", supp_key="rec_id",
                          base_map={"lat": "latitude"}, supp_map={"lat": "lat"})
        out = merge(base, supp, cfg)
        row = {r["rec_id"]: r for r in out.collect()}[1]
        assert (row["lane"], row["Lane"], row["Lane_lmd"], row["Lat"], row["Lat_lmd"]) == (
            "L1", "L1", "L1", "raw", "other")
        assert (row["roadname"], row["RoadName"]) == ("A", "A")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_odd_column_names(spark):
    base, supp = one_each(spark, ", `a.b c` string", ", `d.e``f` string", ("p",), ("q",))
    cfg = MatchConfig(supp_columns=("d.e`f",), base_key="rec_id", supp_key="rec_id")
    row = {r["rec_id"]: r for r in merge(base, supp, cfg).collect()}[1]
    assert (row["a.b c"], row["d.e`f"]) == ("p", "q")


def test_raw_columns_named_like_internal_ones(spark):
    names = ", p_time string, b_lane string, s_id string, gap string"
    base, supp = one_each(spark, names, names, ("1", "2", "3", "4"), ("5", "6", "7", "8"))
    cfg = MatchConfig(supp_columns=("s_id", "gap"), base_key="rec_id", supp_key="rec_id")
    row = {r["rec_id"]: r for r in merge(base, supp, cfg).collect()}[1]
    assert [row[c] for c in ("p_time", "b_lane", "s_id", "gap", "s_id_lmd", "gap_lmd")] == list("123478")
    with pytest.raises(ValueError, match="reserved"):
        prepare_base(base.withColumnRenamed("p_time", "_m_time"))


def test_legacy_drop_and_distance(spark):
    base, supp = one_each(spark)
    keys = {"base_key": "rec_id", "supp_key": "rec_id", "supp_columns": ("Lane", "RoadName")}
    out = merge(base, supp, MatchConfig(legacy_drop=True, **keys))
    assert not {"Lane_lmd", "RoadName_lmd"} & set(out.columns)
    out = merge(base, supp, MatchConfig(include_distance=True, **keys))
    assert {r["rec_id"]: r["spatial_dist_m"] for r in out.collect()} == {1: 0.0, 2: None}


def test_without_time_on_one_side(spark):
    base, supp = one_each(spark)
    cfg = MatchConfig(supp_columns=("rec_id",), base_key="rec_id", supp_key="rec_id")
    out = merge(base, supp.drop("TestDateUTC"), cfg)
    assert "time_diff_seconds" not in out.columns
    assert {r["rec_id"]: r["chainage_diff_meters"] for r in out.collect()} == {1: 2.5, 2: None}


@pytest.mark.parametrize("drop, side", [("lane", "base"), ("roadname", "base"), ("lane", "supplement")])
def test_missing_columns_are_named(spark, drop, side):
    base, supp = one_each(spark)
    base, supp = (base.drop(drop, "road_id"), supp) if side == "base" else (base, supp.drop(drop))
    with pytest.raises(ValueError, match=f"{side} table lacks {'road' if 'road' in drop else 'lane'}"):
        merge(base, supp, MatchConfig(base_key="rec_id", supp_key="rec_id"))


def test_range_needs_its_columns(spark):
    base, supp = one_each(spark)
    with pytest.raises(ValueError, match="road_id, region_id, Start Chainage"):
        merge(base, supp, MatchConfig(strategy="range", base_key="rec_id", supp_key="rec_id"))


# --- parameters -------------------------------------------------------------

def test_parameters_are_checked():
    for bad in ({"max_time_diff_s": 0}, {"max_distance_m": float("inf")}, {"strategy": "best"}):
        with pytest.raises(ValueError):
            MatchConfig(**bad)
    with pytest.warns(UserWarning, match="max_distance_m"):
        MatchConfig(max_distance_m=5000)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        MatchConfig(max_time_diff_s=300, max_chainage_diff_m=0.1, max_distance_m=1000)


@pytest.mark.parametrize("spatial, road, coordinates, intervals, expected", [
    (True, True, True, True, "spatial"),
    (True, True, False, True, "range"),
    (True, False, False, False, "blocked"),
    (False, True, True, False, "blocked"),
    (False, False, True, False, "cross"),
    (False, False, False, False, "cross"),
    (False, False, False, True, "range"),
])
def test_strategy_choice(spatial, road, coordinates, intervals, expected):
    cfg = MatchConfig(strategy="auto", enable_spatial=spatial, enable_road=road)
    assert decide(cfg, coordinates, intervals) == expected


def test_auto_without_coordinates_uses_the_road(spark):
    base, supp = one_each(spark)
    cfg = MatchConfig(strategy="auto", supp_columns=("rec_id",), base_key="rec_id", supp_key="rec_id")
    out = merge(base, supp.drop("lat", "lon"), cfg)
    assert {r["rec_id"]: r["rec_id_lmd"] for r in out.collect()} == {1: 7, 2: None}


# --- reports and files ------------------------------------------------------

def test_reports(spark):
    base, supp = one_each(spark)
    cfg = MatchConfig(supp_columns=("rec_id",), base_key="rec_id", supp_key="rec_id")
    out = merge(base, supp, cfg)
    row = match_report(out).first()
    assert row.asDict() == {
        "base_rows": 2, "matched_rows": 1, "match_rate_pct": 50.0,
        "min_time_diff_s": 0, "avg_time_diff_s": 0.0, "max_time_diff_s": 0,
        "min_chainage_diff_m": 2.5, "avg_chainage_diff_m": 2.5, "max_chainage_diff_m": 2.5}
    nulls = {r["column_name"]: r["nulls"] for r in null_counts(out).collect()}
    assert nulls["rec_id_lmd"] == 1 and nulls["rec_id"] == 0
    sides = {r["side"]: (r["rows"], r["with_lat"]) for r in coverage(
        prepare_base(base), prepare_supp(supp.drop("lat"))).collect()}
    assert sides == {"base": (2, 2), "supplement": (1, 0)}
    assert preview(out, 1).count() == 1


def write_rows(path, schema, rows):
    names = [part.rsplit(" ", 1)[0].strip("` ") for part in schema.split(", ")]
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([names, *rows])


def read_rows(path):
    lines = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="") as f:
            lines += list(csv.DictReader(f))
    return lines


def test_job_on_files(spark, tmp_path):
    base, supp = brute.survey(60, 3), brute.survey(60, 4)
    base_path, supp_path = str(tmp_path / "base.csv"), str(tmp_path / "points V1.0.0.12.csv")
    write_rows(base_path, brute.BASE_SCHEMA,
               [(i, f"  {r} " if r else "", lane, y, x, c, "R", 'say "hi", twice', brute.stamp(t))
                for i, r, lane, y, x, c, t in base])
    write_rows(supp_path, brute.SUPP_SCHEMA,
               [(i, r or "", lane, y, x, c, brute.stamp(t)) for i, r, lane, y, x, c, t in supp])
    cfg = MatchConfig(max_time_diff_s=60, supp_columns=("rec_id",))
    summary = run_merge_job(spark, base_path, supp_path, cfg=cfg)
    assert summary.path == str(tmp_path / "LMD-MSD_Merged" / "LMD_MSD_Merged_V12.csv")
    expected = brute.best(base, supp, rules_for("spatial", cfg, True))
    rows = read_rows(summary.path)
    assert [int(r["rec_id"]) for r in rows] == [b[0] for b in base]       # base order
    assert {int(r["rec_id"]): int(r["rec_id_lmd"]) for r in rows if r["rec_id_lmd"]} == expected
    assert {r["region_id"] for r in rows} == {'say "hi", twice'}
    assert (summary.report["base_rows"], summary.report["matched_rows"]) == (60, len(expected))
    assert summary.strategy == "spatial"
    back = read_survey(spark, summary.path)
    assert back.count() == 60

    # A second run replaces the first.
    again = run_merge_job(spark, base_path, supp_path, str(tmp_path), cfg)
    assert read_rows(again.path) == rows
    assert summary.counts == {"base_read": 60, "base_kept": 60, "supp_read": len(supp), "supp_kept": len(supp), "matched": len(expected)}


def test_nothing_is_written_without_a_match(spark, tmp_path):
    write_rows(tmp_path / "b.csv", brute.BASE_SCHEMA, [(1, "A", "L1", 0, 0, 1, "R", "G", AT)])
    write_rows(tmp_path / "s.csv", brute.SUPP_SCHEMA, [(1, "A", "L1", 50, 50, 1, AT)])
    out = run_merge_job(spark, str(tmp_path / "b.csv"), str(tmp_path / "s.csv"))
    assert out is None
    assert not (tmp_path / "LMD-MSD_Merged").exists()


def test_blanks_and_nested_values_survive_the_file(spark, tmp_path):
    df = spark.sql("SELECT ' a ' AS v, array(1, 2) AS w")
    path = write_merged(df, str(tmp_path / "out"))
    assert read_rows(path) == [{"v": " a ", "w": "[1, 2]"}]
    assert dict(as_text(df).dtypes) == {"v": "string", "w": "string"}


def test_paths():
    assert file_version("/x/V1.0.0.345/lmd.csv") == "345"
    assert file_version("/x/V1.0.1.3.csv") == "unknown"
    assert output_path("/d/base.csv", "s.csv", "/out") == "/out/LMD_MSD_Merged_Vunknown.csv"


# --- keys and limits ---------------------------------------------------------

def keyed(spark, key):
    """Sixty rows a side, matched one to one, under keys made by ``key``."""
    base = spark.createDataFrame(
        [(i, key(i), "A", "L1", "0", "0", str(100 * i), AT) for i in range(60)],
        "n long, k string, roadname string, lane string, latitude string, longitude string, chainage string, TestDateUTC string")
    supp = spark.createDataFrame(
        [(i, key(i), "A", "L1", "0", "0", str(100 * i), AT) for i in range(60)],
        "m long, k string, roadname string, lane string, lat string, lon string, chainage string, TestDateUTC string")
    return base, supp


@pytest.mark.parametrize("key", [
    lambda i: None if i % 2 else str(i), lambda i: str(i // 2), lambda i: f"key {i % 7}", lambda i: None])
def test_keys_neither_lose_nor_multiply_rows(spark, key):
    base, supp = keyed(spark, key)
    out = merge(base, supp, MatchConfig(supp_columns=("m",), base_key="k", supp_key="k")).collect()
    assert sorted((r["n"], r["m"]) for r in out) == [(i, i) for i in range(60)]


def test_keys_decide_ties_by_number_then_text(spark):
    base, _ = one_each(spark)
    rows = [(k, "A", "1", "0", "0", "12.5", AT) for k in ("b", "10", "9", None, "a")]
    supp = spark.createDataFrame(rows, brute.SUPP_SCHEMA.replace("rec_id long", "rec_id string"))
    out = merge(base, supp, MatchConfig(supp_columns=("rec_id",), base_key="rec_id", supp_key="rec_id"))
    assert {r["rec_id"]: r["rec_id_lmd"] for r in out.collect()} == {1: "9", 2: None}


def test_time_limit_is_rounded():
    for ms in (8_200, 1_001, 4_100, 299_999):
        assert rules_for("spatial", MatchConfig(max_time_diff_s=ms / 1000), True).max_time_us == ms * 1000
