"""Files: rows by file and line, damaged rows, and what a job counts."""

import pytest

from waymatch import MatchConfig, kept_rows, merge, number_rows, prepare_base, read_checked, read_survey, rejects, run_merge_job

HEADER = "rec,latitude,longitude,chainage,lane,roadname\n"


def written(folder, name, lines, header=HEADER):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(header + "".join(lines))


def line(i, good=True):
    return f"{i},-27,{153 if good else 'n/a'},{i},1,A\n"


@pytest.fixture
def three_files(tmp_path):
    """A small file, a large one that is read first and in many splits, and one of which no row is kept but the last."""
    folder = tmp_path / "in"
    written(folder, "a.csv", [line(i) for i in range(5)])
    written(folder, "b.csv", [line(i, i % 3 != 0) for i in range(5, 3000)])
    written(folder, "c.csv", [line(i, i == 3009) for i in range(3000, 3010)])
    return folder


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_follow_files_and_lines(spark, three_files, small_splits):
    raw = read_survey(spark, str(three_files))
    assert raw.rdd.getNumPartitions() > 5
    got = {int(r.rec): r.row_number for r in number_rows(prepare_base(raw)).select("rec", "row_number").collect()}
    kept = [*range(5), *[i for i in range(5, 3000) if i % 3], 3009]
    assert got == {i: n for n, i in enumerate(kept)}


def test_rows_that_no_file_gave_are_numbered_too(spark):
    rows = spark.createDataFrame([(str(i), "-27", "153", str(i), "1", "A") for i in range(50)], HEADER.strip().replace(",", " string, ") + " string")
    numbered = number_rows(prepare_base(rows.repartition(3)))
    assert sorted(r.row_number for r in numbered.collect()) == list(range(50))
    assert number_rows(prepare_base(rows.limit(0))).count() == 0


def test_output_follows_the_files_without_a_key(spark, three_files, small_splits, tmp_path):
    supp = tmp_path / "points V1.0.0.3"
    written(supp, "s.csv", [f"{i},{i},1,A,x{i}\n" for i in range(0, 3010, 7)], "rec,chainage,lane,roadname,Filename\n")
    cfg = MatchConfig(strategy="blocked", enable_time=False, supp_columns=("Filename",))
    summary = run_merge_job(spark, str(three_files), str(supp), str(tmp_path), cfg)
    out = []
    for part in sorted((tmp_path / "LMD_MSD_Merged_V3.csv").glob("part-*.csv")):
        out += [int(x.split(",")[0]) for x in part.read_text().splitlines()[1:]]
    assert out == [*range(5), *[i for i in range(5, 3000) if i % 3], 3009]
    assert summary.counts == {"base_read": 3010, "base_kept": len(out), "supp_read": 430, "supp_kept": 430, "matched": len(out)}
    assert summary.rejected == {"base": 0, "supp": 0}
    assert summary.nulls["rec"] == 0 and set(summary.nulls) == {"rec", "latitude", "longitude", "chainage", "RoadName", "Lane", "Filename",
                                                                "chainage_diff_meters"}


def test_without_a_key_ties_go_to_the_first_line(spark, tmp_path):
    folder = tmp_path / "s"
    written(folder, "a.csv", ["1,10,1,A,first\n"], "rec,chainage,lane,roadname,Filename\n")
    written(folder, "b.csv", [f"{i},10,1,A,later\n" for i in range(500)], "rec,chainage,lane,roadname,Filename\n")
    base = spark.createDataFrame([("9", "-27", "153", "10", "1", "A")], HEADER.strip().replace(",", " string, ") + " string")
    cfg = MatchConfig(strategy="blocked", enable_time=False, supp_columns=("Filename",))
    assert merge(base, read_survey(spark, str(folder)), cfg).first().Filename == "first"


def test_damaged_rows_are_returned_and_counted(spark, tmp_path):
    folder = tmp_path / "in"
    bad = ["7,-27,153,7,1\n", "8,-27,153,8,1,A,more\n", "9\n"]
    written(folder, "a.csv", [line(1), bad[0], line(2), '3,-27,153,3,1,"A, B"\n'])
    written(folder, "b.csv", [*bad[1:], "4,-27,153,4,1,\n"])
    checked = read_checked(spark, str(folder))
    assert sorted(r.rec for r in kept_rows(checked).collect()) == ["1", "2", "3", "4"]
    assert kept_rows(checked).select("rec").count() == 4 and checked.count() == 7
    found = rejects(checked).collect()
    assert sorted(r.row + "\n" for r in found) == sorted(bad)
    assert {r.file.rsplit("/", 1)[1] for r in found if r.row.startswith("7")} == {"a.csv"}
    supp = tmp_path / "s"
    written(supp, "s.csv", ["1,1,1,A\n", "2,2,1\n"], "rec,chainage,lane,roadname\n")
    summary = run_merge_job(spark, str(folder), str(supp), str(tmp_path), MatchConfig(strategy="blocked", enable_time=False, supp_columns=("rec",)))
    assert summary.rejected == {"base": 3, "supp": 1} and summary.counts["base_read"] == 7 and summary.counts["supp_read"] == 2


def test_the_name_of_the_damaged_column_is_reserved(spark, tmp_path):
    written(tmp_path / "in", "a.csv", ["1,2\n"], "a,_damaged_row\n")
    with pytest.raises(ValueError, match="reserved"):
        read_checked(spark, str(tmp_path / "in"))
