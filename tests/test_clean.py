import math

import pytest
from pyspark.sql import functions as F

from waymatch import prepare_base, prepare_supp, supp_catalogue
from waymatch.functions.text import lane_code, lenient_double, spoken_double, strip, survey_micros
from waymatch.operators.prepare import find_column

FEB_FIRST = 1706781600_000000      # 2024-02-01 10:00:00


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", expression(df).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


@pytest.mark.parametrize("text, expected", [
    ("01/02/24 10:00:00", FEB_FIRST),
    ("1/2/24 10:00:00.5", FEB_FIRST + 500_000),
    ("01/02/2024 10:00:00", FEB_FIRST),
    ("01/02/2024 10:00:00.125", FEB_FIRST + 125_000),
    ("2024-02-01T10:00:00Z", FEB_FIRST),
    ("2024-02-01T10:00:00.1234567Z", FEB_FIRST + 123_456),
    ("10/03/2024 02:30:00", 1710037800_000000),     # a time New York skips
    ("2024-02-01T10:00:00", None),
    ("2024-02-01T10:00:00+05:00", None),
    ("31/02/2024 10:00:00", None),
    (" 01/02/24 10:00:00", None),
    ("bad", None), ("", None), (None, None),
])
def test_survey_times(spark, text, expected):
    assert column(spark, [text], lambda df: survey_micros(df, "v", F.col("v"))) == [expected]


def test_typed_times(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-02-01 10:00:00' AS v")
    assert df.select(survey_micros(df, "v", F.col("v"))).first()[0] == FEB_FIRST
    df = spark.sql("SELECT timestamp'2024-02-01 10:00:00+00:00' AS v")
    assert df.select(survey_micros(df, "v", F.col("v"))).first()[0] == FEB_FIRST


def test_numbers(spark):
    texts = ["1.5", "-2", ".5", "5.", "1e3", "1.5d", " 1.5 ", "1_000", "n/a", "", None]
    got = column(spark, texts, lambda df: lenient_double(df, "v", F.col("v")))
    assert got == [1.5, -2.0, 0.5, 5.0, 1000.0, None, None, None, None, None, None]
    got = column(spark, texts, lambda df: spoken_double(F.col("v")))
    assert got == [1.5, -2.0, 0.5, 5.0, 1000.0, None, 1.5, 1000.0, None, None, None]
    special = column(spark, ["nan", "Infinity", "-inf"], lambda df: lenient_double(df, "v", F.col("v")))
    assert math.isnan(special[0]) and special[1:] == [math.inf, -math.inf]


def test_strip_and_lane(spark):
    texts = [" a\t", "\n b c ", "　x", None]
    assert column(spark, texts, lambda df: strip(F.col("v"))) == ["a", "b c", "x", None]
    lanes = ["1", " 2 ", "L1", "3", "ALL", None]
    assert column(spark, lanes, lambda df: lane_code(F.col("v"))) == ["L1", "L2", "L1", "3", "ALL", None]


def test_alias_priority(spark):
    df = spark.createDataFrame([("a", "b", "c")], "Road_ID string, RoadName string, LAT string")
    assert find_column(df, ("roadname", "road_id")) == "RoadName"
    assert find_column(df, ("road_id", "roadname")) == "Road_ID"
    assert find_column(df, ("lat",)) == "LAT"
    assert find_column(df, ("lon",)) is None


def test_base_rows_kept(spark):
    rows = [("r", "1", "1", "2", "3", "2024-02-01T10:00:00Z"),
            ("r", "X9", "1", "2", "3", "2024-02-01T10:00:00Z"),
            ("r", None, "1", "2", "3", "2024-02-01T10:00:00Z"),
            ("r", "R1", "x", "2", "3", "2024-02-01T10:00:00Z"),
            ("r", "R1", "1", "2", None, "2024-02-01T10:00:00Z"),
            ("r", "R1", "1", "2", "3", "never"),
            (None, "LSK1", "1", "2", "3", "01/02/24 10:00:00")]
    df = spark.createDataFrame(
        rows, "road string, lane_id string, Lat string, lon string, chain string, TestDateUTC string")
    kept = prepare_base(df).select("_m_road", "_m_lane", "_m_chain", "_m_time", "Lat").collect()
    assert sorted(kept, key=lambda r: r["_m_lane"]) == [
        ("r", "L1", 3.0, FEB_FIRST, "1"), (None, "LSK1", 3.0, FEB_FIRST, "1")]


def test_base_needs_position_and_chainage(spark):
    with pytest.raises(ValueError, match="lon"):
        prepare_base(spark.createDataFrame([("1", "1")], "lat string, chainage string"))
    with pytest.raises(ValueError, match="chainage"):
        prepare_base(spark.createDataFrame([("1", "1")], "lat string, lon string"))


def test_chainage_fallbacks(spark):
    base = spark.createDataFrame([("1", "2", "0.5")], "lat string, lon string, LOCATION string")
    assert prepare_base(base).first()["_m_chain"] == 500.0
    for name, expected in (("location", 500.0), ("Start Chainage (km)", 500.0)):
        supp = spark.createDataFrame([("0.5",)], f"`{name}` string")
        assert prepare_supp(supp).first()["_m_chain"] == expected
    # Only the exact spelling counts in a supplement.
    assert prepare_supp(spark.createDataFrame([("0.5",)], "Location string")).count() == 0


def test_supplement_without_position_or_time(spark):
    supp = prepare_supp(spark.createDataFrame([("5", "L1"), (None, "L1")], "chainage string, lane string"))
    row = supp.collect()
    assert len(row) == 1
    assert (row[0]["_m_lat"], row[0]["_m_lon"], row[0]["_m_time"]) == (None, None, None)


def test_column_map_overrides_aliases(spark):
    df = spark.createDataFrame([("1", "2", "3", "x", "y")],
                               "lat string, lon string, chain string, roadname string, `my.road` string")
    assert prepare_base(df, columns={"road": "my.road"}).first()["_m_road"] == "y"
    with pytest.raises(ValueError):
        prepare_base(df, columns={"road": "absent"})


def test_generated_ids_follow_the_file(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("lat,lon,chain\n" + "".join(f"1,2,{i}\n" for i in range(50)))
    rows = prepare_base(spark.read.csv(str(path), header=True)).orderBy("_m_id").collect()
    assert [r["_m_chain"] for r in rows] == [float(i) for i in range(50)]


def test_catalogue_lists_public_columns(spark):
    df = spark.createDataFrame([("1", "2", "3", "4", "L1")],
                               "lat string, lon string, chain string, `tsd d0` string, lane_id string")
    assert supp_catalogue(prepare_supp(df)) == ["lat", "lon", "chain", "tsd d0", "lane_id", "Lane"]
