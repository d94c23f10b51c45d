"""Survey tables derived from the ``events`` table, in Spark and in SQL.

A vehicle drives east, 5 m and 0.25 s per event.  Every table uses every event;
see FIXTURES.md for the shape of the values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymatch.session import checkpoint_folder

LANE_RAW = """CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN ' L2' WHEN 'purchase' THEN 'R1'
    WHEN 'signup' THEN 'L1 ' ELSE 'X9' END"""
LANES_RAW = """CASE WHEN event_id % 3 = 0 THEN 'ALL' WHEN event_type = 'view' THEN 'L1'
    WHEN event_type = 'click' THEN 'L2' WHEN event_type = 'purchase' THEN 'R1' ELSE '1' END"""

BASE_MS = "event_id * 250"
SUPP_MS = "event_id * 250 + ((event_id % 41) - 20) * 500"

BASE = {
    "rec_id": "event_id",
    "roadname": "concat(' Road ', cast(user_id % 5 as {text}), ' ')",
    "lane": LANE_RAW,
    "latitude": "CASE WHEN event_id % 97 = 0 THEN 'n/a' "
                "ELSE cast(cast(-27 + (user_id % 5) * 0.01 as decimal(10,6)) as {text}) END",
    "longitude": "cast(cast(153 + event_id * 0.00005 as decimal(10,6)) as {text})",
    "chainage": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE cast(event_id * 5 as {text}) END",
    "road_id": "concat('R', cast(user_id % 5 as {text}))",
    "region_id": "CASE WHEN event_id % 50 = 7 THEN NULL "
                 "ELSE concat('G', cast(event_id % 2 as {text})) END",
    "TestDateUTC": "{time:base}",
}
SUPP = {
    "rec_id": "event_id",
    "roadname": "concat('Road ', cast(user_id % 5 as {text}))",
    "lane": LANE_RAW,
    "lat": "CASE WHEN event_id % 89 = 0 THEN NULL ELSE cast(cast("
           "-27 + (user_id % 5) * 0.01 + (event_id % 5) * 0.0001 as decimal(10,6)) as {text}) END",
    "lon": "cast(cast(153 + event_id * 0.00005 as decimal(10,6)) as {text})",
    "chainage": "cast(cast(event_id * 5 + ((event_id % 7) - 3) * 1.25 as decimal(12,2)) as {text})",
    "TestDateUTC": "{time:supp}",
    "tsd_d0": "cast(cast(value as decimal(12,2)) as {text})",
    "Filename": "cast(event_id % 9 as {text})",
}
RANGES = {
    "rec_id": "event_id",
    "road_id": "concat('R', cast(user_id % 5 as {text}))",
    "region_id": "CASE WHEN event_id % 10 = 3 THEN NULL "
                 "ELSE concat('G', cast(event_id % 2 as {text})) END",
    "roadname": "concat('Road ', cast(user_id % 5 as {text}))",
    "Lanes": LANES_RAW,
    "Start Chainage (km)": "CASE WHEN event_id % 11 = 0 THEN 'tbc' "
                           "ELSE cast(cast(event_id * 0.005 as decimal(12,3)) as {text}) END",
    "End Chainage (km)": "cast(cast(event_id * 0.005 + 0.2 + (event_id % 7) * 0.05 "
                         "+ CASE WHEN event_id % 499 = 0 THEN 2 ELSE 0 END as decimal(12,3)) as {text})",
    "tsd_d0": "cast(cast(value as decimal(12,2)) as {text})",
}
# The same events folded into a crowd: one road, four lanes, a few metres and half a minute.  Half of the base rows, and half of
# the supplement rows, lie where the other side has nothing.
CROWD_LANE = "CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN ' 2' WHEN 'purchase' THEN 'R1' WHEN 'signup' THEN 'L1 ' ELSE 'X9' END"
BASE_CROWD = {
    **BASE, "roadname": "' Road 0 '", "lane": CROWD_LANE,
    "latitude": "cast(cast(-27 + (event_id % 29) * 0.000007 as decimal(10,6)) as {text})",
    "longitude": "cast(cast(153 + (event_id % 31) * 0.000003 as decimal(10,6)) as {text})",
    "chainage": "cast(cast((event_id % 37) * 0.1 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 30 END as decimal(12,2)) as {text})",
    "road_id": "'R0'", "region_id": "concat('G', cast(event_id % 4 as {text}))", "TestDateUTC": "{time:crowd}",
}
SUPP_CROWD = {
    **SUPP, "roadname": "'Road 0'", "lane": CROWD_LANE,
    "lat": "cast(cast(-27 + (event_id % 23) * 0.000009 + CASE WHEN event_id % 3 = 0 THEN 0.01 ELSE 0 END as decimal(10,6)) as {text})",
    "lon": "cast(cast(153 + (event_id % 19) * 0.000005 as decimal(10,6)) as {text})",
    "chainage": "cast(cast((event_id % 41) * 0.1 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 10 END as decimal(12,2)) as {text})",
    "TestDateUTC": "{time:crowd}",
}
RANGES_CROWD = {
    **RANGES, "road_id": "'R0'", "region_id": "concat('G', cast(event_id % 5 as {text}))",
    "Start Chainage (km)": "cast(cast((event_id % 1999) * 0.00001 as decimal(12,5)) as {text})",
    "End Chainage (km)": "cast(cast((event_id % 1999) * 0.00001 + 0.001 + (event_id % 13) * 0.003 as decimal(12,5)) as {text})",
}
# Intervals of up to forty kilometres that lie over each other, each with a chainage of its own inside, before or behind it.
RANGES_LONG = {
    **RANGES, "chainage": "cast(event_id * 5 + (event_id % 97) * 450 - 1000 as {text})",
    "End Chainage (km)": "cast(cast(event_id * 0.005 + (event_id % 401) * 0.1 - 0.05 as decimal(12,3)) as {text})",
}
# Supplement rows a fixed time behind the base row of the same event.
SUPP_LATE = {**SUPP, "TestDateUTC": "{time:late}"}
# Chainage in kilometres under another name.
BASE_KM = {**{k: v for k, v in BASE.items() if k != "chainage"}, "location": "cast(cast(event_id * 0.005 as decimal(12,3)) as {text})"}


def _time(ms: str, spark: bool) -> str:
    if spark:
        at = f"timestampadd(MILLISECOND, {ms}, timestamp_ntz'2024-01-01 00:00:00')"
        shown = [f"date_format({at}, \"{p}\")" for p in (
            "dd/MM/yy HH:mm:ss.SSS", "dd/MM/yyyy HH:mm:ss.SSS",
            "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "dd/MM/yyyy HH:mm:ss")]
    else:
        at = f"(TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds({ms}))"
        shown = [f"strftime({at}, '{p}')" for p in (
            "%d/%m/%y %H:%M:%S.%g", "%d/%m/%Y %H:%M:%S.%g",
            "%Y-%m-%dT%H:%M:%S.%gZ", "%d/%m/%Y %H:%M:%S")]
    return (f"CASE WHEN event_id % 103 = 3 THEN 'bad' WHEN event_id % 4 = 0 THEN {shown[0]} "
            f"WHEN event_id % 4 = 1 THEN {shown[1]} WHEN event_id % 4 = 2 THEN {shown[2]} "
            f"ELSE {shown[3]} END")


def _filled(expression: str, spark: bool) -> str:
    return (expression.replace("{text}", "string" if spark else "varchar")
            .replace("{time:base}", _time(BASE_MS, spark))
            .replace("{time:supp}", _time(SUPP_MS, spark))
            .replace("{time:crowd}", _time("(event_id * 7) % 30000", spark))
            .replace("{time:late}", _time(f"{BASE_MS} + 8200", spark)))


# Folders written by this application, by data folder and table.
_written: dict[tuple[str, str, str], str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, columns: dict) -> DataFrame:
    """The derived table, written once to the shared folder and read from there.

    A survey reaches a merge as stored text; deriving it anew inside each plan
    would put the cost of making the text into every query.
    """
    context = spark.sparkContext
    key = (context.applicationId, sf_dir, name)
    if key not in _written:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        rows = events.select(*[F.expr(_filled(e, True)).alias(n) for n, e in columns.items()])
        # The given file is one row group, which one task would read alone.
        spread = rows.repartition("rec_id")
        path = f"{checkpoint_folder(spark)}/survey-{uuid.uuid4().hex}/{name}"
        spread.write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def base_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "base", BASE)


def supp_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "points", SUPP)


def supp_range_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "intervals", RANGES)


def base_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "base_crowd", BASE_CROWD)


def supp_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "points_crowd", SUPP_CROWD)


def range_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "intervals_crowd", RANGES_CROWD)


def range_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "intervals_long", RANGES_LONG)


def supp_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "points_late", SUPP_LATE)


def base_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "base_km", BASE_KM)


# --- the same tables in SQL -------------------------------------------------

def _select(columns: dict) -> str:
    return "SELECT " + ", ".join(f'{_filled(e, False)} AS "{n}"' for n, e in columns.items()) + " FROM events"


MICROS = ("epoch_us(try_strptime(\"TestDateUTC\", ['%d/%m/%y %H:%M:%S.%f', '%d/%m/%Y %H:%M:%S.%f', "
          "'%d/%m/%y %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%Y-%m-%dT%H:%M:%S.%fZ']))")
LANE_SQL = "CASE trim(lane) WHEN '1' THEN 'L1' WHEN '2' THEN 'L2' ELSE trim(lane) END"
VALID_SQL = "('L1', 'R1', 'L2', 'R2', 'LSK1', 'RSK1')"


def tables_sql(base: dict = BASE, supp: dict = SUPP, ranges: dict = RANGES) -> str:
    """The raw tables and their cleaned forms ``b``, ``s`` and ``r`` as common table expressions."""
    raw = f"base_raw AS ({_select(base)}),\nsupp_raw AS ({_select(supp)}),\nrange_raw AS ({_select(ranges)}),"
    cleaned = CLEANED_SQL.replace("try_cast(chainage AS double) AS c\n    FROM base_raw",
                                  "try_cast(location AS double) * 1000 AS c\n    FROM base_raw") if "location" in base else CLEANED_SQL
    return raw + cleaned


CLEANED_SQL = f"""
b AS (
  SELECT * FROM (
    SELECT *, trim(roadname) AS road, {LANE_SQL} AS code, {MICROS} AS t,
      try_cast(latitude AS double) AS y, try_cast(longitude AS double) AS x,
      try_cast(chainage AS double) AS c
    FROM base_raw)
  WHERE code IN {VALID_SQL} AND t IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AND c IS NOT NULL),
s AS (
  SELECT * FROM (
    SELECT *, trim(roadname) AS road, {LANE_SQL} AS code, {MICROS} AS t,
      try_cast(lat AS double) AS y, try_cast(lon AS double) AS x,
      try_cast(chainage AS double) AS c
    FROM supp_raw)
  WHERE code IN {VALID_SQL} AND t IS NOT NULL AND c IS NOT NULL),
r AS (
  SELECT * FROM (
    SELECT *, trim(roadname) AS road, try_cast("Start Chainage (km)" AS double) * 1000 AS c,
      try_cast("End Chainage (km)" AS double) * 1000 AS c_end
    FROM range_raw)
  WHERE c IS NOT NULL)
"""

TABLES_SQL = tables_sql()
LONG_SQL = f"""{TABLES_SQL}, long_raw AS ({_select(RANGES_LONG)}),
l AS (
  SELECT * FROM (
    SELECT *, trim(roadname) AS road, try_cast(chainage AS double) AS c,
      try_cast("Start Chainage (km)" AS double) * 1000 AS c_start, try_cast("End Chainage (km)" AS double) * 1000 AS c_end
    FROM long_raw)
  WHERE c IS NOT NULL)
"""

DIST_SQL = """2 * 6371000 * asin(least(1, sqrt(
  sin((radians(s.y) - radians(b.y)) / 2) * sin((radians(s.y) - radians(b.y)) / 2)
  + cos(radians(b.y)) * cos(radians(s.y))
  * sin((radians(s.x) - radians(b.x)) / 2) * sin((radians(s.x) - radians(b.x)) / 2))))"""
