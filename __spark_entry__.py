"""Queries over the survey tables and their SQL counterparts."""

from __future__ import annotations

import importlib.util
import os
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import survey_tables as tables
from survey_tables import BASE_CROWD, BASE_KM, DIST_SQL, LONG_SQL, MICROS, RANGES_CROWD, SUPP_CROWD, SUPP_LATE, TABLES_SQL, tables_sql
from waymatch import (
    MatchConfig,
    blocked_pair_counts,
    coverage,
    cross_pair_count,
    kept_rows,
    match_pairs,
    match_report,
    merge,
    null_counts,
    number_rows,
    pair_volume,
    prepare_base,
    prepare_sides,
    prepare_supp,
    preview,
    radius_join,
    range_join,
    read_checked,
    read_survey,
    rejects,
    rules_for,
    run_merge_job,
    supp_catalogue,
)
from waymatch.functions.text import lenient_double, spoken_double, survey_micros
from waymatch.session import checkpoint_folder, saved
from waymatch.sources.csv import as_text

KEYS = {"base_key": "rec_id", "supp_key": "rec_id"}


def _base(spark, sf):
    return prepare_base(tables.base_raw(spark, sf), "rec_id")


def _supp(spark, sf):
    return prepare_supp(tables.supp_raw(spark, sf), "rec_id")


def _ranges(spark, sf):
    return prepare_supp(tables.supp_range_raw(spark, sf), "rec_id")


def _canonical(df: DataFrame) -> DataFrame:
    return df.select("rec_id", F.col("_m_road").alias("road"), F.col("_m_lane").alias("code"),
                     F.col("_m_time").alias("time_us"), F.col("_m_lat").alias("lat_deg"),
                     F.col("_m_lon").alias("lon_deg"), F.col("_m_chain").alias("chain_m"))


# --- cleaning ---------------------------------------------------------------

def prep_base(spark, sf):
    return _canonical(_base(spark, sf))


def prep_supp(spark, sf):
    return _canonical(_supp(spark, sf))


def prep_ranges(spark, sf):
    return _ranges(spark, sf).select(
        "rec_id", F.col("_m_road").alias("road"), F.col("_m_chain").alias("chain_m"),
        F.col("_m_time").alias("time_us"), F.col("_m_lat").alias("lat_deg"))


def lane_recode_filter(spark, sf):
    return _base(spark, sf).groupBy(F.col("_m_road").alias("road"), F.col("_m_lane").alias("code")) \
        .agg(F.count(F.lit(1)).alias("base_rows"))


def timestamp_multi_format(spark, sf):
    raw = tables.supp_raw(spark, sf)
    return raw.select("rec_id", "TestDateUTC",
                      survey_micros(raw, "TestDateUTC", F.col("TestDateUTC")).alias("time_us"))


def lenient_numbers(spark, sf):
    raw = tables.base_raw(spark, sf).select("rec_id", "latitude", "chainage").join(
        tables.supp_range_raw(spark, sf).select("rec_id", "Start Chainage (km)"), "rec_id")
    return raw.select(
        "rec_id", lenient_double(raw, "latitude", F.col("latitude")).alias("lat_deg"),
        lenient_double(raw, "chainage", F.col("chainage")).alias("chain_m"),
        (spoken_double(F.col("`Start Chainage (km)`")) * 1000).alias("start_m"))


# --- pairs ------------------------------------------------------------------

def radius_pairs(spark, sf):
    return radius_join(_base(spark, sf), _supp(spark, sf), 100).select(
        "base_id", "supp_id", F.round("spatial_dist_m", 3).alias("dist_m"))


def cross_pairs_count(spark, sf):
    counts = cross_pair_count(_base(spark, sf), _supp(spark, sf))
    return counts.withColumn("pairs", F.col("pairs").cast("long"))


def road_lane_pairs(spark, sf):
    counts = blocked_pair_counts(_base(spark, sf), _supp(spark, sf))
    return counts.withColumn("pairs", F.col("pairs").cast("long"))


VOLUMES = {
    "cross, time": MatchConfig(strategy="cross", enable_road=False), "cross": MatchConfig(strategy="cross", enable_road=False, enable_time=False),
    "blocked, time": MatchConfig(strategy="blocked", enable_road=False), "blocked": MatchConfig(strategy="blocked", enable_time=False),
    "range": MatchConfig(strategy="range"), "blocked, time and chainage": MatchConfig(strategy="blocked"),
}


def pair_volumes(spark, sf):
    """Candidate pairs and those that pass, counted without forming them."""
    # Each side is asked for by several kinds, so it is cleaned once and written down.
    base, points, intervals = [saved(side(spark, sf)) for side in (_base, _supp, _ranges)]
    rows = [pair_volume(base, intervals if cfg.strategy == "range" else points, cfg).select(F.lit(name).alias("kind"), *[
        F.col(c).cast("long").alias(c) for c in ("candidates", "filtered")]) for name, cfg in VOLUMES.items()]
    return reduce(DataFrame.unionByName, rows)


def chainage_range_join(spark, sf):
    return range_join(_base(spark, sf), _ranges(spark, sf)).select(
        "base_id", "supp_id", "lane_base", "lane_supp", "region_id_base", "start_m", "end_m",
        "chainage_diff_m")


def _pairs(strategy: str, **flags):
    def query(spark, sf):
        cfg = MatchConfig(strategy=strategy, **flags)
        pairs = match_pairs(_base(spark, sf), _supp(spark, sf), rules_for(strategy, cfg, True))
        return pairs.select("base_id", "supp_id", "time_diff_us", "chainage_diff_m")
    return query


# --- merges -----------------------------------------------------------------

def _best(strategy: str, intervals: bool = False, **flags):
    """Ids of the best match and both differences, for every base row."""
    def query(spark, sf):
        cfg = MatchConfig(strategy=strategy, supp_columns=("rec_id",), **KEYS, **flags)
        supp = (tables.supp_range_raw if intervals else tables.supp_raw)(spark, sf)
        result = merge(tables.base_raw(spark, sf), supp, cfg)
        if "time_diff_seconds" not in result.columns:
            return result.select("rec_id", "rec_id_lmd", "chainage_diff_meters")
        return result.select("rec_id", "rec_id_lmd", "time_diff_seconds", "chainage_diff_meters")
    return query


def _crowded(strategy: str, intervals: bool = False, **flags):
    """``_best`` over tables folded into a crowd."""
    def query(spark, sf):
        cfg = MatchConfig(strategy=strategy, supp_columns=("rec_id",), **KEYS, **flags)
        supp = (tables.range_crowd if intervals else tables.supp_crowd)(spark, sf)
        result = merge(tables.base_crowd(spark, sf), supp, cfg)
        timed = ["time_diff_seconds"] if "time_diff_seconds" in result.columns else []
        return result.select("rec_id", "rec_id_lmd", *timed, "chainage_diff_meters")
    return query


def range_long(spark, sf):
    """Very long intervals over each other, which rank by a chainage of their own."""
    cfg = MatchConfig(strategy="range", supp_columns=("rec_id",), **KEYS)
    return merge(tables.base_raw(spark, sf), tables.range_long(spark, sf), cfg).select("rec_id", "rec_id_lmd", "chainage_diff_meters")


def time_limit_edge(spark, sf):
    """Partners exactly at a limit that is no whole number of microseconds in floating point."""
    cfg = MatchConfig(max_time_diff_s=8.2, supp_columns=("rec_id",), **KEYS)
    return merge(tables.base_raw(spark, sf), tables.supp_late(spark, sf), cfg).select(
        "rec_id", "rec_id_lmd", "time_diff_seconds", "chainage_diff_meters")


def merge_without_keys(spark, sf):
    """Generated ids; the time gap alone is compared, so that ties cannot decide."""
    cfg = MatchConfig(supp_columns=("tsd_d0",))
    return merge(tables.base_raw(spark, sf), tables.supp_raw(spark, sf), cfg).select(
        "rec_id", F.col("tsd_d0").isNotNull().alias("matched"), "time_diff_seconds")


DEFAULT_SOME = ("tsd_d200", "tsd_d300", "r2", "NumIts", "h1", "h2", "E1", "E2", "c0", "n", "FitMethod", "Governing LDE")


def merge_default_columns(spark, sf):
    """No column list: the usual columns of those the supplement has."""
    supp = tables.supp_raw(spark, sf).withColumns({c: F.concat(F.lit(f"{i}-"), "tsd_d0") for i, c in enumerate(DEFAULT_SOME)})
    out = merge(tables.base_raw(spark, sf), supp, MatchConfig(**KEYS))
    return out.select("rec_id", "Filename", "tsd_d0", *DEFAULT_SOME, F.lit(len(out.columns)).alias("n_columns"))


def location_chainage(spark, sf):
    return _canonical(prepare_base(tables.base_km(spark, sf), "rec_id"))


def job_counts(spark, sf):
    """Rows that a job on files has read, kept after cleaning, and matched."""
    summary = _csv_job(spark, sf)
    return spark.createDataFrame([tuple(summary.counts.values())], ", ".join(f"{k} long" for k in summary.counts))


def row_numbers(spark, sf):
    """Numbers of the rows kept, by file and line, in files of very unlike size."""
    folder = os.path.join(checkpoint_folder(spark), f"csv-{uuid.uuid4().hex}")
    raw = tables.base_raw(spark, sf)
    for name, some in (("a", "rec_id % 10 = 0"), ("b", "rec_id % 10 BETWEEN 1 AND 8"), ("c", "rec_id % 10 = 9")):
        raw.where(some).repartitionByRange("rec_id").sortWithinPartitions("rec_id").write.option("header", True).csv(f"{folder}/{name}")
    numbered = number_rows(prepare_base(read_survey(spark, f"{folder}/*")))
    return numbered.select(F.col("rec_id").cast("long").alias("rec_id"), "row_number")


def damaged_rows(spark, sf):
    """Rows with a field too few or too many are rejected with their whole text; the others are read."""
    path = os.path.join(checkpoint_folder(spark), f"csv-{uuid.uuid4().hex}")
    line = "concat(event_id, ',', event_type, IF(event_id % 53 = 1, '', concat(',', user_id)), IF(event_id % 53 != 1 AND event_id % 59 = 2, ',more', ''))"
    spark.read.parquet(f"{sf}/events.parquet").select(F.expr(line).alias("event_id,event_type,user_id")) \
        .write.options(header=True, sep="\x01").csv(path)
    checked = read_checked(spark, path)
    kept = kept_rows(checked).select(F.col("event_id").cast("long").alias("event_id"), F.lit(False).alias("rejected"),
                                     F.concat_ws(",", "event_id", "event_type", "user_id").alias("row"))
    return kept.unionByName(rejects(checked).select(
        F.split_part("row", F.lit(","), F.lit(1)).cast("long").alias("event_id"), F.lit(True).alias("rejected"), "row"))


def job_nulls(spark, sf):
    """Null counts of the job's output, from its summary."""
    return spark.createDataFrame(list(_csv_job(spark, sf).nulls.items()), "column_name string, nulls long")


def column_catalogue(spark, sf):
    """Columns of a prepared supplement that may be asked for."""
    supp = _supp(spark, sf)
    names = F.array(*[F.lit(c) for c in supp_catalogue(supp)])
    return supp.agg(F.count(F.lit(1)).alias("supp_rows")).select(F.explode(names).alias("column_name"), "supp_rows")


def all_as_text(spark, sf):
    """A merge with every column as text."""
    out = as_text(merge(tables.base_raw(spark, sf), tables.supp_raw(spark, sf), PAYLOAD))
    return out.select("rec_id", "tsd_d0", "time_diff_seconds", F.expr("try_cast(chainage_diff_meters AS double)").alias("chainage_diff_meters"))


def missing_interval_columns(spark, sf):
    """A supplement without interval ends: the error names them, and ``auto`` does without."""
    base, supp = tables.base_raw(spark, sf), tables.supp_range_raw(spark, sf).drop("End Chainage (km)")
    try:
        merge(base, supp, MatchConfig(strategy="range", **KEYS))
        said = None
    except ValueError as error:
        said = str(error)
    cfg = MatchConfig(strategy="auto", supp_columns=("rec_id",), **KEYS)
    return merge(base, supp.withColumn("lane", F.lit("L1")), cfg).select("rec_id", "rec_id_lmd", F.lit(said).alias("said"))


def without_coordinates(spark, sf):
    """Distances are asked for, but the supplement has no coordinates: the road decides, even if it is turned off."""
    cfg = MatchConfig(strategy="auto", enable_road=False, supp_columns=("rec_id",), **KEYS)
    return merge(tables.base_raw(spark, sf), tables.supp_raw(spark, sf).drop("lat", "lon"), cfg).select(
        "rec_id", "rec_id_lmd", "time_diff_seconds")


def parameter_ranges(spark, sf):
    """Base rows with a match for limits inside and outside their usual ranges, and whether these were warned about."""
    rows, sides = [], None
    base, supp = tables.base_raw(spark, sf), tables.supp_raw(spark, sf)
    for seconds, metres, far in ((10, 5.0, 100), (1, 0.1, 10), (300, 100, 1000), (0.5, 5.0, 100), (10, 0.05, 5)):
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            cfg = MatchConfig(max_time_diff_s=seconds, max_chainage_diff_m=metres, max_distance_m=far, supp_columns=("rec_id",), **KEYS)
        sides = sides or prepare_sides(base, supp, cfg)     # cleaned once, as only the limits differ
        report = match_report(merge(base, supp, cfg, sides))
        rows.append(report.select(F.lit(float(seconds)).alias("max_time_s"), F.lit(len(said)).cast("long").alias("warned"), "matched_rows"))
    return reduce(DataFrame.unionByName, rows)


def csv_order(spark, sf):
    """The rows of each output file in base order: how many come after a larger one, and the version in the name."""
    summary = _csv_job(spark, sf)
    back = read_survey(spark, summary.path).select(
        F.col("rec_id").cast("long").alias("rec_id"), F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("file"))
    here = back.withColumn("before", F.lag("rec_id").over(Window.partitionBy("file").orderBy("at")))
    return here.agg(F.count(F.lit(1)).alias("rows_out"), F.count_if(F.col("before") > F.col("rec_id")).alias("out_of_order"),
                    F.lit(os.path.basename(summary.path)).alias("name"))


PAYLOAD = MatchConfig(supp_columns=("tsd_d0", "Filename"), **KEYS)


def merge_default(spark, sf):
    return merge(tables.base_raw(spark, sf), tables.supp_raw(spark, sf), PAYLOAD)


def merge_distance(spark, sf):
    cfg = MatchConfig(supp_columns=("rec_id",), enable_road=False, include_distance=True, **KEYS)
    return merge(tables.base_raw(spark, sf), tables.supp_raw(spark, sf), cfg).select(
        "rec_id", "rec_id_lmd", F.round("spatial_dist_m", 3).alias("dist_m"))


def suffix_conflicts(spark, sf):
    """Conflicts with the base, with each other, repeats and an unknown name."""
    base = tables.base_raw(spark, sf).withColumn("Filename_s", F.lit("x"))
    base = base.withColumn("Filename", F.lit("y"))
    cfg = MatchConfig(supp_columns=("Filename", "tsd_d0", "Lane", "tsd_d0", "chainage", "nosuch", "Chain"),
                      suffix="_s", **KEYS)
    return merge(base, tables.supp_raw(spark, sf), cfg)


def report(spark, sf):
    out = match_report(merge_default(spark, sf))
    return out.select("base_rows", "matched_rows", *[
        F.round(c, 6).alias(c) for c in out.columns if c not in ("base_rows", "matched_rows")])


def nulls(spark, sf):
    return null_counts(merge_default(spark, sf))


def coverage_check(spark, sf):
    return coverage(_base(spark, sf), _ranges(spark, sf))


def _csv_job(spark, sf):
    """Both surveys to CSV, and the whole job on the files."""
    folder = os.path.join(checkpoint_folder(spark), f"csv-{uuid.uuid4().hex}")
    base, supp = f"{folder}/base.csv", f"{folder}/points V1.0.0.7.csv"
    tables.base_raw(spark, sf).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(base)
    tables.supp_raw(spark, sf).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(supp)
    return run_merge_job(spark, base, supp, cfg=PAYLOAD)


def csv_roundtrip(spark, sf):
    """The output of the job on files, read back."""
    summary = _csv_job(spark, sf)
    back = read_survey(spark, summary.path)
    return back.withColumns({
        "rec_id": F.col("rec_id").cast("long"),
        "time_diff_seconds": F.col("time_diff_seconds").cast("long"),
        "chainage_diff_meters": F.col("chainage_diff_meters").cast("double")})


def first_rows(spark, sf):
    return preview(tables.base_raw(spark, sf).orderBy("rec_id"))


# --- contract ---------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    return merge_default(spark, "/root/testdata/sf0.001")


def survey_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "prep_base": prep_base,
        "prep_supp": prep_supp,
        "prep_ranges": prep_ranges,
        "lane_recode_filter": lane_recode_filter,
        "timestamp_multi_format": timestamp_multi_format,
        "lenient_numbers": lenient_numbers,
        "radius_join": radius_pairs,
        "cross_pairs_count": cross_pairs_count,
        "road_lane_pairs": road_lane_pairs,
        "chainage_range_join": chainage_range_join,
        "pair_volumes": pair_volumes,
        "tolerance_all": _pairs("spatial"),
        "tolerance_road_off": _pairs("spatial", enable_road=False),
        "tolerance_time_off": _pairs("spatial", enable_time=False),
        "tolerance_distance_only": _pairs("spatial", enable_road=False, enable_time=False),
        "tolerance_spatial_off": _pairs("blocked"),
        "tolerance_time_lane": _pairs("cross", enable_road=False),
        "best_by_time": _best("spatial", max_chainage_diff_m=20),
        "best_by_chainage": _best("spatial", enable_time=False, max_chainage_diff_m=20),
        "best_by_distance": _best("spatial", enable_time=False, enable_road=False),
        "best_first": _best("cross", enable_time=False, enable_road=False),
        "merge_default": merge_default,
        "merge_distance": merge_distance,
        "merge_range": _best("range", intervals=True),
        "merge_range_mixed": _best("auto", intervals=True),
        "merge_blocked": _best("blocked"),
        "merge_blocked_untimed": _best("blocked", enable_time=False),
        "merge_blocked_road_off": _best("blocked", enable_road=False),
        "merge_cross": _best("cross", enable_road=False),
        "strategy_auto": _best("auto"),
        "strategy_auto_forced": _best("auto", enable_spatial=False, enable_road=False),
        "suffix_conflicts": suffix_conflicts,
        "match_report": report,
        "null_counts": nulls,
        "coverage_check": coverage_check,
        "csv_roundtrip": csv_roundtrip,
        "preview": first_rows,
        "merge_crowded": _crowded("spatial"),
        "distance_crowded": _crowded("spatial", enable_road=False, enable_time=False, max_distance_m=12),
        "range_crowded": _crowded("range", intervals=True),
        "range_long": range_long,
        "auto_blocked": _best("auto", enable_spatial=False),
        "time_limit_edge": time_limit_edge,
        "merge_without_keys": merge_without_keys,
        "merge_default_columns": merge_default_columns,
        "location_chainage": location_chainage,
        "job_counts": job_counts,
        "csv_order": csv_order,
        "row_numbers": row_numbers,
        "damaged_rows": damaged_rows,
        "job_nulls": job_nulls,
        "column_catalogue": column_catalogue,
        "all_as_text": all_as_text,
        "missing_interval_columns": missing_interval_columns,
        "without_coordinates": without_coordinates,
        "parameter_ranges": parameter_ranges,
    }


def _sql(body: str, more: str = "", given: str = TABLES_SQL) -> str:
    return f"WITH {given}{more}\n{body}"


NEAR = f"""abs(s.y - b.y) <= 0.0009 AND abs(s.x - b.x) <= 0.00102 AND {DIST_SQL} <= 100"""
ROAD = "b.road = s.road AND b.code = s.code"
LANE = "b.code = s.code"
TIME = "abs(b.t - s.t) <= 10000000"
TIME_GAP, CHAIN_GAP = "abs(b.t - s.t)", "abs(b.c - s.c)"
MICROMETRES = f"round({DIST_SQL}, 6)"


def _pair_sql(on: str) -> str:
    return _sql(f"""SELECT b.rec_id AS base_id, s.rec_id AS supp_id, {TIME_GAP} AS time_diff_us,
        {CHAIN_GAP} AS chainage_diff_m FROM b JOIN s ON {on}""")


def _best_cte(on: str, order: str, supp: str = "s") -> str:
    gap = TIME_GAP if supp == "s" else "NULL"
    dist = f"CASE WHEN s.y IS NULL THEN NULL ELSE {DIST_SQL} END" if supp == "s" else "NULL"
    return f""",
    ranked AS (SELECT b.rec_id AS bid, s.rec_id AS sid, {gap} AS tgap, {CHAIN_GAP} AS cgap,
        {dist} AS dist,
        row_number() OVER (PARTITION BY b.rec_id ORDER BY {order}, s.rec_id) AS place
      FROM b JOIN {supp} s ON {on}),
    best AS (SELECT * FROM ranked WHERE place = 1)"""


def _best_sql(on: str, order: str, supp: str = "s", given: str = TABLES_SQL) -> str:
    seconds = "CAST(floor(tgap / 1000000) AS bigint) AS time_diff_seconds, " if supp == "s" else ""
    return _sql(f"""SELECT b.rec_id, sid AS rec_id_lmd, {seconds}cgap AS chainage_diff_meters
        FROM b LEFT JOIN best ON bid = b.rec_id""", _best_cte(on, order, supp), given)


DEFAULT_BEST = _best_cte(f"{ROAD} AND {TIME} AND {CHAIN_GAP} <= 5 AND {NEAR}",
                         f"{TIME_GAP}, {MICROMETRES}")
DEFAULT_MERGE = """SELECT b.rec_id, b.road AS "RoadName", b.code AS "Lane", b.latitude, b.longitude,
    b.chainage, b.road_id, b.region_id, b."TestDateUTC", m.tsd_d0, m."Filename",
    CAST(floor(tgap / 1000000) AS bigint) AS time_diff_seconds, cgap AS chainage_diff_meters
  FROM b LEFT JOIN best ON bid = b.rec_id LEFT JOIN s m ON m.rec_id = sid"""


def survey_sql() -> dict[str, str]:
    crowd = tables_sql(BASE_CROWD, SUPP_CROWD, RANGES_CROWD)
    inside = ("b.road_id IS NOT DISTINCT FROM s.road_id AND b.region_id IS NOT DISTINCT FROM s.region_id "
              "AND b.c BETWEEN s.c AND s.c_end")
    road_lane_any = "b.road = s.road AND (s.\"Lanes\" = 'ALL' OR b.code = s.\"Lanes\")"
    block = "b.road IS NOT DISTINCT FROM s.road AND b.code IS NOT DISTINCT FROM s.code"
    near20 = f"{ROAD} AND {CHAIN_GAP} <= 20 AND {NEAR}"
    canonical = "rec_id, road, code, t AS time_us, y AS lat_deg, x AS lon_deg, c AS chain_m"
    default_names = ["rec_id", "RoadName", "Lane", "latitude", "longitude", "chainage", "road_id",
                     "region_id", "TestDateUTC", "tsd_d0", "Filename", "time_diff_seconds",
                     "chainage_diff_meters"]
    return {
        "prep_base": _sql(f"SELECT {canonical} FROM b"),
        "prep_supp": _sql(f"SELECT {canonical} FROM s"),
        "prep_ranges": _sql("SELECT rec_id, road, c AS chain_m, CAST(NULL AS bigint) AS time_us, "
                            "CAST(NULL AS double) AS lat_deg FROM r"),
        "lane_recode_filter": _sql("SELECT road, code, count(*) AS base_rows FROM b GROUP BY road, code"),
        "timestamp_multi_format": _sql(f'SELECT rec_id, "TestDateUTC", {MICROS} AS time_us FROM supp_raw'),
        "lenient_numbers": _sql("""SELECT base_raw.rec_id, try_cast(latitude AS double) AS lat_deg,
            try_cast(chainage AS double) AS chain_m,
            try_cast("Start Chainage (km)" AS double) * 1000 AS start_m
            FROM base_raw JOIN range_raw ON base_raw.rec_id = range_raw.rec_id"""),
        "radius_join": _sql(f"""SELECT b.rec_id AS base_id, s.rec_id AS supp_id,
            round({DIST_SQL}, 3) AS dist_m FROM b JOIN s ON {NEAR}"""),
        "cross_pairs_count": _sql("""SELECT (SELECT count(*) FROM b) AS base_rows,
            (SELECT count(*) FROM s) AS supp_rows,
            (SELECT count(*) FROM b CROSS JOIN s) AS pairs"""),
        "road_lane_pairs": _sql("""SELECT b.road, b.code AS lane, count(DISTINCT b.rec_id) AS base_rows,
            count(DISTINCT s.rec_id) AS supp_rows, count(*) AS pairs
            FROM b JOIN s ON b.road IS NOT DISTINCT FROM s.road AND b.code IS NOT DISTINCT FROM s.code
            GROUP BY b.road, b.code"""),
        "chainage_range_join": _sql(f"""SELECT b.rec_id AS base_id, s.rec_id AS supp_id,
            b.code AS lane_base, s."Lanes" AS lane_supp, b.region_id AS region_id_base,
            s.c AS start_m, s.c_end AS end_m, {CHAIN_GAP} AS chainage_diff_m
            FROM b JOIN r s ON {inside}"""),
        "pair_volumes": _sql(" UNION ALL ".join(
            f"""SELECT '{kind}' AS kind, (SELECT count(*) FROM b JOIN {supp} s ON {candidate}) AS candidates, {filtered} AS filtered"""
            for kind, supp, candidate, filtered in (
                ("cross, time", "s", "true", f"(SELECT count(*) FROM b JOIN s ON {LANE} AND {TIME})"),
                ("cross", "s", "true", f"(SELECT count(*) FROM b JOIN s ON {LANE})"),
                ("blocked, time", "s", block, f"(SELECT count(*) FROM b JOIN s ON {block} AND {TIME})"),
                ("blocked", "s", block, f"(SELECT count(*) FROM b JOIN s ON {ROAD})"),
                ("range", "r", inside, f"(SELECT count(*) FROM b JOIN r s ON {inside} AND {road_lane_any})"),
                ("blocked, time and chainage", "s", block, "NULL::bigint")))),
        "tolerance_all": _pair_sql(f"{ROAD} AND {TIME} AND {CHAIN_GAP} <= 5 AND {NEAR}"),
        "tolerance_road_off": _pair_sql(f"{LANE} AND {TIME} AND {NEAR}"),
        "tolerance_time_off": _pair_sql(f"{ROAD} AND {CHAIN_GAP} <= 5 AND {NEAR}"),
        "tolerance_distance_only": _pair_sql(f"{LANE} AND {NEAR}"),
        "tolerance_spatial_off": _pair_sql(f"{ROAD} AND {TIME} AND {CHAIN_GAP} <= 5"),
        "tolerance_time_lane": _pair_sql(f"{LANE} AND {TIME}"),
        "best_by_time": _best_sql(f"{near20} AND {TIME}", f"{TIME_GAP}, {MICROMETRES}"),
        "best_by_chainage": _best_sql(near20, f"{CHAIN_GAP}, {MICROMETRES}"),
        "best_by_distance": _best_sql(f"{LANE} AND {NEAR}", MICROMETRES),
        "best_first": _sql(f"""SELECT b.rec_id, f.rec_id AS rec_id_lmd,
            CAST(floor(abs(b.t - f.t) / 1000000) AS bigint) AS time_diff_seconds,
            abs(b.c - f.c) AS chainage_diff_meters
            FROM b LEFT JOIN (SELECT * FROM s WHERE rec_id IN
                (SELECT min(rec_id) FROM s GROUP BY code)) f ON f.code = b.code"""),
        "merge_default": _sql(DEFAULT_MERGE, DEFAULT_BEST),
        "merge_distance": _sql("""SELECT b.rec_id, sid AS rec_id_lmd, round(dist, 3) AS dist_m
            FROM b LEFT JOIN best ON bid = b.rec_id""",
            _best_cte(f"{LANE} AND {TIME} AND {NEAR}", f"{TIME_GAP}, {MICROMETRES}")),
        "merge_range": _best_sql(f"{inside} AND {road_lane_any}", CHAIN_GAP, "r"),
        "merge_range_mixed": _best_sql(f"{inside} AND {road_lane_any} AND {CHAIN_GAP} <= 5", CHAIN_GAP, "r"),
        "merge_blocked": _best_sql(f"{ROAD} AND {TIME} AND {CHAIN_GAP} <= 5", TIME_GAP),
        "merge_blocked_untimed": _best_sql(ROAD, CHAIN_GAP),
        "merge_blocked_road_off": _best_sql(
            f"b.road IS NOT DISTINCT FROM s.road AND {LANE} AND {TIME}", TIME_GAP),
        "merge_cross": _best_sql(f"{LANE} AND {TIME}", TIME_GAP),
        "strategy_auto": _best_sql(f"{ROAD} AND {TIME} AND {CHAIN_GAP} <= 5 AND {NEAR}",
                                   f"{TIME_GAP}, {MICROMETRES}"),
        "strategy_auto_forced": _best_sql(f"{LANE} AND {TIME}", TIME_GAP),
        "suffix_conflicts": _sql("""SELECT b.rec_id, b.road AS "RoadName", b.code AS "Lane", b.latitude,
            b.longitude, b.chainage, b.road_id, b.region_id, b."TestDateUTC", 'x' AS "Filename_s",
            'y' AS "Filename", m."Filename" AS "Filename_s2", m.tsd_d0, m.code AS "Lane_s",
            m.chainage AS chainage_s, m.c AS "Chain_s",
            CAST(floor(tgap / 1000000) AS bigint) AS time_diff_seconds, cgap AS chainage_diff_meters
            FROM b LEFT JOIN best ON bid = b.rec_id LEFT JOIN s m ON m.rec_id = sid""", DEFAULT_BEST),
        "match_report": _sql("""SELECT count(*) AS base_rows, count(sid) AS matched_rows,
            round(count(sid) * 100.0 / count(*), 6) AS match_rate_pct,
            CAST(min(floor(tgap / 1000000)) AS bigint) AS min_time_diff_s,
            round(avg(floor(tgap / 1000000)), 6) AS avg_time_diff_s,
            CAST(max(floor(tgap / 1000000)) AS bigint) AS max_time_diff_s,
            round(min(cgap), 6) AS min_chainage_diff_m, round(avg(cgap), 6) AS avg_chainage_diff_m,
            round(max(cgap), 6) AS max_chainage_diff_m
            FROM b LEFT JOIN best ON bid = b.rec_id""", DEFAULT_BEST),
        "null_counts": _sql(" UNION ALL ".join(
            f"SELECT '{n}' AS column_name, count(*) - count(\"{n}\") AS nulls FROM merged"
            for n in default_names), f"{DEFAULT_BEST}, merged AS ({DEFAULT_MERGE})"),
        "coverage_check": _sql("""SELECT 'base' AS side, count(*) AS "rows", count(y) AS with_lat,
            count(x) AS with_lon FROM b UNION ALL
            SELECT 'supplement', count(*), 0, 0 FROM r"""),
        "csv_roundtrip": _sql(DEFAULT_MERGE, DEFAULT_BEST),
        "preview": _sql("SELECT * FROM base_raw ORDER BY rec_id LIMIT 100"),
        "merge_crowded": _best_sql(f"{ROAD} AND {TIME} AND {CHAIN_GAP} <= 5 AND {NEAR}", f"{TIME_GAP}, {MICROMETRES}", given=crowd),
        "distance_crowded": _best_sql(f"{LANE} AND abs(s.y - b.y) <= 0.0002 AND {DIST_SQL} <= 12", MICROMETRES, given=crowd),
        "range_crowded": _best_sql(f"{inside} AND {road_lane_any}", CHAIN_GAP, "r", given=crowd),
        "range_long": _best_sql(f"{inside.replace('BETWEEN s.c ', 'BETWEEN s.c_start ')} AND {road_lane_any}", CHAIN_GAP, "l", given=LONG_SQL),
        "auto_blocked": _best_sql(f"{ROAD} AND {TIME} AND {CHAIN_GAP} <= 5", TIME_GAP),
        "time_limit_edge": _best_sql(f"{ROAD} AND abs(b.t - s.t) <= 8200000 AND {CHAIN_GAP} <= 5 AND {NEAR}",
                                     f"{TIME_GAP}, {MICROMETRES}", given=tables_sql(supp=SUPP_LATE)),
        "merge_without_keys": _sql("""SELECT b.rec_id, sid IS NOT NULL AS matched, CAST(floor(tgap / 1000000) AS bigint) AS time_diff_seconds
            FROM b LEFT JOIN best ON bid = b.rec_id""", DEFAULT_BEST),
        "merge_default_columns": _sql("SELECT b.rec_id, m.\"Filename\", m.tsd_d0, " + ", ".join(
            f"'{i}-' || m.tsd_d0 AS \"{c}\"" for i, c in enumerate(DEFAULT_SOME)) + f""", {9 + 2 + len(DEFAULT_SOME) + 2} AS n_columns
            FROM b LEFT JOIN best ON bid = b.rec_id LEFT JOIN s m ON m.rec_id = sid""", DEFAULT_BEST),
        "location_chainage": _sql(f"SELECT {canonical} FROM b", given=tables_sql(base=BASE_KM)),
        "job_counts": _sql("""SELECT (SELECT count(*) FROM base_raw) AS base_read, (SELECT count(*) FROM b) AS base_kept,
            (SELECT count(*) FROM supp_raw) AS supp_read, (SELECT count(*) FROM s) AS supp_kept, (SELECT count(*) FROM best) AS matched""",
            DEFAULT_BEST),
        "row_numbers": _sql("""SELECT rec_id, row_number() OVER (ORDER BY CASE WHEN rec_id % 10 = 0 THEN 1 WHEN rec_id % 10 = 9 THEN 3 ELSE 2 END, rec_id) - 1
            AS row_number FROM b"""),
        "damaged_rows": """SELECT event_id, event_id % 53 = 1 OR event_id % 59 = 2 AS rejected, event_id || ',' || CASE WHEN event_id % 53 = 1
            THEN event_type ELSE event_type || ',' || user_id || CASE WHEN event_id % 59 = 2 THEN ',more' ELSE '' END END AS row FROM events""",
        "job_nulls": _sql(" UNION ALL ".join(f"SELECT '{n}' AS column_name, count(*) - count(\"{n}\") AS nulls FROM merged"
                                             for n in default_names), f"{DEFAULT_BEST}, merged AS ({DEFAULT_MERGE})"),
        "column_catalogue": _sql("""SELECT unnest(['rec_id', 'lat', 'lon', 'chainage', 'TestDateUTC', 'tsd_d0', 'Filename', 'RoadName', 'Lane'])
            AS column_name, (SELECT count(*) FROM s) AS supp_rows"""),
        "all_as_text": _sql("""SELECT b.rec_id::varchar AS rec_id, m.tsd_d0, CAST(floor(tgap / 1000000) AS bigint)::varchar AS time_diff_seconds,
            cgap AS chainage_diff_meters FROM b LEFT JOIN best ON bid = b.rec_id LEFT JOIN s m ON m.rec_id = sid""", DEFAULT_BEST),
        "missing_interval_columns": _sql("""SELECT b.rec_id, sid AS rec_id_lmd, 'supplement table lacks End Chainage (km)' AS said
            FROM b LEFT JOIN best ON bid = b.rec_id""", _best_cte("b.road = s.road AND b.code = 'L1' AND abs(b.c - s.c) <= 5", CHAIN_GAP, "r")),
        "without_coordinates": _sql("""SELECT b.rec_id, sid AS rec_id_lmd, CAST(floor(tgap / 1000000) AS bigint) AS time_diff_seconds
            FROM b LEFT JOIN best ON bid = b.rec_id""", _best_cte(f"b.road IS NOT DISTINCT FROM s.road AND {LANE} AND {TIME}", TIME_GAP)),
        "parameter_ranges": _sql(" UNION ALL ".join(f"""SELECT {seconds}::double AS max_time_s, {warned}::bigint AS warned, count(DISTINCT b.rec_id) AS matched_rows
            FROM b JOIN s ON {ROAD} AND abs(b.t - s.t) <= {seconds} * 1000000 AND {CHAIN_GAP} <= {metres}
                AND abs(s.y - b.y) <= {far} / 100000.0 AND {DIST_SQL} <= {far}"""
            for seconds, metres, far, warned in ((10, 5.0, 100, 0), (1, 0.1, 10, 0), (300, 100, 1000, 0), (0.5, 5.0, 100, 1), (10, 0.05, 5, 2)))),
        "csv_order": _sql("SELECT count(*) AS rows_out, 0::bigint AS out_of_order, 'LMD_MSD_Merged_V7.csv' AS name FROM b"),
    }


# --- the training-data operators, where their folder is present ---------------

def _with_llm() -> bool:
    """Only the folder's absence is forgiven; an import that fails inside it is an error."""
    return importlib.util.find_spec("llm") is not None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name: from a session and the folder of the tables to its rows."""
    found = survey_queries()
    if _with_llm():
        from llm.queries import queries as llm_queries
        found |= llm_queries()
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL for each query that SQL can express."""
    found = survey_sql()
    if _with_llm():
        from llm.queries import oracle_sql as llm_sql
        found |= llm_sql()
    return found
