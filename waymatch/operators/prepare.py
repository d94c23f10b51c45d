"""Clean a raw survey table into the canonical form the search works on.

Raw columns stay as they are.  The canonical values sit beside them under
private names, so that a raw ``lat`` and the parsed latitude never meet:

``_m_id`` row id, ``_m_place`` place in the files read, ``_m_road`` and ``_m_lane`` text, ``_m_time`` microseconds,
``_m_chain`` metres, ``_m_lat`` and ``_m_lon`` degrees.

Both functions are one narrow stage: a projection and a filter.  ``store``, if
given, is applied between the two: a merge writes the table down there, so that
no value is parsed twice.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymatch import config as C
from waymatch.functions.text import lane_code, lenient_double, strip, survey_micros
from waymatch.session import all_of, quoted, saved

log = logging.getLogger(__name__)

ROLES = ("lat", "lon", "chain", "road", "lane")


def find_column(df: DataFrame, aliases) -> str | None:
    """First alias present in the table, whatever its letter case."""
    by_lower: dict[str, str] = {}
    for name in df.columns:
        by_lower.setdefault(name.lower(), name)
    return next((by_lower[a.lower()] for a in aliases if a.lower() in by_lower), None)


def raw_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_m_")]


def has_time(df: DataFrame) -> bool:
    return C.TIME_COLUMN in df.columns


def _number(df: DataFrame, name: str) -> Column:
    return lenient_double(df, name, F.col(quoted(name)))


def _resolve(df: DataFrame, aliases: dict, given: dict) -> dict:
    unknown = [v for v in given.values() if v not in df.columns]
    if unknown or set(given) - set(ROLES):
        raise ValueError(f"column map {given} does not fit the table's columns")
    return {role: given.get(role) or find_column(df, aliases[role]) for role in ROLES}


def _prepare(df: DataFrame, key: str | None, found: dict, numbers: dict, needed, store=None) -> DataFrame:
    private = [c for c in df.columns if c.startswith("_m_")]
    if private:
        raise ValueError(f"column names starting with _m_ are reserved: {private}")
    added = {f"_m_{role}": number for role, number in numbers.items()}
    if found["road"]:
        added["_m_road"] = strip(F.col(quoted(found["road"])))
    if found["lane"]:
        added["_m_lane"] = lane_code(F.col(quoted(found["lane"])))
    if has_time(df):
        added["_m_time"] = survey_micros(df, C.TIME_COLUMN, F.col(quoted(C.TIME_COLUMN)))
    else:
        added["_m_time"] = F.lit(None).cast("long")

    kept = []
    if found["lane"]:
        kept.append(F.col("_m_lane").isin(*C.VALID_LANES))
    if has_time(df):
        kept.append(F.col("_m_time").isNotNull())
    kept += [F.col(f"_m_{role}").isNotNull() for role in needed]
    added["_m_place"] = _place()
    added["_m_id"] = F.col(quoted(key)).try_cast("long") if key else F.monotonically_increasing_id()
    ready = df.withColumns(added)
    return (store(ready) if store else ready).where(all_of(kept))


def _place() -> Column:
    """File, first byte of the split and a number that grows along it; rows that no file gave go by partition."""
    at, file = F.monotonically_increasing_id(), F.input_file_name()
    return F.struct(file.alias("file"), F.when(file == "", F.shiftright(at, 33)).otherwise(F.input_file_block_start()).alias("split"), at.alias("at"))


def number_rows(prepared: DataFrame, name: str = "row_number") -> DataFrame:
    """The rows kept with their number, 0-based and without gaps, by file name and line.

    Each split of a file is counted and numbered by itself; what lies before a
    split comes from the splits' counts, one row each.  So neither the number of
    files nor their sizes and the order in which Spark reads them matter.
    """
    rows = saved(prepared)
    split = [F.col("_m_place.file"), F.col("_m_place.split")]
    before = Window.orderBy("in_file", "in_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(split[0].alias("in_file"), split[1].alias("in_split")).agg(F.count(F.lit(1)).alias("n")).select(
        "in_file", "in_split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_m_start"))
    along = Window.partitionBy(*split).orderBy("_m_place.at")
    numbered = rows.withColumn("_m_nth", F.row_number().over(along)).join(
        starts, (split[0] == F.col("in_file")) & (split[1] == F.col("in_split")))
    return numbered.select(*[F.col(quoted(c)) for c in rows.columns], (F.col("_m_start") + F.col("_m_nth") - 1).alias(name))


def prepare_base(df: DataFrame, key: str | None = None, columns: dict | None = None, store=None) -> DataFrame:
    """The base survey: position and chainage are required in every row kept."""
    aliases = {"lat": C.LAT_ALIASES, "lon": C.LON_ALIASES, "chain": C.CHAIN_ALIASES,
               "road": C.BASE_ROAD_ALIASES, "lane": C.LANE_ALIASES}
    found = _resolve(df, aliases, columns or {})
    for role in ("lat", "lon"):
        if not found[role]:
            raise ValueError(f"base table has no {role} column (one of {aliases[role]})")
    numbers = {role: _number(df, found[role]) for role in ("lat", "lon")}
    location = find_column(df, (C.LOCATION_KM,))
    if found["chain"]:
        numbers["chain"] = _number(df, found["chain"])
    elif location:
        numbers["chain"] = _number(df, location) * 1000
    else:
        raise ValueError(f"base table has no chainage column ({C.CHAIN_ALIASES} or {C.LOCATION_KM})")
    return _prepare(df, key, found, numbers, needed=("lat", "lon", "chain"), store=store)


def prepare_supp(df: DataFrame, key: str | None = None, columns: dict | None = None, store=None) -> DataFrame:
    """The supplement survey: only chainage is required; the rest may be absent."""
    aliases = {"lat": C.LAT_ALIASES, "lon": C.LON_ALIASES, "chain": C.CHAIN_ALIASES,
               "road": C.SUPP_ROAD_ALIASES, "lane": C.LANE_ALIASES}
    found = _resolve(df, aliases, columns or {})
    missing = F.lit(None).cast("double")
    numbers = {role: _number(df, found[role]) if found[role] else missing
               for role in ("lat", "lon")}
    if found["chain"]:
        numbers["chain"] = _number(df, found["chain"])
    elif C.LOCATION_KM in df.columns:
        numbers["chain"] = _number(df, C.LOCATION_KM) * 1000
    elif C.START_KM in df.columns:
        numbers["chain"] = _number(df, C.START_KM) * 1000
    else:
        log.warning("supplement has no chainage column, so none of its rows can be used")
        numbers["chain"] = missing
    return _prepare(df, key, found, numbers, needed=("chain",), store=store)
