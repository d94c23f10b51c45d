"""Put the result together: every base row, plus columns of its best match."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymatch import config as C
from waymatch.config import MatchConfig
from waymatch.functions.geo import haversine_m
from waymatch.operators.prepare import raw_columns
from waymatch.operators.rules import MatchRules, both_timed
from waymatch.operators.search import base_columns
from waymatch.session import all_of, case_sensitive, quoted

log = logging.getLogger(__name__)

# Names under which a cleaned column is public, if the raw table has none such.
PUBLIC = {"RoadName": "_m_road", "Lane": "_m_lane"}


def public_columns(df: DataFrame) -> dict[str, str]:
    """Visible columns of a prepared table: name to source column.

    Cleaned road and lane replace a raw column of the same name.  Where Spark
    ignores letter case they also replace ``lane`` or ``roadname``, since both
    could not stand in one table.
    """
    sensitive = case_sensitive(df.sparkSession)
    columns = {name: name for name in raw_columns(df)}
    for name, source in PUBLIC.items():
        if source not in df.columns:
            continue
        twin = next((c for c in columns if c != name and c.lower() == name.lower()), None)
        if twin and not sensitive:
            columns = {name if c == twin else c: s for c, s in columns.items()}
        columns[name] = source
    return columns


def supp_catalogue_columns(supp: DataFrame) -> dict[str, str]:
    columns = public_columns(supp)
    return {**{n: s for n, s in C.HELPERS.items() if n not in columns}, **columns}


def plan_names(requested, available, taken, suffix: str, sensitive: bool = True) -> dict[str, str]:
    """Source column to output column.

    Unknown columns are left out, repeats count once.  A name already in the
    result gets the suffix, then the suffix with 2, 3, … until it is free.
    """
    fold = (lambda n: n) if sensitive else str.lower
    used = {fold(n) for n in taken}
    plan: dict[str, str] = {}
    for name in dict.fromkeys(requested):
        if name not in available:
            log.warning("supplement has no column %r", name)
            continue
        out, attempt = name, 1
        while fold(out) in used:
            out = f"{name}{suffix}{attempt if attempt > 1 else ''}"
            attempt += 1
        used.add(fold(out))
        plan[name] = out
    return plan


def assemble(base: DataFrame, supp: DataFrame, best: DataFrame, rules: MatchRules,
             cfg: MatchConfig, keep_id: bool = False) -> DataFrame:
    """Left outer join of base with the chosen columns of its best match.

    Only the narrow best-match table is joined to the supplement; the wide base
    is shuffled once.  Copies of a base point all find the one answer.
    """
    timed = both_timed(base, supp)
    shown = public_columns(base)
    offered = supp_catalogue_columns(supp)
    plan = plan_names(cfg.requested_columns, offered, (*shown, *C.RESERVED), cfg.suffix,
                      case_sensitive(base.sparkSession))
    if cfg.legacy_drop:
        plan = {n: out for n, out in plan.items() if out not in C.LEGACY_DROPPED}

    # Everything joined to the base carries the private prefix, so that no raw
    # column name can clash with it.
    picked = {"_m_p_id": F.col("_m_id"), "_m_p_time": F.col("_m_time"),
              "_m_p_chain": F.col("_m_chain"), "_m_p_lat": F.col("_m_lat"), "_m_p_lon": F.col("_m_lon")}
    payload = {name: f"_m_p_col{i}" for i, name in enumerate(plan)}
    for name, inner in payload.items():
        picked[inner] = F.col(quoted(offered[name]))
    points = best.select(*[F.col(c).alias(f"_m_{c}") for c in best.columns])
    found = points.join(
        supp.select(*[value.alias(name) for name, value in picked.items()]),
        F.col("_m_s_id") == F.col("_m_p_id"))
    if rules.rank is None and rules.keys == ("lane",):
        found = F.broadcast(found)      # one row per valid lane, six at most

    joined = base.join(found, all_of([_same(c, rules) for c in base_columns(rules)]), "left")
    columns = {name: F.col(quoted(source)) for name, source in shown.items()}
    for name, out in plan.items():
        columns[out] = F.col(payload[name])
    if timed:
        gap = F.abs(F.col("_m_time") - F.col("_m_p_time"))
        columns["time_diff_seconds"] = F.floor(gap / 1_000_000)
    columns["chainage_diff_meters"] = F.abs(F.col("_m_chain") - F.col("_m_p_chain"))
    if cfg.include_distance:
        columns["spatial_dist_m"] = haversine_m(
            F.col("_m_lat"), F.col("_m_lon"), F.col("_m_p_lat"), F.col("_m_p_lon"))
    if keep_id:
        columns["_m_id"] = F.col("_m_id")
    return joined.select(*[value.alias(name) for name, value in columns.items()])


def _same(column: str, rules: MatchRules):
    field = column.removeprefix("b_")
    left = F.col(field if field in ("road_id", "region_id") else f"_m_{field}")
    right = F.col(f"_m_{column}")
    return left.eqNullSafe(right) if field in rules.same else left == right
