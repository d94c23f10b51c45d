"""Pick the candidate strategy for a pair of prepared tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from waymatch import config as C
from waymatch.config import MatchConfig
from waymatch.operators.report import coverage

log = logging.getLogger(__name__)


def has_interval_columns(base: DataFrame, supp: DataFrame) -> bool:
    return {"road_id", "region_id"} <= set(base.columns) and {
        "road_id", "region_id", C.START_KM, C.END_KM} <= set(supp.columns)


def decide(cfg: MatchConfig, coordinates: bool, intervals: bool) -> str:
    """The strategy for given capabilities; plain logic without Spark."""
    # Asking for distances where none can be had falls back to the road.
    force_road = cfg.enable_spatial and not coordinates
    if cfg.enable_spatial and coordinates:
        return "spatial"
    if intervals:
        return "range"
    return "blocked" if cfg.enable_road or force_road else "cross"


def choose_strategy(base: DataFrame, supp: DataFrame, cfg: MatchConfig) -> str:
    """The configured strategy; "auto" takes one count over each side."""
    if cfg.strategy != "auto":
        return cfg.strategy
    sides = {row["side"]: row for row in coverage(base, supp).collect()}
    coordinates = all(row["with_lat"] > 0 and row["with_lon"] > 0 for row in sides.values())
    chosen = decide(cfg, coordinates, has_interval_columns(base, supp))
    log.info("strategy %s", chosen)
    return chosen
