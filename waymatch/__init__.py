"""waymatch: merge two road surveys that share no key, as lazy Spark plans."""

from waymatch.config import (
    DEFAULT_SUPP_COLUMNS,
    ESSENTIAL_SUPP_COLUMNS,
    VALID_LANES,
    MatchConfig,
)
from waymatch.operators.assemble import assemble, plan_names
from waymatch.operators.pairs import (
    blocked_pair_counts,
    cross_pair_count,
    match_pairs,
    radius_join,
    range_join,
)
from waymatch.operators.prepare import number_rows, prepare_base, prepare_supp
from waymatch.operators.report import coverage, match_report, null_counts
from waymatch.operators.rules import MatchRules, rules_for
from waymatch.operators.search import find_best
from waymatch.operators.volume import pair_volume
from waymatch.plans.merge import merge, prepare_sides, run_merge_job
from waymatch.plans.strategy import choose_strategy
from waymatch.sources.csv import kept_rows, preview, read_checked, read_survey, rejects, supp_catalogue, write_merged

__all__ = [
    "DEFAULT_SUPP_COLUMNS",
    "ESSENTIAL_SUPP_COLUMNS",
    "VALID_LANES",
    "MatchConfig",
    "MatchRules",
    "assemble",
    "blocked_pair_counts",
    "choose_strategy",
    "coverage",
    "cross_pair_count",
    "find_best",
    "kept_rows",
    "match_pairs",
    "match_report",
    "merge",
    "null_counts",
    "number_rows",
    "pair_volume",
    "plan_names",
    "prepare_base",
    "prepare_sides",
    "prepare_supp",
    "preview",
    "radius_join",
    "range_join",
    "read_checked",
    "read_survey",
    "rejects",
    "rules_for",
    "run_merge_job",
    "supp_catalogue",
    "write_merged",
]
