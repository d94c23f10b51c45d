"""Which comparisons decide a match, and which difference ranks the matches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymatch import config as C
from waymatch.config import MatchConfig
from waymatch.functions.geo import haversine_m
from waymatch.functions.text import finite, spoken_double
from waymatch.operators.prepare import has_time
from waymatch.session import all_of, quoted

SECOND = 1_000_000

# Raw key columns of the interval strategy; other fields come from "_m_…".
_RAW_FIELDS = ("road_id", "region_id")


@dataclass(frozen=True)
class MatchRules:
    """Conjunction of predicates, all limits inclusive; ``None`` means unused.

    ``equal`` fields must be equal and present; ``same`` fields must be equal or
    both missing.
    """

    equal: tuple[str, ...] = ("lane",)
    same: tuple[str, ...] = ()
    max_time_s: float | None = None
    max_chain_m: float | None = None
    max_dist_m: float | None = None
    inside_interval: bool = False
    rank: str | None = None      # "time", "chain", "dist" or None for the lowest id

    @property
    def values(self) -> tuple[str, ...]:
        """Numeric fields the rules look at."""
        used = []
        if self.max_time_s is not None or self.rank == "time":
            used.append("time")
        if self.max_chain_m is not None or self.rank == "chain" or self.inside_interval:
            used.append("chain")
        if self.max_dist_m is not None:
            used += ["lat", "lon"]
        return tuple(used)

    @property
    def keys(self) -> tuple[str, ...]:
        return self.equal + self.same

    @property
    def fields(self) -> tuple[str, ...]:
        return self.keys + self.values

    @property
    def on_a_line(self) -> bool:
        """Only one number is compared and it is also the rank."""
        return not self.inside_interval and self.values == (self.rank,)

    @property
    def max_time_us(self) -> int | None:
        return None if self.max_time_s is None else round(self.max_time_s * SECOND)

    @property
    def rank_limit(self) -> float | None:
        return {"time": self.max_time_s, "chain": self.max_chain_m,
                "dist": self.max_dist_m}[self.rank]

    def with_rank_limit(self, limit: float) -> "MatchRules":
        name = {"time": "max_time_s", "chain": "max_chain_m", "dist": "max_dist_m"}[self.rank]
        return replace(self, **{name: limit})


def rules_for(strategy: str, cfg: MatchConfig, timed: bool) -> MatchRules:
    """Rules of one candidate strategy; ``timed`` says both sides carry a time."""
    spatial = strategy == "spatial"
    road = cfg.enable_road or strategy == "range"
    time_used = cfg.time_on and timed
    mixed = spatial or cfg.time_on
    if time_used:
        rank = "time"
    elif road:
        rank = "chain"
    elif spatial:
        rank = "dist"
    else:
        rank = None
    same = ()
    if strategy == "range":
        same = _RAW_FIELDS
    elif strategy == "blocked" and not road:
        same = ("road",)
    return MatchRules(
        equal=("road", "lane") if road else ("lane",),
        same=same,
        max_time_s=cfg.max_time_diff_s if time_used else None,
        max_chain_m=cfg.max_chainage_diff_m if road and mixed else None,
        max_dist_m=cfg.max_distance_m if spatial else None,
        inside_interval=strategy == "range",
        rank=rank,
    )


def both_timed(base: DataFrame, supp: DataFrame) -> bool:
    return has_time(base) and has_time(supp)


def check_columns(base: DataFrame, supp: DataFrame, rules: MatchRules) -> None:
    """Fail early, naming the column, when the rules need one that is absent."""
    needs = {"base": [], "supplement": []}
    for field in rules.keys:
        name = field if field in _RAW_FIELDS else f"_m_{field}"
        needs["base"].append(name)
        if not (field == "lane" and rules.inside_interval and C.RANGE_LANES in supp.columns):
            needs["supplement"].append(name)
    if rules.inside_interval:
        needs["supplement"] += [C.START_KM, C.END_KM]
    for side, df in (("base", base), ("supplement", supp)):
        absent = [n.removeprefix("_m_") for n in needs[side] if n not in df.columns]
        if absent:
            raise ValueError(f"{side} table lacks {', '.join(absent)}")


def _source(field: str) -> Column:
    return F.col(field if field in _RAW_FIELDS else f"_m_{field}")


def _usable(df: DataFrame, prefix: str, rules: MatchRules) -> DataFrame:
    """Drop rows that can match nothing: a missing key or a non-number."""
    tests = [F.col(prefix + field).isNotNull() for field in rules.equal]
    for field in rules.values:
        value = F.col(prefix + field)
        tests.append(value.isNotNull() if field == "time" else finite(value))
    return df.where(all_of(tests))


def base_fields(base: DataFrame, rules: MatchRules, extra: tuple[str, ...] = ()) -> DataFrame:
    """Usable base rows as ``b_…`` columns; ``extra`` fields ride along."""
    names = dict.fromkeys((*rules.fields, *extra))
    rows = base.select(*[_source(f).alias(f"b_{f}") for f in names])
    return _usable(rows, "b_", rules)


def base_points(base: DataFrame, rules: MatchRules) -> DataFrame:
    """Distinct search keys: copies of a base row are searched for once."""
    return base_fields(base, rules).distinct()


def interval_lane(supp: DataFrame) -> Column:
    """Lane of an interval row, as written in its own column if it has one."""
    return F.col(quoted(C.RANGE_LANES)) if C.RANGE_LANES in supp.columns else F.col("_m_lane")


def supp_fields(supp: DataFrame, rules: MatchRules, extra: tuple[str, ...] = ()) -> DataFrame:
    """Usable supplement rows as ``s_…`` columns with their id."""
    columns = {f"s_{f}": _source(f) for f in dict.fromkeys((*rules.fields, "id", *extra))}
    if rules.inside_interval:
        columns["s_start"] = spoken_double(F.col(quoted(C.START_KM))) * 1000
        columns["s_end"] = spoken_double(F.col(quoted(C.END_KM))) * 1000
    if rules.inside_interval and "lane" in rules.equal:
        # The any-lane mark stands for each valid lane, which keeps the lane
        # an equality key of the join.
        every = F.array(*[F.lit(lane) for lane in C.VALID_LANES])
        lanes = interval_lane(supp)
        columns["s_lane"] = F.explode(F.when(lanes == C.ANY_LANE, every).otherwise(F.array(lanes)))
    rows = supp.select(*[value.alias(name) for name, value in columns.items()])
    if rules.inside_interval:
        rows = rows.where(finite(F.col("s_start")) & finite(F.col("s_end")))
    return _usable(rows, "s_", rules)


def supp_points(supp: DataFrame, rules: MatchRules) -> DataFrame:
    """One row per distinct supplement point, with the lowest id among copies.

    Copies tie on every rank, so the lowest id is the one a tie would pick.
    """
    rows = supp_fields(supp, rules)
    return rows.groupBy(*[c for c in rows.columns if c != "s_id"]).agg(F.min("s_id").alias("s_id"))


def time_gap() -> Column:
    return F.abs(F.col("b_time") - F.col("s_time"))


def chain_gap() -> Column:
    return F.abs(F.col("b_chain") - F.col("s_chain"))


def distance() -> Column:
    return haversine_m(F.col("b_lat"), F.col("b_lon"), F.col("s_lat"), F.col("s_lon"))


def key_condition(rules: MatchRules) -> Column:
    """Equality part of the join; both kinds become hash keys."""
    tests = [F.col(f"b_{f}") == F.col(f"s_{f}") for f in rules.equal]
    tests += [F.col(f"b_{f}").eqNullSafe(F.col(f"s_{f}")) for f in rules.same]
    return all_of(tests)


def residual_condition(rules: MatchRules) -> Column:
    """Tolerances, cheapest first."""
    tests = []
    if rules.max_time_s is not None:
        tests.append(time_gap() <= rules.max_time_us)
    if rules.max_chain_m is not None:
        tests.append(chain_gap() <= rules.max_chain_m)
    if rules.inside_interval:
        tests.append(F.col("b_chain").between(F.col("s_start"), F.col("s_end")))
    if rules.max_dist_m is not None:
        tests.append(distance() <= rules.max_dist_m)
    return all_of(tests)


def order_columns(rules: MatchRules) -> list[Column]:
    """Total order of the candidates of one base row, best first."""
    order = []
    if rules.rank == "time":
        order.append(time_gap().alias("gap"))
    elif rules.rank == "chain":
        order.append(chain_gap().alias("gap"))
    if rules.max_dist_m is not None:
        order.append(F.round(distance(), 6).alias("dist"))
    return [*order, F.col("s_id")]
