"""Parameters of a merge and the fixed values it depends on."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------
# Results depend on these lists and numbers; they are data, kept in their
# natural order.

VALID_LANES = ("L1", "R1", "L2", "R2", "LSK1", "RSK1")
LANE_RECODES = {"1": "L1", "2": "L2"}
ANY_LANE = "ALL"

EARTH_RADIUS_M = 6371000.0

# Alias lists, best name first; matched without regard to letter case.
LAT_ALIASES = ("latitude", "lat")
LON_ALIASES = ("longitude", "lon")
CHAIN_ALIASES = ("chainage", "chain")
BASE_ROAD_ALIASES = ("roadname", "road_name", "road", "road_id", "roadid")
SUPP_ROAD_ALIASES = (
    "roadname", "road_name", "road", "road_id", "roadid", "Road Name",
)
LANE_ALIASES = ("lane", "lane_id", "laneid")
LOCATION_KM = "location"
TIME_COLUMN = "TestDateUTC"
START_KM = "Start Chainage (km)"
END_KM = "End Chainage (km)"
RANGE_LANES = "Lanes"

DEFAULT_SUFFIX = "_lmd"
OUTPUT_NAME = "LMD_MSD_Merged_V{version}.csv"
OUTPUT_SUBFOLDER = "LMD-MSD_Merged"
VERSION_PATTERN = r"V1\.0\.0\.(\d+)"
PREVIEW_ROWS = 100

# Supplement columns appended when the caller names none.
DEFAULT_SUPP_COLUMNS = (
    "BinViewerVersion", "Filename", "lmd_sequence_num", "tsdLagOffset",
    "tsdZeroChange", "tsdSlopeMaxX", "tsdSlopeMaxY", "tsdSlopeMinX",
    "tsdSlopeMinY", "tsdCurveMaxX", "tsdCurveMaxY", "tsdCurveMinX",
    "tsdCurveMinY", "tsdJoltMaxX1", "tsdJoltMaxY1", "tsdJoltMinX",
    "tsdJoltMinY", "tsdJoltMaxX2", "tsdJoltMaxY2", "FitMethod", "CurveFitA",
    "CurveFitB", "CurveFitC", "CurveFitD", "CurveFitX", "CurveFitY",
    "ZeroOffset", "TrailingFactor", "r2", "NumIts", "tsd_d0", "tsd_d200",
    "tsd_d300", "tsd_d450", "tsd_d600", "tsd_d750", "tsd_d900", "tsd_d1200",
    "tsd_d1500", "tsd_d0s", "tsd_curvature", "FitCorrel",
    "compositeModulus3000", "compositeModulus2950", "compositeModulus2800",
    "compositeModulus2000", "compositeModulus1500", "compositeModulus1200",
    "compositeModulus900", "compositeModulus750", "compositeModulus600",
    "compositeModulus450", "compositeModulus300", "compositeModulus200",
    "compositeModulus0", "h1", "h2", "h3", "h4", "E1", "E2", "E3", "E4", "E5",
    "c0", "n", "Governing Distress Mode", "Governing Rem Life",
    "Governing LDE", "Governing Testing Life", "Governing Rem MESA",
    "Surface Cracking Down_remLife", "Bound Base Cracking Down 1_remLife",
    "Base Flexure_remLife", "Base Flexure 1_remLife",
    "Base Flexure 2_remLife", "Base Flexure 3_remLife",
    "Bound Base Cracking Upward_remLife", "Base Spreading_remLife",
    "Bound Subbase Cracking Upward_remLife", "Subgrade Rutting_remLife",
    "Subgrade Shear_remLife", "Subbase Spreading_remLife",
    "Subgrade Spreading_remLife", "Transverse Cracking_remLife",
    "Shrinkage_remLife", "Subbase Rutting_remLife", "Subbase Shear_remLife",
    "Aggregate Spreading_remLife", "Surface Flexure_remLife",
    "Shallow Shear_remLife", "Shallow Shear 2_remLife",
    "Shallow Shear 4_remLife", "Surface Cracking Upward_remLife",
    "Shallow Instability_remLife", "Shallow Instability 5_remLife",
    "Shallow Instability 7_remLife", "Aggregate Rutting_remLife",
    "Aggregate Shear_remLife", "Shallow Instability 4_remLife",
    "Shallow Instability 1_remLife", "Shallow Instability 2_remLife",
)

# The short pick for a small output.
ESSENTIAL_SUPP_COLUMNS = (
    "BinViewerVersion", "Filename", "tsdSlope3000", "tsdSlope2000",
    "tsdSlope1000", "compositeModulus3000", "compositeModulus2000",
)

# Names of the helper columns and of those a result may drop again.
HELPERS = {"Lat": "_m_lat", "Lon": "_m_lon", "Chain": "_m_chain", "TestDateUTC_parsed": "_m_time"}
DIFFERENCES = ("time_diff_seconds", "chainage_diff_meters")
RESERVED = (*HELPERS, "time_diff", "chainage_diff", *DIFFERENCES)
LEGACY_DROPPED = ("Lane_lmd", "Time_lmd", "Chain_lmd", "RoadName_lmd")
# --- End of fixed values ----------------------------------------------------

STRATEGIES = ("spatial", "range", "blocked", "cross", "auto")

# Usual ranges; values outside are allowed but warned about.
_USUAL = {
    "max_time_diff_s": (1, 300),
    "max_chainage_diff_m": (0.1, 100),
    "max_distance_m": (10, 1000),
}


@dataclass(frozen=True)
class MatchConfig:
    """Everything a caller can set for one merge.

    ``enable_time`` left at ``None`` means on, except for the explicit range
    strategy, where a position inside the interval is the whole test.

    ``base_key`` / ``supp_key`` name a column that orders the rows: the base key
    the output, the supplement key ties (nulls come last).  It need not be
    unique, a number or present in every row; rows are told apart by ids that
    are generated and written down with the columns the merge needs.

    ``hot_bucket_rows`` is the bucket size beyond which the search refines a
    bucket instead of comparing everything in it; ``None`` skips that check.
    """

    max_time_diff_s: float = 10
    max_chainage_diff_m: float = 5.0
    max_distance_m: float = 100
    strategy: str = "spatial"
    enable_time: bool | None = None
    enable_road: bool = True
    enable_spatial: bool = True
    supp_columns: tuple[str, ...] | None = None
    suffix: str = DEFAULT_SUFFIX
    base_key: str | None = None
    supp_key: str | None = None
    base_map: dict[str, str] = field(default_factory=dict)
    supp_map: dict[str, str] = field(default_factory=dict)
    include_distance: bool = False
    legacy_drop: bool = False
    hot_bucket_rows: int | None = 2_000

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}: {self.strategy!r}")
        for name, (low, high) in _USUAL.items():
            value = getattr(self, name)
            if not 0 < value < float("inf"):
                raise ValueError(f"{name} must be positive and finite: {value!r}")
            if not low <= value <= high:
                warnings.warn(f"{name}={value} is outside the usual {low}..{high}", stacklevel=3)

    @property
    def time_on(self) -> bool:
        if self.enable_time is None:
            return self.strategy != "range"
        return self.enable_time

    @property
    def requested_columns(self) -> tuple[str, ...]:
        return DEFAULT_SUPP_COLUMNS if self.supp_columns is None else tuple(self.supp_columns)
