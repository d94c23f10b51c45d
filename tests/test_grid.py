"""The radius join against every pair, where a grid is most likely to fail."""

import random

import pytest

from tests.brute import metres
from waymatch import radius_join

PLACES = {
    "mid latitude": ((-27.02, -26.98), (153.0, 153.04), 250),
    "equator": ((-0.02, 0.02), (10.0, 10.04), 250),
    "antimeridian": ((-10.02, -9.98), (179.98, 180.02), 250),
    "far north": ((70.0, 70.02), (25.0, 25.05), 250),
    "pole": ((89.99, 90.0), (-180.0, 180.0), 250),
    "south pole": ((-90.0, -89.99), (-180.0, 180.0), 250),
    "wide": ((-60.0, 60.0), (-180.0, 180.0), 900_000),
    "beyond the pole": ((89.99, 90.01), (0.0, 90.0), 250),
}


@pytest.mark.parametrize("place", PLACES)
def test_radius_join_equals_all_pairs(spark, place):
    (south, north), (west, east), radius = PLACES[place]
    rng = random.Random(place)

    def points(count):
        rows = [(i, rng.uniform(south, north), rng.uniform(west, east)) for i in range(count)]
        return [(i, y, x - 360 if x > 180 else x) for i, y, x in rows]

    def frame(rows):
        return spark.createDataFrame([(i, y, x, 0.0, None, "r", "L1") for i, y, x in rows],
                                     "_m_id long, _m_lat double, _m_lon double, _m_chain double, "
                                     "_m_time long, _m_road string, _m_lane string")

    base, supp = points(250), points(250)
    got = [(r["base_id"], r["supp_id"]) for r in
           radius_join(frame(base), frame(supp), radius).collect()]
    expected = {(i, j) for i, y, x in base for j, y2, x2 in supp if metres(y, x, y2, x2) <= radius}
    assert len(got) == len(set(got))
    assert set(got) == expected
    assert expected


def test_missing_coordinates_never_match(spark):
    schema = ("_m_id long, _m_lat double, _m_lon double, _m_chain double, _m_time long, "
              "_m_road string, _m_lane string")
    odd = [(0, None, 1.0), (1, float("nan"), 1.0), (2, float("inf"), 1.0), (3, 1.0, 1.0)]
    df = spark.createDataFrame([(i, y, x, 0.0, None, "r", "L1") for i, y, x in odd], schema)
    assert [(r["base_id"], r["supp_id"], r["spatial_dist_m"]) for r in
            radius_join(df, df, 100).collect()] == [(3, 3, 0.0)]
