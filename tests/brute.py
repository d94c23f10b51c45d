"""Plain-Python matching, one pair at a time, to compare the searches with."""

import math
import random

from waymatch.config import ANY_LANE, EARTH_RADIUS_M

BASE_SCHEMA = ("rec_id long, roadname string, lane string, latitude string, longitude string, "
               "chainage string, road_id string, region_id string, TestDateUTC string")
SUPP_SCHEMA = "rec_id long, roadname string, lane string, lat string, lon string, chainage string, TestDateUTC string"
RANGE_SCHEMA = ("rec_id long, road_id string, region_id string, roadname string, Lanes string, "
                "`Start Chainage (km)` string, `End Chainage (km)` string")


def stamp(micros):
    seconds, micro = divmod(micros, 1_000_000)
    return (f"2024-01-01T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
            f".{micro:06d}Z")


def survey(count, seed, step=0.00002, spread_m=400, hours=0.05, crowd=False):
    """Points near one spot.  A third are copies of one row; a crowd leaves the
    rest within one bucket as well."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        road = "A" if crowd else rng.choice(["A", "A", "B", None])
        lane = "L1" if crowd else rng.choice(["L1", "L1", "R1", "L2"])
        chain = round(rng.uniform(0, 12 if crowd else spread_m), 2)
        micros = rng.randrange(0, 6_000_000 if crowd else int(hours * 3_600_000_000))
        row = [road, lane, -27 + rng.uniform(-1, 1) * step, 153 + chain / 99_000 + rng.uniform(-1, 1) * step,
               chain, micros]
        if i and rng.random() < 0.33:
            row = list(rows[0][1:])
        rows.append((i, *row))
    return rows


def as_base(spark, rows):
    return spark.createDataFrame(
        [(i, road, lane, repr(y), repr(x), repr(c), f"R{road}", None if i % 5 == 0 else "G", stamp(t))
         for i, road, lane, y, x, c, t in rows], BASE_SCHEMA)


def as_supp(spark, rows):
    return spark.createDataFrame(
        [(i, road, lane, repr(y), repr(x), repr(c), stamp(t)) for i, road, lane, y, x, c, t in rows],
        SUPP_SCHEMA)


def metres(y1, x1, y2, x2):
    p1, p2 = math.radians(y1), math.radians(y2)
    a = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2)
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(max(a, 0.0))))


def best(base, supp, rules):
    """Base id to best supplement id."""
    found = {}
    for i, road, lane, y, x, c, t in base:
        options = []
        for j, road2, lane2, y2, x2, c2, t2 in supp:
            if lane != lane2:
                continue
            if "road" in rules.equal and (road is None or road != road2):
                continue
            if "road" in rules.same and road != road2:
                continue
            if rules.max_time_s is not None and abs(t - t2) > rules.max_time_s * 1_000_000:
                continue
            if rules.max_chain_m is not None and abs(c - c2) > rules.max_chain_m:
                continue
            far = metres(y, x, y2, x2)
            if rules.max_dist_m is not None and far > rules.max_dist_m:
                continue
            order = []
            if rules.rank == "time":
                order.append(abs(t - t2))
            elif rules.rank == "chain":
                order.append(abs(c - c2))
            if rules.max_dist_m is not None:
                order.append(round(far, 6))
            options.append((*order, j))
        if options:
            found[i] = min(options)[-1]
    return found


def best_interval(base, intervals, mixed_m=None):
    """Base id to best interval id; base rows as made by ``as_base``."""
    found = {}
    for row in base:
        options = []
        for j, road_id, region, road, lanes, start, end in intervals:
            try:
                low, high = float(start) * 1000, float(end) * 1000
            except ValueError:
                continue
            if (row["road_id"], row["region_id"]) != (road_id, region):
                continue
            if row["roadname"] is None or row["roadname"] != road:
                continue
            if lanes not in (ANY_LANE, row["lane"]):
                continue
            c = float(row["chainage"])
            gap = abs(c - low)
            if low <= c <= high and (mixed_m is None or gap <= mixed_m):
                options.append((gap, j))
        if options:
            found[row["rec_id"]] = min(options)[-1]
    return found
