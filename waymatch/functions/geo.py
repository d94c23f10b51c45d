"""Great-circle distance and the latitude/longitude grid of the radius join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymatch.config import EARTH_RADIUS_M

PAD = 1.000001      # keeps grid reach just above the exact radius
PAD_DEG = 1e-9      # and above rounding, about 0.1 mm
CELL_WIDTH = 2.0    # cell side in radii: about four cells per circle


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres between two points given in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    up = F.sin((p2 - p1) / 2)
    across = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    half = up * up + F.cos(p1) * F.cos(p2) * across * across
    # Rounding may step out of 0..1; greatest() and least() would hide a null.
    bounded = F.when(half < 0.0, 0.0).when(half > 1.0, 1.0).otherwise(half)
    return F.asin(F.sqrt(bounded)) * (2 * EARTH_RADIUS_M)


def _on_globe(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same place with latitude in -90..90 and longitude in 0..360."""
    turn = F.pmod(lat + 90.0, F.lit(360.0))
    beyond = turn > 180.0
    inside = F.abs(lat) <= 90.0
    lat_in = F.when(inside, lat).when(beyond, 270.0 - turn).otherwise(turn - 90.0)
    flip = F.when(inside | ~beyond, 180.0).otherwise(360.0)
    return lat_in, F.pmod(lon + flip, F.lit(360.0))


def _band_height(radius_m: float) -> float:
    return math.degrees(radius_m * CELL_WIDTH / EARTH_RADIUS_M) * PAD


def _cells_in(band: Column, height: float) -> Column:
    """How many cells a latitude band is cut into: fewer towards the poles."""
    low = band * height - 90.0
    edge = F.least(F.greatest(F.abs(low), F.abs(low + height)), F.lit(90.0))
    count = F.floor(F.cos(F.radians(edge)) * 360.0 / height)
    return F.greatest(count, F.lit(1)).cast("long")


def with_cell(df: DataFrame, lat: str, lon: str, radius_m: float,
              band: str, cell: str) -> DataFrame:
    """Add the one grid cell each point lies in."""
    height = _band_height(radius_m)
    lat_in, east = _on_globe(F.col(lat), F.col(lon))
    count = _cells_in(F.col(band), height)
    slot = F.floor(F.col("_east") / 360.0 * count).cast("long")
    return (
        df.withColumns({band: F.floor((lat_in + 90.0) / height).cast("long"), "_east": east})
        .withColumn(cell, F.least(slot, count - 1))
        .drop("_east")
    )


def with_cells_near(df: DataFrame, lat: str, lon: str, radius_m: float,
                    band: str, cell: str) -> DataFrame:
    """One row per grid cell touched by the circle around each point."""
    height = _band_height(radius_m)
    angle = radius_m / EARTH_RADIUS_M
    spread = math.degrees(angle) * PAD + PAD_DEG
    lat_in, east = _on_globe(F.col(lat), F.col(lon))
    first = F.greatest(F.floor((lat_in - spread + 90.0) / height), F.lit(0))
    last = F.floor((F.least(lat_in + spread, F.lit(90.0)) + 90.0) / height)
    over_pole = F.abs(lat_in) + spread >= 90.0
    half = F.asin(F.least(math.sin(min(angle, math.pi / 2)) / F.cos(F.radians(lat_in)), F.lit(1.0)))
    reach = F.when(over_pole, F.lit(360.0)).otherwise(F.degrees(half) * PAD + PAD_DEG)
    df = df.withColumns({"_east": east, "_reach": reach,
                         band: F.explode(F.sequence(first, last).cast("array<long>"))})
    count = F.col("_count")
    left = F.floor((F.col("_east") - F.col("_reach")) / 360.0 * count).cast("long")
    right = F.floor((F.col("_east") + F.col("_reach")) / 360.0 * count).cast("long")
    whole = right - left >= count - 1
    start = F.when(whole, F.lit(0).cast("long")).otherwise(left)
    end = F.when(whole, count - 1).otherwise(right)
    return (
        df.withColumn("_count", _cells_in(F.col(band), height))
        .withColumn(cell, F.explode(F.sequence(start, end)))
        .withColumn(cell, F.pmod(F.col(cell), count))
        .drop("_east", "_reach", "_count")
    )


def within_cell(df: DataFrame, lat: str, lon: str, radius_m: float, band: str, cell: str, parts: int, reach: bool):
    """The part of its grid cell a point lies in, counted from 0 to ``parts`` - 1 in latitude and in longitude.

    With ``reach`` the first and last parts that the circle around the point
    touches: two pairs of columns.
    """
    height = _band_height(radius_m)
    lat_in, east = _on_globe(F.col(lat), F.col(lon))
    count = _cells_in(F.col(band), height)
    up = (lat_in + 90.0) / height - F.col(band)
    along = F.pmod(east / 360.0 * count - F.col(cell), count.cast("double"))

    def part(x):
        return F.greatest(F.least(F.floor(x * parts), F.lit(parts - 1)), F.lit(0))
    if not reach:
        return part(up), part(along)
    angle = radius_m / EARTH_RADIUS_M
    spread = math.degrees(angle) * PAD + PAD_DEG
    half = F.asin(F.least(math.sin(min(angle, math.pi / 2)) / F.cos(F.radians(lat_in)), F.lit(1.0)))
    over_pole = F.abs(lat_in) + spread >= 90.0
    wide = F.when(over_pole, F.lit(360.0)).otherwise(F.degrees(half) * PAD + PAD_DEG) / 360.0 * count
    # The way round the globe by which the circle is nearer to the cell.
    nearer = F.when(along > count / 2, along - count).otherwise(along)
    whole = wide * 2 >= count - 1
    low = F.when(whole, 0.0).otherwise(nearer - wide)
    high = F.when(whole, 1.0).otherwise(nearer + wide)
    return (part(up - spread / height), part(up + spread / height)), (part(low), part(high))
