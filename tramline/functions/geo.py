"""Geometry as column expressions.

Three distances are kept apart on purpose, as their users rely on each: the
great circle with the radius of the equator, the great circle with the mean
radius, and a flat approximation scaled at the origin (not symmetric).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUATOR_M, MEAN_M, DEGREE_M = 6_378_100.0, 6_371_000.0, 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EQUATOR_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def equirect(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres, longitude scaled by the cosine of the origin's latitude."""
    return F.sqrt(F.pow((lat2 - lat1) * DEGREE_M, F.lit(2.0)) + F.pow((lon2 - lon1) * DEGREE_M * F.cos(F.radians(lat1)), F.lit(2.0)))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, scale: Column | float = 1.0) -> Column:
    """Fraction of the segment a-b nearest to p, between 0 and 1; x is scaled."""
    dx, dy = (bx - ax) * scale, by - ay
    length = dx * dx + dy * dy
    t = (((px - ax) * scale) * dx + (py - ay) * dy) / length
    return F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def line_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of p from the segment a-b in the units given (degrees)."""
    t = along(px, py, ax, ay, bx, by)
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), F.lit(2.0)) + F.pow(py - (ay + t * (by - ay)), F.lit(2.0)))


def band_width(band: Column, size: float) -> Column:
    """Degrees of longitude that ``size`` degrees of latitude make anywhere in a band of latitude, all of them at the poles."""
    most = F.greatest(F.abs(band * size), F.abs((band + 1) * size))
    return F.when(most >= 89.9, 360.0).otherwise(F.least(F.lit(360.0), F.lit(size) / F.cos(F.radians(most))))


def neighbours(left: DataFrame, right: DataFrame, metres: float, keep: list[str] | None = None) -> DataFrame:
    """Pairs of points within ``metres``: a grid join, not a product.

    Both sides have id, lat, lon.  Cells are bands of latitude, cut into stretches
    of longitude that are as wide as the reach is there, so the join is exact at
    any latitude.  The right side is copied to the three bands about its own and
    three stretches of each, so that each pair meets in the left point's cell.
    Gives from_id, to_id and distance_m, measured from the left point; the flat
    distance does not go round at 180 degrees, nor does the join.
    """
    size = metres / DEGREE_M * (1 + 1e-9)
    a = left.select(F.col("id").alias("from_id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), cell(F.col("lat"), size).alias("cy"), *(keep or []))
    a = a.withColumn("cx", F.floor(F.col("lon1") / band_width(F.col("cy"), size)))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    b = right.select(F.col("id").alias("to_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(near).alias("d"))
    b = b.withColumn("cy", cell(F.col("lat2"), size) + F.col("d")).drop("d")
    b = b.select("*", F.explode(near).alias("d")).withColumn("cx", F.floor(F.col("lon2") / band_width(F.col("cy"), size)) + F.col("d")).drop("d")
    pairs = a.join(b, ["cy", "cx"]).withColumn("distance_m", equirect(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return pairs.where((F.col("from_id") != F.col("to_id")) & (F.col("distance_m") <= metres)).drop("cy", "cx", "lat1", "lon1", "lat2", "lon2")
