"""Geo commands on DataFrames of (member, longitude, latitude)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.spatial import COMMAND_RADIUS, MOST_LATITUDE, degrees, geo_point, geo_score, geohash, haversine, unit


def add(lon: Column, lat: Column) -> Column:
    """GEOADD: the score that stands for the point in a sorted set; out of range is an error."""
    inside = lon.between(-180, 180) & lat.between(-MOST_LATITUDE, MOST_LATITUDE)
    score = geo_score(lat, lon)
    return F.when(inside, score).otherwise(F.when(F.assert_true(inside, "invalid longitude,latitude pair").isNull(), score))


def position(score: Column) -> Column:
    """GEOPOS: the point of a score."""
    return geo_point(score)


def distance_of(a: Column, b: Column, in_unit: str = "m") -> Column:
    """GEODIST between two scores."""
    p, q = geo_point(a), geo_point(b)
    return distance(p["longitude"], p["latitude"], q["longitude"], q["latitude"], in_unit)


def distance(lon1: Column, lat1: Column, lon2, lat2, in_unit: str = "m") -> Column:
    return haversine(lat1, lon1, lat2, lon2, COMMAND_RADIUS) / unit(in_unit)


def hash_of(lon: Column, lat: Column) -> Column:
    return geohash(lat, lon)


def search(df: DataFrame, lon: float, lat: float, radius: float | None = None, width: float | None = None, height: float | None = None, in_unit: str = "m", count: int | None = None, descending: bool | None = None, x: str = "longitude", y: str = "latitude", ties: tuple[str, ...] = ()) -> DataFrame:
    """GEOSEARCH by radius, or by a box of width and height around a point; with the distance of each member.

    A band of latitudes is filtered first, which file statistics can prune. ties are columns that order members at one distance."""
    d = distance(F.col(x), F.col(y), lon, lat, in_unit)
    reach = radius if radius is not None else height / 2
    band = degrees(reach * unit(in_unit), COMMAND_RADIUS) + 1e-9
    out = df.filter(F.col(y).between(lat - band, lat + band)).withColumn("distance", d)
    if radius is not None:
        out = out.filter(F.col("distance") <= radius)
    else:
        out = out.filter((distance(F.col(x), F.col(y), F.col(x), F.lit(lat), in_unit) <= height / 2) & (distance(F.col(x), F.col(y), F.lit(lon), F.col(y), in_unit) <= width / 2))
    if descending is not None or count is not None:
        out = out.orderBy(F.desc("distance") if descending else F.asc("distance"), *ties)
    return out if count is None else out.limit(count)
