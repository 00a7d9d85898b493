"""Distances and shapes on the earth as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres: the mean radius that queries use, and the one of the geo commands.
QUERY_RADIUS, COMMAND_RADIUS = 6371008.7714, 6372797.560856
#: Metres of a unit; unknown units count as metres.
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "yd": 0.9144, "nm": 1852.0, "nmi": 1852.0, "ft": 0.3048}


def unit(name: str | None) -> float:
    return UNITS.get((name or "m").lower(), 1.0)


def haversine(lat1, lon1, lat2, lon2, radius: float = QUERY_RADIUS) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)))


def degrees(metres: float, radius: float = QUERY_RADIUS) -> float:
    return math.degrees(metres / radius)


def in_circle(lat: Column, lon: Column, at_lat: float, at_lon: float, metres: float) -> Column:
    """A band of latitude first, which a scan can use, then the distance."""
    band = degrees(metres) + 1e-9
    return lat.between(at_lat - band, at_lat + band) & (haversine(lat, lon, at_lat, at_lon) <= metres)


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Corners top-left and bottom-right; left > right crosses the date line."""
    across = lon.between(left, right) if left <= right else (lon >= left) | (lon <= right)
    return lat.between(bottom, top) & across


def in_polygon(lat: Column, lon: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting over constant edges: an odd number of edges lies to the east."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossings = crossings + F.when(spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


# The digits of a geohash; of the geo commands, the latitudes that count and the bits of each coordinate.
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
MOST_LATITUDE, BITS = 85.05112878, 26


def _cell(x: Column, most: float, bits: int) -> Column:
    """The place of x among 2**bits equal cells from -most to most; beyond them the first or last."""
    inside = F.least(F.greatest(x, F.lit(-most)), F.lit(most))
    return F.least(F.floor((inside + most) / (2 * most) * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def _bound(value: Column, f) -> Column:
    """f(value) with value made once for all its uses."""
    return F.get(F.transform(F.array(value), f), 0)


def _bit(n: Column, at: int, to: int) -> Column:
    return F.shiftleft(F.shiftright(n, at).bitwiseAND(F.lit(1).cast("long")), to)


def geo_score(lat: Column, lon: Column) -> Column:
    """The 52-bit number that the geo commands store for a point: bits of longitude and latitude by turns."""
    cells = F.struct(_cell(lon, 180.0, BITS).alias("x"), _cell(lat, MOST_LATITUDE, BITS).alias("y"))
    turns = lambda c: reduce(lambda a, b: a.bitwiseOR(b), [_bit(c[n], k, 2 * k + odd) for k in range(BITS) for n, odd in (("x", 1), ("y", 0))])
    return _bound(cells, turns)


def geo_point(score: Column) -> Column:
    """The longitude and latitude of a stored number: the middle of its cell."""

    def middle(n: Column) -> Column:
        x, y = (reduce(lambda a, b: a.bitwiseOR(b), [_bit(n, 2 * k + odd, k) for k in range(BITS)]) for odd in (1, 0))
        x, y = ((c + 0.5) / float(1 << BITS) for c in (x, y))
        return F.struct((x * 360.0 - 180.0).alias("longitude"), (y * (2 * MOST_LATITUDE) - MOST_LATITUDE).alias("latitude"))

    return _bound(score, middle)


def geohash(lat: Column, lon: Column) -> Column:
    """The eleven digits of GEOHASH: the stored 52 bits and three zeros, five to a digit."""

    def digits(n: Column) -> Column:
        places = [F.shiftright(n, 47 - 5 * i) if i < 10 else F.shiftleft(n, 3) for i in range(11)]
        return F.concat(*[F.substring(F.lit(DIGITS), (p.bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for p in places])

    return _bound(geo_score(lat, lon), digits)
