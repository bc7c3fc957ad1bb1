"""Projections and spherical distance as closed-form Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The European equal-area grid (Snyder 1987, oblique azimuthal equal-area, GRS80).
LAT0, LON0, FALSE_E, FALSE_N = math.radians(52.0), math.radians(10.0), 4_321_000.0, 3_210_000.0
E2 = 0.006694380022900787
QP = 1.9955310874809387
BETA0 = 0.9053975168158784
RQ = 6371007.1808835175
D = 1.0004253945280137
EARTH_RADIUS = 6_371_000.0
#: Metres in a degree of latitude, and the least cosine of a search window.
DEGREE_M, LEAST_COSINE = 111_320.0, 0.2
SPHERICAL_RADIUS = 6_378_137.0
#: Semi-major axis, flattening and scale factor of the UTM zones (GRS80 / WGS84).
UTM_AXIS, UTM_FLATTENING, UTM_SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996


def laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the European equal-area grid (EPSG:3035)."""
    e = math.sqrt(E2)
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / QP))
    sin_b, cos_b = ratio, F.sqrt(1 - ratio * ratio)
    turn = F.radians(lon) - LON0
    b = RQ * F.sqrt(2 / (1 + math.sin(BETA0) * sin_b + math.cos(BETA0) * cos_b * F.cos(turn)))
    return FALSE_E + b * D * cos_b * F.sin(turn), FALSE_N + b / D * (math.cos(BETA0) * sin_b - math.sin(BETA0) * cos_b * F.cos(turn))


def laea_arrays(lon, lat):
    """:func:`laea` of numpy arrays."""
    import numpy as np

    e = math.sqrt(E2)
    s = np.sin(np.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))
    sin_b = np.clip(q / QP, -1.0, 1.0)
    cos_b = np.sqrt(1 - sin_b * sin_b)
    turn = np.radians(lon) - LON0
    b = RQ * np.sqrt(2 / (1 + math.sin(BETA0) * sin_b + math.cos(BETA0) * cos_b * np.cos(turn)))
    return FALSE_E + b * D * cos_b * np.sin(turn), FALSE_N + b / D * (math.cos(BETA0) * sin_b - math.sin(BETA0) * cos_b * np.cos(turn))


@dataclass(frozen=True)
class Metric:
    """A projection to metres, once for columns and once for numpy arrays: (lon, lat) to (x, y).

    ``least_scale`` gives, of a longitude and latitude, what a metre near there measures at least.
    """

    columns: Callable
    arrays: Callable
    least_scale: Callable = lambda lon, lat: F.lit(0.98)


def _europe_scale(lon: Column, lat: Column) -> Column:
    """An azimuthal equal-area projection shrinks radii by the cosine of half the angle from its centre."""
    return 0.98 * F.cos(haversine(F.lit(math.degrees(LON0)), F.lit(math.degrees(LAT0)), lon, lat) / (2 * EARTH_RADIUS))


#: The default for matching, as for areas.
EUROPE = Metric(laea, laea_arrays, _europe_scale)


def azimuthal(lon0: float, lat0: float) -> Metric:
    """A metric for places far from Europe, on the sphere: distances from the centre are true, those near it almost."""
    at, s0, c0 = math.radians(lon0), math.sin(math.radians(lat0)), math.cos(math.radians(lat0))

    def columns(lon: Column, lat: Column) -> tuple[Column, Column]:
        turn, phi = F.radians(lon) - at, F.radians(lat)
        c = haversine(F.lit(lon0), F.lit(lat0), lon, lat) / EARTH_RADIUS
        k = F.when(c < 1e-12, 1.0).otherwise(c / F.sin(c)) * EARTH_RADIUS
        return k * F.cos(phi) * F.sin(turn), k * (c0 * F.sin(phi) - s0 * F.cos(phi) * F.cos(turn))

    def arrays(lon, lat):
        import numpy as np

        turn, phi = np.radians(lon) - at, np.radians(lat)
        h = np.sin((phi - math.radians(lat0)) / 2) ** 2 + c0 * np.cos(phi) * np.sin(turn / 2) ** 2
        c = 2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        k = np.where(c < 1e-12, 1.0, c / np.where(c < 1e-12, 1.0, np.sin(c))) * EARTH_RADIUS
        return k * np.cos(phi) * np.sin(turn), k * (c0 * np.sin(phi) - s0 * np.cos(phi) * np.cos(turn))

    return Metric(columns, arrays)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along a sphere of 6,371 km."""
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dx) * F.sin(dx)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def window(lat: Column, radius: float | Column) -> tuple[Column, Column]:
    """Half width and half height, in degrees, of the search window of ``radius`` metres."""
    radius = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    return radius / (DEGREE_M * F.greatest(F.cos(F.radians(lat)), F.lit(LEAST_COSINE))), radius / DEGREE_M


def sure_within(lat: Column, reach: float) -> Column:
    """Metres on the ground within which nothing lies outside the window of ``reach`` metres."""
    dx, dy = window(lat, reach)
    across = EARTH_RADIUS * F.asin(F.sin(F.radians(F.least(dx, F.lit(90.0)))) * F.cos(F.radians(lat)))
    return 0.99 * F.least(across, EARTH_RADIUS * F.radians(dy))


def to_degrees(x, y, srid: int):
    """Longitudes and latitudes of numpy coordinates in a supported system; others raise ValueError."""
    import numpy as np

    if srid == 4326:
        return x, y
    if srid == 3857:
        return np.degrees(x / SPHERICAL_RADIUS), np.degrees(2 * np.arctan(np.exp(y / SPHERICAL_RADIUS)) - math.pi / 2)
    if srid == 3035:
        dx, dy = (x - FALSE_E) / D, (y - FALSE_N) * D
        rho = np.hypot(dx, dy)
        c = 2 * np.arcsin(np.clip(rho / (2 * RQ), -1, 1))
        safe = np.where(rho == 0, 1, rho)
        sin_b = np.cos(c) * math.sin(BETA0) + np.where(rho == 0, 0, dy * np.sin(c) * math.cos(BETA0) / safe)
        beta = np.arcsin(np.clip(sin_b, -1, 1))
        lon = LON0 + np.arctan2(dx * np.sin(c), safe * math.cos(BETA0) * np.cos(c) - dy * math.sin(BETA0) * np.sin(c))
        e2, e4, e6 = E2, E2**2, E2**3
        lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * np.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * np.sin(4 * beta) + 761 * e6 / 45360 * np.sin(6 * beta)
        return np.degrees(lon), np.degrees(lat)
    if srid // 100 in (258, 326, 327) and 1 <= srid % 100 <= 60:
        north = srid // 100 != 327
        f = UTM_FLATTENING
        e2 = f * (2 - f)
        ep2 = e2 / (1 - e2)
        m = (y - (0 if north else 10_000_000.0)) / UTM_SCALE
        mu = m / (UTM_AXIS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
        e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
        p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * np.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * np.sin(4 * mu) + 151 * e1**3 / 96 * np.sin(6 * mu) + 1097 * e1**4 / 512 * np.sin(8 * mu)
        c, t = ep2 * np.cos(p) ** 2, np.tan(p) ** 2
        n = UTM_AXIS / np.sqrt(1 - e2 * np.sin(p) ** 2)
        r = UTM_AXIS * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5
        d = (x - 500_000.0) / (n * UTM_SCALE)
        lat = p - n * np.tan(p) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
        lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / np.cos(p)
        return np.degrees(lon) + (srid % 100) * 6 - 183, np.degrees(lat)
    from terrafoot.functions.projections import SYSTEMS, degrees_of

    if srid in SYSTEMS:
        return degrees_of(SYSTEMS[srid], x, y)
    raise ValueError(f"unsupported coordinate system EPSG:{srid}")
