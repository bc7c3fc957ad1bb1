"""National projections of boundaries: Lambert conformal conic and transverse Mercator, on their own datums.

Formulas are those of Snyder (1987) and of the EPSG guidance note 7-2; datums are related to WGS84 by
seven-parameter (position vector) shifts of the earth-centred coordinates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ellipsoid:
    axis: float
    inverse_flattening: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)


@dataclass(frozen=True)
class Lambert:
    """Two standard parallels; angles in degrees, lengths in metres."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    lats: tuple[float, float]
    false_e: float
    false_n: float
    shift: tuple[float, ...] | None = None

    def _constants(self) -> tuple[float, float, float]:
        m = [math.cos(math.radians(x)) / math.sqrt(1 - self.ellipsoid.e2 * math.sin(math.radians(x)) ** 2) for x in self.lats]
        t = [float(self._t(np.radians(x))) for x in (*self.lats, self.lat0)]
        n = (math.log(m[0]) - math.log(m[1])) / (math.log(t[0]) - math.log(t[1]))
        f = m[0] / (n * t[0] ** n) * self.ellipsoid.axis
        return n, f, f * t[2] ** n

    def _t(self, phi):
        e = math.sqrt(self.ellipsoid.e2)
        s = e * np.sin(phi)
        return np.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    def forward(self, lon, lat):
        n, f, r0 = self._constants()
        r, turn = f * self._t(np.radians(lat)) ** n, n * np.radians(lon - self.lon0)
        return self.false_e + r * np.sin(turn), self.false_n + r0 - r * np.cos(turn)

    def inverse(self, x, y):
        n, f, r0 = self._constants()
        dx, dy = x - self.false_e, r0 - (y - self.false_n)
        t = (np.copysign(np.hypot(dx, dy), n) / f) ** (1 / n)
        turn = np.arctan2(math.copysign(1, n) * dx, math.copysign(1, n) * dy)
        e = math.sqrt(self.ellipsoid.e2)
        phi = math.pi / 2 - 2 * np.arctan(t)
        for _ in range(8):
            s = e * np.sin(phi)
            phi = math.pi / 2 - 2 * np.arctan(t * ((1 - s) / (1 + s)) ** (e / 2))
        return self.lon0 + np.degrees(turn / n), np.degrees(phi)


@dataclass(frozen=True)
class Transverse:
    """Transverse Mercator, as of Gauss and Krueger, by series."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    scale: float
    false_e: float
    false_n: float
    shift: tuple[float, ...] | None = None

    def _arc(self, phi):
        e2 = self.ellipsoid.e2
        e4, e6 = e2 * e2, e2**3
        return self.ellipsoid.axis * ((1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * np.sin(2 * phi) + (15 * e4 / 256 + 45 * e6 / 1024) * np.sin(4 * phi) - 35 * e6 / 3072 * np.sin(6 * phi))

    def _local(self, phi):
        """(second eccentricity term, squared tangent, radius across, radius along) at a latitude."""
        e2 = self.ellipsoid.e2
        w = 1 - e2 * np.sin(phi) ** 2
        return e2 / (1 - e2) * np.cos(phi) ** 2, np.tan(phi) ** 2, self.ellipsoid.axis / np.sqrt(w), self.ellipsoid.axis * (1 - e2) / w**1.5

    def forward(self, lon, lat):
        phi = np.radians(lat)
        c, t, across, _ = self._local(phi)
        a = np.cos(phi) * np.radians(lon - self.lon0)
        ep2 = self.ellipsoid.e2 / (1 - self.ellipsoid.e2)
        east = a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a**5 / 120
        north = a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a**6 / 720
        return self.false_e + self.scale * across * east, self.false_n + self.scale * (self._arc(phi) - self._arc(math.radians(self.lat0)) + across * np.tan(phi) * north)

    def inverse(self, x, y):
        arc = self._arc(math.radians(self.lat0)) + (y - self.false_n) / self.scale
        phi = arc / self.ellipsoid.axis
        for _ in range(6):  # the latitude of this meridian arc
            phi = phi + (arc - self._arc(phi)) / self._local(phi)[3]
        c, t, across, along = self._local(phi)
        ep2 = self.ellipsoid.e2 / (1 - self.ellipsoid.e2)
        d = (x - self.false_e) / (across * self.scale)
        lat = phi - across * np.tan(phi) / along * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d**6 / 720)
        turn = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d**5 / 120) / np.cos(phi)
        return self.lon0 + np.degrees(turn), np.degrees(lat)


def earth_centred(ellipsoid: Ellipsoid, lon, lat):
    """Coordinates about the earth's centre of places on the ellipsoid."""
    phi, lam = np.radians(lat), np.radians(lon)
    across = ellipsoid.axis / np.sqrt(1 - ellipsoid.e2 * np.sin(phi) ** 2)
    return across * np.cos(phi) * np.cos(lam), across * np.cos(phi) * np.sin(lam), across * (1 - ellipsoid.e2) * np.sin(phi)


def geodetic(ellipsoid: Ellipsoid, x, y, z):
    """Longitude and latitude; the height is left out."""
    p = np.hypot(x, y)
    phi = np.arctan2(z, p * (1 - ellipsoid.e2))
    for _ in range(6):
        across = ellipsoid.axis / np.sqrt(1 - ellipsoid.e2 * np.sin(phi) ** 2)
        phi = np.arctan2(z + ellipsoid.e2 * across * np.sin(phi), p)
    return np.degrees(np.arctan2(y, x)), np.degrees(phi)


def shifted(shift: tuple[float, ...], x, y, z):
    """Position vector shift: metres, seconds of arc, parts per million."""
    tx, ty, tz, *turns, ppm = shift
    rx, ry, rz = (math.radians(r / 3600) for r in turns)
    m = 1 + ppm * 1e-6
    return tx + m * (x - rz * y + ry * z), ty + m * (rz * x + y - rx * z), tz + m * (-ry * x + rx * y + z)


#: Ellipsoids, projections and datum shifts of the EPSG registry.
WGS84 = Ellipsoid(6_378_137.0, 298.257223563)
GRS80 = Ellipsoid(6_378_137.0, 298.257222101)
BESSEL = Ellipsoid(6_377_397.155, 299.1528128)
AIRY = Ellipsoid(6_377_563.396, 299.3249646)
DHDN = (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)
MGI = (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)
OSGB = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
SYSTEMS: dict[int, Lambert | Transverse] = {
    2154: Lambert(GRS80, 46.5, 3.0, (49.0, 44.0), 700_000.0, 6_600_000.0),
    3034: Lambert(GRS80, 52.0, 10.0, (35.0, 65.0), 4_000_000.0, 2_800_000.0),
    27700: Transverse(AIRY, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0, OSGB),
    31287: Lambert(BESSEL, 47.5, 13.0 + 1 / 3, (49.0, 46.0), 400_000.0, 400_000.0, MGI),
    **{31464 + zone: Transverse(BESSEL, 0.0, 3.0 * zone, 1.0, zone * 1_000_000.0 + 500_000.0, 0.0, DHDN) for zone in (2, 3, 4, 5)},
}


def degrees_of(system: Lambert | Transverse, x, y):
    """Longitudes and latitudes on WGS84."""
    lon, lat = system.inverse(x, y)
    if system.shift is None:
        return lon, lat
    return geodetic(WGS84, *shifted(system.shift, *earth_centred(system.ellipsoid, lon, lat)))
