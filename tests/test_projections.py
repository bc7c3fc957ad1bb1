"""National projections: published examples, and the way there and back."""

import math

import numpy as np
import pytest

from terrafoot.functions import crs
from terrafoot.functions.projections import AIRY, SYSTEMS, WGS84, Ellipsoid, Lambert, Transverse, earth_centred, geodetic, shifted

FOOT = 1200 / 3937


def test_published_lambert_example():
    """EPSG guidance note 7-2: Texas South Central, in US survey feet."""
    clarke = Ellipsoid(6_378_206.4, 294.9786982)
    texas = Lambert(clarke, 27 + 50 / 60, -99.0, (28 + 23 / 60, 30 + 17 / 60), 2_000_000 * FOOT, 0.0)
    x, y = texas.forward(np.array([-96.0]), np.array([28.5]))
    assert x[0] / FOOT == pytest.approx(2_963_503.91, abs=0.05) and y[0] / FOOT == pytest.approx(254_759.80, abs=0.05)
    lon, lat = texas.inverse(np.array([2_963_503.91 * FOOT]), np.array([254_759.80 * FOOT]))
    assert lon[0] == pytest.approx(-96.0, abs=1e-7) and lat[0] == pytest.approx(28.5, abs=1e-7)


def test_published_transverse_example():
    """EPSG guidance note 7-2: the British grid."""
    grid = Transverse(AIRY, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0)
    x, y = grid.forward(np.array([0.5]), np.array([50.5]))
    assert x[0] == pytest.approx(577_274.99, abs=0.02) and y[0] == pytest.approx(69_740.50, abs=0.02)
    lon, lat = grid.inverse(np.array([577_274.99]), np.array([69_740.50]))
    assert lon[0] == pytest.approx(0.5, abs=1e-6) and lat[0] == pytest.approx(50.5, abs=1e-6)


def test_published_shift_example():
    """EPSG guidance note 7-2: from WGS 72 to WGS 84."""
    found = shifted((0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219), 3_657_660.66, 255_768.55, 5_201_382.11)
    assert found == pytest.approx((3_657_660.78, 255_778.43, 5_201_387.75), abs=0.01)


def test_known_transverse_is_utm():
    zone = Transverse(WGS84, 0.0, 9.0, 0.9996, 500_000.0, 0.0)
    rng = np.random.default_rng(1)
    x, y = rng.uniform(250_000, 750_000, 200), rng.uniform(5_200_000, 6_100_000, 200)
    want, found = crs.to_degrees(x, y, 32632), zone.inverse(x, y)
    assert np.abs(np.array(want) - np.array(found)).max() < 1e-8


@pytest.mark.parametrize("srid", sorted(SYSTEMS))
def test_there_and_back(srid):
    system = SYSTEMS[srid]
    rng = np.random.default_rng(srid)
    lon, lat = system.lon0 + rng.uniform(-3, 3, 300), max(system.lat0, 47.0) + rng.uniform(-3, 6, 300)
    back = system.inverse(*system.forward(lon, lat))
    assert np.abs(np.array(back) - [lon, lat]).max() < 2e-8  # about 2 mm
    assert np.abs(np.array(geodetic(WGS84, *earth_centred(WGS84, lon, lat))) - [lon, lat]).max() < 1e-11
    on_wgs = crs.to_degrees(*system.forward(lon, lat), srid)
    moved = np.hypot((on_wgs[0] - lon) * np.cos(np.radians(lat)), on_wgs[1] - lat) * 111_000
    assert moved.max() < 1e-2 if system.shift is None else 30 < moved.min() and moved.max() < 250


def test_unknown_systems_are_an_error():
    with pytest.raises(ValueError):
        crs.to_degrees(np.zeros(1), np.zeros(1), 9999)
    assert math.isfinite(float(crs.to_degrees(np.array([3_500_000.0]), np.array([5_500_000.0]), 31467)[0][0]))
