"""Reprojection between geographic coordinates and 3-degree Gauss-Kruger zones, as column expressions.

The transverse Mercator projection follows Kruger's series to the third order in the flattening; WGS 84 and CGCS2000
are taken as the same datum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Central meridians of the zones, and the ellipsoid.
MERIDIANS = {4534 + i: 75.0 + 3 * i for i in range(21)}
GEOGRAPHIC = 4326
SEMI_MAJOR, FLATTENING, FALSE_EASTING, SCALE = 6378137.0, 1 / 298.257222101, 500000.0, 1.0

_n = FLATTENING / (2 - FLATTENING)
_radius = SEMI_MAJOR / (1 + _n) * (1 + _n ** 2 / 4 + _n ** 4 / 64) * SCALE
_alpha = (_n / 2 - 2 * _n ** 2 / 3 + 5 * _n ** 3 / 16, 13 * _n ** 2 / 48 - 3 * _n ** 3 / 5, 61 * _n ** 3 / 240)
_beta = (_n / 2 - 2 * _n ** 2 / 3 + 37 * _n ** 3 / 96, _n ** 2 / 48 + _n ** 3 / 15, 17 * _n ** 3 / 480)
_delta = (2 * _n - 2 * _n ** 2 / 3 - 2 * _n ** 3, 7 * _n ** 2 / 3 - 8 * _n ** 3 / 5, 56 * _n ** 3 / 15)
_e = 2 * _n ** 0.5 / (1 + _n)


def _series(start: Column, terms: tuple[float, ...], first, second, x: Column, y: Column) -> Column:
    total = start
    for j, k in enumerate(terms, 1):
        total = total + k * first(2 * j * x) * second(2 * j * y)
    return total


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing in a zone; a latitude beyond a pole counts as the one with the same sine."""
    d, s = F.radians(lon - MERIDIANS[epsg]), F.sin(F.radians(lat))  # the difference of degrees is exact near the meridian
    t = F.sinh(F.atanh(s) - _e * F.atanh(_e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = FALSE_EASTING + _radius * _series(eta, _alpha, F.cos, F.sinh, xi, eta)
    return east, _radius * _series(xi, _alpha, F.sin, F.cosh, xi, eta)


def unproject(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude of a point in a zone."""
    xi, eta = y / _radius, (x - FALSE_EASTING) / _radius
    back = tuple(-k for k in _beta)
    a, b = _series(xi, back, F.sin, F.cosh, xi, eta), _series(eta, back, F.cos, F.sinh, xi, eta)
    chi = F.atan2(F.sin(a), F.hypot(F.sinh(b), F.cos(a)))  # an arc sine would lose half the digits near the poles
    lat = chi
    for j, k in enumerate(_delta, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + MERIDIANS[epsg], F.degrees(lat)


def to_crs(x: Column, y: Column, source: int = 4326, target: int = 4545) -> tuple[Column, Column]:
    """Coordinates in another system: 4326 or a 3-degree zone (4534 to 4554), from and to."""
    if unknown := [e for e in (source, target) if e != GEOGRAPHIC and e not in MERIDIANS]:
        raise ValueError(f"unsupported system: {unknown[0]}")
    if source == target:
        return x, y
    lon, lat = (x, y) if source == GEOGRAPHIC else unproject(x, y, source)
    return (lon, lat) if target == GEOGRAPHIC else project(lon, lat, target)
