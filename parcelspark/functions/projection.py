"""Map projections as Column expressions: planar coordinates to longitude and latitude in degrees, and to Web Mercator.

Constants of a projection are computed once on the driver; what remains per vertex is a fixed number of JVM operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XY = tuple[Column, Column]


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)


# Fixed values of the ellipsoids and of the shifts to WGS84, in metres.
GRS80, WGS84, INTL1924 = Ellipsoid(6378137.0, 298.257222101), Ellipsoid(6378137.0, 298.257223563), Ellipsoid(6378388.0, 297.0)
SHIFTS = {2970: (-467.0, -16.0, -300.0), 2973: (186.0, 482.0, 151.0)}


def conic_inverse(ell: Ellipsoid, lat0: float, par1: float, par2: float, lon0: float, fe: float, fn: float) -> Callable[[Column, Column], XY]:
    """Lambert's conic projection with two parallels, undone."""
    e = math.sqrt(ell.e2)
    rad = math.radians
    m = lambda p: math.cos(p) / math.sqrt(1 - ell.e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2 = rad(par1), rad(par2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    c = ell.a * m(p1) / (n * t(p1) ** n)
    r0 = c * t(rad(lat0)) ** n

    def inverse(x: Column, y: Column) -> XY:
        dx, dy = x - fe, F.lit(fn + r0) - y
        lon = F.atan2(dx, dy) / n + rad(lon0)
        # latitude from the isometric one by fixed-point steps; five reach the last digit, seven are taken
        q = F.pow(F.sqrt(dx * dx + dy * dy) / c, F.lit(1 / n))
        step = lambda p, _: math.pi / 2 - 2 * F.atan(q * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2)))
        lat = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(math.pi / 2) - 2 * F.atan(q), step)
        return F.degrees(lon), F.degrees(lat)

    return inverse


def utm_inverse(ell: Ellipsoid, zone: int, south: bool) -> Callable[[Column, Column], XY]:
    """Transverse Mercator in a UTM zone, undone by Krueger's series in the third flattening (to the fourth order)."""
    f = 1 / ell.inverse_flattening
    n = f / (2 - f)
    radius = 0.9996 * ell.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    lon0 = math.radians(6 * zone - 183)

    def inverse(x: Column, y: Column) -> XY:
        xi, eta = (y - (1e7 if south else 0.0)) / radius, (x - 500000.0) / radius
        u, v = xi, eta
        for k, b in enumerate(beta, 1):
            u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
            v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        chi = F.asin(F.sin(u) / F.cosh(v))
        lat = chi
        for k, d in enumerate(delta, 1):
            lat = lat + d * F.sin(2 * k * chi)
        return F.degrees(F.atan2(F.sinh(v), F.cos(u)) + lon0), F.degrees(lat)

    return inverse


def shifted(inverse: Callable[[Column, Column], XY], ell: Ellipsoid, shift: tuple[float, float, float]) -> Callable[[Column, Column], XY]:
    """``inverse`` followed by the shift of ``ell``'s datum to WGS84, over geocentric coordinates at height 0."""

    def to_wgs84(x: Column, y: Column) -> XY:
        lon, lat = (F.radians(c) for c in inverse(x, y))
        nu = ell.a / F.sqrt(1 - ell.e2 * F.sin(lat) * F.sin(lat))
        gx, gy, gz = nu * F.cos(lat) * F.cos(lon) + shift[0], nu * F.cos(lat) * F.sin(lon) + shift[1], nu * (1 - ell.e2) * F.sin(lat) + shift[2]
        p = F.sqrt(gx * gx + gy * gy)
        b = WGS84.a * (1 - 1 / WGS84.inverse_flattening)
        u = F.atan2(gz * WGS84.a, p * b)  # Bowring's formula, exact to far below a millimetre near the ground
        lat2 = F.atan2(gz + WGS84.e2 / (1 - WGS84.e2) * b * F.pow(F.sin(u), F.lit(3)), p - WGS84.e2 * WGS84.a * F.pow(F.cos(u), F.lit(3)))
        return F.degrees(F.atan2(gy, gx)), F.degrees(lat2)

    return to_wgs84


def mercator_forward(lon: Column, lat: Column) -> XY:
    """Web Mercator; latitudes beyond 85 degrees are put there."""
    r = 6378137.0
    held = F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat)))
    return F.radians(lon) * r, F.ln(F.tan(F.lit(math.pi / 4) + held / 2)) * r


def mercator_inverse(x: Column, y: Column) -> XY:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)


def _sources() -> dict[int, Callable[[Column, Column], XY]]:
    out = {2154: conic_inverse(GRS80, 46.5, 44, 49, 3, 700000, 6600000)}
    for n in range(42, 51):
        out[3900 + n] = conic_inverse(GRS80, n, n - 0.75, n + 0.75, 3, 1700000, 200000 + (n - 41) * 1000000)
    for code, zone, south in ((32620, 20, False), (32622, 22, False), (32738, 38, True), (32740, 40, True)):
        out[code] = utm_inverse(WGS84, zone, south)
    out[2972], out[2975] = utm_inverse(GRS80, 22, False), utm_inverse(GRS80, 40, True)
    for code, shift in SHIFTS.items():
        out[code] = shifted(utm_inverse(INTL1924, 20, False), INTL1924, shift)
    out[3857] = mercator_inverse
    return out


SOURCES = _sources()


def transformer(source: int, target: int) -> Callable[[Column, Column], XY] | None:
    """How to get from one EPSG code to another; None if they are the same. Unknown pairs are an error, as is 4326 to itself
    nowhere: the same code is always the identity."""
    if source == target:
        return None
    if target not in (4326, 3857) or (source != 4326 and source not in SOURCES):
        raise ValueError(f"no way from EPSG:{source} to EPSG:{target}")
    if source == 4326:
        return mercator_forward
    if target == 4326:
        return SOURCES[source]
    return lambda x, y: mercator_forward(*SOURCES[source](x, y))


def precision(srid: int) -> int:
    """Decimals that coordinates keep by default."""
    return 7 if srid == 4326 else 2
