"""Map projection and tiling as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import METRES_PER_DEGREE
from .geometry import named

SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
EASTING = 500_000.0


def _series(n: float) -> tuple[float, list[float], list[float], list[float]]:
    """Rectifying radius, forward, inverse and latitude coefficients of the Krueger series to sixth order (published)."""
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45 - 2854 * n**6 / 675,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315 + 2323 * n**6 / 945,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105 + 73814 * n**6 / 2835,
        4279 * n**4 / 630 - 332 * n**5 / 35 - 399572 * n**6 / 14175,
        4174 * n**5 / 315 - 144838 * n**6 / 6237,
        601676 * n**6 / 22275,
    ]
    return radius, alpha, beta, delta


N = FLATTENING / (2 - FLATTENING)
RADIUS, ALPHA, BETA, DELTA = _series(N)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def utm_zone(longitude: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((longitude + 180) / 6) + 1).cast("int")))


def utm_epsg(longitude: Column, latitude: Column) -> Column:
    return F.when(latitude >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(longitude)


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def to_utm(longitude: Column, latitude: Column, zone: Column | None = None) -> Column:
    """struct(x, y) in metres; southern rows get the false northing."""
    zone = utm_zone(longitude) if zone is None else zone
    lam, phi = F.radians(longitude - central_meridian(zone)), F.radians(latitude)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for k, a in enumerate(ALPHA, 1):
        east = east + F.lit(a) * F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k))
        north = north + F.lit(a) * F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k))
    south = F.when(latitude < 0, F.lit(10_000_000.0)).otherwise(F.lit(0.0))
    return named(x=F.lit(EASTING) + F.lit(SCALE * RADIUS) * east, y=south + F.lit(SCALE * RADIUS) * north)


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """struct(longitude, latitude) in degrees."""
    north = F.when(south, y - 10_000_000.0).otherwise(y)
    xi0, eta0 = north / F.lit(SCALE * RADIUS), (x - EASTING) / F.lit(SCALE * RADIUS)
    xi, eta = xi0, eta0
    for k, b in enumerate(BETA, 1):
        xi = xi - F.lit(b) * F.sin(xi0 * (2 * k)) * F.cosh(eta0 * (2 * k))
        eta = eta - F.lit(b) * F.cos(xi0 * (2 * k)) * F.sinh(eta0 * (2 * k))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for k, d in enumerate(DELTA, 1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * k))
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    return named(longitude=central_meridian(zone) + F.degrees(lam), latitude=F.degrees(phi))


def search_box(longitude: Column, latitude: Column, radius: float) -> Column:
    """struct of the box a radius around a point, in degrees."""
    dy = F.lit(radius / METRES_PER_DEGREE)
    dx = F.lit(float(radius)) / F.greatest(F.lit(1.0), F.lit(METRES_PER_DEGREE) * F.cos(F.radians(latitude)))
    return named(x0=longitude - dx, y0=latitude - dy, x1=longitude + dx, y1=latitude + dy)


def quadkey(longitude: Column, latitude: Column, zoom: int = 9) -> Column:
    """Tile key: a base-4 digit per level."""
    size = F.lit(1 << zoom)
    lat = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), latitude))
    s = F.sin(F.radians(lat))
    x = (longitude + 180) / 360
    y = F.lit(0.5) - F.ln((1 + s) / (1 - s)) / F.lit(4 * math.pi)
    tile = lambda v: F.greatest(F.lit(0), F.least(size - 1, F.floor(v * size).cast("int")))
    tx, ty = tile(x), tile(y)
    digits = [((F.shiftright(tx, k).bitwiseAND(F.lit(1))) + (F.shiftright(ty, k).bitwiseAND(F.lit(1))) * 2).cast("string") for k in range(zoom - 1, -1, -1)]
    return F.concat(*digits)
