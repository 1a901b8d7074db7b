"""Scalar geometry and physics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665


def corner(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def signed_area(xs: Column, ys: Column) -> Column:
    """Area of a triangle or quadrangle from its corner arrays; positive if counter-clockwise."""
    x1, y1 = corner(xs, 0), corner(ys, 0)
    half = lambda i, j: (corner(xs, i) - x1) * (corner(ys, j) - y1) - (corner(xs, j) - x1) * (corner(ys, i) - y1)
    return (half(1, 2) + F.when(F.size(xs) == 4, half(2, 3)).otherwise(F.lit(0.0))) / 2


def heron(xs: Column, ys: Column) -> Column:
    side = lambda i, j: F.hypot(corner(xs, i) - corner(xs, j), corner(ys, i) - corner(ys, j))
    a, b, c = side(0, 1), side(1, 2), side(2, 0)
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))


def angle(xs: Column, ys: Column, i: Column) -> Column:
    """Interior angle in degrees at corner ``i`` (0-based) of an element; 0 beside a side without length."""
    n = F.size(xs)
    before, after = F.pmod(i + n - 1, n), F.pmod(i + 1, n)
    ax, ay = F.get(xs, before) - F.get(xs, i), F.get(ys, before) - F.get(ys, i)
    bx, by = F.get(xs, after) - F.get(xs, i), F.get(ys, after) - F.get(ys, i)
    cos = F.try_divide(ax * bx + ay * by, F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)))
    return F.when(cos.isNull(), F.lit(0.0)).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))))


def is_deep(depth: Column, amplitude: float) -> Column:
    return depth <= -abs(amplitude)


def particle_velocity(depth: Column, amplitude: float = 2.0) -> Column:
    return F.when(is_deep(depth, amplitude), amplitude * F.sqrt(GRAVITY / F.abs(depth))).otherwise(math.sqrt(GRAVITY * amplitude))


def characteristic_velocity(depth: Column, amplitude: float = 2.0) -> Column:
    u = particle_velocity(depth, amplitude)
    return F.when(is_deep(depth, amplitude), u + F.sqrt(GRAVITY * F.abs(depth))).otherwise(2 * u)


def courant_number(depth: Column, size: Column, timestep: float, amplitude: float = 2.0) -> Column:
    """Raises where the element size is zero."""
    return characteristic_velocity(depth, amplitude) * timestep / F.when(size == 0, F.raise_error(F.lit("element size is zero"))).otherwise(size)


def courant_size(depth: Column, timestep: float, target: float = 1.0, amplitude: float = 2.0) -> Column:
    return characteristic_velocity(depth, amplitude) * timestep / target


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone of a point, with the exceptions for Norway and Svalbard; null outside of [-180, 180] x [-90, 90]."""
    plain = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32)).when((lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain)
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), zone).cast("int")


#: GRS80 and WGS84 differ below a tenth of a millimetre here.
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257222101, 0.9996


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres by the Krueger series; false northing south of the equator."""
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return SCALE * a * x + 500000.0, SCALE * a * y + F.when(lat < 0, 10000000.0).otherwise(0.0)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * SEMI_MAJOR, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * SEMI_MAJOR


def inverse_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat)"""
    return F.degrees(x / SEMI_MAJOR), F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR)) - math.pi / 2)


def inverse_utm(easting: Column, northing: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """(lon, lat) by the inverse Krueger series."""
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi0, eta0 = (northing - (10000000.0 if south else 0.0)) / (SCALE * a), (easting - 500000.0) / (SCALE * a)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + float(zone * 6 - 183), F.degrees(lat)


def _epsg(crs: str | int) -> int:
    code = int(str(crs).upper().removeprefix("EPSG:"))
    if code not in (4326, 3857) and not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError("known systems: EPSG:4326, EPSG:3857, EPSG:326xx and EPSG:327xx (UTM)")
    return code


def reproject(x: Column, y: Column, source: str | int, target: str | int) -> tuple[Column, Column]:
    """(x, y) from one system to another: longitude and latitude (EPSG:4326), web Mercator or a UTM zone."""
    a, b = _epsg(source), _epsg(target)
    if a == b:
        return x, y
    if a == 3857:
        x, y = inverse_web_mercator(x, y)
    elif a != 4326:
        x, y = inverse_utm(x, y, a % 100, a > 32700)
    if b == 3857:
        return web_mercator(x, y)
    if b == 4326:
        return x, y
    e, north = utm(x, y, F.lit(b % 100))
    return e, north - F.when(y < 0, 10000000.0).otherwise(0.0) + (10000000.0 if b > 32700 else 0.0)
