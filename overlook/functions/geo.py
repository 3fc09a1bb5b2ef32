"""Map projections, tiles and units as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = math.pi * 6378137.0
MILE, FOOT, YARD = 1609.344, 0.3048, 0.9144
A, FLAT, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column | int) -> tuple[Column, Column]:
    """(easting, northing) of the northern hemisphere by Krueger's series to the third power of n; millimetres within a zone."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    n = FLAT / (2 - FLAT)
    big = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + SCALE * big * x, SCALE * big * y


def lonlat(easting: Column, northing: Column, zone: Column | int) -> tuple[Column, Column]:
    """(lon, lat) of a point of the northern hemisphere: the series back, latitude from the conformal one by three terms."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    n = FLAT / (2 - FLAT)
    big = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = northing / (SCALE * big), (easting - 500000) / (SCALE * big)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x, y = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in web-Mercator metres."""
    size = 2 * HALF / F.pow(F.lit(2.0), z)
    return -HALF + x * size, HALF - (y + 1) * size, -HALF + (x + 1) * size, HALF - y * size


def mercator_to_lonlat(mx: Column, my: Column) -> tuple[Column, Column]:
    return mx / HALF * 180, F.degrees(F.atan(F.sinh(my / 6378137.0)))


def tile_of(lon: Column, lat: Column, z: int) -> tuple[Column, Column]:
    n = 2**z
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor(y * n).cast("int")


def terrarium(z: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of an elevation: 256ths of a metre over -32768, half to even."""
    v = F.rint((z + 32768) * 256).cast("long")
    return F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)


def cover_class(tree: Column) -> Column:
    """1 open, 2 partial, 3 dense, 4 unknown."""
    return F.when(~F.coalesce(tree.between(0, 1), F.lit(False)), 4).when(tree < 0.1, 1).when(tree < 0.4, 2).otherwise(3)


def wedge(x: Column, y: Column, inner: Column, outer: Column, start: Column, width: float, samples: int = 31) -> Column:
    """Ring of a polar bin: out along the outer arc, back along the inner one, closed."""
    step = width / (samples - 1)

    def at(r, i):
        a = F.radians(start + i * step)
        return F.struct((x + r * F.sin(a)).alias("x"), (y + r * F.cos(a)).alias("y"))

    there = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: at(outer, i))
    back = F.transform(F.sequence(F.lit(samples - 1), F.lit(0)), lambda i: at(inner, i))
    return F.concat(there, back, F.array(at(outer, F.lit(0))))


def rounded_distance(dx: Column, dy: Column, dz: Column, side: float, radius: float) -> Column:
    """Signed distance to a cube of the given side with rounded edges."""
    q = [F.abs(v) - (side / 2 - radius) for v in (dx, dy, dz)]
    out = F.sqrt(sum((F.greatest(v, F.lit(0.0)) ** 2 for v in q[1:]), F.greatest(q[0], F.lit(0.0)) ** 2))
    return out + F.least(F.greatest(*q), F.lit(0.0)) - radius


def suggested_mb(need: Column) -> Column:
    """A fifth more, up to the next ten."""
    return (F.ceil(need * 1.2 / 10) * 10).cast("long")
