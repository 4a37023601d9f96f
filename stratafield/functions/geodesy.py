"""WGS84 geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

A = 6_378_137.0
FLATTENING = 1 / 298.257_223_563
N = FLATTENING / (2 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
K0 = 0.9996

RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
#: Krueger series in the third flattening, to the fourth order.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone number with the exceptions of south-west Norway and Svalbard."""
    plain = F.floor(F.pmod(lon + 180, F.lit(360.0)) / 6).cast("int") + 1
    svalbard = F.when(lon < 0, plain).when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).when(lon < 42, 37).otherwise(plain)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat <= 84), svalbard).otherwise(plain)


def norwegian_zone(lon: Column) -> Column:
    """Zone 32 to 35 by centre longitude; others fall to the nearest of them."""
    return F.when(lon < 12, 32).when(lon < 18, 33).when(lon < 24, 34).otherwise(35)


def to_utm(lat: Column, lon: Column, zone: Column | int, north: bool | Column = True) -> tuple[Column, Column]:
    """(easting, northing) in metres; null outside the valid range."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    north = F.lit(north) if isinstance(north, bool) else north
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = E2**0.5
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi0, eta0 = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    valid = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(valid, 500_000 + K0 * RECTIFYING * eta), F.when(valid, K0 * RECTIFYING * xi + F.when(north, 0.0).otherwise(10_000_000.0))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the ellipsoid by Lambert's long-line formula (relative error
    below 1e-5 for points that are not nearly antipodal)."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    dl = F.radians(lon2 - lon1)
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(dl / 2), 2)
    s = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q) / F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q) / F.sin(s / 2), 2)
    return F.when(h == 0, 0.0).otherwise(A * (s - FLATTENING / 2 * (x + y)))
