"""Transverse Mercator between WGS84 degrees and metres as Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of one projected system; the defaults are the published EPSG:3414 values."""

    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257223563
    origin_latitude: float = 1.0 + 22.0 / 60
    origin_longitude: float = 103.0 + 50.0 / 60
    scale: float = 1.0
    false_easting: float = 28001.642
    false_northing: float = 38744.572

    @property
    def third_flattening(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def rectifying_radius(self) -> float:
        n = self.third_flattening
        return self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def alpha(self) -> list[float]:
        """Forward series of the conformal-to-rectifying map (Krueger, order three)."""
        n = self.third_flattening
        return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]

    def beta(self) -> list[float]:
        n = self.third_flattening
        return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]

    def delta(self) -> list[float]:
        n = self.third_flattening
        return [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]

    @property
    def eccentricity(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def origin_northing(self) -> float:
        phi, e = math.radians(self.origin_latitude), self.eccentricity
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi = math.atan(t)
        xi += sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(self.alpha()))
        return self.scale * self.rectifying_radius * xi


def to_metres(longitude: Column, latitude: Column, system: TransverseMercator = TransverseMercator()) -> Column:
    """struct(easting, northing) of a WGS84 position."""
    e = F.lit(system.eccentricity)
    sin_phi = F.sin(F.radians(latitude))
    lam = F.radians(longitude - F.lit(system.origin_longitude))
    t = F.sinh(F.atanh(sin_phi) - e * F.atanh(e * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for j, a in enumerate(system.alpha(), start=1):
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    radius = F.lit(system.scale * system.rectifying_radius)
    return F.struct(
        (F.lit(system.false_easting) + radius * east).alias("easting"),
        (F.lit(system.false_northing) - F.lit(system.origin_northing()) + radius * north).alias("northing"),
    )


def to_degrees(easting: Column, northing: Column, system: TransverseMercator = TransverseMercator()) -> Column:
    """struct(longitude, latitude) of a position in metres."""
    radius = F.lit(system.scale * system.rectifying_radius)
    xi0 = (northing - F.lit(system.false_northing) + F.lit(system.origin_northing())) / radius
    eta0 = (easting - F.lit(system.false_easting)) / radius
    xi, eta = xi0, eta0
    for j, b in enumerate(system.beta(), start=1):
        xi = xi - F.lit(b) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - F.lit(b) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    latitude = chi
    for j, d in enumerate(system.delta(), start=1):
        latitude = latitude + F.lit(d) * F.sin(2 * j * chi)
    longitude = F.lit(system.origin_longitude) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    return F.struct(longitude.alias("longitude"), F.degrees(latitude).alias("latitude"))
