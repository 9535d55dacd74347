"""Map projections, both ways: Lambert conformal conic, transverse Mercator, Web Mercator.

Formulas: J. P. Snyder, "Map Projections - A Working Manual" (USGS 1395, 1987), 14-15
to 15-11, ellipsoidal case, for the conic one; C. F. F. Karney, "Transverse Mercator with an accuracy of a few
nanometers" (2011), section 4, for transverse Mercator.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ConformalConic:
    """Angles in degrees; lengths in units of the projected coordinates."""

    latitude_1: float
    latitude_2: float
    latitude_0: float
    longitude_0: float
    false_easting: float
    false_northing: float
    semi_major_axis: float
    flattening: float

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.eccentricity * math.sin(lat)) ** 2)

    def _t(self, lat: float) -> float:
        e_sin = self.eccentricity * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / (
            (1 - e_sin) / (1 + e_sin)) ** (self.eccentricity / 2)

    @property
    def cone(self) -> tuple[float, float, float]:
        """Cone constant n, scaled F, and radius at the origin latitude."""
        one, two, origin = (math.radians(v) for v in
                            (self.latitude_1, self.latitude_2, self.latitude_0))
        n = (math.log(self._m(one)) - math.log(self._m(two))) / (
            math.log(self._t(one)) - math.log(self._t(two)))
        scaled = self.semi_major_axis * self._m(one) / (n * self._t(one) ** n)
        return n, scaled, scaled * self._t(origin) ** n


@dataclass(frozen=True)
class TransverseMercator:
    """Angles in degrees; lengths in units of the projected coordinates."""

    longitude_0: float
    false_easting: float
    false_northing: float
    scale: float
    semi_major_axis: float
    flattening: float

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @property
    def radius(self) -> float:
        """Rectifying radius times the scale."""
        n = self.flattening / (2 - self.flattening)
        return self.scale * self.semi_major_axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    # Series in the third flattening n, one row for each multiple of the angle, from its own power on.
    _TO_GRID = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140),
                (49561 / 161280,))
    _FROM_GRID = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840),
                  (4397 / 161280,))
    _TO_LATITUDE = ((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))

    def series(self, rows: tuple[tuple[float, ...], ...]) -> list[float]:
        n = self.flattening / (2 - self.flattening)
        return [sum(c * n ** (power + i) for i, c in enumerate(row)) for power, row in enumerate(rows, start=1)]


@dataclass(frozen=True)
class WebMercator:
    """Spherical Mercator of ellipsoidal coordinates."""

    semi_major_axis: float = 6378137.0


Projection = ConformalConic | TransverseMercator | WebMercator

US_FOOT = 1200 / 3937  # metres, fixed value
GRS80, WGS84 = 1 / 298.257222101, 1 / 298.257223563  # flattenings, fixed values

# Projection parameters by EPSG code (GRS 1980 ellipsoid).
PROJECTIONS: dict[str, Projection] = {
    "EPSG:2263": ConformalConic(  # NAD83 / New York Long Island, US feet
        latitude_1=41 + 2 / 60, latitude_2=40 + 40 / 60, latitude_0=40 + 10 / 60,
        longitude_0=-74.0, false_easting=984250.0, false_northing=0.0,
        semi_major_axis=6378137.0 / US_FOOT, flattening=GRS80),
    "EPSG:32118": ConformalConic(  # the same in metres
        latitude_1=41 + 2 / 60, latitude_2=40 + 40 / 60, latitude_0=40 + 10 / 60,
        longitude_0=-74.0, false_easting=300000.0, false_northing=0.0,
        semi_major_axis=6378137.0, flattening=GRS80),
    "EPSG:3857": WebMercator(),
}
# Longitude and latitude; their data differ by less than two metres from each other.
GEOGRAPHIC = ("EPSG:4326", "EPSG:4269", "EPSG:4258", "OGC:CRS84")
# First code before zone 1, number of zones, false northing, flattening of the UTM systems.
UTM = ((32600, 60, 0.0, WGS84), (32700, 60, 10_000_000.0, WGS84), (26900, 23, 0.0, GRS80), (25800, 38, 0.0, GRS80))


def projection_of(code: str) -> Projection | None:
    """The projection of an EPSG code, None for longitude and latitude; ``ValueError`` for codes not known."""
    if code in GEOGRAPHIC:
        return None
    if code in PROJECTIONS:
        return PROJECTIONS[code]
    number = int(code[5:]) if code.startswith("EPSG:") and code[5:].isdigit() else 0
    for before, zones, northing, flattening in UTM:
        if before < number <= before + zones:
            return TransverseMercator(6.0 * (number - before) - 183, 500_000.0, northing, 0.9996, 6378137.0, flattening)
    raise ValueError(f"Unknown coordinate system {code}; known are {', '.join([*GEOGRAPHIC, *sorted(PROJECTIONS)])} "
                     "and UTM zones (EPSG:326xx, 327xx, 269xx, 258xx).")


def inverse(x: Column, y: Column, projection: Projection) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of projected coordinates."""
    if isinstance(projection, WebMercator):
        r = projection.semi_major_axis
        return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)
    if isinstance(projection, TransverseMercator):
        return _transverse_inverse(x, y, projection)
    return _conic_inverse(x, y, projection)


def forward(lon: Column, lat: Column, projection: Projection) -> tuple[Column, Column]:
    """Projected coordinates of longitude and latitude in degrees."""
    if isinstance(projection, WebMercator):
        r = projection.semi_major_axis
        return F.radians(lon) * r, F.atanh(F.sin(F.radians(lat))) * r
    if isinstance(projection, TransverseMercator):
        return _transverse_forward(lon, lat, projection)
    return _conic_forward(lon, lat, projection)


def _waves(coefficients: list[float], along: Column, across: Column) -> tuple[Column, Column]:
    """Sums of c_j sin(2j along) cosh(2j across) and c_j cos(2j along) sinh(2j across)."""
    north, east = F.lit(0.0), F.lit(0.0)
    for j, c in enumerate(coefficients, start=1):
        north = north + c * F.sin(2 * j * along) * F.cosh(2 * j * across)
        east = east + c * F.cos(2 * j * along) * F.sinh(2 * j * across)
    return north, east


def _transverse_inverse(x: Column, y: Column, p: TransverseMercator) -> tuple[Column, Column]:
    along, across = (y - p.false_northing) / p.radius, (x - p.false_easting) / p.radius
    north, east = _waves(p.series(p._FROM_GRID), along, across)
    xi, eta = along - north, across - east
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    latitude = chi
    for j, c in enumerate(p.series(p._TO_LATITUDE), start=1):
        latitude = latitude + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + p.longitude_0, F.degrees(latitude)


def _transverse_forward(lon: Column, lat: Column, p: TransverseMercator) -> tuple[Column, Column]:
    e, sine, away = p.eccentricity, F.sin(F.radians(lat)), F.radians(lon - p.longitude_0)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north, east = _waves(p.series(p._TO_GRID), xi, eta)
    return (p.radius * (eta + east) + p.false_easting, p.radius * (xi + north) + p.false_northing)


def _conic_inverse(x: Column, y: Column, projection: ConformalConic) -> tuple[Column, Column]:
    """The latitude starts from its series in sin(2k chi), good to some micrometres; one step
    of the usual fixed-point iteration then divides that error by 150.
    """
    n, scaled, radius_0 = projection.cone
    dx = x - projection.false_easting
    dy = F.lit(radius_0) - (y - projection.false_northing)
    radius = F.sqrt(dx * dx + dy * dy) * math.copysign(1.0, n)
    t = F.pow(radius / scaled, F.lit(1 / n))
    sign = math.copysign(1.0, n)
    theta = F.atan2(dx * sign, dy * sign)
    chi = math.pi / 2 - 2 * F.atan(t)
    e2 = projection.eccentricity ** 2
    series = (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    )
    latitude = chi
    for k, factor in enumerate(series, start=1):
        latitude = latitude + F.sin(chi * (2 * k)) * factor
    e = projection.eccentricity
    refined = math.pi / 2 - 2 * F.atan(t * F.exp(F.atanh(F.sin(latitude) * e) * -e))
    return F.degrees(theta / n) + projection.longitude_0, F.degrees(refined)


def _conic_forward(lon: Column, lat: Column, projection: ConformalConic) -> tuple[Column, Column]:
    n, scaled, radius_0 = projection.cone
    e = projection.eccentricity
    phi = F.radians(lat)
    e_sin = F.sin(phi) * e
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e_sin) / (1 + e_sin), F.lit(e / 2))
    radius = F.pow(t, F.lit(n)) * scaled
    theta = F.radians(lon - projection.longitude_0) * n
    return (radius * F.sin(theta) + projection.false_easting,
            F.lit(radius_0) - radius * F.cos(theta) + projection.false_northing)


def reproject(vertices: DataFrame, projection: Projection) -> DataFrame:
    """Vertex table with x, y turned from projected units into degrees."""
    lon, lat = inverse(F.col("x"), F.col("y"), projection)
    return vertices.withColumns({"x": lon, "y": lat})
