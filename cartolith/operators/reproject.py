"""Reprojection of layers.

Closed forms only: EPSG:4326 (longitude, latitude), EPSG:3857 and the UTM zones of WGS 84 (EPSG:32601 to 32660 and
32701 to 32760), any of them to any other. Pairs that are equal are left alone; any other pair needs pyproj on the
executors or is an error, never a silent relabelling. A coordinate that has no image (a latitude of +-90 or beyond
towards EPSG:3857, one further than REACH degrees from a zone's meridian, or none at all) is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs as G
from ..functions.columns import points_of, points_wkb, spread
from ..model import Crs, CrsError, GeometryMeta, quoted, require_geometry, with_geometry

RADIUS = 6378137.0


def parse_target(text: str) -> Crs:
    """EPSG code, PROJJSON (`{` begins it) or a WKT or PROJ text."""
    text = text.strip()
    if not text:
        raise CrsError("the target CRS is empty")
    if text.upper().startswith("EPSG:") and text[5:].strip().isdigit():
        return Crs.epsg(int(text[5:]))
    return Crs(projjson=text) if text[0] == "{" else Crs(wkt=text, wkt_flavor="V2")


def spec(crs: Crs) -> str:
    code = crs.epsg_code()
    return f"EPSG:{code}" if code is not None else crs.projjson or crs.wkt or ""


def forward(x, y):
    """Longitude and latitude to spherical Mercator."""
    with np.errstate(all="ignore"):
        out = RADIUS * np.radians(x), RADIUS * np.log(np.tan(math.pi / 4 + np.radians(y) / 2))
    return out[0], np.where(np.abs(y) < 90, out[1], np.nan)


def inverse(x, y):
    return np.degrees(x / RADIUS), np.degrees(2 * np.arctan(np.exp(y / RADIUS)) - math.pi / 2)


# WGS 84 and the transverse Mercator series of Krueger in the third flattening, to its fourth power.
FLATTENING, SCALE, EASTING, SOUTH, REACH = 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0, 40
_N = FLATTENING / (2 - FLATTENING)
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_RECTIFYING = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)


def _series(xi, eta, terms, sign):
    """xi and eta after all terms, which are taken at their values before."""
    return (
        xi + sign * sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(terms, 1)),
        eta + sign * sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(terms, 1)),
    )


def to_utm(x, y, zone: int, south: bool):
    """Longitude and latitude to easting and northing of a zone."""
    with np.errstate(all="ignore"):
        away = np.mod(x - (6 * zone - 183) + 180, 360) - 180
        lon, sine = np.radians(away), np.sin(np.radians(y))
        t = np.sinh(np.arctanh(sine) - _E * np.arctanh(_E * sine))
        xi, eta = _series(np.arctan2(t, np.cos(lon)), np.arcsinh(np.sin(lon) / np.hypot(t, np.cos(lon))), ALPHA, 1)
        out = EASTING + SCALE * _RECTIFYING * eta, (SOUTH if south else 0) + SCALE * _RECTIFYING * xi
    sound = (np.abs(away) <= REACH) & (np.abs(y) < 90)
    return np.where(sound, out[0], np.nan), np.where(sound, out[1], np.nan)


def from_utm(x, y, zone: int, south: bool):
    """Easting and northing of a zone to longitude and latitude."""
    with np.errstate(all="ignore"):
        xi, eta = _series((y - (SOUTH if south else 0)) / (SCALE * _RECTIFYING), (x - EASTING) / (SCALE * _RECTIFYING), BETA, -1)
        t = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
        tau = t  # the tangent of the latitude, from that of the conformal one by Newton's steps
        for _ in range(5):
            root = np.sqrt(1 + tau * tau)
            sigma = np.sinh(_E * np.arctanh(_E * tau / root))
            now = tau * np.sqrt(1 + sigma * sigma) - sigma * root
            tau = tau + (t - now) / np.sqrt(1 + now * now) * (1 + (1 - _E2) * tau * tau) / ((1 - _E2) * root)
        lon = np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))) + 6 * zone - 183
    return np.mod(lon + 180, 360) - 180, np.degrees(np.arctan(tau))


def _zone(text: str) -> tuple[int, bool] | None:
    """Number of a UTM zone of WGS 84, and whether it is southern."""
    code = int(text[5:]) if text.startswith("EPSG:") and text[5:].isdigit() else 0
    return (code % 100, code >= 32700) if code // 100 in (326, 327) and 1 <= code % 100 <= 60 else None


def _from_degrees(text: str):
    if text == "EPSG:4326":
        return lambda x, y: (x, y)
    if text == "EPSG:3857":
        return forward
    zone = _zone(text)
    return (lambda x, y: to_utm(x, y, *zone)) if zone else None


def _to_degrees(text: str):
    if text == "EPSG:4326":
        return lambda x, y: (x, y)
    if text == "EPSG:3857":
        return inverse
    zone = _zone(text)
    return (lambda x, y: from_utm(x, y, *zone)) if zone else None


def transform_for(source: Crs, target: Crs):
    """A function of arrays x, y; raises CrsError for pairs without one."""
    pair = spec(source), spec(target)
    there, back = _to_degrees(pair[0]), _from_degrees(pair[1])
    if there and back:
        return lambda x, y: back(*there(x, y))
    try:
        from pyproj import Transformer
    except ImportError:
        raise CrsError(f"no transformation from {pair[0]} to {pair[1]} (pyproj is not installed)") from None
    Transformer.from_crs(*pair, always_xy=True)
    return lambda x, y: Transformer.from_crs(*pair, always_xy=True).transform(x, y)


def _checked(x, y):
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise CrsError("a coordinate cannot be transformed")
    return x, y


def reproject(df: DataFrame, target: Crs, source: Crs | None = None) -> DataFrame:
    """The layer in the target CRS; nulls stay null."""
    name, meta = require_geometry(df.schema)
    source = source or meta.crs
    if source is None:
        raise CrsError("the source CRS is not known")
    after = GeometryMeta(meta.geometry_type, target, meta.edges)
    if spec(source) == spec(target):
        return with_geometry(df, name, quoted(name), after)
    f = transform_for(source, target)

    @F.pandas_udf(T.BinaryType())
    def moved(wkb: pd.Series) -> pd.Series:
        fast = points_of(wkb)
        if fast is not None:
            x, y = _checked(*f(fast[0][:, 0], fast[0][:, 1]))
            return spread(points_wkb(x, y), fast[1])
        geoms = [None if b is None else G.wkb_decode(b) for b in wkb]
        flat = np.array([p for g in geoms if g for p in G.walk(g)], float).reshape(-1, 2)
        x, y = _checked(*f(flat[:, 0], flat[:, 1]))
        new = iter(zip(x.tolist(), y.tolist()))
        return pd.Series([None if g is None else G.wkb_encode(G.mapped(g, lambda *_: next(new))) for g in geoms], dtype=object)

    return with_geometry(df, name, moved(quoted(name)), after)
