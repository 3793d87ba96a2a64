"""Drivers by scheme. A driver has NAME, SCHEMES, CAPABILITIES, read(spark, uri, options) and write(df, uri, options)."""

from __future__ import annotations

from ..model import FormatError, Uri
from . import csv, flatgeobuf, geojson, geoparquet, rdb, shapefile, sqlite

_drivers: dict[str, object] = {}


def register_driver(driver) -> None:
    """Adds a driver, or replaces the one of that name."""
    _drivers[driver.NAME] = driver


def drivers() -> list:
    return [_drivers[n] for n in sorted(_drivers)]


def select_driver(uri: Uri):
    if not uri.scheme:
        raise FormatError(f"{uri.raw!r} has no extension")
    for driver in drivers():
        if uri.scheme in driver.SCHEMES:
            return driver
    raise FormatError(f"no driver for scheme {uri.scheme!r}")


for _driver in (csv, geojson, geoparquet, flatgeobuf, shapefile, sqlite.GPKG, sqlite.SPATIALITE, rdb.POSTGIS, rdb.SQLSERVER):
    register_driver(_driver)
