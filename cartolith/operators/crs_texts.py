"""CRS texts: PROJJSON, WKT1 and codes inside them."""

from __future__ import annotations

import json
import re

from ..model import Crs

# The WKT1 texts written to .prj files, as readers of those files expect them.
WKT1 = {
    4326: 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AXIS["Latitude",NORTH],AXIS["Longitude",EAST],AUTHORITY["EPSG","4326"]]',
    3857: 'PROJCS["WGS 84 / Pseudo-Mercator",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4326"]],PROJECTION["Mercator_1SP"],PARAMETER["central_meridian",0],PARAMETER["scale_factor",1],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["X",EAST],AXIS["Y",NORTH],AUTHORITY["EPSG","3857"]]',
    4269: 'GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]],AUTHORITY["EPSG","6269"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4269"]]',
    6668: 'GEOGCS["JGD2011",DATUM["Japanese_Geodetic_Datum_2011",SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]],AUTHORITY["EPSG","1128"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","6668"]]',
}


def wkt1_code(text: str) -> int | None:
    """The last EPSG authority of a WKT1 text."""
    found = re.findall(r'AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]', text)
    return int(found[-1]) if found else None


def from_wkt1(text: str) -> Crs:
    code = wkt1_code(text)
    return Crs("EPSG" if code is not None else None, str(code) if code is not None else None, text, "V1")


def projjson_of(crs: Crs | None) -> dict | None:
    """Minimal PROJJSON for an EPSG code, else the one that was stored, else none."""
    if crs is None:
        return None
    if (code := crs.epsg_code()) is not None:
        return {"id": {"authority": "EPSG", "code": code}}
    return json.loads(crs.projjson) if crs.projjson else None


def from_projjson(value) -> Crs | None:
    if not isinstance(value, dict):
        return None
    key = value.get("id") if isinstance(value.get("id"), dict) else {}
    return Crs(key.get("authority"), str(key["code"]) if "code" in key else None, projjson=json.dumps(value))


def from_name(name: str) -> Crs | None:
    """A name as GeoJSON's `crs` member has it."""
    if re.fullmatch(r"urn:ogc:def:crs:OGC:[^:]*:CRS84", name):
        return Crs.epsg(4326)
    m = re.fullmatch(r"(?:EPSG:|urn:ogc:def:crs:EPSG:[^:]*:)(\d+)", name)
    return Crs.epsg(int(m[1])) if m else None
