"""Geometry functions over columns.

Arrow batches go through Python; batches that hold nothing but little-endian points take whole-array paths.
register_all() makes the functions available to SQL.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codecs as G

XY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y")])
BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("minx", "miny", "maxx", "maxy")])
POINT = b"\x01\x01\x00\x00\x00"


def points_of(values: pd.Series) -> tuple[np.ndarray, np.ndarray] | None:
    """Coordinates (n x 2) and validity, if all values are null or little-endian points."""
    valid = values.notna().to_numpy()
    data = b"".join(values[valid])
    n = int(valid.sum())
    if len(data) != 21 * n:
        return None
    raw = np.frombuffer(data, np.uint8).reshape(n, 21)
    if n and not (raw[:, :5] == np.frombuffer(POINT, np.uint8)).all():
        return None
    return np.ascontiguousarray(raw[:, 5:]).view("<f8"), valid


def rings_of(values: pd.Series) -> tuple[np.ndarray, np.ndarray] | None:
    """Coordinates (n x 2k) and validity, if all values are null or little-endian polygons of one ring, all with k corners."""
    valid = values.notna().to_numpy()
    data, n = b"".join(values[valid]), int(valid.sum())
    size = len(data) // n if n else 0
    if size < 29 or (size - 13) % 16 or len(data) != n * size:
        return None
    raw = np.frombuffer(data, np.uint8).reshape(n, size)
    head = np.frombuffer(b"\x01\x03\x00\x00\x00\x01\x00\x00\x00" + ((size - 13) // 16).to_bytes(4, "little"), np.uint8)
    return (np.ascontiguousarray(raw[:, 13:]).view("<f8"), valid) if (raw[:, :13] == head).all() else None


def rings_text(flat: np.ndarray):
    bits, at = np.unique(flat.view(np.int64), return_inverse=True)  # bits: -0 is not 0
    numbers = np.array([G.number(x) for x in bits.view(float).tolist()], object)
    for row in numbers[at.reshape(flat.shape)].tolist():
        yield "POLYGON((" + ",".join([f"{x} {y}" for x, y in zip(row[0::2], row[1::2])]) + "))"


def points_wkb(x: np.ndarray, y: np.ndarray) -> list[bytes]:
    raw = np.empty((len(x), 21), np.uint8)
    raw[:, :5] = np.frombuffer(POINT, np.uint8)
    raw[:, 5:] = np.column_stack([x, y]).astype("<f8").view(np.uint8)
    data = raw.tobytes()
    return [data[i : i + 21] for i in range(0, len(data), 21)]


def spread(values, valid: np.ndarray) -> pd.Series:
    out = np.full(len(valid), None, object)
    out[valid] = np.fromiter(values, object, int(valid.sum()))
    return pd.Series(out)


def each(f):
    """A function of one value over a series, nulls passed on."""
    return lambda s: pd.Series([None if x is None or x is pd.NA else f(x) for x in s], dtype=object)


def _udf(name: str, kind: str, f):
    wrapped = each(f)

    def run(s: pd.Series) -> pd.Series:
        return wrapped(s)

    run.__name__ = name
    return F.pandas_udf(run, kind)


@F.arrow_udf(T.BinaryType())
def st_point(x: pa.Array, y: pa.Array) -> pa.Array:
    """Points as one buffer for a batch, without an object for each."""
    x, y = (v.cast(pa.float64(), safe=False) for v in (x, y))
    valid = (x.is_valid().to_numpy(zero_copy_only=False)) & (y.is_valid().to_numpy(zero_copy_only=False))
    raw = np.empty((int(valid.sum()), 21), np.uint8)
    raw[:, :5] = np.frombuffer(POINT, np.uint8)
    raw[:, 5:] = np.column_stack([v.to_numpy(zero_copy_only=False)[valid] for v in (x, y)]).astype("<f8").view(np.uint8)
    ends = np.concatenate([[0], np.cumsum(valid) * 21]).astype(np.int32)
    known = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(valid), [known, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


@F.pandas_udf(XY)
def st_xy(wkb: pd.Series) -> pd.DataFrame:
    """Coordinates of points; null for other geometries."""
    fast = points_of(wkb)
    if fast is None:
        got = [None if b is None else G.wkb_decode(b) for b in wkb]
        return pd.DataFrame([g[1] if g and g[0] == 1 else (None, None) for g in got], columns=["x", "y"], dtype=object)
    out = np.full((len(wkb), 2), np.nan)
    out[fast[1]] = fast[0]
    return pd.DataFrame(out, columns=["x", "y"])


@F.pandas_udf(T.StringType())
def st_as_text(wkb: pd.Series) -> pd.Series:
    fast = points_of(wkb)
    if fast is None:
        alike = rings_of(wkb)
        return each(lambda b: G.wkt_encode(G.wkb_decode(b)))(wkb) if alike is None else spread(rings_text(alike[0]), alike[1])
    return spread((f"POINT({G.number(x)} {G.number(y)})" for x, y in fast[0].tolist()), fast[1])


@F.pandas_udf(T.StringType())
def st_as_geojson(wkb: pd.Series) -> pd.Series:
    fast = points_of(wkb)
    if fast is None:
        return each(lambda b: G.geojson_geometry(G.wkb_decode(b)))(wkb)
    return spread((f'{{"type":"Point","coordinates":[{json.dumps(x)},{json.dumps(y)}]}}' for x, y in fast[0].tolist()), fast[1])


st_from_text = _udf("st_from_text", T.BinaryType(), G.wkt_to_wkb)
st_from_geojson = _udf("st_from_geojson", T.BinaryType(), lambda t: G.wkb_encode(G.geojson_decode(json.loads(t))) if json.loads(t) is not None else None)
st_normalise = _udf("st_normalise", T.BinaryType(), G.wkb_normal)
st_from_spatialite = _udf("st_from_spatialite", T.BinaryType(), lambda b: G.spatialite_decode(b)[0])
st_spatialite_srid = _udf("st_spatialite_srid", T.IntegerType(), lambda b: G.spatialite_decode(b)[1])


@F.pandas_udf(T.BinaryType())
def st_as_spatialite(wkb: pd.Series, srid: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else G.spatialite_encode(b, int(s)) for b, s in zip(wkb, srid)], dtype=object)


@F.pandas_udf(BOX)
def st_bbox(wkb: pd.Series) -> pd.DataFrame:
    names = ["minx", "miny", "maxx", "maxy"]
    fast = points_of(wkb)
    if fast is None:
        boxes = [None if b is None else G.bbox(G.wkb_decode(b)) for b in wkb]
        return pd.DataFrame([b or (None,) * 4 for b in boxes], columns=names, dtype=object)
    out = np.full((len(wkb), 4), np.nan)
    xy = np.where(np.isfinite(fast[0]).all(axis=1)[:, None], fast[0], np.nan)
    out[fast[1]] = np.hstack([xy, xy])
    return pd.DataFrame(out, columns=names)


def _byte(b: Column, at: int) -> Column:
    """The byte at a place (from 1) as a number."""
    return F.conv(F.hex(F.substring(b, at, 1)), 16, 10).cast("int")


def _int32(b: Column, at: int, little: Column) -> Column:
    """The signed 32-bit integer whose first byte is at a place."""
    digits = [F.hex(F.substring(b, at + i, 1)) for i in range(4)]
    value = F.conv(F.when(little, F.concat(*reversed(digits))).otherwise(F.concat(*digits)), 16, 10).cast("long")
    return F.when(value >= 2**31, value - 2**32).otherwise(value).cast("int")


def _checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def _ewkb(b: Column) -> tuple[Column, Column, Column]:
    """Of EWKB: whether it is little-endian, the byte of the type that holds the flags, and what makes it no plain EWKB (true or null if sound)."""
    little = _byte(b, 1) == 1
    flags = F.when(little, _byte(b, 5)).otherwise(_byte(b, 2))
    has_srid = flags.bitwiseAND(0x20) != 0
    bad = (F.length(b) < 5) | (_byte(b, 1) > 1) | (flags.bitwiseAND(0xC0) != 0) | (has_srid & (F.length(b) < 9))
    return little, flags, bad


def st_from_ewkb(ewkb) -> Column:
    """WKB of EWKB without its SRID, without leaving the JVM; Z, M and truncated values are errors."""
    b = F.col(ewkb) if isinstance(ewkb, str) else ewkb
    little, flags, bad = _ewkb(b)
    plain = F.unhex(F.lpad(F.hex(flags.bitwiseAND(0xDF).cast("long")), 2, "0"))
    kept = F.when(little, F.concat(F.substring(b, 1, 4), plain)).otherwise(F.concat(F.substring(b, 1, 1), plain, F.substring(b, 3, 3)))
    made = F.when(flags.bitwiseAND(0x20) == 0, b).otherwise(F.concat(kept, F.substring(b, 10, 2**31 - 11)))
    return F.when(b.isNotNull(), _checked(made, bad, "not plain EWKB"))


def st_ewkb_srid(ewkb) -> Column:
    """SRID of EWKB, null where it has none, without leaving the JVM."""
    b = F.col(ewkb) if isinstance(ewkb, str) else ewkb
    little, flags, bad = _ewkb(b)
    return F.when(b.isNotNull(), _checked(F.when(flags.bitwiseAND(0x20) != 0, _int32(b, 6, little)), bad, "not plain EWKB"))


def _gpkg(b: Column) -> tuple[Column, Column]:
    """Of a GeoPackage geometry: where its WKB begins (from 1), and what makes it unsound."""
    envelope = F.shiftright(_byte(b, 4), 1).bitwiseAND(7)
    begin = F.when(envelope == 0, 9).when(envelope == 1, 41).when(envelope.isin(2, 3), 57).when(envelope == 4, 73)
    bad = (F.length(b) < 8) | (F.substring(b, 1, 3) != F.lit(bytearray(b"GP\0"))) | begin.isNull() | (F.length(b) < begin - 1)
    return begin, bad


def st_from_gpkg(blob) -> Column:
    """WKB of a GeoPackage geometry without leaving the JVM; other values are errors."""
    b = F.col(blob) if isinstance(blob, str) else blob
    begin, bad = _gpkg(b)
    return F.when(b.isNotNull(), _checked(F.substring(b, begin, F.lit(2**31 - 74)), bad, "not a GeoPackage geometry"))


def st_gpkg_srid(blob) -> Column:
    b = F.col(blob) if isinstance(blob, str) else blob
    return F.when(b.isNotNull(), _checked(_int32(b, 5, _byte(b, 4).bitwiseAND(1) == 1), _gpkg(b)[1], "not a GeoPackage geometry"))


def _le32(n: int) -> Column:
    return F.lit(bytearray(int(n).to_bytes(4, "little", signed=n < 0)))


def st_as_ewkb(wkb: Column, srid: int) -> Column:
    """EWKB of little-endian WKB without leaving the JVM: flag and SRID go in behind the type."""
    plain = (F.substring(wkb, 1, 1) == F.lit(bytearray(b"\x01"))) & (F.substring(wkb, 3, 3) == F.lit(bytearray(3)))
    made = F.concat(F.substring(wkb, 1, 4), F.lit(bytearray(b"\x20")), _le32(srid), F.substring(wkb, 6, 2**31 - 7))
    return F.when(wkb.isNull(), None).when(plain, made).otherwise(F.raise_error(F.lit("not plain little-endian WKB")).cast("binary"))


def st_as_gpkg(wkb: Column, srid: int) -> Column:
    return F.concat(F.lit(bytearray(b"GP\x00\x01")), _le32(srid), wkb)


def st_geometry_type(wkb: Column) -> Column:
    """Name of the type from the header, or null, without leaving the JVM."""
    little, h = F.substring(wkb, 1, 1) == F.lit(bytearray(b"\x01")), F.hex(F.substring(wkb, 2, 4))
    out = F.lit(None).cast("string")
    for i, name in enumerate(G.GEOMETRY_TYPES):
        if i:
            code = int(i)
            hit = (little & (h == code.to_bytes(4, "little").hex().upper())) | (~little & (h == code.to_bytes(4, "big").hex().upper()))
            out = F.when(hit, name).otherwise(out)
    return out


def layer_bbox(df, geometry: str):
    box = df.select(st_bbox(F.col(geometry)).alias("b"))
    return box.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


#: For SQL texts, which cannot call functions that make expressions.
SQL_FORMS = {
    "st_from_ewkb": _udf("st_from_ewkb", T.BinaryType(), lambda b: G.ewkb_strip(b)[0]), "st_ewkb_srid": _udf("st_ewkb_srid", T.IntegerType(), lambda b: G.ewkb_strip(b)[1]),
    "st_from_gpkg": _udf("st_from_gpkg", T.BinaryType(), lambda b: G.gpkg_decode(b)[0]), "st_gpkg_srid": _udf("st_gpkg_srid", T.IntegerType(), lambda b: G.gpkg_decode(b)[1]),
}


def register_all(spark: SparkSession) -> None:
    """Makes the functions available to SQL under their names."""
    for name in "st_point st_xy st_as_text st_as_geojson st_from_text st_from_geojson st_normalise st_from_ewkb st_ewkb_srid st_from_gpkg st_gpkg_srid st_from_spatialite st_spatialite_srid st_as_spatialite st_bbox".split():
        spark.udf.register(name, SQL_FORMS.get(name) or globals()[name])
