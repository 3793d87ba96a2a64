"""Shapefiles: .shp, .shx, .dbf, .prj and .cpg, from the published format descriptions.

Reading splits by record number: the .shx has a fixed eight bytes a record, the .dbf fixed rows. M and Z are
dropped; multipatches are an error. Attributes keep their DBF types in field metadata.
"""

from __future__ import annotations

import datetime as dt
import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import codecs as G
from ..model import Capabilities, FormatError, GeometryError, GeometryMeta, OnLoss, ReadOptions, Uri, WriteOptions, as_geometry, log, quoted, require_geometry, type_of
from ..operators import crs_texts, loss, text
from . import files, ranged

NAME, SCHEMES = "shp", ("shp",)
CAPABILITIES = Capabilities(supports_decimal=True, supports_timestamp_tz=False, string_encoding=("utf-8", "cp932", "latin-1"), max_decimal_precision=18)
KINDS = {1: 1, 3: 5, 5: 6, 8: 4}  # shape: the declared geometry
SHAPES = {"Point": 1, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5, "MultiPoint": 8}
METADATA = "dbf:type"


def _base(path: str) -> str:
    return os.path.splitext(path)[0]


def _codec(base: str, wanted: str | None) -> str:
    if wanted:
        return text.encoding(wanted)
    if os.path.exists(base + ".cpg"):
        with open(base + ".cpg") as f:
            try:
                return text.encoding(f.read())
            except ValueError:
                pass
    return "utf-8"


def dbf_header(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, length of header and record, fields (name, type, length, decimals)."""
    with open(path, "rb") as f:
        head = f.read(32)
        n, start, size = struct.unpack_from("<IHH", head, 4)
        fields = []
        while (d := f.read(32)) and d[0] != 0x0D and len(d) == 32:
            fields.append((d[:11].split(b"\0")[0].decode("utf-8", "replace"), chr(d[11]), d[16], d[17]))
    return n, start, size, fields


def spark_type(kind: str) -> str:
    return {"C": "string", "M": "string", "N": "double", "F": "double", "B": "double", "O": "double", "Y": "double", "L": "boolean", "I": "int", "D": "date", "T": "date", "@": "date"}.get(kind, "string")


def cell(raw: bytes, kind: str, codec: str):
    if kind == "I":
        return struct.unpack("<i", raw)[0]
    if kind in "BO":
        return struct.unpack("<d", raw)[0]
    value = raw.decode(codec, "replace").rstrip(" \0")
    if kind in "CM":
        return value or None
    value = value.strip()
    if kind == "L":
        return True if value in ("T", "t", "Y", "y") else False if value in ("F", "f", "N", "n") else None
    if kind in "DT@":
        return dt.date(int(value[:4]), int(value[4:6]), int(value[6:8])) if value[:8].isdigit() and int(value[:8]) else None
    try:
        return float(value)
    except ValueError:
        return None


def decode_shape(data: bytes) -> tuple | None:
    (kind,) = struct.unpack_from("<i", data)
    if kind == 0:
        return None
    if kind == 31:
        raise GeometryError("multipatches are not supported")
    plain = kind % 10
    if plain == 1:
        return 1, struct.unpack_from("<dd", data, 4)
    if plain == 8:
        (n,) = struct.unpack_from("<i", data, 36)
        v = struct.unpack_from(f"<{2 * n}d", data, 40)
        return 4, list(zip(v[0::2], v[1::2]))
    if plain not in (3, 5):
        raise GeometryError(f"unknown shape {kind}")
    parts, n = struct.unpack_from("<ii", data, 36)
    if 44 + 4 * parts + 16 * n > len(data):
        raise GeometryError("truncated shape")
    at = [*struct.unpack_from(f"<{parts}i", data, 44), n]
    v = struct.unpack_from(f"<{2 * n}d", data, 44 + 4 * parts)
    points = list(zip(v[0::2], v[1::2]))
    lines = [points[a:b] for a, b in zip(at, at[1:])]
    if plain == 5:
        return 3, lines
    return (2, lines[0]) if parts == 1 else (5, lines)


def encode_shape(geom: tuple, shape: int) -> bytes:
    code, c = geom
    if {1: 1, 2: 3, 5: 3, 3: 5, 6: 5, 4: 8}[code] != shape:
        raise GeometryError(f"{G.NAMES[code]} in a layer of shape {shape}")
    if shape == 1:
        return struct.pack("<idd", 1, *c)
    box = G.bbox(geom)
    if shape == 8:
        return struct.pack(f"<i4di{2 * len(c)}d", 8, *box, len(c), *[v for p in c for v in p])
    lines = [c] if code == 2 else c if code in (3, 5) else [r for polygon in c for r in polygon]
    starts = [sum(len(x) for x in lines[:i]) for i in range(len(lines))]
    points = [v for line in lines for p in line for v in p]
    return struct.pack(f"<i4dii{len(lines)}i{len(points)}d", shape, *box, len(lines), len(points) // 2, *starts, *points)


def read(spark: SparkSession, uri: Uri, options: ReadOptions) -> DataFrame:
    base = _base(uri.path)
    if not os.path.exists(uri.path):
        raise FormatError(f"no file {uri.path}")
    with open(uri.path, "rb") as f:
        head = f.read(100)
    (shape,) = struct.unpack_from("<i", head, 32)
    if shape > 10:  # only x and y are read
        loss.apply_policy("m-on-shp" if shape > 20 else "z-on-shp", "geometry", OnLoss(options.extra.get("on_loss", "warn")))
    _, _, _, fields = dbf_header(base + ".dbf")
    crs = options.src_crs
    if crs is None and os.path.exists(base + ".prj"):
        with open(base + ".prj", encoding="utf-8", errors="replace") as f:
            crs = crs_texts.from_wkt1(f.read().strip())
    meta = GeometryMeta(G.NAMES.get(KINDS.get(shape % 10, 0), "Geometry"), crs)
    schema = T.StructType([T.StructField(n, type_of(spark_type(k)), True, {METADATA: k}) for n, k, _, _ in fields] + [T.StructField("geometry", T.BinaryType(), True)])
    records = (os.path.getsize(base + ".shx") - 100) // 8
    layer = {"base": os.path.abspath(base), "shp": os.path.abspath(uri.path), "codec": _codec(base, options.encoding)}
    df = ranged.load(spark, "shapefile", layer, schema, ranged.ranges(0, records, spark.sparkContext.defaultParallelism))
    return df.select(*[as_geometry(quoted(c), c, meta) if c == "geometry" else quoted(c) for c in df.columns])


def batches(layer: dict, low: int, high: int):
    from pyspark.sql.pandas.types import to_arrow_type

    _, start, size, fields = dbf_header(layer["base"] + ".dbf")
    kinds = [to_arrow_type(type_of(spark_type(k))) for _, k, _, _ in fields]
    with open(layer["base"] + ".shx", "rb") as x, open(layer["shp"], "rb") as s, open(layer["base"] + ".dbf", "rb") as d:
        for a in range(low, high, ranged.ROWS // 4):
            b = min(a + ranged.ROWS // 4, high)
            x.seek(100 + 8 * a)
            index = struct.unpack(f">{2 * (b - a)}i", x.read(8 * (b - a)))
            first, last = index[0], index[-2] + index[-1] + 4
            s.seek(2 * first)
            block = s.read(2 * (last - first))
            shapes = []
            for offset, length in zip(index[0::2], index[1::2]):
                at = 2 * (offset - first) + 8
                geom = decode_shape(block[at : at + 2 * length])
                shapes.append(None if geom is None else G.wkb_encode(geom))
            d.seek(start + size * a)
            rows = d.read(size * (b - a))
            columns, at = [], 1
            for (_, kind, n, _), t in zip(fields, kinds):
                columns.append(pa.array([cell(rows[i * size + at : i * size + at + n], kind, layer["codec"]) for i in range(b - a)], t))
                at += n
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shapes, pa.binary())], [*[f[0] for f in fields], "geometry"])


def dbf_cell(value, f: loss.DbfField, codec: str, policy: OnLoss) -> bytes:
    if f.kind == "C":
        if value is None:
            return b" " * f.length
        try:
            data = value.encode(codec)
        except UnicodeEncodeError:
            loss.apply_policy("utf8-cp-unmappable", f.source, policy)
            data = value.encode(codec, "replace")
        if len(data) > f.length:
            loss.apply_policy("utf8-length-on-dbf", f.source, policy)
            data = text.cut_bytes(value, f.length, codec).encode(codec, "replace")
        return data.ljust(f.length)
    if value is None:
        return {"L": b"?", "D": b" " * 8}.get(f.kind, b" " * f.length)
    if f.kind == "L":
        return b"T" if value else b"F"
    if f.kind == "D":
        return value.strftime("%Y%m%d").zfill(8).encode()
    out = (f"%.{f.decimals}f" % value if f.decimals else "%d" % value).encode()
    if len(out) > f.length:
        raise FormatError(f"{f.source}: {value} does not fit {f.length} characters")
    return out.rjust(f.length)


def write(df: DataFrame, uri: Uri, options: WriteOptions) -> None:
    geometry, meta = require_geometry(df.schema)
    shape = SHAPES.get(meta.geometry_type)
    if shape is None:
        raise GeometryError(f"a shapefile holds one type of geometry, not {meta.geometry_type}")
    fields, _ = loss.plan_dbf(df.schema, options.on_loss)
    base, codec, policy = _base(uri.path), text.encoding(options.encoding), options.on_loss
    suffixes = (".shp", ".shx", ".dbf", ".prj", ".cpg")
    files.refuse_existing(uri.path, options.overwrite, tuple(base + s for s in suffixes[1:] if os.path.exists(base + s)) if options.overwrite else ())
    code = meta.crs.epsg_code() if meta.crs else None
    prj = crs_texts.WKT1.get(code) or (meta.crs.wkt if meta.crs and meta.crs.wkt_flavor == "V1" else None)
    if prj is None and meta.crs is not None:
        loss.apply_policy("prj-write-unsupported-epsg", geometry, policy)
    if not fields:
        fields = [loss.DbfField("", "FID", "N", 11)]
    rows = df.select(*[quoted(f.source) for f in fields if f.source], quoted(geometry))

    def put(batches, path):
        box, n, at = [float("inf"), float("inf"), float("-inf"), float("-inf")], 0, 50
        with open(path + ".shp", "wb") as s, open(path + ".shx", "wb") as x, open(path + ".dbf", "wb") as d:
            s.write(b"\0" * 100)
            x.write(b"\0" * 100)
            size = 1 + sum(f.length for f in fields)
            start = 33 + 32 * len(fields)
            d.write(struct.pack("<BBBBIHH20x", 3, 126, 1, 1, 0, start, size))
            for f in fields:
                d.write(f.name.encode("utf-8").ljust(11, b"\0") + f.kind.encode() + b"\0" * 4 + bytes([f.length, f.decimals]) + b"\0" * 14)
            d.write(b"\r")
            for batch in batches:
                columns = [batch.column(f.source).to_pylist() if f.source else list(range(n, n + batch.num_rows)) for f in fields]
                for i, wkb in enumerate(batch.column(geometry).to_pylist()):
                    if wkb is None:
                        raise GeometryError("a shapefile row needs a geometry")
                    geom = G.wkb_decode(wkb)
                    body = encode_shape(geom, shape)
                    own = G.bbox(geom)
                    if own:
                        box = [*map(min, box[:2], own[:2]), *map(max, box[2:], own[2:])]
                    s.write(struct.pack(">ii", n + 1, len(body) // 2) + body)
                    x.write(struct.pack(">ii", at, len(body) // 2))
                    at += 4 + len(body) // 2
                    n += 1
                    d.write(b" " + b"".join(dbf_cell(c[i], f, codec, policy) for c, f in zip(columns, fields)))
            d.write(b"\x1a")
            d.seek(4)
            d.write(struct.pack("<I", n))
            box = box if n else [0.0] * 4
            for f, length in ((s, at), (x, 50 + 4 * n)):
                f.seek(0)
                f.write(struct.pack(">i20xi", 9994, length) + struct.pack("<ii8d", 1000, shape, *box, 0, 0, 0, 0))
        with open(path + ".cpg", "w") as f:
            f.write({"utf-8": "UTF-8", "cp932": "CP932", "latin-1": "ISO-8859-1", "cp1252": "CP1252"}[codec])
        if prj:
            with open(path + ".prj", "w", encoding="utf-8") as f:
                f.write(prj)
        return n

    files.write_single(rows, base, put, suffixes)
    log.info("wrote %s", uri.path)
