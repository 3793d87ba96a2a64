"""FlatGeobuf, with a small FlatBuffers reader and writer, from the published schemas.

Files are written without a spatial index; an index in a file that is read is skipped. Reading goes through the
lengths of features, so that a range of features is found without decoding those before it.
"""

from __future__ import annotations

import datetime as dt
import itertools
import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import codecs as G
from ..model import Capabilities, Crs, FormatError, GeometryError, GeometryMeta, ReadOptions, SchemaError, Uri, WriteOptions, as_geometry, quoted, require_geometry, type_of
from ..operators import loss
from ..operators.text import parse_timestamp
from . import files, ranged

NAME, SCHEMES = "fgb", ("fgb",)
CAPABILITIES = Capabilities(supports_blob=True)
MAGIC = b"fgb\x03fgb\x00"
COLUMN_TYPES = ("byte", "ubyte", "bool", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "string", "json", "datetime", "binary")
PACK = {"byte": "b", "ubyte": "B", "bool": "?", "short": "h", "ushort": "H", "int": "i", "uint": "I", "long": "q", "ulong": "Q", "float": "f", "double": "d"}
TO_SPARK = {"byte": "tinyint", "ubyte": "smallint", "bool": "boolean", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint", "long": "bigint", "ulong": "decimal(20,0)", "float": "float", "double": "double", "string": "string", "json": "string", "binary": "binary"}
SAMPLE = 65_536


class Table:
    """A FlatBuffers table that is read in place."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    @classmethod
    def root(cls, data: bytes) -> Table:
        return cls(data, struct.unpack_from("<I", data)[0])

    def place(self, field: int) -> int:
        slot = 4 + 2 * field
        if slot >= self.size:
            return 0
        offset = struct.unpack_from("<H", self.data, self.vtable + slot)[0]
        return self.at + offset if offset else 0

    def scalar(self, field: int, form: str, default=0):
        at = self.place(field)
        return struct.unpack_from("<" + form, self.data, at)[0] if at else default

    def _vector(self, field: int) -> tuple[int, int]:
        at = self.place(field)
        if not at:
            return 0, 0
        at += struct.unpack_from("<I", self.data, at)[0]
        return struct.unpack_from("<I", self.data, at)[0], at + 4

    def array(self, field: int, form: str) -> tuple:
        n, at = self._vector(field)
        if n * struct.calcsize("<" + form) > len(self.data) - at:
            raise FormatError("a vector is longer than its buffer")
        return struct.unpack_from(f"<{n}{form}", self.data, at)

    def raw(self, field: int) -> bytes:
        n, at = self._vector(field)
        return self.data[at : at + n]

    def text(self, field: int) -> str | None:
        return self.raw(field).decode("utf-8", "replace") if self.place(field) else None

    def table(self, field: int) -> Table | None:
        at = self.place(field)
        return Table(self.data, at + struct.unpack_from("<I", self.data, at)[0]) if at else None

    def tables(self, field: int) -> list[Table]:
        n, at = self._vector(field)
        return [Table(self.data, at + 4 * i + struct.unpack_from("<I", self.data, at + 4 * i)[0]) for i in range(n)]


class Builder:
    """Writes tables front to back: a table, then what it refers to. Fields: (number, form or kind, value)."""

    def __init__(self):
        self.out = bytearray(4)

    def finish(self, fields) -> bytes:
        at = self.table(fields)
        struct.pack_into("<I", self.out, 0, at)
        return bytes(self.out)

    def _align(self, n: int, extra: int = 0) -> None:
        while (len(self.out) + extra) % n:
            self.out.append(0)

    def table(self, fields) -> int:
        fields = [f for f in fields if f[2] is not None]
        count = max((f[0] for f in fields), default=-1) + 1
        inline = sorted(fields, key=lambda f: -self._size(f[1]))
        self._align(2)
        vtable, size = len(self.out), 4 + 2 * count
        self.out += bytes(size)
        self._align(8, 4)  # fields of eight bytes come first, right behind the offset to the vtable
        at = len(self.out)
        self.out += struct.pack("<i", at - vtable)
        later, slots = [], [0] * count
        for number, form, value in inline:
            n = self._size(form)
            self._align(n)
            slots[number] = len(self.out) - at
            if form in PACK.values():
                self.out += struct.pack("<" + form, value)
            else:
                later.append((len(self.out), form, value))
                self.out += bytes(4)
        struct.pack_into(f"<HH{count}H", self.out, vtable, size, len(self.out) - at, *slots)
        for place, form, value in later:
            target = self._child(form, value)
            struct.pack_into("<I", self.out, place, target - place)
        return at

    @staticmethod
    def _size(form: str) -> int:
        return struct.calcsize("<" + form) if form in PACK.values() else 4

    def _child(self, form: str, value) -> int:
        if form == "table":
            return self.table(value)
        if form == "tables":
            self._align(4)
            at = len(self.out)
            self.out += struct.pack("<I", len(value)) + bytes(4 * len(value))
            for i, fields in enumerate(value):
                place = at + 4 + 4 * i
                struct.pack_into("<I", self.out, place, self.table(fields) - place)
            return at
        if form == "text":
            data = value.encode("utf-8")
            self._align(4)
            at = len(self.out)
            self.out += struct.pack("<I", len(data)) + data + b"\0"
            return at
        item = form[1:]  # "*d": a vector of doubles; "*B": bytes
        n = struct.calcsize("<" + item)
        self._align(max(4, n), 4 if n > 4 else 0)
        at = len(self.out)
        self.out += struct.pack("<I", len(value)) + (bytes(value) if item == "B" else struct.pack(f"<{len(value)}{item}", *value))
        return at


def geometry_fields(geom: tuple, nested: bool = False) -> list:
    code, c = geom
    if code == 6:
        return [(6, "B", 6), (7, "tables", [geometry_fields((3, p), True) for p in c])]
    lines = {1: lambda: [[c]], 2: lambda: [c], 3: lambda: c, 4: lambda: [c], 5: lambda: c}[code]()
    xy = [v for line in lines for p in line for v in p]
    ends, n = [], 0
    for line in lines:
        n += len(line)
        ends.append(n)
    return [(0, "*I", ends if code in (3, 5) and len(lines) > 1 else None), (1, "*d", xy), (6, "B", code)]


def decode_geometry(t: Table, kind: int) -> tuple:
    kind = t.scalar(6, "B") or kind
    if kind == 6:
        return 6, [decode_geometry(p, 3)[1] for p in t.tables(7)]
    v = t.array(1, "d")
    points = list(zip(v[0::2], v[1::2]))
    if kind == 1:
        return 1, points[0]
    if kind in (2, 4):
        return kind, points
    if kind not in (3, 5):
        raise GeometryError(f"unsupported geometry type {kind}")
    ends = list(t.array(0, "I")) or [len(points)]
    return kind, [points[a:b] for a, b in zip([0, *ends], ends)]


def index_size(features: int, node: int) -> int:
    if node < 2 or features == 0:
        return 0
    n, total = features, features
    while n != 1:
        n = -(-n // node)
        total += n
    return 40 * total


def header(path: str) -> tuple[dict, int]:
    """What the header says, and where features begin."""
    with open(path, "rb") as f:
        magic = f.read(8)
        if magic[:3] != b"fgb" or magic[4:7] != b"fgb":
            raise FormatError("not a FlatGeobuf file")
        (n,) = struct.unpack("<I", f.read(4))
        if n > os.path.getsize(path):
            raise FormatError("the header is longer than the file")
        t = Table.root(f.read(n))
    columns = [(c.text(0), COLUMN_TYPES[c.scalar(1, "B")], bool(c.scalar(7, "?", True))) for c in t.tables(7)]
    crs = t.table(10)
    got = None
    if crs is not None and (crs.scalar(1, "i") or crs.text(4)):
        code = crs.scalar(1, "i")
        got = Crs((crs.text(0) or "EPSG") if code else None, str(code) if code else None, crs.text(4), "V2" if crs.text(4) else None)
    count = t.scalar(8, "Q")
    index = index_size(count, t.scalar(9, "H", 16))
    return {"columns": columns, "kind": t.scalar(2, "B"), "count": count, "crs": got, "index": index}, 12 + n + index


NODE = 40  # bytes of an index node: a box and a place
SPAN = 1 << 20  # bytes of a range at least


def feature_spans(path: str, start: int, head: dict, parts: int) -> list[tuple[int, int]]:
    """Byte ranges of whole features, at most so many and about as long as each other.

    An index ends with one node a feature, which holds its place: only the nodes at the borders are read. Without an
    index the file is walked by the lengths of its features; no more than the borders is kept.
    """
    size = os.path.getsize(path)
    borders, step = [], max(ranged.ROWS // 8, -(-head["count"] // max(1, parts)))
    with open(path, "rb") as f:
        if head["index"] and head["count"]:
            for i in range(0, head["count"], step):
                f.seek(start - NODE * (head["count"] - i) + NODE - 8)
                borders.append(start + struct.unpack("<Q", f.read(8))[0])
            sound = borders == sorted(set(borders)) and borders[-1] < size
            borders = borders if sound else []
        if not borders:
            at, apart = start, max(SPAN, (size - start) // max(1, parts))
            while at + 4 <= size:
                if not borders or at - borders[-1] >= apart:
                    borders.append(at)
                f.seek(at)
                at += 4 + struct.unpack("<I", f.read(4))[0]
    return list(zip(borders, [*borders[1:], size])) or [(0, 0)]


def features_between(path: str, low: int, high: int):
    with open(path, "rb") as f:
        while low + 4 <= high:
            yield _feature(f, low)
            f.seek(low)
            low += 4 + struct.unpack("<I", f.read(4))[0]


def properties(data: bytes, columns) -> dict[int, object]:
    out, at = {}, 0
    while at + 2 <= len(data):
        (i,) = struct.unpack_from("<H", data, at)
        at += 2
        kind = columns[i][1]
        if kind in PACK:
            out[i] = struct.unpack_from("<" + PACK[kind], data, at)[0]
            at += struct.calcsize("<" + PACK[kind])
        else:
            (n,) = struct.unpack_from("<I", data, at)
            raw = data[at + 4 : at + 4 + n]
            out[i] = raw if kind == "binary" else raw.decode("utf-8", "replace")
            at += 4 + n
    return out


def read(spark: SparkSession, uri: Uri, options: ReadOptions) -> DataFrame:
    head, start = header(uri.path)
    spans = feature_spans(uri.path, start, head, spark.sparkContext.defaultParallelism)
    stamps = [i for i, c in enumerate(head["columns"]) if c[1] == "datetime"]
    dates = set()
    first = list(itertools.islice(features_between(uri.path, *spans[0]), SAMPLE + 1)) if stamps and len(spans) == 1 else []
    if 0 < len(first) <= SAMPLE:  # dates only if every value of a file that fits one sample is one
        dates = set(stamps)
        for feature in first:
            for i, v in properties(feature.raw(1), head["columns"]).items():
                if i in dates and ("T" in str(v) or " " in str(v)):
                    dates.discard(i)
    kinds = ["date" if i in dates else "timestamp" if c[1] == "datetime" else TO_SPARK[c[1]] for i, c in enumerate(head["columns"])]
    schema = T.StructType([T.StructField(c[0], type_of(k), c[2]) for c, k in zip(head["columns"], kinds)] + [T.StructField("geometry", T.BinaryType(), True)])
    layer = {"path": os.path.abspath(uri.path), "columns": [list(c) for c in head["columns"]], "kinds": kinds, "kind": head["kind"]}
    df = ranged.load(spark, "flatgeobuf", layer, schema, spans)
    meta = GeometryMeta(G.NAMES.get(head["kind"], "Geometry"), options.src_crs or head["crs"])
    return df.select(*[as_geometry(quoted(c), c, meta) if c == "geometry" else quoted(c) for c in df.columns])


def _feature(f, at: int) -> Table:
    f.seek(at)
    (n,) = struct.unpack("<I", f.read(4))
    return Table.root(f.read(n))


def _value(v, kind: str):
    if v is None:
        return None
    if kind == "date":
        return dt.date.fromisoformat(v[:10])
    if kind == "timestamp":
        return parse_timestamp(v)
    if kind.startswith("decimal"):
        from decimal import Decimal

        return Decimal(v)
    return v


def batches(layer: dict, low: int, high: int):
    """Features whose bytes lie in [low, high)."""
    from pyspark.sql.pandas.types import to_arrow_type

    columns, kinds = layer["columns"], layer["kinds"]
    types = [pa.timestamp("us", "UTC") if k == "timestamp" else to_arrow_type(type_of(k)) for k in kinds]
    names = [*[c[0] for c in columns], "geometry"]
    with open(layer["path"], "rb") as f:
        at = low
        while at < high:
            rows, shapes = [], []
            while at < high and len(rows) < ranged.ROWS // 8:
                t = _feature(f, at)
                at = f.tell()
                rows.append(properties(t.raw(1), columns))
                g = t.table(0)
                shapes.append(None if g is None else G.wkb_encode(decode_geometry(g, layer["kind"])))
            arrays = [pa.array([_value(r.get(i), k) for r in rows], t) for i, (k, t) in enumerate(zip(kinds, types))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(shapes, pa.binary())], names)


def column_type(kind: T.DataType) -> str:
    for cls, name in ((T.BooleanType, "bool"), (T.ByteType, "byte"), (T.ShortType, "short"), (T.IntegerType, "int"), (T.LongType, "long"), (T.FloatType, "float"), (T.DoubleType, "double"), (T.StringType, "string"), (T.BinaryType, "binary"), (T.DateType, "datetime"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.DecimalType, "double")):
        if isinstance(kind, cls):
            return name
    raise SchemaError(f"FlatGeobuf cannot hold {kind.simpleString()}")


def _bytes(i: int, v, kind: str) -> bytes:
    if v is None:
        return b""
    if kind in PACK:
        return struct.pack("<H" + PACK[kind], i, v)
    if isinstance(v, dt.datetime):
        v = v.replace(tzinfo=None).strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
    elif isinstance(v, dt.date):
        v = v.isoformat()
    data = v if isinstance(v, bytes) else v.encode("utf-8")
    return struct.pack("<HI", i, len(data)) + data


def _whole(geom: tuple) -> bytes:
    """A feature up to the length of its properties, which come last."""
    return Builder().finish([(0, "table", geometry_fields(geom)), (1, "*B", b"")])[:-4]


POINT, MARK = b"\x01\x01\x00\x00\x00", (1.2345678e-9, 8.7654321e-9)
BEFORE, AFTER = _whole((1, MARK)).split(struct.pack("<dd", *MARK))


def _start(wkb: bytes) -> bytes:
    if len(wkb) == 21 and wkb[:5] == POINT:  # all points have the same layout
        return BEFORE + wkb[5:] + AFTER
    return _whole(G.wkb_decode(wkb))


def write(df: DataFrame, uri: Uri, options: WriteOptions) -> None:
    geometry, meta = require_geometry(df.schema)
    files.refuse_existing(uri.path, options.overwrite)
    decimals = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    df = loss.apply_plan(df, loss.plan_losses(df.schema, NAME, options.on_loss))
    columns = [(f.name, column_type(f.dataType), f.nullable) for f in df.schema.fields if f.name != geometry]
    if meta.crs is None:
        loss.apply_policy("missing-crs-on-fgb", geometry, options.on_loss)
    described = [[(0, "text", n), (1, "B", COLUMN_TYPES.index(k)), (5, "i", decimals[n].precision if n in decimals else None), (6, "i", decimals[n].scale if n in decimals else None), (7, "?", nullable)] for n, k, nullable in columns]
    crs = meta.crs
    crs_fields = crs and [(0, "text", crs.authority), (1, "i", int(crs.code) if crs.code and crs.code.isdigit() else None), (4, "text", crs.wkt if not crs.authority else None)]
    kind = G.CODES.get(meta.geometry_type, 0)

    def encode(batches):
        """The bytes of a batch's features and their number."""
        for batch in batches:
            values = [batch.column(c[0]).to_pylist() for c in columns]
            out = []
            for i, wkb in enumerate(batch.column(geometry).to_pylist()):
                if wkb is None:
                    raise GeometryError("a FlatGeobuf feature needs a geometry")
                own = b"".join([_bytes(k, v[i], c[1]) for k, (v, c) in enumerate(zip(values, columns))])
                start = _start(wkb)
                out += (struct.pack("<I", len(start) + 4 + len(own)), start, struct.pack("<I", len(own)), own)
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["body", "n"])

    def put(batches, path):
        n = 0
        with open(path + ".body", "wb") as body:
            for batch in batches:
                for data, rows in zip(batch.column("body").to_pylist(), batch.column("n").to_pylist()):
                    body.write(data)
                    n += rows
        head = Builder().finish([(0, "text", "layer"), (2, "B", kind), (7, "tables", described), (8, "Q", n), (9, "H", 0), (10, "table", crs_fields)])
        with open(path, "wb") as out, open(path + ".body", "rb") as body:
            out.write(MAGIC + struct.pack("<I", len(head)) + head)
            while block := body.read(1 << 20):
                out.write(block)
        os.remove(path + ".body")
        return n

    files.write_single(df.mapInArrow(encode, "body binary, n long"), uri.path, put)
