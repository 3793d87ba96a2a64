"""Data model: errors, addresses, coordinate reference systems, geometry columns, capabilities, options."""

from __future__ import annotations

import json
import logging
import re
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("cartolith")

GEOMETRY_KEY = "geo:geometry"
GEOMETRY_TYPES = ("Geometry", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


class LayerError(Exception):
    """Base of all errors."""


class IoError(LayerError):
    pass


class SchemaError(LayerError):
    pass


class UnsupportedType(LayerError):
    def __init__(self, source: str, target: str, field_name: str):
        super().__init__(f"{field_name}: type {source} is not supported by {target}")
        self.source, self.target, self.field = source, target, field_name


class GeometryError(LayerError):
    pass


class CrsError(LayerError):
    pass


class LossError(LayerError):
    def __init__(self, kind: str, field_name: str):
        super().__init__(f"{kind}: {field_name}")
        self.kind, self.field = kind, field_name


class DriverError(LayerError):
    def __init__(self, name: str, message: str):
        super().__init__(f"{name}: {message}")
        self.name = name


class FormatError(LayerError):
    pass


class OnLoss(str, Enum):
    ERROR, WARN, SKIP = "error", "warn", "skip"


class CreateTable(str, Enum):
    IF_NOT_EXISTS, ALWAYS, NEVER = "if-not-exists", "always", "never"


class CreateIndex(str, Enum):
    AUTO, ALWAYS, NEVER = "auto", "always", "never"


@dataclass(frozen=True)
class Uri:
    scheme: str
    raw: str

    @property
    def path(self) -> str:
        rest = self.raw.split("://", 1)[1] if "://" in self.raw else self.raw
        return rest.split("?", 1)[0]


def parse_uri(text: str) -> Uri:
    """Scheme from `scheme://`, else the lower-cased file extension; postgres and postgresql mean pg."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", text)
    if m:
        scheme = m[1].lower()
    else:
        name = text.split("?", 1)[0].replace("\\", "/").rsplit("/", 1)[-1]
        scheme = name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""
    return Uri({"postgres": "pg", "postgresql": "pg"}.get(scheme, scheme), text)


def percent_decode(text: str) -> str:
    """`+` is a space, a bad `%` stays as it is."""
    raw, out, i = text.encode(), bytearray(), 0
    while i < len(raw):
        two = raw[i + 1 : i + 3]
        if raw[i : i + 1] == b"%" and len(two) == 2 and re.fullmatch(rb"[0-9A-Fa-f]{2}", two):
            out.append(int(two, 16))
            i += 3
        else:
            out += b" " if raw[i : i + 1] == b"+" else raw[i : i + 1]
            i += 1
    return out.decode("utf-8", "replace")


def query_options(raw: str) -> dict[str, str]:
    """Options after `?`: keys in lower case, the first of equal keys."""
    out: dict[str, str] = {}
    for pair in raw.split("?", 1)[1].split("&") if "?" in raw else []:
        key, _, value = pair.partition("=")
        if key:
            out.setdefault(percent_decode(key).lower(), percent_decode(value))
    return out


@dataclass(frozen=True)
class Crs:
    authority: str | None = None
    code: str | None = None
    wkt: str | None = None
    wkt_flavor: str | None = None
    projjson: str | None = None

    @classmethod
    def epsg(cls, code: int) -> Crs:
        return cls("EPSG", str(code))

    @classmethod
    def parse(cls, text: str) -> Crs:
        """`EPSG:n` or `epsg:n`, with outer white space."""
        m = re.fullmatch(r"(?:EPSG|epsg):(\d+)", text.strip())
        if not m:
            raise CrsError(f"not an EPSG code: {text!r}")
        return cls.epsg(int(m[1]))

    def epsg_code(self) -> int | None:
        if self.authority and self.authority.upper() == "EPSG" and self.code and self.code.isdigit():
            return int(self.code)
        return None

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}

    def describe(self) -> str:
        if (code := self.epsg_code()) is not None:
            return f"EPSG:{code}"
        if self.wkt:
            return f"WKT: {self.wkt[:60]}" + ("…" if len(self.wkt) > 60 else "")
        return self.projjson or "none"


@dataclass(frozen=True)
class GeometryMeta:
    geometry_type: str = "Geometry"
    crs: Crs | None = None
    edges: str | None = None
    encoding: str = "WKB"

    def to_json(self) -> str:
        out: dict = {"encoding": self.encoding, "geometry_type": self.geometry_type}
        if self.crs:
            out["crs"] = self.crs.to_dict()
        if self.edges:
            out["edges"] = self.edges
        return json.dumps(out)

    @classmethod
    def from_json(cls, text: str) -> GeometryMeta:
        x = json.loads(text)
        return cls(x.get("geometry_type", "Geometry"), Crs(**x["crs"]) if x.get("crs") else None, x.get("edges"), x.get("encoding", "WKB"))


@dataclass(frozen=True)
class Capabilities:
    read: bool = True
    write: bool = True
    random_access: bool = False
    bulk_load: bool = False
    supports_blob: bool = False
    supports_decimal: bool = False
    supports_timestamp_tz: bool = True
    string_encoding: tuple[str, ...] = ("utf-8",)
    max_decimal_precision: int | None = None

    def to_dict(self) -> dict:
        out = asdict(self)
        e = self.string_encoding
        out["string_encoding"] = {"kind": "fixed", "value": e[0]} if len(e) == 1 else {"kind": "configurable", "value": list(e)}
        return out


@dataclass(frozen=True)
class ReadOptions:
    src_crs: Crs | None = None
    where: str | None = None
    select: tuple[str, ...] | None = None
    query: str | None = None
    encoding: str | None = None
    table: str | None = None
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class WriteOptions:
    overwrite: bool = False
    on_loss: OnLoss = OnLoss.ERROR
    create_table: CreateTable = CreateTable.IF_NOT_EXISTS
    create_index: CreateIndex = CreateIndex.AUTO
    encoding: str | None = None
    batch_size: int | None = None
    insert_mode: str = "auto"
    partitioned: bool = False
    extra: dict = field(default_factory=dict)


_SIMPLE = {t.typeName() if t is not T.LongType else "bigint": t for t in (T.BooleanType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.LongType)}
_SIMPLE |= {"tinyint": T.ByteType, "smallint": T.ShortType, "int": T.IntegerType}


def type_of(name: str) -> T.DataType:
    """The type of that simple name; unlike Spark's own parser it works on executors."""
    if name.startswith("decimal("):
        return T.DecimalType(*map(int, name[8:-1].split(",")))
    return _SIMPLE[name]()


# geometry columns


def geometry_field(schema: T.StructType) -> T.StructField | None:
    """The first field with geometry metadata."""
    return next((f for f in schema.fields if GEOMETRY_KEY in (f.metadata or {})), None)


def require_geometry(schema: T.StructType) -> tuple[str, GeometryMeta]:
    f = geometry_field(schema)
    if f is None:
        raise SchemaError("the layer has no geometry column")
    return f.name, GeometryMeta.from_json(f.metadata[GEOMETRY_KEY])


def as_geometry(column: Column, name: str, meta: GeometryMeta) -> Column:
    """The column under that name with geometry metadata (any expression but a bare reference loses it)."""
    return column.alias(name, metadata={GEOMETRY_KEY: meta.to_json()})


def with_geometry(df: DataFrame, name: str, column: Column, meta: GeometryMeta) -> DataFrame:
    """df with the column in its place, or last if it is new."""
    new = as_geometry(column, name, meta)
    if name in df.columns:
        return df.select(*[new if c == name else quoted(c) for c in df.columns])
    return df.select(*[quoted(c) for c in df.columns], new)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def replace_crs(df: DataFrame, crs: Crs | None) -> DataFrame:
    """Another label, the same coordinates: metadata only."""
    name, meta = require_geometry(df.schema)
    return with_geometry(df, name, quoted(name), GeometryMeta(meta.geometry_type, crs, meta.edges))
