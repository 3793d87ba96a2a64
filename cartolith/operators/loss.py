"""What a target format cannot hold: a plan by schema, and value-level fallbacks as expressions.

plan_losses() decides before any job runs which columns stay, change or go; under `error` it raises at the first
loss. Value-level losses become expressions: `error` raises at the value, the others use the fallback.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CreateTable, DriverError, LossError, OnLoss, SchemaError, UnsupportedType, geometry_field, log, quoted
from .text import timestamp_text

#: Unsigned 64-bit integers come as this type.
UINT64 = T.DecimalType(20, 0)
NESTED = (T.ArrayType, T.StructType, T.MapType)
STAMPS = (T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Loss:
    kind: str
    field: str


def apply_policy(kind: str, name: str, policy: OnLoss) -> bool:
    """Raises under error; true under warn, false under skip."""
    if policy == OnLoss.ERROR:
        raise LossError(kind, name)
    if policy == OnLoss.WARN:
        log.warning("%s: %s", kind, name)
        return True
    return False


@dataclass
class Plan:
    columns: list[tuple[str, str]]  # name, what becomes of it: keep, empty, null, text, double, date, uint64-(policy)
    losses: list[Loss]
    sink: str = ""


def plan_losses(schema: T.StructType, sink: str, policy: OnLoss) -> Plan:
    geometry = geometry_field(schema)
    columns, losses = [], []

    def lose(kind: str, name: str) -> bool:
        losses.append(Loss(f"{kind}-on-{sink}", name))
        return apply_policy(f"{kind}-on-{sink}", name, policy)

    for f in schema.fields:
        what, kind = "keep", f.dataType
        if geometry is not None and f.name == geometry.name:
            pass
        elif sink in ("csv", "geojson") and isinstance(kind, T.BinaryType):
            what = {"csv": "empty", "geojson": "null"}[sink] if lose("binary", f.name) else ""
        elif sink in ("csv", "geojson") and isinstance(kind, NESTED):
            if lose("structured", f.name):
                raise DriverError(sink, f"column {f.name} has a nested type")
            what = ""
        elif sink in ("geojson", "gpkg", "spatialite") and kind == UINT64:
            what = f"uint64-{policy.value}"
        elif sink == "geojson" and isinstance(kind, T.DecimalType):
            what = "text" if lose("decimal", f.name) else ""
        elif sink == "geojson" and isinstance(kind, STAMPS):
            what = "text" if lose("timestamp-precision", f.name) else ""
        elif sink in ("gpkg", "spatialite", "fgb") and isinstance(kind, NESTED):
            raise SchemaError(f"{sink} cannot hold column {f.name} of type {kind.simpleString()}")
        elif sink in ("gpkg", "spatialite") and isinstance(kind, T.DecimalType):
            lose("decimal", f.name)
            what = "text"
        elif sink == "fgb" and isinstance(kind, T.DecimalType):
            lose("decimal", f.name)
            what = "double"
        if what:
            columns.append((f.name, what))
    return Plan(columns, losses, sink)


def apply_plan(df: DataFrame, plan: Plan) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out: list[Column] = []
    for name, what in plan.columns:
        c, kind = quoted(name), kinds[name]
        if what == "empty":
            c = F.lit("").alias(name)
        elif what == "null":
            c = F.lit(None).cast("string").alias(name)
        elif what == "text":
            c = (timestamp_text(c, kind) if isinstance(kind, STAMPS) else c.cast("string")).alias(name)
        elif what == "double":
            c = c.cast("double").alias(name)
        elif what.startswith("uint64-"):
            c = unsigned(c, name, plan.sink, OnLoss(what.removeprefix("uint64-"))).alias(name)
        out.append(c)
    return df.select(*out)


def guarded(value: Column, bad: Column, fallback: Column, kind: str, name: str, policy: OnLoss) -> Column:
    """value, or what a value-level loss makes of it."""
    if policy == OnLoss.ERROR:
        return F.when(bad, F.raise_error(F.lit(f"{kind}: {name}"))).otherwise(value)
    return F.when(bad, fallback).otherwise(value)


def finite(value: Column, name: str, policy: OnLoss) -> Column:
    """NaN and infinities are no JSON."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return guarded(value, bad, F.lit(None), "nonfinite-float-on-geojson", name, policy)


def unsigned(value: Column, name: str, sink: str, policy: OnLoss) -> Column:
    """Unsigned 64-bit integers above the signed range: a text in GeoJSON (where others are numbers), the largest signed
    integer in SQLite files, or null there if losses are skipped."""
    bad, kind = value > 2**63 - 1, f"uint64-overflow-on-{sink}"
    if sink == "geojson":
        number = F.parse_json(value.cast("string"))
        return guarded(number, bad, F.parse_json(F.concat(F.lit('"'), value.cast("string"), F.lit('"'))), kind, name, policy)
    return guarded(value.cast("long"), bad, F.lit(2**63 - 1 if policy == OnLoss.WARN else None).cast("long"), kind, name, policy)


# DBF


@dataclass(frozen=True)
class DbfField:
    source: str
    name: str
    kind: str
    length: int
    decimals: int = 0


def _cut(name: str, limit: int = 10) -> str:
    return name.encode("utf-8")[:limit].decode("utf-8", "ignore")


def plan_dbf(schema: T.StructType, policy: OnLoss) -> tuple[list[DbfField], list[Loss]]:
    """Field names of at most 10 bytes without repeats, and the DBF types of all attributes."""
    geometry, out, losses, used = geometry_field(schema), [], [], set()

    def lose(kind: str, name: str) -> bool:
        losses.append(Loss(kind, name))
        return apply_policy(kind, name, policy)

    for f in schema.fields:
        if geometry is not None and f.name == geometry.name:
            continue
        k = f.dataType
        if isinstance(k, T.BinaryType):
            lose("binary-on-shp", f.name)
            continue
        if isinstance(k, (T.StringType, T.CharType, T.VarcharType)):
            kind = ("C", 254, 0)
        elif isinstance(k, T.BooleanType):
            kind = ("L", 1, 0)
        elif isinstance(k, (T.ByteType, T.ShortType, T.IntegerType)):
            kind = ("N", 11, 0)
        elif isinstance(k, T.LongType):
            kind = ("N", 18, 0)
        elif isinstance(k, (T.FloatType, T.DoubleType)):
            kind = ("F", 19, 6)
        elif isinstance(k, T.DecimalType):
            if k.precision <= 18:
                kind = ("N", k.precision + 1, k.scale)
            else:
                lose("decimal-precision-on-dbf", f.name)
                kind = ("N", 18, min(k.scale, 17))
        elif isinstance(k, T.DateType):
            kind = ("D", 8, 0)
        elif isinstance(k, STAMPS):
            keep = isinstance(k, T.TimestampNTZType) or lose("timestamp-tz-on-dbf", f.name)
            if not keep or not lose("timestamp-truncate-on-dbf", f.name):
                continue
            kind = ("D", 8, 0)
        else:
            if policy == OnLoss.ERROR:
                raise UnsupportedType(k.simpleString(), "dbf", f.name)
            lose("unsupported-type-on-dbf", f.name)
            continue
        name = _cut(f.name)
        if name != f.name:
            lose("dbf-name-truncation", f.name)
        plain, i = name, 0
        while name.upper() in used:
            i += 1
            if i > 9999:
                raise SchemaError(f"no free DBF name for {f.name}")
            name = _cut(plain, 10 - len(str(i))) + str(i)
        used.add(name.upper())
        out.append(DbfField(f.name, name, *kind))
    return out, losses


def check_table_strategy(overwrite: bool, create: CreateTable) -> None:
    if overwrite and create == CreateTable.NEVER:
        raise SchemaError("overwrite excludes create-table=never")
