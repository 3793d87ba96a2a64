"""GeoJSON: one FeatureCollection, or a feature a line. Both are read in parallel; lines are written in parallel too."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import st_as_geojson, st_from_geojson
from ..model import Capabilities, Crs, CrsError, FormatError, GeometryError, GeometryMeta, ReadOptions, Uri, WriteOptions, as_geometry, quoted, require_geometry
from ..operators import crs_texts, loss, reproject
from . import collection, files

NAME, SCHEMES = "geojson", ("geojson", "geojsonl", "ndjson", "jsonl")
CAPABILITIES = Capabilities()
SAMPLE = 1024
HEAD = 1 << 20


def by_line(uri: Uri) -> bool:
    return uri.scheme != "geojson"


def features(spark: SparkSession, uri: Uri) -> DataFrame:
    """A column `feature` of JSON texts."""
    if by_line(uri):
        line = F.trim(F.regexp_replace("value", "^﻿", ""))
        return spark.read.text(uri.path).select(line.alias("feature")).where("feature != '' AND NOT feature LIKE '#%'")
    return collection.read(spark, uri.path)[0]


def layer_crs(uri: Uri, options: ReadOptions, head: str = "") -> Crs | None:
    """src_crs, else the `crs` member in the head of a collection, else EPSG:4326."""
    if options.src_crs:
        return options.src_crs
    if by_line(uri):
        return Crs.epsg(4326)
    import re

    head = head[:HEAD]
    m = re.search(r'"crs"\s*:\s*(null|\{)', head.split('"features"')[0])
    if not m:
        return Crs.epsg(4326)
    if m[1] == "null":
        return None
    try:
        member, _ = json.JSONDecoder().raw_decode(head[m.end() - 1 :])
        name = member["properties"]["name"]
    except (ValueError, KeyError, TypeError):
        raise CrsError("bad crs member") from None
    crs = crs_texts.from_name(name)
    if crs is None:
        raise CrsError(f"unknown CRS name {name!r}")
    return crs


def _kind(value) -> str | None:
    """The column type of a JSON value; null says nothing."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return "bigint"
    return "double" if isinstance(value, (int, float)) else "string"


class Inferred:
    """Names in order of first appearance with their types, and the types of the geometries."""

    def __init__(self):
        self.kinds: dict[str, str | None] = {}
        self.shapes: set[str] = set()

    def add(self, key: str, kind: str | None) -> None:
        old = self.kinds.get(key)
        if old is None or kind is None:
            self.kinds[key] = kind if old is None else old
        elif old != kind:
            self.kinds[key] = "double" if {old, kind} == {"bigint", "double"} else "string"

    def see(self, line: str) -> None:
        try:
            feature = json.loads(line)
        except ValueError as e:
            raise FormatError(f"not JSON: {e}: {line[:60]!r}") from None
        geometry = feature.get("geometry")
        if geometry:
            if geometry.get("type") == "GeometryCollection":
                raise GeometryError("GeometryCollection is not supported")
            self.shapes.add(geometry.get("type"))
        for key, value in (feature.get("properties") or {}).items():
            self.add(key, _kind(value))

    def result(self) -> tuple[list[tuple[str, str]], str]:
        return [(k, v or "string") for k, v in self.kinds.items()], next(iter(self.shapes)) if len(self.shapes) == 1 else "Geometry"


def infer(samples: list[str]) -> tuple[list[tuple[str, str]], str]:
    seen = Inferred()
    for line in samples:
        seen.see(line)
    return seen.result()


def infer_all(rows: DataFrame) -> tuple[list[tuple[str, str]], str]:
    """infer() over all features: a row a partition comes to the driver, with the names that occur in it."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seen = Inferred()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                seen.see(line)
        found = json.dumps([list(seen.kinds.items()), sorted(map(str, seen.shapes))])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([found])], ["part", "found"])

    whole = Inferred()
    for row in sorted(rows.mapInArrow(run, "part int, found string").collect()):
        kinds, shapes = json.loads(row["found"])
        whole.shapes.update(shapes)
        for key, kind in kinds:
            whole.add(key, kind)
    return whole.result()


def _path(key: str) -> str:
    return "$.properties['" + key.replace("'", "\\'") + "']"


def read(spark: SparkSession, uri: Uri, options: ReadOptions) -> DataFrame:
    """Columns as the first SAMPLE features have them: what comes later under another name is left out, and what does not
    fit its column is null. extra={"sample": "all"} takes the columns from all features, by one more pass over them."""
    rows, head = (features(spark, uri), "") if by_line(uri) else collection.read(spark, uri.path)
    sample = options.extra.get("sample", SAMPLE)
    columns, shape = infer_all(rows) if sample == "all" else infer([r["feature"] for r in rows.limit(int(sample)).collect()])
    meta = GeometryMeta(shape, layer_crs(uri, options, head))
    fits = {"boolean": "^(true|false)$", "bigint": "^-?[0-9]+$", "double": "^-?[0-9.]"}

    def value(key: str, kind: str):
        c = F.get_json_object("feature", _path(key))
        return c.alias(key) if kind == "string" else F.when(c.rlike(fits[kind]), c.try_cast(kind)).alias(key)

    geometry = st_from_geojson(F.get_json_object("feature", "$.geometry"))
    return rows.select(*[value(k, t) for k, t in columns], as_geometry(geometry, "geometry", meta))


def feature_texts(df: DataFrame, options: WriteOptions) -> DataFrame:
    """A column `value` with one feature's text a row, in the order of the schema; EPSG:4326 where the CRS is known."""
    name, meta = require_geometry(df.schema)
    if meta.crs is not None and meta.crs.epsg_code() != 4326:
        if meta.crs.epsg_code() is not None or meta.crs.wkt or meta.crs.projjson:
            df = reproject.reproject(df, Crs.epsg(4326))
    df = loss.apply_plan(df, loss.plan_losses(df.schema, NAME, options.on_loss))
    values = []
    for f in df.schema.fields:
        if f.name == name:
            continue
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = loss.finite(c, f.name, options.on_loss)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        values.append(c.alias(f.name))
    keep = {"ignoreNullFields": "false"}
    properties = F.to_json(F.struct(*values), keep) if values else F.lit("{}")
    shape = F.coalesce(st_as_geojson(quoted(name)), F.lit("null"))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write(df: DataFrame, uri: Uri, options: WriteOptions) -> None:
    files.refuse_existing(uri.path, options.overwrite)
    rows, lines = feature_texts(df, options), by_line(uri)
    if options.partitioned:
        if not lines:
            raise FormatError("a FeatureCollection is one file")
        rows.write.text(uri.path)
        return

    def put(batches, path):
        n = 0
        with open(path, "w", encoding="utf-8", newline="") as out:
            if not lines:
                out.write('{"type":"FeatureCollection","features":[')
            for batch in batches:
                values = batch.column(0).to_pylist()
                if values:
                    joint = "\n" if lines else ","
                    out.write(("" if lines or not n else joint) + joint.join(values) + ("\n" if lines else ""))
                n += len(values)
            if not lines:
                out.write("]}")
        return n

    files.write_single(rows, uri.path, put)
