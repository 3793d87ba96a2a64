"""CSV and TSV with a WKT column. Every attribute is text; an empty text cell is "", an empty geometry null."""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import wkt_type
from ..functions.columns import st_as_text, st_from_text
from ..model import Capabilities, FormatError, GeometryMeta, ReadOptions, SchemaError, Uri, WriteOptions, as_geometry, quoted, require_geometry
from ..operators import loss, text
from . import files

NAME, SCHEMES = "csv", ("csv", "tsv")
CAPABILITIES = Capabilities(string_encoding=("utf-8", "cp932", "latin-1"))
CANDIDATES = ("geometry", "geom", "wkt", "the_geom")
JAVA = {"utf-8": "UTF-8", "cp932": "windows-31j", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}


def delimiter(uri: Uri, options: dict) -> str:
    got = options.get("delimiter") or ("\t" if uri.scheme == "tsv" else ",")
    if len(got.encode()) != 1:
        raise FormatError("the delimiter must be one byte")
    return got


def geometry_column(names: list[str], wanted: str | None) -> str:
    if wanted:
        if wanted not in names:
            raise SchemaError(f"no column {wanted!r}")
        return wanted
    for candidate in CANDIDATES:
        for name in names:
            if name.lower() == candidate:
                return name
    raise SchemaError(f"no geometry column among {names}")


def read(spark: SparkSession, uri: Uri, options: ReadOptions) -> DataFrame:
    codec = text.encoding(options.encoding)
    df = spark.read.csv(uri.path, header=True, inferSchema=False, sep=delimiter(uri, options.extra), quote='"', escape='"', multiLine=True, encoding=JAVA[codec], mode="FAILFAST", emptyValue="", nullValue="\u0000")
    # Spark leaves a byte order mark in the first name of some encodings
    df = df.toDF(*[c.lstrip("﻿").strip('"') if i == 0 else c for i, c in enumerate(df.columns)])
    geometry = geometry_column(df.columns, options.extra.get("geometry"))
    cell = quoted(geometry)
    first = df.where(F.length(F.trim(cell)) > 0).select(cell.alias("g")).head()
    meta = GeometryMeta(wkt_type(first["g"]) if first else "Geometry", options.src_crs)
    wkb = st_from_text(F.when(F.length(F.trim(cell)) > 0, cell))
    return df.select(*[as_geometry(wkb, c, meta) if c == geometry else F.coalesce(quoted(c), F.lit("")).alias(c) for c in df.columns])


def text_rows(df: DataFrame, options: WriteOptions) -> DataFrame:
    """All cells as text, after the loss plan."""
    geometry, _ = require_geometry(df.schema)
    df = loss.apply_plan(df, loss.plan_losses(df.schema, NAME, options.on_loss))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(st_as_text(quoted(c)) if c == geometry else text.as_text(quoted(c), kinds[c])).alias(c) for c in df.columns])


def write(df: DataFrame, uri: Uri, options: WriteOptions) -> None:
    files.refuse_existing(uri.path, options.overwrite)
    rows, sep = text_rows(df, options), delimiter(uri, options.extra)
    if options.partitioned:
        rows.write.csv(uri.path, header=True, sep=sep, quote='"', escape='"', emptyValue="", nullValue="")
        return
    codec, names = text.encoding(options.encoding), rows.columns
    mark = "﻿" if codec == "utf-8" and options.extra.get("bom", "auto") != "never" else ""

    def put(batches, path):
        n = 0
        with open(path, "wb") as out:
            def lines(values, begin=""):
                buffer = io.StringIO(newline="")
                _csv.writer(buffer, delimiter=sep, lineterminator="\n").writerows(values)
                out.write((begin + buffer.getvalue()).encode(codec, "replace"))

            lines([names], mark)
            for batch in batches:
                lines(["" if v is None else v for v in row] for row in zip(*[c.to_pylist() for c in batch.columns]))
                n += batch.num_rows
        return n

    files.write_single(rows, uri.path, put)
