"""GeoParquet 1.0.0. Reading is Spark's own scan, with pruning and pushdown; only the footer's `geo` key is extra."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

from ..model import Capabilities, GeometryMeta, ReadOptions, SchemaError, Uri, WriteOptions, as_geometry, geometry_field, quoted, replace_crs, require_geometry
from ..operators import crs_texts
from . import files

NAME, SCHEMES = "parquet", ("parquet",)
CAPABILITIES = Capabilities(supports_blob=True, supports_decimal=True, max_decimal_precision=38)


def geo_text(name: str, meta: GeometryMeta) -> str:
    column = {"encoding": "WKB", "geometry_types": [] if meta.geometry_type == "Geometry" else [meta.geometry_type], "crs": crs_texts.projjson_of(meta.crs)}
    if meta.edges:
        column["edges"] = meta.edges
    return json.dumps({"version": "1.0.0", "primary_column": name, "columns": {name: column}})


def geo_of(text: str, names: list[str]) -> tuple[str, GeometryMeta]:
    geo = json.loads(text)
    name = geo.get("primary_column")
    if name not in names or name not in geo.get("columns", {}):
        raise SchemaError(f"the primary column {name!r} is missing")
    column = geo["columns"][name]
    if column.get("encoding", "WKB") != "WKB":
        raise SchemaError(f"encoding {column['encoding']!r} is not supported")
    kinds = [re.sub(r" (Z|M|ZM)$", "", t) for t in column.get("geometry_types", [])]
    return name, GeometryMeta(kinds[0] if len(kinds) == 1 else "Geometry", crs_texts.from_projjson(column.get("crs")), column.get("edges"))


def footer_geo(spark: SparkSession, path: str) -> str | None:
    """The `geo` key of the first file, read through Spark's file system, so that any store works."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs, conf = p.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jsc.hadoopConfiguration()
    if fs.getFileStatus(p).isDirectory():
        p = next((s.getPath() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")), None)
        if p is None:
            return None
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()


def row_groups(spark: SparkSession, files: list[str], enough: int) -> tuple[int, int]:
    """Row groups and rows by the footers, no further than up to so many groups."""
    jvm, conf, groups, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0, 0
    for file in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf))
        try:
            groups, rows = groups + reader.getFooter().getBlocks().size(), rows + reader.getRecordCount()
        finally:
            reader.close()
        if groups >= enough:
            break
    return groups, rows


def read(spark: SparkSession, uri: Uri, options: ReadOptions) -> DataFrame:
    df = spark.read.parquet(uri.path)
    if geometry_field(df.schema) is None:
        text = footer_geo(spark, uri.path)
        if text:
            name, meta = geo_of(text, df.columns)
            df = df.select(*[as_geometry(quoted(c), c, meta) if c == name else quoted(c) for c in df.columns])
    return replace_crs(df, options.src_crs) if options.src_crs and geometry_field(df.schema) is not None else df


def write(df: DataFrame, uri: Uri, options: WriteOptions) -> None:
    name, meta = require_geometry(df.schema)
    files.refuse_existing(uri.path, options.overwrite)
    geo, size = geo_text(name, meta), options.batch_size or 1 << 17

    def put(batches, path):
        import pyarrow.parquet as pq

        writer, n = None, 0
        for batch in batches:
            if writer is None:
                schema = batch.schema.with_metadata({**(batch.schema.metadata or {}), b"geo": geo.encode()})
                writer = pq.ParquetWriter(path, schema)
            writer.write_batch(batch.replace_schema_metadata(schema.metadata), row_group_size=size)
            n += batch.num_rows
        if writer:
            writer.close()
        return n

    if not options.partitioned:
        from pyspark.sql.pandas.types import to_arrow_schema

        empty = to_arrow_schema(df.schema)

        def put_one(batches, path):
            import pyarrow as pa

            first = next(iter(batches), None)
            rest = [first] if first is not None else [pa.RecordBatch.from_pylist([], schema=empty)]

            def chained():
                yield from rest
                yield from batches

            return put(chained(), path)

        files.write_single(df, uri.path, put_one)
        return
    os.makedirs(uri.path, exist_ok=True)
    folder = uri.path

    def each_partition(batches):
        import uuid

        import pyarrow as pa

        part = f"{folder}/part-{uuid.uuid4().hex}.parquet"
        rows = put(batches, part + ".tmp")
        yield pa.RecordBatch.from_arrays([pa.array([part if rows else ""]), pa.array([rows], pa.int64())], ["file", "rows"])

    for row in df.mapInArrow(each_partition, "file string, rows long").collect():  # all tasks at once; toLocalIterator() runs one after another
        if row["file"]:  # only parts of tasks that succeeded get their names
            os.replace(row["file"] + ".tmp", row["file"])
