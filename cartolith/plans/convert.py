"""The verbs: read_layer, write_layer, convert, info, schema, drivers."""

from __future__ import annotations

import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import register_all
from ..model import GEOMETRY_KEY, Crs, DriverError, GeometryMeta, ReadOptions, Uri, WriteOptions, geometry_field, parse_uri
from ..operators import filters, reproject
from ..sources import registry


def _own_filters(driver, options: ReadOptions) -> bool:
    return driver.NAME in ("postgis", "sqlserver")


def read_layer(spark: SparkSession, source: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """A layer as a DataFrame; where, select and query work for every format and are pushed into its scan."""
    uri = parse_uri(source)
    driver = registry.select_driver(uri)
    if _own_filters(driver, options):
        return driver.read(spark, uri, options)
    if options.query is not None and driver.NAME == "spatialite" and options.extra.get("native_query"):
        return driver.read_query(spark, uri, options.query)
    df = driver.read(spark, uri, options)
    if options.query is not None:
        register_all(spark)
    return filters.apply(df, options, options.extra.get("layer", "layer"))


def use_bulk(driver, mode: str) -> bool:
    if mode == "bulk" and not driver.CAPABILITIES.bulk_load:
        raise DriverError(driver.NAME, "bulk load is not supported")
    return mode == "bulk" or mode == "auto" and driver.CAPABILITIES.bulk_load


def write_layer(df: DataFrame, target: str, options: WriteOptions = WriteOptions()) -> None:
    uri = parse_uri(target)
    driver = registry.select_driver(uri)
    use_bulk(driver, options.insert_mode)
    driver.write(df, uri, options)


def convert(spark: SparkSession, source: str, target: str, read: ReadOptions = ReadOptions(), write: WriteOptions = WriteOptions(), to: str | Crs | None = None) -> None:
    registry.select_driver(parse_uri(target))
    df = read_layer(spark, source, read)
    if to is not None:
        df = reproject.reproject(df, reproject.parse_target(to) if isinstance(to, str) else to, read.src_crs)
    write_layer(df, target, write)


def row_count_hint(spark: SparkSession, uri: Uri) -> int | None:
    """Rows as the format's own counters have them; never a scan."""
    driver = registry.select_driver(uri)
    if driver.NAME == "shp":
        return (os.path.getsize(os.path.splitext(uri.path)[0] + ".shx") - 100) // 8
    if driver.NAME == "fgb":
        return driver.header(uri.path)[0]["count"] or None
    if driver.NAME == "parquet":
        return spark.read.parquet(uri.path).count()  # from the footers
    if driver.NAME in ("gpkg", "spatialite"):
        from ..sources.sqlite import _connect, quote

        with _connect(uri.path) as db:
            layers = driver.layers(db)
            return db.execute(f"SELECT count(*) FROM {quote(driver.pick(layers, None))}").fetchone()[0]
    return None


def info(spark: SparkSession, source: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """key, value: driver, rows, crs, geometry column, and each field with its type."""
    uri = parse_uri(source)
    return info_frame(read_layer(spark, source, options), registry.select_driver(uri).NAME, row_count_hint(spark, uri))


def info_frame(df: DataFrame, driver: str, rows: int | None) -> DataFrame:
    field = geometry_field(df.schema)
    crs = GeometryMeta.from_json(field.metadata[GEOMETRY_KEY]).crs if field else None
    out = [("driver", driver), ("rows", "unknown" if rows is None else str(rows)), ("crs", crs.describe() if crs else "none"), ("geometry", field.name if field else "none")]
    out += [(f"field {i}", f"{f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' not null'}") for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(out, "key string, value string")


def schema_frame(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, json.dumps(f.metadata, sort_keys=True) if f.metadata else None) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, data_type string, nullable boolean, metadata string")


def schema_json(df: DataFrame, driver: str, pretty: bool = False) -> str:
    """Geometry metadata is embedded as parsed JSON."""
    shown = lambda m: {k: json.loads(v) if k == GEOMETRY_KEY else v for k, v in (m or {}).items()}
    fields = [{"name": f.name, "data_type": f.dataType.simpleString(), "nullable": f.nullable, "metadata": shown(f.metadata)} for f in df.schema.fields]
    return json.dumps({"driver": driver, "fields": fields, "metadata": {}}, indent=2 if pretty else None)


def drivers_frame(spark: SparkSession) -> DataFrame:
    rows = [(d.NAME, ",".join(d.SCHEMES), json.dumps(d.CAPABILITIES.to_dict(), sort_keys=True)) for d in registry.drivers()]
    return spark.createDataFrame(rows, "name string, schemes string, capabilities string")


def options_from(cls, **given):
    """ReadOptions or WriteOptions from keyword texts, unknown ones in extra."""
    known = {f.name for f in dataclasses.fields(cls)} - {"extra"}
    return cls(**{k: v for k, v in given.items() if k in known}, extra={k: v for k, v in given.items() if k not in known})
