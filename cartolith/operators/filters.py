"""where, select and query on any layer; Catalyst pushes them into the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..model import ReadOptions, SchemaError, geometry_field, quoted


def where(df: DataFrame, condition: str | None) -> DataFrame:
    return df.where(condition) if condition and condition.strip() else df


def select(df: DataFrame, columns) -> DataFrame:
    """The columns in the order of the list; the geometry must be among them."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise SchemaError(f"unknown columns {unknown}; there are {df.columns}")
    geometry = geometry_field(df.schema)
    if geometry is not None and geometry.name not in columns:
        raise SchemaError(f"the geometry column {geometry.name!r} must be selected")
    return df.select(*[quoted(c) for c in columns])


def validate_query(sql: str) -> str:
    if not sql.strip():
        raise SchemaError("the query is empty")
    if ";" in sql:
        raise SchemaError("the query must not hold `;`")
    return sql


def query(df: DataFrame, sql: str, name: str = "layer") -> DataFrame:
    """A sub-select over the layer, which it calls by `name`; the result must have a geometry column."""
    validate_query(sql)
    view = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    spark = df.sparkSession
    out = spark.sql(f"WITH `{name}` AS (SELECT * FROM {view}) SELECT * FROM ({sql}) x")
    if geometry_field(df.schema) is not None and geometry_field(out.schema) is None:
        raise SchemaError("the query's result has no geometry column")
    return out


def apply(df: DataFrame, options: ReadOptions, name: str = "layer") -> DataFrame:
    if options.query is not None:
        if options.where or options.select:
            raise SchemaError("query excludes where and select")
        return query(df, options.query, name)
    df = where(df, options.where)
    return select(df, options.select) if options.select else df
