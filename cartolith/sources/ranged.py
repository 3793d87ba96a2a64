"""A Spark data source for files that can be read in ranges of records.

A format gives a function of (options, low, high) that yields Arrow batches; the ranges become partitions, so that
one file is read by many tasks.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 65_536


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class RangedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [Range(a, b) for a, b in json.loads(self.options["ranges"])]

    def read(self, partition):
        module = importlib.import_module(f"cartolith.sources.{self.options['module']}")
        yield from module.batches(json.loads(self.options["layer"]), partition.low, partition.high)


class RangedSource(DataSource):
    @classmethod
    def name(cls):
        return "cartolith-ranged"

    def schema(self):
        return self.options["ddl"]

    def reader(self, schema):
        return RangedReader(dict(self.options))


def ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """[low, high) in at most so many ranges of at least ROWS // 8 records."""
    n = max(0, high - low)
    step = max(ROWS // 8, -(-n // max(1, parts)), 1)
    return [(a, min(a + step, high)) for a in range(low, high, step)] or [(low, high)]


def load(spark: SparkSession, module: str, layer: dict, schema, spans: list[tuple[int, int]]) -> DataFrame:
    spark.dataSource.register(RangedSource)
    options = {"module": module, "layer": json.dumps(layer), "ddl": schema.simpleString(), "ranges": json.dumps(spans)}
    return spark.read.format("cartolith-ranged").schema(schema).options(**options).load()
