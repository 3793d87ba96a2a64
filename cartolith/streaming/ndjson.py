"""GeoJSON lines and CSV directories as unbounded streams: an extension on Structured Streaming.

The schema is stated (a stream cannot be inferred from what is yet to come); files that arrive become rows of the
same layer that the bounded readers give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import st_from_geojson
from ..model import Crs, GeometryMeta, as_geometry
from ..sources.geojson import _path


def read_ndjson_stream(spark: SparkSession, folder: str, columns: list[tuple[str, str]], crs: Crs | None = Crs.epsg(4326), max_files: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).where("trim(value) != '' AND NOT value LIKE '#%'")
    values = [F.get_json_object("value", _path(k)).try_cast(t).alias(k) for k, t in columns]
    geometry = as_geometry(st_from_geojson(F.get_json_object("value", "$.geometry")), "geometry", GeometryMeta("Geometry", crs))
    return lines.select(*values, geometry)
