"""Queries over layers derived from the test tables, and SQL for them.

The tables carry no geometry: a key k makes the point (k mod 360 - 180, k mod 170 - 85) and the square of side 1
with that corner.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..functions import columns as C
from ..operators import filters, loss, reproject, text
from ..sources import files, geoparquet, rdb
from . import convert as P

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _table(spark, sf_dir, name):
    env = spark.sparkContext.environment  # Python workers find the package where the driver did
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DEALT = 1 << 16


def _dealt(spark, sf_dir, name):
    """A table whose geometries many tasks make: a row group is read by one task, so that a file of few groups is dealt out."""
    df, cores = _table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    groups, rows = geoparquet.row_groups(spark, df.inputFiles(), cores)
    return df.repartition(cores) if groups * 2 <= cores and rows >= DEALT else df


def points(spark, sf_dir, table="customer", key="c_custkey", crs=4326):
    df = _dealt(spark, sf_dir, table)
    k = F.col(key)
    return M.with_geometry(df, "geometry", C.st_point((k % 360 - 180).cast("double"), (k % 170 - 85).cast("double")), M.GeometryMeta("Point", M.Crs.epsg(crs)))


def squares(spark, sf_dir):
    df = _dealt(spark, sf_dir, "customer")
    x, y = F.col("c_custkey") % 360 - 180, F.col("c_custkey") % 170 - 85
    wkt = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d,%d %d))", x, y, x + 1, y, x + 1, y + 1, x, y + 1, x, y)
    return M.with_geometry(df, "geometry", C.st_from_text(wkt), M.GeometryMeta("Polygon", M.Crs.epsg(4326)))


X, Y = "(c_custkey % 360 - 180)", "(c_custkey % 170 - 85)"
POINT = f"'POINT(' || {X} || ' ' || {Y} || ')'"
SQUARE = f"'POLYGON((' || {X} || ' ' || {Y} || ',' || ({X}+1) || ' ' || {Y} || ',' || ({X}+1) || ' ' || ({Y}+1) || ',' || {X} || ' ' || ({Y}+1) || ',' || {X} || ' ' || {Y} || '))'"
MX, MY = "round(6378137 * radians(c_custkey % 360 - 180), 2)", "round(6378137 * ln(tan(pi() / 4 + radians(c_custkey % 170 - 85) / 2)), 2)"


def _wkt(df, *names):
    return df.select(*names, C.st_as_text("geometry").alias("wkt"))


def layer_where(spark, d):
    return _wkt(filters.apply(points(spark, d), M.ReadOptions(where="c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")), "c_custkey", "c_name")


def layer_select(spark, d):
    return _wkt(filters.apply(points(spark, d), M.ReadOptions(select=("geometry", "c_name", "c_nationkey"))), "c_name", "c_nationkey")


def layer_query(spark, d):
    return _wkt(filters.apply(points(spark, d), M.ReadOptions(query="SELECT c_custkey + 1 AS next_key, geometry FROM layer WHERE c_nationkey IN (1, 2, 3)")), "next_key")


def wkt_encode(spark, d):
    return _wkt(points(spark, d), "c_custkey")


def _xy(df, *names):
    return df.select(*names, C.st_xy("geometry").alias("p")).select(*names, F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def wkt_decode_xy(spark, d):
    df = points(spark, d)
    return _xy(df.withColumn("geometry", C.st_from_text(C.st_as_text("geometry"))), "c_custkey")


def wkt_polygon_roundtrip(spark, d):
    return _wkt(squares(spark, d), "c_custkey")


def wkb_roundtrip(spark, d):
    df = squares(spark, d)
    return df.withColumn("geometry", C.st_normalise("geometry")).select("c_custkey", F.length("geometry").alias("n_bytes"), C.st_as_text("geometry").alias("wkt"))


def ewkb_srid(spark, d):
    df = points(spark, d).withColumn("e", C.st_as_ewkb(F.col("geometry"), 4326))
    return _xy(df.select("c_custkey", C.st_from_ewkb("e").alias("geometry"), C.st_ewkb_srid("e").alias("srid")), "c_custkey", "srid")


def gpkg_blob_roundtrip(spark, d):
    df = points(spark, d).withColumn("b", C.st_as_gpkg(F.col("geometry"), 3857))
    return _xy(df.select("c_custkey", C.st_from_gpkg("b").alias("geometry"), C.st_gpkg_srid("b").alias("srid")), "c_custkey", "srid")


def spatialite_blob_mbr(spark, d):
    df = squares(spark, d).withColumn("b", C.st_as_spatialite("geometry", F.lit(4326)))
    df = df.select("c_custkey", C.st_spatialite_srid("b").alias("srid"), C.st_bbox(C.st_from_spatialite("b")).alias("m"))
    return df.select("c_custkey", "srid", *[F.col(f"m.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def geometry_type(spark, d):
    one = points(spark, d).select("c_custkey", "geometry").unionByName(squares(spark, d).select("c_custkey", "geometry"))
    return one.groupBy(C.st_geometry_type(F.col("geometry")).alias("geometry_type")).agg(F.count(F.lit(1)).alias("n"))


def layer_bbox(spark, d):
    return C.layer_bbox(points(spark, d, "orders", "o_orderkey"), "geometry")


def geometry_bbox(spark, d):
    return squares(spark, d).select("c_custkey", C.st_bbox("geometry").alias("m")).select("c_custkey", *[F.col(f"m.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def _rounded(df, key):
    return _xy(df, key).select(key, F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def reproject_4326_3857(spark, d):
    return _rounded(reproject.reproject(points(spark, d), M.Crs.epsg(3857)), "c_custkey")


def reproject_roundtrip(spark, d):
    there = reproject.reproject(points(spark, d), M.Crs.epsg(3857))
    df = _xy(reproject.reproject(there, M.Crs.epsg(4326)), "c_custkey")
    return df.select("c_custkey", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def reproject_lineitem(spark, d):
    """The bench query: every line's point in Web Mercator, as the extent for each return flag."""
    df = reproject.reproject(points(spark, d, "lineitem", "l_orderkey").select("l_returnflag", "geometry"), M.Crs.epsg(3857))
    p = df.select("l_returnflag", C.st_xy("geometry").alias("p"))
    return p.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("p.x"), 2).alias("min_x"), F.round(F.max("p.y"), 2).alias("max_y"))


def _round_trip(extension, **read):
    def run(spark, d):
        path = files.scratch(spark, f"layer.{extension}")
        P.write_layer(points(spark, d), path)
        df = P.read_layer(spark, path, M.ReadOptions(**read))
        return df.select(*[c for c in df.columns if c != "geometry"], C.st_as_text("geometry").alias("wkt"))

    return run


def csv_roundtrip(spark, d):
    return _round_trip("csv")(spark, d).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


def partitioned_ndjson(spark, d):
    """Lines written by all tasks, read in parallel."""
    path = files.scratch(spark, "orders.ndjson")
    P.write_layer(points(spark, d, "orders", "o_orderkey").drop("o_orderdate"), path, M.WriteOptions(partitioned=True))
    df = P.read_layer(spark, path, M.ReadOptions(extra={"sample": "all"}))
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def partitioned_geoparquet(spark, d):
    path = files.scratch(spark, "lines.parquet")
    P.write_layer(points(spark, d, "lineitem", "l_orderkey"), path, M.WriteOptions(partitioned=True))
    df = P.read_layer(spark, path, M.ReadOptions(where="l_quantity > 25"))
    return df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count("geometry").alias("n_geometries"))


def geojson_feature_text(spark, d):
    from ..sources.geojson import feature_texts

    return feature_texts(points(spark, d).select("c_custkey", "c_mktsegment", "geometry"), M.WriteOptions()).withColumnRenamed("value", "feature")


def loss_decimal_to_text(spark, d):
    df = points(spark, d).select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("amount"), "geometry")
    df = loss.apply_plan(df, loss.plan_losses(df.schema, "geojson", M.OnLoss.WARN))
    return df.select("c_custkey", "amount")


def loss_nonfinite_null(spark, d):
    df = points(spark, d).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, float("nan")).when(F.col("c_custkey") % 5 == 0, float("inf")).otherwise(F.col("c_acctbal")).alias("v"))
    return df.select("c_custkey", loss.finite(F.col("v"), "v", M.OnLoss.WARN).alias("v"))


def loss_drop_columns(spark, d):
    df = _table(spark, d, "embeddings")
    df = M.with_geometry(df, "geometry", C.st_point((F.col("vec_id") % 360 - 180).cast("double"), (F.col("vec_id") % 170 - 85).cast("double")), M.GeometryMeta("Point", M.Crs.epsg(4326)))
    df = loss.apply_plan(df, loss.plan_losses(df.schema, "csv", M.OnLoss.SKIP))
    return df.select(*[c for c in df.columns if c != "geometry"], C.st_as_text("geometry").alias("wkt"))


def dbf_name_plan(spark, d):
    fields, _ = loss.plan_dbf(points(spark, d).schema, M.OnLoss.WARN)
    return spark.createDataFrame([(f.source, f.name, f.kind, f.length, f.decimals) for f in fields], "source string, name string, kind string, length int, decimals int")


def fmt_timestamp(spark, d):
    return _table(spark, d, "events").select("event_id", text.timestamp_text(F.col("ts"), T.TimestampNTZType()).alias("t"))


def fmt_date(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", text.date_text(F.col("o_orderdate").cast("date")).alias("t"))


def fmt_decimal(spark, d):
    return _table(spark, d, "part").select("p_partkey", text.decimal_text(F.col("p_retailprice").cast("decimal(12,3)")).alias("t"))


def info_layer(spark, d):
    path = files.scratch(spark, "i.gpkg")
    P.write_layer(points(spark, d).select("c_custkey", "c_name", "geometry"), path)
    return P.info(spark, path)


def schema_layer(spark, d):
    return P.schema_frame(points(spark, d).select("c_custkey", "c_acctbal", "geometry")).select("ordinal", "name", "data_type")


def drivers_list(spark, d):
    return P.drivers_frame(spark).select("name", "schemes")


def sanitize_table_name(spark, d):
    return _table(spark, d, "customer").select("c_custkey", text.table_name_column(F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.col("c_name"))).alias("name"))


def sqlite_coercion(spark, d):
    from ..sources.sqlite import coerce

    f = F.pandas_udf(lambda s: s.map(lambda v: coerce(v, "bigint")), "bigint")
    return _table(spark, d, "part").select("p_partkey", f("p_retailprice").alias("whole"))


def copy_binary_rows(spark, d):
    """Each customer's row of the COPY payload (without header and trailer)."""
    df = points(spark, d).select("c_custkey", "c_name", "c_nationkey", "geometry")
    return rdb.encode_copy(df, 4326, chunk=1).select(F.lower(F.hex("chunk")).alias("row_hex"))


def reproject_utm(spark, d):
    """Points within six degrees of a meridian, in UTM zone 31 north, to the centimetre."""
    k = F.col("c_custkey")
    df = M.with_geometry(_table(spark, d, "customer"), "geometry", C.st_point((k % 13 - 3).cast("double"), (k % 85).cast("double")), M.GeometryMeta("Point", M.Crs.epsg(4326)))
    return _rounded(reproject.reproject(df, M.Crs.epsg(32631)), "c_custkey")


def convert_mesh(spark, d):
    """A layer through six formats one after another."""
    rows = points(spark, d).select("c_custkey", "c_name", "c_acctbal", "geometry")
    paths = [files.scratch(spark, f"mesh.{x}") for x in ("gpkg", "fgb", "parquet", "ndjson", "sqlite", "geojson")]
    P.write_layer(rows, paths[0])
    for a, b in zip(paths, paths[1:]):
        P.convert(spark, a, b)
    return _wkt(P.read_layer(spark, paths[-1]), "c_custkey", "c_name", "c_acctbal")


def convert_reprojected(spark, d):
    a, b = files.scratch(spark, "a.gpkg"), files.scratch(spark, "b.parquet")
    P.write_layer(points(spark, d).select("c_custkey", "geometry"), a)
    P.convert(spark, a, b, read=M.ReadOptions(where="c_custkey % 2 = 0"), to="EPSG:3857")
    return _rounded(P.read_layer(spark, b), "c_custkey")


def layer_where_select(spark, d):
    return _wkt(filters.apply(points(spark, d), M.ReadOptions(where="c_nationkey < 5", select=("c_custkey", "geometry"))), "c_custkey")


def geojson_inference(spark, d):
    """Types that properties of mixed JSON values get."""
    k = F.col("c_custkey").cast("string")
    whole = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"whole":'), k, F.lit(',"mixed":'), F.when(F.col("c_custkey") % 2 == 0, k).otherwise(F.concat(k, F.lit(".5"))), F.lit(',"flag":true,"text":'), F.when(F.col("c_custkey") % 2 == 0, k).otherwise(F.lit('"word"')), F.lit(',"nested":{"a":['), k, F.lit("]}}}"))
    path = files.scratch(spark, "mixed.ndjson")
    _table(spark, d, "customer").select(whole).write.text(path)
    return P.read_layer(spark, path, M.ReadOptions(extra={"sample": "all"})).select("whole", "mixed", "flag", "text", "nested")


def geojson_crs(spark, d):
    """The crs member of a collection, as the layer's CRS, and coordinates brought to EPSG:4326 from it."""
    path = files.scratch(spark, "crs.geojson")
    rows = points(spark, d, crs=3857).select("c_custkey", "geometry")
    from ..sources.geojson import feature_texts

    texts = [r["value"] for r in feature_texts(M.with_geometry(rows, "geometry", F.col("geometry"), M.GeometryMeta("Point", None)), M.WriteOptions()).orderBy("value").limit(100).collect()]
    with open(path, "w", encoding="utf-8") as f:  # a small document with a member that the writer does not write
        f.write('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}},"features":[' + ",".join(texts) + "]}")
    df = P.read_layer(spark, path)
    crs = M.GeometryMeta.from_json(M.geometry_field(df.schema).metadata[M.GEOMETRY_KEY]).crs
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("crs", F.lit(crs.describe()))


def uint64_on_geojson(spark, d):
    from ..sources.geojson import feature_texts

    big = F.when(F.col("c_custkey") % 2 == 0, F.lit("18446744073709551615")).otherwise(F.col("c_custkey").cast("string")).cast("decimal(20,0)")
    return feature_texts(points(spark, d).select(big.alias("u"), "geometry"), M.WriteOptions(on_loss=M.OnLoss.WARN)).withColumnRenamed("value", "feature")


def uint64_on_gpkg(spark, d):
    path = files.scratch(spark, "u.gpkg")
    big = F.when(F.col("c_custkey") % 2 == 0, F.lit("18446744073709551615")).otherwise(F.col("c_custkey").cast("string")).cast("decimal(20,0)")
    P.write_layer(points(spark, d).select("c_custkey", big.alias("u"), "geometry"), path, M.WriteOptions(on_loss=M.OnLoss.WARN))
    return P.read_layer(spark, path).select("c_custkey", "u")


def fmt_timestamp_zone(spark, d):
    """Timestamps with a zone, as text in UTC."""
    ts = F.to_utc_timestamp(F.from_utc_timestamp(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))), F.current_timezone()), F.current_timezone())
    return _table(spark, d, "events").select("event_id", text.timestamp_text(ts, T.TimestampType()).alias("t"))


def dbf_text_cut(spark, d):
    """Texts cut to a number of bytes of UTF-8, between characters."""
    f = F.pandas_udf(lambda s: s.map(lambda v: text.cut_bytes(v, 7)), "string")
    return _table(spark, d, "customer").select("c_custkey", f(F.concat(F.lit("aé漢"), F.col("c_custkey").cast("string"))).alias("cut"))


def missing_crs_on_gpkg(spark, d):
    """A layer without CRS is written with srs_id 0 where losses are warned of."""
    path = files.scratch(spark, "none.gpkg")
    df = M.with_geometry(points(spark, d).select("c_custkey", "geometry"), "geometry", F.col("geometry"), M.GeometryMeta("Point", None))
    P.write_layer(df, path, M.WriteOptions(on_loss=M.OnLoss.WARN))
    return P.info(spark, path).where("key IN ('rows', 'crs')")


def statement_sizes(spark, d):
    """Rows that one INSERT of a database takes, for so many attributes."""
    n = spark.range(1, 41).select(F.col("id").cast("int").alias("attributes")).collect()
    return spark.createDataFrame([(r[0], rdb.insert_rows("pg", r[0]), rdb.insert_rows("mssql", r[0])) for r in n], "attributes int, pg int, mssql int")


def _double_hex(x: str) -> str:
    """SQL for the little-endian bytes of an integer as a double, from the definition of the format."""
    e = f"floor(log2(abs({x}) + 0.0001))::BIGINT"
    bits = f"(CASE WHEN {x} < 0 THEN 2048 ELSE 0 END + 1023 + {e})"
    mantissa = f"((abs({x})::BIGINT << (52 - {e})) - (1::BIGINT << 52))"
    digits = f"CASE WHEN {x} = 0 THEN repeat('0', 16) ELSE lpad(lower(to_hex({bits})), 3, '0') || lpad(lower(to_hex({mantissa})), 13, '0') END"
    return "(" + " || ".join(f"substr({digits}, {i}, 2)" for i in range(15, 0, -2)) + ")"


COPY_ROWS = f"""SELECT '0004' || '00000008' || lpad(lower(to_hex(c_custkey)), 16, '0') || lpad(lower(to_hex(strlen(c_name))), 8, '0') || lower(hex(encode(c_name)))
  || '00000004' || lpad(lower(to_hex(c_nationkey)), 8, '0') || '00000019' || '0101000020e6100000' || {_double_hex(X)} || {_double_hex(Y)} AS row_hex FROM customer"""
_TERMS = "[n/2 - 2*n^2/3 + 5*n^3/16 + 41*n^4/180, 13*n^2/48 - 3*n^3/5 + 557*n^4/1440, 61*n^3/240 - 103*n^4/140, 49561*n^4/161280]"
UTM = f"""
WITH w AS (SELECT 1 / 298.257223563::DOUBLE AS f), e AS (SELECT f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM w), c AS (SELECT *, 6378137 / (1 + n) * (1 + n^2/4 + n^4/64) AS a, {_TERMS} AS s FROM e),
p AS (SELECT c_custkey, radians(c_custkey % 13 - 3 - 3) AS lon, sin(radians(c_custkey % 85)) AS z FROM customer),
t AS (SELECT *, sinh(atanh(z) - e * atanh(e * z)) AS t FROM p, c),
g AS (SELECT *, atan2(t, cos(lon)) AS xi, asinh(sin(lon) / sqrt(t^2 + cos(lon)^2)) AS eta FROM t)
SELECT c_custkey, round(500000 + 0.9996 * a * (eta + list_sum([s[j] * cos(2*j*xi) * sinh(2*j*eta) FOR j IN range(1, 5)])), 2) AS x,
       round(0.9996 * a * (xi + list_sum([s[j] * sin(2*j*xi) * cosh(2*j*eta) FOR j IN range(1, 5)])), 2) AS y FROM g"""
CUSTOMER = f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, {POINT} AS wkt FROM customer"
QUERIES = {
    "reproject_lineitem": (reproject_lineitem, "SELECT l_returnflag, count(*) AS n, round(min(6378137 * radians(l_orderkey % 360 - 180)), 2) AS min_x, round(max(6378137 * ln(tan(pi() / 4 + radians(l_orderkey % 170 - 85) / 2))), 2) AS max_y FROM lineitem GROUP BY 1"),
    "layer_where": (layer_where, f"SELECT c_custkey, c_name, {POINT} AS wkt FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'"),
    "layer_select": (layer_select, f"SELECT c_name, c_nationkey, {POINT} AS wkt FROM customer"),
    "layer_query": (layer_query, f"SELECT c_custkey + 1 AS next_key, {POINT} AS wkt FROM customer WHERE c_nationkey IN (1, 2, 3)"),
    "wkt_encode": (wkt_encode, f"SELECT c_custkey, {POINT} AS wkt FROM customer"),
    "wkt_decode_xy": (wkt_decode_xy, f"SELECT c_custkey, {X}::DOUBLE AS x, {Y}::DOUBLE AS y FROM customer"),
    "wkt_polygon_roundtrip": (wkt_polygon_roundtrip, f"SELECT c_custkey, {SQUARE} AS wkt FROM customer"),
    "wkb_roundtrip": (wkb_roundtrip, f"SELECT c_custkey, 93 AS n_bytes, {SQUARE} AS wkt FROM customer"),
    "ewkb_srid": (ewkb_srid, f"SELECT c_custkey, 4326 AS srid, {X}::DOUBLE AS x, {Y}::DOUBLE AS y FROM customer"),
    "gpkg_blob_roundtrip": (gpkg_blob_roundtrip, f"SELECT c_custkey, 3857 AS srid, {X}::DOUBLE AS x, {Y}::DOUBLE AS y FROM customer"),
    "spatialite_blob_mbr": (spatialite_blob_mbr, f"SELECT c_custkey, 4326 AS srid, {X}::DOUBLE AS minx, {Y}::DOUBLE AS miny, {X} + 1.0::DOUBLE AS maxx, {Y} + 1.0::DOUBLE AS maxy FROM customer"),
    "geometry_type": (geometry_type, "SELECT t AS geometry_type, (SELECT count(*) FROM customer) AS n FROM (VALUES ('Point'), ('Polygon')) v(t)"),
    "layer_bbox": (layer_bbox, "SELECT min(o_orderkey % 360 - 180)::DOUBLE AS minx, min(o_orderkey % 170 - 85)::DOUBLE AS miny, max(o_orderkey % 360 - 180)::DOUBLE AS maxx, max(o_orderkey % 170 - 85)::DOUBLE AS maxy FROM orders"),
    "geometry_bbox": (geometry_bbox, f"SELECT c_custkey, {X}::DOUBLE AS minx, {Y}::DOUBLE AS miny, {X} + 1.0::DOUBLE AS maxx, {Y} + 1.0::DOUBLE AS maxy FROM customer"),
    "reproject_4326_3857": (reproject_4326_3857, f"SELECT c_custkey, {MX} AS x, {MY} AS y FROM customer"),
    "reproject_roundtrip": (reproject_roundtrip, f"SELECT c_custkey, {X}::DOUBLE AS x, {Y}::DOUBLE AS y FROM customer"),
    "csv_roundtrip": (csv_roundtrip, f"SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal, c_mktsegment, {POINT} AS wkt FROM customer"),
    "ndjson_roundtrip": (_round_trip("ndjson", extra={"sample": "all"}), CUSTOMER.replace("c_nationkey,", "c_nationkey::BIGINT AS c_nationkey,")),
    "geojson_roundtrip": (_round_trip("geojson", extra={"sample": "all"}), CUSTOMER.replace("c_nationkey,", "c_nationkey::BIGINT AS c_nationkey,")),
    "geoparquet_roundtrip": (_round_trip("parquet"), CUSTOMER),
    "gpkg_roundtrip": (_round_trip("gpkg"), CUSTOMER),
    "spatialite_roundtrip": (_round_trip("sqlite"), CUSTOMER),
    "fgb_roundtrip": (_round_trip("fgb"), CUSTOMER),
    "partitioned_ndjson": (partitioned_ndjson, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "partitioned_geoparquet": (partitioned_geoparquet, "SELECT l_linestatus, count(*) AS n, count(*) AS n_geometries FROM lineitem WHERE l_quantity > 25 GROUP BY 1"),
    "geojson_feature_text": (geojson_feature_text, f"""SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {X} || '.0,' || {Y} || '.0]}},"properties":{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}}}' AS feature FROM customer"""),
    "loss_decimal_to_text": (loss_decimal_to_text, "SELECT c_custkey, c_acctbal::DECIMAL(12,2)::VARCHAR AS amount FROM customer"),
    "loss_nonfinite_null": (loss_nonfinite_null, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer"),
    "loss_drop_columns": (loss_drop_columns, "SELECT vec_id, label, 'POINT(' || (vec_id % 360 - 180) || ' ' || (vec_id % 170 - 85) || ')' AS wkt FROM embeddings"),
    "dbf_name_plan": (dbf_name_plan, "SELECT * FROM (VALUES ('c_custkey', 'c_custkey', 'N', 18, 0), ('c_name', 'c_name', 'C', 254, 0), ('c_nationkey', 'c_nationke', 'N', 11, 0), ('c_acctbal', 'c_acctbal', 'F', 19, 6), ('c_mktsegment', 'c_mktsegme', 'C', 254, 0)) v(source, name, kind, length, decimals)"),
    "fmt_timestamp": (fmt_timestamp, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t FROM events"),
    "fmt_date": (fmt_date, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders"),
    "fmt_decimal": (fmt_decimal, "SELECT p_partkey, p_retailprice::DECIMAL(12,3)::VARCHAR AS t FROM part"),
    "info_layer": (info_layer, "SELECT * FROM (VALUES ('driver', 'gpkg'), ('rows', (SELECT count(*) FROM customer)::VARCHAR), ('crs', 'EPSG:4326'), ('geometry', 'geometry'), ('field 0', 'c_custkey: bigint'), ('field 1', 'c_name: string'), ('field 2', 'geometry: binary')) v(key, value)"),
    "schema_layer": (schema_layer, "SELECT * FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_acctbal', 'double'), (2, 'geometry', 'binary')) v(ordinal, name, data_type)"),
    "drivers_list": (drivers_list, "SELECT * FROM (VALUES ('csv', 'csv,tsv'), ('fgb', 'fgb'), ('geojson', 'geojson,geojsonl,ndjson,jsonl'), ('gpkg', 'gpkg'), ('parquet', 'parquet'), ('postgis', 'pg'), ('shp', 'shp'), ('spatialite', 'sqlite,db,spatialite'), ('sqlserver', 'mssql')) v(name, schemes)"),
    "sanitize_table_name": (sanitize_table_name, "SELECT c_custkey, '_' || c_custkey || '_' || regexp_replace(c_name, '[^A-Za-z0-9_]', '_', 'g') AS name FROM customer"),
    "sqlite_coercion": (sqlite_coercion, "SELECT p_partkey, trunc(p_retailprice)::BIGINT AS whole FROM part"),
    "copy_binary_rows": (copy_binary_rows, COPY_ROWS),
    "reproject_utm": (reproject_utm, UTM),
    "convert_mesh": (convert_mesh, f"SELECT c_custkey, c_name, c_acctbal, {POINT} AS wkt FROM customer"),
    "convert_reprojected": (convert_reprojected, f"SELECT c_custkey, {MX} AS x, {MY} AS y FROM customer WHERE c_custkey % 2 = 0"),
    "layer_where_select": (layer_where_select, f"SELECT c_custkey, {POINT} AS wkt FROM customer WHERE c_nationkey < 5"),
    "geojson_inference": (geojson_inference, """SELECT c_custkey AS whole, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE ELSE c_custkey + 0.5::DOUBLE END AS mixed, true AS flag, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'word' END AS text, '{"a":[' || c_custkey || ']}' AS nested FROM customer"""),
    "geojson_crs": (geojson_crs, "SELECT 100::BIGINT AS n, 'EPSG:3857' AS crs"),
    "uint64_on_geojson": (uint64_on_geojson, f"""SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {X} || '.0,' || {Y} || '.0]}},"properties":{{"u":' || CASE WHEN c_custkey % 2 = 0 THEN '"18446744073709551615"' ELSE c_custkey::VARCHAR END || '}}}}' AS feature FROM customer"""),
    "uint64_on_gpkg": (uint64_on_gpkg, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 9223372036854775807 ELSE c_custkey END::BIGINT AS u FROM customer"),
    "fmt_timestamp_zone": (fmt_timestamp_zone, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS t FROM events"),
    "dbf_text_cut": (dbf_text_cut, "SELECT c_custkey, left('aé漢' || c_custkey, 4) AS cut FROM customer"),
    "missing_crs_on_gpkg": (missing_crs_on_gpkg, "SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM customer)::VARCHAR), ('crs', 'none')) v(key, value)"),
    "statement_sizes": (statement_sizes, "SELECT a::INT AS attributes, ((32767 - 16) // (a + 1))::INT AS pg, ((2100 - 16) // (a + 2))::INT AS mssql FROM range(1, 41) t(a)"),
    "shp_roundtrip": (lambda spark, d: _shp(spark, d), f"SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationke, round(c_acctbal, 6) AS c_acctbal, c_mktsegment AS c_mktsegme, {POINT} AS wkt FROM customer"),
}


def _shp(spark, d):
    path = files.scratch(spark, "layer.shp")
    P.write_layer(points(spark, d), path, M.WriteOptions(on_loss=M.OnLoss.WARN))
    df = P.read_layer(spark, path)
    return df.select(*[c for c in df.columns if c != "geometry"], C.st_as_text("geometry").alias("wkt"))


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: s for k, (_, s) in QUERIES.items()}
