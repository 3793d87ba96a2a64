"""Formats round trip, filters, reprojection, loss policy, tables and texts."""

import datetime as dt
import glob
import json
import math
import os
import sqlite3
import struct
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith import model as M
from cartolith.functions import codecs as G
from cartolith.functions import columns as C
from cartolith.operators import crs_texts, filters, loss, reproject, text
from cartolith.plans import convert as P
from cartolith.sources import flatgeobuf, rdb, registry, shapefile, sqlite

SHAPES = [
    "POINT(1 2)", "LINESTRING(0 0,1 1.5)", "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT((1 2),(3 4))",
    "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))",
]
BIG = ">"


@pytest.mark.parametrize("wkt", SHAPES)
def test_codecs_round_trip(wkt):
    geom = G.wkt_decode(wkt)
    wkb = G.wkb_encode(geom)
    assert G.wkt_encode(G.wkb_decode(wkb)) == wkt
    assert G.ewkb_strip(G.ewkb_encode(wkb, 4326)) == (wkb, 4326)
    assert G.gpkg_decode(G.gpkg_encode(wkb, 3857)) == (wkb, 3857, False)
    assert G.spatialite_decode(G.spatialite_encode(wkb, 4326)) == (wkb, 4326)
    assert G.geojson_decode(json.loads(G.geojson_geometry(geom))) == geom
    assert G.wkb_type(wkb).upper() == wkt.split("(")[0]


def test_codecs_reject():
    point = G.wkb_encode((1, (1.0, 2.0)))
    assert point == bytes.fromhex("0101000000000000000000f03f0000000000000040")
    assert G.wkb_decode(struct.pack(">BIdd", 0, 1, 1.0, 2.0)) == (1, (1.0, 2.0))
    for bad in (point[:-1], point + b"\0", b"\x02" + point[1:], struct.pack("<BI", 1, 7), struct.pack("<BII", 1, 2, 2**31), struct.pack("<BIdd", 1, 1001, 1, 2)):
        with pytest.raises(M.GeometryError):
            G.wkb_decode(bad)
    for bad in ("POINT EMPTY", "POINT(1)", "POINT(1 2 3)", "POINT(1 2) x", "GEOMETRYCOLLECTION(POINT(1 2))", "", "LINESTRING(1 2"):
        with pytest.raises(M.GeometryError):
            G.wkt_decode(bad)
    with pytest.raises(M.GeometryError):
        G.ewkb_encode(G.ewkb_encode(point, 1), 1)
    with pytest.raises(M.GeometryError):
        G.gpkg_decode(b"XX" + bytes(10))
    with pytest.raises(M.GeometryError):
        G.geojson_decode({"type": "Point", "coordinates": [1, 2, 3]})
    assert [G.number(x) for x in (1.0, -0.0, 139.7, 1e22, 1e-7)] == ["1", "-0", "139.7", "10000000000000000000000", "0.0000001"]


def layer(spark, rows=7, shape="POINT(1 2)", crs=M.Crs.epsg(4326)):
    kind = G.NAMES[G.wkt_decode(shape)[0]]
    data = [(i, f"row-{i}" if i % 3 else None, i / 4 if i % 2 else None, i % 2 == 0, dt.date(2020, 1, 1 + i % 28), G.wkb_encode(G.mapped(G.wkt_decode(shape), lambda x, y: (x + i, y + 2 * i)))) for i in range(rows)]  # noqa: B023
    df = spark.createDataFrame(data, "id long, name string, ratio double, flag boolean, day date, g binary").coalesce(1)
    return M.with_geometry(df, "geometry", F.col("g"), M.GeometryMeta(kind, crs)).drop("g")


def rows_of(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("extension", ["parquet", "gpkg", "sqlite", "fgb", "shp", "geojson", "ndjson", "csv", "tsv"])
@pytest.mark.parametrize("shape", [SHAPES[0], SHAPES[2]])
def test_round_trip(spark, tmp_path, extension, shape):
    df = layer(spark, shape=shape)
    path = str(tmp_path / f"layer.{extension}")
    P.write_layer(df, path)
    read = M.ReadOptions(src_crs=M.Crs.epsg(4326)) if extension in ("csv", "tsv") else M.ReadOptions()
    back = P.read_layer(spark, path, read)
    name, meta = M.require_geometry(back.schema)
    assert name == "geometry" and meta.crs.epsg_code() == 4326
    # a shapefile's polygons may have several parts, so that the layer declares the multi type
    assert meta.geometry_type == (G.NAMES[G.wkt_decode(shape)[0]] if extension != "shp" or shape[:5] == "POINT" else "MultiPolygon")
    want = df
    if extension in ("csv", "tsv"):
        want = df.select(F.col("id").cast("string"), F.coalesce("name", F.lit("")), F.coalesce(text.float_text("ratio"), F.lit("")), F.col("flag").cast("string"), F.col("day").cast("string"), "geometry")
    elif extension in ("geojson", "ndjson"):
        want = df.withColumn("day", F.col("day").cast("string"))
    elif extension == "shp":
        want = df.withColumn("id", F.col("id").cast("double"))
    assert rows_of(back) == rows_of(want)
    assert back.columns == want.columns or extension in ("csv", "tsv")
    with pytest.raises((M.IoError,)) if extension != "sqlite" else pytest.MonkeyPatch.context():
        P.write_layer(df, path)
    P.write_layer(df, path, M.WriteOptions(overwrite=True))
    assert P.read_layer(spark, path, read).count() == 7


def test_mesh(spark, tmp_path):
    start = layer(spark, 3).select("id", "geometry")
    P.write_layer(start, str(tmp_path / "a.shp"))
    formats = ["shp", "parquet", "gpkg", "geojson", "fgb", "csv"]
    options = lambda e: M.ReadOptions(src_crs=M.Crs.epsg(4326)) if e == "csv" else M.ReadOptions()
    for a in formats:
        one = str(tmp_path / f"one-{a}.{a}")
        P.convert(spark, str(tmp_path / "a.shp"), one)
        for b in formats:
            if a != b:
                two, end = str(tmp_path / f"two-{a}-{b}.{b}"), str(tmp_path / f"end-{a}-{b}.shp")
                P.convert(spark, one, two, options(a))
                P.convert(spark, two, end, options(b))
                got = [G.wkb_decode(bytes(r.geometry))[1] for r in P.read_layer(spark, end).select("geometry").collect()]
                assert got == [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]


def test_partitioned_outputs(spark, tmp_path):
    df = layer(spark, 40).repartition(3)
    for extension in ("parquet", "ndjson", "csv"):
        path = str(tmp_path / f"many.{extension}")
        P.write_layer(df, path, M.WriteOptions(partitioned=True))
        assert len(glob.glob(path + "/*part-*")) >= 3
        assert P.read_layer(spark, path).count() == 40
    assert M.require_geometry(P.read_layer(spark, str(tmp_path / "many.parquet")).schema)[1].crs.epsg_code() == 4326


def test_filters(spark):
    df = layer(spark)
    assert [r.id for r in filters.apply(df, M.ReadOptions(where="id < 3")).collect()] == [0, 1, 2]
    got = filters.apply(df, M.ReadOptions(where="id = 1", select=("geometry", "name")))
    assert got.columns == ["geometry", "name"] and M.geometry_field(got.schema)
    got = filters.apply(df, M.ReadOptions(query="SELECT name AS n, geometry FROM layer WHERE id > 4"))
    assert got.columns == ["n", "geometry"] and got.count() == 2 and M.require_geometry(got.schema)[1].crs.epsg_code() == 4326
    for bad in (M.ReadOptions(query="SELECT 1; SELECT 2"), M.ReadOptions(query=" "), M.ReadOptions(query="SELECT id FROM layer"), M.ReadOptions(select=("id",)), M.ReadOptions(select=("no", "geometry")), M.ReadOptions(query="SELECT 1", where="1=1")):
        with pytest.raises(M.SchemaError):
            filters.apply(df, bad)


def test_reproject(spark):
    point = spark.createDataFrame([(bytearray(G.wkb_encode((1, (139.7671, 35.68124)))),), (None,)], "g binary")
    df = M.with_geometry(point, "g", F.col("g"), M.GeometryMeta("Point", M.Crs.epsg(4326)))
    there = reproject.reproject(df, M.Crs.epsg(3857))
    assert M.require_geometry(there.schema)[1].crs.epsg_code() == 3857
    x, y = G.wkb_decode(bytes(there.where("g IS NOT NULL").first().g))[1]
    assert abs(x - 6378137 * math.radians(139.7671)) < 0.01 and abs(y - 6378137 * math.log(math.tan(math.pi / 4 + math.radians(35.68124) / 2))) < 0.01
    back = G.wkb_decode(bytes(reproject.reproject(there, M.Crs.epsg(4326)).where("g IS NOT NULL").first().g))[1]
    assert max(abs(back[0] - 139.7671), abs(back[1] - 35.68124)) < 1e-9
    assert reproject.reproject(there, M.Crs.epsg(4326)).where("g IS NULL").count() == 1
    with pytest.raises(M.CrsError):
        reproject.reproject(df, M.Crs.epsg(2056))
    with pytest.raises(M.CrsError):
        reproject.reproject(M.replace_crs(df, None), M.Crs.epsg(3857))
    pole = M.with_geometry(spark.createDataFrame([(bytearray(G.wkb_encode((1, (0.0, 90.0)))),)], "g binary"), "g", F.col("g"), M.GeometryMeta("Point", M.Crs.epsg(4326)))
    with pytest.raises(Exception, match="cannot be transformed"):
        reproject.reproject(pole, M.Crs.epsg(3857)).collect()
    polygons = reproject.reproject(layer(spark, 2, SHAPES[2]), M.Crs.epsg(3857))
    assert all(G.wkb_decode(bytes(r.geometry))[0] == 3 for r in polygons.collect())


LOSSES = [
    ("csv", "b", "warn", "empty"), ("csv", "b", "skip", None), ("csv", "a", "skip", None), ("geojson", "b", "warn", "null"), ("geojson", "b", "skip", None), ("geojson", "d", "warn", "text"),
    ("geojson", "d", "skip", None), ("geojson", "t", "warn", "text"), ("geojson", "t", "skip", None), ("gpkg", "d", "warn", "text"), ("gpkg", "d", "skip", "text"), ("fgb", "d", "warn", "double"),
]


@pytest.mark.parametrize("sink,field,policy,want", LOSSES)
def test_loss_plan(sink, field, policy, want):
    kinds = {"b": T.BinaryType(), "a": T.ArrayType(T.LongType()), "d": T.DecimalType(20, 5), "t": T.TimestampNTZType()}
    schema = T.StructType([T.StructField(field, kinds[field])])
    plan = loss.plan_losses(schema, sink, M.OnLoss(policy))
    assert plan.columns == ([(field, want)] if want else []) and len(plan.losses) == 1
    with pytest.raises(M.LossError):
        loss.plan_losses(schema, sink, M.OnLoss.ERROR)
    if field == "a":
        with pytest.raises(M.DriverError):
            loss.plan_losses(schema, sink, M.OnLoss.WARN)


def test_geojson_losses(spark, tmp_path):
    df = spark.createDataFrame([("alpha", Decimal("1234.56789"), float("nan"), dt.datetime(2020, 1, 2, 3, 4, 5, 6), bytearray(G.wkb_encode((1, (1.0, 2.0)))))], "name string, amount decimal(20,5), x double, ts timestamp_ntz, g binary")
    df = M.with_geometry(df, "g", F.col("g"), M.GeometryMeta("Point", M.Crs.epsg(4326)))
    path = str(tmp_path / "l.ndjson")
    with pytest.raises(M.LossError):
        P.write_layer(df, path)
    P.write_layer(df, path, M.WriteOptions(on_loss=M.OnLoss.WARN))
    got = json.loads(open(path).read())
    assert got == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"name": "alpha", "amount": "1234.56789", "x": None, "ts": "2020-01-02T03:04:05.000006"}}
    P.write_layer(df, path, M.WriteOptions(on_loss=M.OnLoss.SKIP, overwrite=True))
    assert json.loads(open(path).read())["properties"] == {"name": "alpha", "x": None}


def test_geojson_inference_and_crs(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": 1, "b": 1, "c": None}}, {"type": "Feature", "geometry": None, "properties": {"a": 2.5, "b": "x", "late": {"k": 1}}}]
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "bbox": [1, 2, 3, 4], "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": features}))
    df = P.read_layer(spark, str(path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("a", "double"), ("b", "string"), ("c", "string"), ("late", "string"), ("geometry", "binary")]
    assert M.require_geometry(df.schema)[1].crs.epsg_code() == 3857
    assert [(r.a, r.b, r.late, r.geometry is None) for r in df.collect()] == [(1.0, "1", None, False), (2.5, "x", '{"k":1}', True)]
    lines = tmp_path / "f.ndjson"
    lines.write_text("# comment\n\n" + "\n".join(map(json.dumps, features)) + "\n")
    assert P.read_layer(spark, str(lines)).count() == 2
    for bad in ('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[]},"properties":{}}]}', "{broken"):
        path.write_text(bad)
        with pytest.raises(Exception):
            P.read_layer(spark, str(path)).collect()


def test_geojson_is_written_in_wgs84(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(G.wkb_encode((1, (15558325.04, 4256749.97)))),)], "g binary")
    df = M.with_geometry(df, "g", F.col("g"), M.GeometryMeta("Point", M.Crs.epsg(3857)))
    P.write_layer(df, str(tmp_path / "w.geojson"))
    x, y = json.loads((tmp_path / "w.geojson").read_text())["features"][0]["geometry"]["coordinates"]
    assert 139 < x < 141 and 35 < y < 37


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes("﻿name,Geom,other\nSão Paulo,POINT(0 0),\n東京,,\"a \"\"b\"\", c\"\n".encode())
    df = P.read_layer(spark, str(path))
    assert df.columns == ["name", "Geom", "other"] and M.require_geometry(df.schema)[1].geometry_type == "Point"
    assert [(r.name, r.Geom is None, r.other) for r in df.collect()] == [("São Paulo", False, ""), ("東京", True, 'a "b", c')]
    P.write_layer(df, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(M.SchemaError):
        P.read_layer(spark, str(path))


def test_dbf_plan():
    schema = T.StructType([T.StructField("very_long_field_name_a", T.BooleanType()), T.StructField("very_long_field_name_b", T.BooleanType()), T.StructField("amt", T.DecimalType(10, 3)), T.StructField("n", T.LongType()), T.StructField("blob", T.BinaryType())])
    fields, losses = loss.plan_dbf(schema, M.OnLoss.WARN)
    assert [(f.name, f.kind, f.length, f.decimals) for f in fields] == [("very_long_", "L", 1, 0), ("very_long1", "L", 1, 0), ("amt", "N", 11, 3), ("n", "N", 18, 0)]
    assert [x.kind for x in losses] == ["dbf-name-truncation", "dbf-name-truncation", "binary-on-shp"]
    with pytest.raises(M.LossError):
        loss.plan_dbf(schema, M.OnLoss.ERROR)


def test_shapefile_bytes(spark, tmp_path):
    P.write_layer(layer(spark, 1).select("id", "geometry"), str(tmp_path / "s.shp"))
    data = (tmp_path / "s.shp").read_bytes()
    assert len(data) == 128 and struct.unpack_from(">i", data)[0] == 9994 and struct.unpack_from(">i", data, 24)[0] == 64
    assert struct.unpack_from("<ii4d", data, 28) == (1000, 1, 1.0, 2.0, 1.0, 2.0)
    assert struct.unpack_from(">ii", data, 100) == (1, 10) and struct.unpack_from("<idd", data, 108) == (1, 1.0, 2.0)
    assert struct.unpack_from(">ii", (tmp_path / "s.shx").read_bytes(), 100) == (50, 10)
    assert (tmp_path / "s.dbf").read_bytes()[65:] == b" " + b"0".rjust(18) + b"\x1a"
    assert (tmp_path / "s.cpg").read_text() == "UTF-8" and "AUTHORITY" in (tmp_path / "s.prj").read_text()
    with pytest.raises(M.GeometryError):
        shapefile.encode_shape((1, (1.0, 2.0)), 5)


def test_sqlite_files(spark, tmp_path):
    path = str(tmp_path / "g.gpkg")
    P.write_layer(layer(spark), path, M.WriteOptions(extra={"table": "roads"}))
    with sqlite3.connect(path) as db:
        assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
        assert db.execute("SELECT min_x, max_y FROM gpkg_contents").fetchone() == (1.0, 14.0)
        assert db.execute("SELECT count(*) FROM gpkg_spatial_ref_sys").fetchone()[0] == 3
        assert db.execute("SELECT fid, id FROM roads ORDER BY fid LIMIT 1").fetchone() == (1, 0)
    with pytest.raises(M.SchemaError):
        P.read_layer(spark, path, M.ReadOptions(table="Roads"))
    spatialite = str(tmp_path / "s.sqlite")
    P.write_layer(layer(spark), spatialite, M.WriteOptions(extra={"table": "roads"}))
    P.write_layer(layer(spark), spatialite, M.WriteOptions(extra={"table": "roads"}))  # appends
    assert P.read_layer(spark, spatialite, M.ReadOptions(table="ROADS")).count() == 14
    got = sqlite.SPATIALITE.read_query(spark, M.parse_uri(spatialite), "SELECT name, geometry, id FROM roads WHERE id < 2")
    assert got.columns == ["name", "id", "geometry"] and got.count() == 4
    with pytest.raises(M.SchemaError):
        P.write_layer(layer(spark), str(tmp_path / "n.sqlite"), M.WriteOptions(create_table=M.CreateTable.NEVER))
    assert [sqlite.coerce(*x) for x in ((1.9, "bigint"), ("12", "int"), (3, "string"), (2.0, "string"), (None, "int"), ("2020-01-02", "date"))] == [1, 12, "3", "2", None, dt.date(2020, 1, 2)]
    for bad in (("x", "double"), ("1.5", "bigint"), ("soon", "date"), ("12:00", "timestamp_ntz")):
        with pytest.raises(M.FormatError):
            sqlite.coerce(*bad)


def test_flatgeobuf_header(spark, tmp_path):
    P.write_layer(layer(spark, 3), str(tmp_path / "h.fgb"))
    head, start = flatgeobuf.header(str(tmp_path / "h.fgb"))
    assert [c[:2] for c in head["columns"]] == [("id", "long"), ("name", "string"), ("ratio", "double"), ("flag", "bool"), ("day", "datetime")]
    assert head["count"] == 3 and head["kind"] == 1 and head["crs"].epsg_code() == 4326 and len(list(flatgeobuf.features_between(str(tmp_path / "h.fgb"), start, os.path.getsize(tmp_path / "h.fgb")))) == 3
    assert flatgeobuf.index_size(0, 16) == 0 and flatgeobuf.index_size(1, 16) == 40 and flatgeobuf.index_size(17, 16) == 40 * (17 + 2 + 1)


def test_copy_binary(spark):
    n = lambda v, s: rdb.numeric_bytes(Decimal(v), s)
    assert n("0", 2) == struct.pack(">hhHH", 0, 0, 0, 2)
    assert n("12345.678", 3) == struct.pack(">hhHHhhh", 3, 1, 0, 3, 1, 2345, 6780)
    assert n("-1", 0) == struct.pack(">hhHHh", 1, 0, 0x4000, 0, 1) and n("10000", 0) == struct.pack(">hhHHh", 1, 1, 0, 0, 1)
    assert n("0.0001", 4) == struct.pack(">hhHHh", 1, -1, 0, 4, 1) and n("1.29", 1) == struct.pack(">hhHHhh", 2, 0, 0, 1, 1, 2000)
    f = rdb.field_bytes
    assert f(None, T.LongType()) == b"\xff" * 4 and f(True, T.BooleanType()) == b"\0\0\0\x01\x01" and f(7, T.IntegerType()) == struct.pack(">ii", 4, 7)
    assert f(dt.date(2000, 1, 2), T.DateType()) == struct.pack(">ii", 4, 1) and f(dt.datetime(2000, 1, 1, 0, 0, 1), T.TimestampNTZType()) == struct.pack(">iq", 8, 1_000_000)
    row = rdb.copy_row([5, "ab"], [T.LongType(), T.StringType()], G.wkb_encode((1, (1.0, 2.0))), 4326)
    assert row == struct.pack(">hiqi", 3, 8, 5, 2) + b"ab" + struct.pack(">i", 25) + G.ewkb_encode(G.wkb_encode((1, (1.0, 2.0))), 4326)
    chunks = rdb.encode_copy(layer(spark), 4326).collect()
    assert sum(len(r.chunk) for r in chunks) > 0


def test_database_sql():
    a = rdb.parse_address("postgres://me:p%40ss@host:5433/db?table=s.t&table=x")
    assert (a.kind, a.user, a.password, a.port, a.schema, a.table) == ("pg", "me", "p@ss", 5433, "s", "t")
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("na\"me", T.StringType()), T.StructField("geom", T.BinaryType(), True, {M.GEOMETRY_KEY: M.GeometryMeta("Point").to_json()})])
    assert rdb.create_table_sql(a, schema, 4326) == 'CREATE TABLE "s"."t" ("id" bigint NOT NULL, "na""me" text, "geom" geometry(Point,4326))'
    assert rdb.select_sql(a, ["id", "geom"], "geom", "id < 3") == 'SELECT "id", ST_AsEWKB("geom") AS "geom" FROM "s"."t" WHERE id < 3'
    assert rdb.insert_rows("pg", 6) == 4678 + 0 if (32767 - 16) // 7 == 4678 else rdb.insert_rows("pg", 6) == (32767 - 16) // 7
    assert rdb.insert_rows("mssql", 6) == 260
    m = rdb.parse_address("mssql://sa:x@h/db?table=roads")
    assert (m.port, m.schema) == (1433, "dbo") and rdb.quote("a]b", "mssql") == "[a]]b]" and rdb.literal("a'b", "mssql") == "N'a''b'"
    assert "STGeomFromWKB([geom], 4326)" in rdb.staging_statements(m, schema, 4326)["move"]
    assert rdb.index_statements(m, "geom", 4326, True, M.CreateIndex.AUTO) == [] and "BOUNDING_BOX" in rdb.index_statements(m, "geom", 4326, False, M.CreateIndex.ALWAYS)[0]
    with pytest.raises(M.SchemaError):
        rdb.table_statements(a, schema, 0, True, M.WriteOptions(create_table=M.CreateTable.ALWAYS))
    assert len(rdb.table_statements(m, schema, 0, True, M.WriteOptions(create_table=M.CreateTable.ALWAYS))) == 2
    assert [rdb.spark_type(x, "pg") for x in ("int4", "numeric(10,2)", "numeric", "timestamptz")] == ["int", "decimal(10,2)", "decimal(38,0)", "timestamp"]
    assert rdb.spark_type("decimal(99,1)", "mssql") == "decimal(38,0)"


def test_model():
    assert [M.parse_uri(x).scheme for x in ("a/b.GPKG", "postgresql://h/d", "x.tsv?table=a.b", "noext", "c.d/e")] == ["gpkg", "pg", "tsv", "", ""]
    assert M.percent_decode("a+b%20%zz%4") == "a b %zz%4" and M.query_options("x?Table=a&table=b&c") == {"table": "a", "c": ""}
    assert M.Crs.parse(" epsg:4326 ").epsg_code() == 4326
    with pytest.raises(M.CrsError):
        M.Crs.parse("Epsg:4326")
    with pytest.raises(M.FormatError):
        registry.select_driver(M.parse_uri("x.unknown"))
    with pytest.raises(M.DriverError):
        P.use_bulk(registry.select_driver(M.parse_uri("x.csv")), "bulk")
    assert P.use_bulk(registry.select_driver(M.parse_uri("pg://h/d")), "auto")
    meta = M.GeometryMeta("Point", M.Crs.epsg(4326), "planar")
    assert M.GeometryMeta.from_json(meta.to_json()) == meta and "crs" not in json.loads(M.GeometryMeta().to_json())
    assert crs_texts.wkt1_code(crs_texts.WKT1[3857]) == 3857 and crs_texts.from_projjson([1]) is None
    assert text.table_name("1 a-b") == "_1_a_b" and text.cut_bytes("éé", 3) == "é" and text.rows_in_statement(10, 16, 3) == 1
    assert text.parse_timestamp("2020-01-02 03:04:05.5+01:00").isoformat() == "2020-01-02T02:04:05.500000+00:00"
    with pytest.raises(M.SchemaError):
        loss.check_table_strategy(True, M.CreateTable.NEVER)


def test_native_geometry_expressions(spark):
    df = layer(spark, 2)
    got = df.select(C.st_as_ewkb(F.col("geometry"), 4326).alias("e"), C.st_as_gpkg(F.col("geometry"), 3857).alias("p"), C.st_geometry_type(F.col("geometry")).alias("t"), "geometry", C.st_bbox("geometry").alias("b")).collect()
    for r in got:
        assert bytes(r.e) == G.ewkb_encode(bytes(r.geometry), 4326) and bytes(r.p) == G.gpkg_encode(bytes(r.geometry), 3857) and r.t == "Point"
        assert tuple(r.b) == G.bbox(G.wkb_decode(bytes(r.geometry)))
    box = C.layer_bbox(layer(spark, 3, SHAPES[2]), "geometry").first()
    assert tuple(box) == (0.0, 0.0, 6.0, 8.0)


def test_info_schema_drivers(spark, tmp_path):
    path = str(tmp_path / "i.gpkg")
    P.write_layer(layer(spark), path)
    got = {r.key: r.value for r in P.info(spark, path).collect()}
    assert got["driver"] == "gpkg" and got["rows"] == "7" and got["crs"] == "EPSG:4326" and got["field 0"] == "id: bigint"
    assert P.schema_frame(P.read_layer(spark, path)).count() == 6
    assert json.loads(P.schema_json(layer(spark), "csv"))["fields"][-1]["metadata"][M.GEOMETRY_KEY]["geometry_type"] == "Point"
    assert [r.name for r in P.drivers_frame(spark).collect()] == ["csv", "fgb", "geojson", "gpkg", "parquet", "postgis", "shp", "spatialite", "sqlserver"]
    for extension in ("parquet", "shp", "fgb"):
        P.write_layer(layer(spark), str(tmp_path / f"i.{extension}"))
        assert P.row_count_hint(spark, M.parse_uri(str(tmp_path / f"i.{extension}"))) == 7


def test_metadata_survives(spark, tmp_path):
    df = layer(spark).where("id > 1").select("geometry", "id")
    assert M.require_geometry(df.schema)[0] == "geometry"
    assert M.geometry_field(df.withColumn("geometry", F.upper(F.hex("geometry"))).schema) is None


def test_stream(spark, tmp_path):
    from cartolith.streaming.ndjson import read_ndjson_stream

    P.write_layer(layer(spark), str(tmp_path / "in" / "a.ndjson"))
    q = read_ndjson_stream(spark, str(tmp_path / "in"), [("id", "bigint"), ("name", "string")]).writeStream.format("memory").queryName("stream_out").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("stream_out").count() == 7
    assert not os.path.exists(str(tmp_path / "in" / "a.ndjson.tmp"))


def test_columns_from_all_features(spark, tmp_path):
    lines = [json.dumps({"type": "Feature", "geometry": None, "properties": {"a": i}}) for i in range(50)]
    lines.append(json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"late": "x", "a": 1.5}}))
    (tmp_path / "late.ndjson").write_text("\n".join(lines))
    read = lambda sample: P.read_layer(spark, str(tmp_path / "late.ndjson"), M.ReadOptions(extra={"sample": sample}))
    assert [f.simpleString() for f in read(10).schema] == ["a:bigint", "geometry:binary"]
    assert [f.simpleString() for f in read("all").schema] == ["a:double", "late:string", "geometry:binary"]
    assert read("all").where("late = 'x' AND a = 1.5").count() == 1


def test_flatgeobuf_spans_by_index_and_by_walk(tmp_path):
    features = [struct.pack("<I", n) + bytes(n) for n in (30, 50, 20, 90, 10)]
    places, at = [], 0
    for f in features:
        places.append(at)
        at += len(f)
    nodes = b"".join(struct.pack("<4dQ", 0, 0, 0, 0, p) for p in [0, *places])  # a root before the leaves
    path = tmp_path / "x.fgb"
    path.write_bytes(b"head" + nodes + b"".join(features))
    start = 4 + len(nodes)
    flatgeobuf_rows, flatgeobuf.ranged.ROWS = flatgeobuf.ranged.ROWS, 8
    try:
        spans = flatgeobuf.feature_spans(str(path), start, {"count": 5, "index": len(nodes)}, 3)
    finally:
        flatgeobuf.ranged.ROWS = flatgeobuf_rows
    size = path.stat().st_size
    assert spans == [(start, start + places[2]), (start + places[2], start + places[4]), (start + places[4], size)]
    assert flatgeobuf.feature_spans(str(path), start, {"count": 5, "index": 0}, 3) == [(start, size)]


def test_utm():
    import numpy as np

    lat = np.linspace(0, 84, 15)
    x, y = reproject.to_utm(np.full(15, 3.0), lat, 31, False)
    e2 = reproject._E2
    for top, got in zip(lat, y):  # the length of the meridian, summed up
        phi = np.radians(np.linspace(0, top, 20_001))
        radius = 6378137 * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
        assert abs(0.9996 * np.trapezoid(radius, phi) - got) < 1e-3
    assert np.allclose(x, 500_000)
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(-17, 23, 500), rng.uniform(-84, 84, 500)
    for south in (False, True):
        back = reproject.from_utm(*reproject.to_utm(lon, lat, 31, south), 31, south)
        assert np.abs(back[0] - lon).max() < 1e-7 and np.abs(back[1] - lat).max() < 1e-7
    h = 1e-5  # angles are kept: both partial derivatives are alike, turned by a right angle
    east = np.subtract(reproject.to_utm(lon + h, lat, 31, False), reproject.to_utm(lon - h, lat, 31, False))
    north = np.subtract(reproject.to_utm(lon, lat + h, 31, False), reproject.to_utm(lon, lat - h, 31, False))
    s = np.sin(np.radians(lat))
    ratio = (1 - e2) / (1 - e2 * s * s) / np.cos(np.radians(lat))  # of lengths of a degree north and east
    assert np.allclose(north[0], -east[1] * ratio, atol=1e-4) and np.allclose(north[1], east[0] * ratio, rtol=1e-5, atol=1e-4)
    there = reproject.transform_for(M.Crs.epsg(32733), M.Crs.epsg(3857))(*reproject.to_utm(np.array([15.5]), np.array([-20.0]), 33, True))
    assert np.allclose(there, reproject.forward(np.array([15.5]), np.array([-20.0])), atol=1e-3)
    assert np.isnan(reproject.to_utm(np.array([60.0]), np.array([0.0]), 31, False)[0][0])
    with pytest.raises(M.CrsError):
        reproject.transform_for(M.Crs.epsg(4326), M.Crs.epsg(32661))


def test_scratch_folders(spark, tmp_path):
    from cartolith.sources import files

    class Session:
        def __init__(self, path):
            self.conf = {"spark.checkpoint.dir": path}

    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        assert files.scratch(Session(path), "x").startswith(f"{tmp_path}/cartolith-layers/")
    with pytest.raises(M.IoError):
        files.scratch(Session("hdfs://host/folder"), "x")


def _documents():
    feature = lambda i, t: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 1.5]}, "properties": {"k": i, "t": t, "o": {"a": [{"b": "]}"}, []]}}}
    some = [feature(i, ['plain', 'a}b', '{"features":[', '\\', '\\"}', "é漢}", ""][i % 7] * (1 + i % 3)) for i in range(200)]
    foreign = {"features": [{"no": "feature"}] * 20, "x": "}]" * 50}
    own = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::4326"}}}
    compact, spaced = (json.dumps(own | {"features": some}, separators=(",", ":"), ensure_ascii=False), json.dumps(own | {"features": some}, indent=2))
    yield compact, some
    yield "﻿" + spaced + "\n", some
    yield json.dumps({"a": foreign, "features": some, "b": foreign, "type": "FeatureCollection"}) + " \n", some
    yield json.dumps({"type": "FeatureCollection", "features": []}), []
    yield json.dumps(some[2] | {"features": some[:3]}, indent=1), None
    yield json.dumps(some[3]), None
    for bad in (compact[:-1], compact[: len(compact) // 2], compact.replace("},{", "}{", 1), compact.replace("]}", ",]}")[-900:], compact + "}", compact + " x", '{"type":"FeatureCollection"}', json.dumps(some), "", " ", compact[:-2] + ",]}", compact[:-2] + "}]", compact[:-2]):
        yield bad, M.FormatError


def test_collections_are_read_in_splits(spark, tmp_path):
    """Wherever splits begin: inside texts, in members of other names, within features; and no whole document in a row."""
    from cartolith.sources import geojson

    whole = lambda d, s: [s.removeprefix("﻿")] if d is None else [json.dumps(f, ensure_ascii=False) for f in d]
    try:
        for size in ("1700", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1" if size == "1700" else "4m")
            for i, (text, features) in enumerate(_documents()):
                path = tmp_path / f"{size}-{i}.geojson"
                path.write_text(text, encoding="utf-8")
                read = lambda: geojson.features(spark, M.parse_uri(str(path)))
                if features is M.FormatError:
                    with pytest.raises(Exception, match="not JSON|no FeatureCollection|no features|no comma"):
                        read().collect()
                    continue
                df = read()
                assert [r["feature"] for r in df.collect()] == whole(features, text), (size, i)
                if size == "1700" and features and len(features) > 9:
                    assert df.rdd.getNumPartitions() > 3
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)


@pytest.mark.parametrize("extension", ["geojson", "gpkg", "sqlite", "fgb", "parquet", "csv"])
def test_single_files_are_made_of_rows_of_all_tasks(spark, tmp_path, extension):
    """Rows are made where they are, not in the one task that writes; they keep their order, and nothing is left beside the file."""
    from pyspark import TaskContext

    task = F.udf(lambda k: TaskContext.get().partitionId(), "int")
    k = F.col("id")
    df = spark.range(0, 40, 1, 4).select(k.alias("k"), task("id").alias("task"), C.st_point((k - 20).cast("double"), k.cast("double")).alias("geometry"))
    df = M.with_geometry(df, "geometry", F.col("geometry"), M.GeometryMeta("Point", M.Crs.epsg(4326)))
    path = str(tmp_path / f"a.{extension}")
    P.write_layer(df, path)
    assert os.listdir(tmp_path) == [f"a.{extension}"]
    got = [(int(r["k"]), int(r["task"])) for r in P.read_layer(spark, path).collect()]
    assert got == [(i, i // 10) for i in range(40)]
    if extension == "gpkg":
        with sqlite3.connect(path) as db:
            assert db.execute("SELECT min_x, min_y, max_x, max_y FROM gpkg_contents").fetchall() == [(-20, 0, 19, 39)]


def test_plain_shapes_are_as_others(spark):
    texts = [
        "POINT(1 2)", "point ( -.5  +1e3 ) ", "LINESTRING(0 0 , 1 1.5)", "POLYGON((0 0,4 0,4 4,0 0))", "POLYGON((0 0,1 1),(2 2,3 3))", "POLYGON( ( 1 2 , 3 4 ) )", "LINESTRING(1-2,3 4)", "POINT(1. .5)",
    ]
    for t in texts:
        assert G.wkt_to_wkb(t) == G.wkb_encode(G.wkt_decode(t))
    for t in ("POINT(1 2 3)", "POINT(1)", "LINESTRING((0 0,1 1))", "POLYGON(0 0,1 1)", "POLYGON((0 0,1 1)", "POLYGON((0 0,,1 1))", "POLYGON((1 2),3 4)", "POLYGON(1 2,(3 4))", "POINT(1 2) x"):
        with pytest.raises(M.GeometryError):
            G.wkt_to_wkb(t)
    area = G.wkt_to_wkb("POLYGON((-0.0 1e22,2 2.5,2 3,-0 1e22),(1 1,2 2,1 1))")
    assert G.wkb_normal(area) == area
    assert G.wkb_normal(struct.pack(">BIIIdd", 0, 3, 1, 1, 1, 2)) == struct.pack("<BIIIdd", 1, 3, 1, 1, 1, 2)
    for bad in (area[:-1], area + b"\0", area[:8], area[:9] + b"\xff" * 4 + area[13:], area[:5] + b"\xff" * 4 + area[9:]):
        with pytest.raises(M.GeometryError):
            G.wkb_normal(bad)
    rings = ["POLYGON((-0 10000000000000000000000,2 2.5,2 3,0 0.0000001))", None, "POLYGON((1 2,3 4,5 6,1 2))"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rings)], "i int, t string").coalesce(1)
    assert [r["t"] for r in df.select("i", C.st_as_text(C.st_from_text("t")).alias("t")).orderBy("i").collect()] == rings


def test_files_of_few_row_groups_are_dealt_out(spark, tmp_path):
    """One row group is read by one task: geometries of a large table are made by all of them."""
    from cartolith.plans import queries

    for name, rows in (("large", queries.DEALT), ("small", 100)):
        (tmp_path / name).mkdir()
        pq_table = pa.table({"c_custkey": pa.array(range(rows), pa.int64())})
        pq.write_table(pq_table, tmp_path / name / "customer.parquet", row_group_size=1 << 20)
    large = queries.squares(spark, str(tmp_path / "large"))
    assert large.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() == 4
    assert queries.wkb_roundtrip(spark, str(tmp_path / "small")).count() == 100


def test_points_are_made_without_an_object_each(spark):
    """A batch of points is one Arrow buffer; nulls on either side stay null."""
    import inspect

    assert inspect.signature(C.st_point.func).return_annotation in ("pa.Array", pa.Array)
    xs, ys = [1.0, None, -0.0, math.inf, 2.5, math.nan], [2.0, 1.0, None, -1.5, 1e-300, 4.0]
    want = [None if x is None or y is None else struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(xs, ys)]
    assert C.st_point.func(pa.array(xs), pa.array(ys)).to_pylist() == want
    assert C.st_point.func(pa.array([], pa.float64()), pa.array([], pa.float64())).to_pylist() == []
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(xs, ys))], "i int, x double, y double").coalesce(1)
    assert [r["p"] for r in df.select("i", C.st_point("x", "y").alias("p")).orderBy("i").collect()] == want
    C.register_all(spark)
    assert bytes(spark.sql("SELECT st_point(1, 2) AS p").first()["p"]) == struct.pack("<BIdd", 1, 1, 1, 2)
    assert spark.sql("SELECT st_point(CAST(NULL AS DOUBLE), 2D) AS p").first()["p"] is None


def test_partitioned_geoparquet_is_one_job(spark, tmp_path):
    """The tasks run at once, not one job after another."""
    k = F.col("id")
    df = M.with_geometry(spark.range(0, 80, 1, 8), "geometry", C.st_point(k.cast("double"), k.cast("double")), M.GeometryMeta("Point", M.Crs.epsg(4326)))
    spark.sparkContext.setJobGroup("parts", "parts")
    try:
        P.write_layer(df, str(tmp_path / "p.parquet"), M.WriteOptions(partitioned=True))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("parts")) == 1
    assert len(os.listdir(tmp_path / "p.parquet")) == 8
