"""What is sent to databases and how their answers are read, with a connector that notes statements."""

import json
import sys

import pytest

from cartolith import model as M
from cartolith.functions import codecs as G
from cartolith.functions import columns as C
from cartolith.plans import convert as P
from cartolith.sources import rdb

CONNECTOR = {"connector": "tests.fake_database:connect"}


@pytest.fixture
def fake(tmp_path):
    def answers(*pairs):
        (tmp_path / "answers.json").write_text(json.dumps(pairs))
        (tmp_path / "sent.jsonl").write_text("")

    def sent():
        return [json.loads(x) for x in (tmp_path / "sent.jsonl").read_text().splitlines()]

    answers()
    return tmp_path, answers, sent


def points(spark, n=5):
    df = spark.range(n).selectExpr("id", "concat('p', id) AS name")
    return M.with_geometry(df, "geom", C.st_point(df.id.cast("double"), df.id.cast("double")), M.GeometryMeta("Point", M.Crs.epsg(4326))).repartition(2)


def test_postgis_bulk_write(spark, fake):
    folder, answers, sent = fake
    P.write_layer(points(spark), f"pg://u:p@h/db?table=s.roads&folder={folder}", M.WriteOptions(extra=CONNECTOR))
    runs = [x for x in sent() if x[0] != "rows"]
    assert runs[0][1].startswith('CREATE TABLE "s"."roads" (') and runs[1] == ["commit"]
    copies = [x for x in runs if x[0] == "copy"]
    assert len(copies) == 2 and all('FROM STDIN (FORMAT BINARY)' in x[1] for x in copies)
    header, trailer = rdb.COPY_HEADER.hex(), rdb.COPY_TRAILER.hex()
    assert all(x[2].startswith(header) and x[2].endswith(trailer) for x in copies)
    want = sorted(rdb.copy_row([i, f"p{i}"], [s.dataType for s in points(spark).schema.fields[:2]], G.wkb_encode((1, (float(i), float(i)))), 4326).hex() for i in range(5))
    got = "".join(x[2][len(header) : -len(trailer)] for x in copies)
    assert len(got) == sum(map(len, want)) and all(w in got for w in want)
    moves = [x[1] for x in runs if x[0] == "run" and x[1].startswith("INSERT INTO")]
    assert len(moves) == 2 and all(m.startswith('INSERT INTO "s"."roads" ("id", "name", "geom") SELECT') for m in moves)
    assert sum(x[1].startswith("DROP TABLE") for x in runs if x[0] == "run") == 2
    assert runs[-2][1].startswith("CREATE INDEX") and runs[-1] == ["commit"]
    stages = {m.split("FROM ")[1] for m in moves}
    assert {x[1].split("CREATE TABLE ")[1].split(" (LIKE")[0] for x in runs if "(LIKE" in x[-2 if x[0] == "run" else 0]} == stages


def test_postgis_batch_write_into_a_table_that_exists(spark, fake):
    folder, answers, sent = fake
    answers(("information_schema.columns", [["id", "int8", None, None]]))
    P.write_layer(points(spark, 3).coalesce(1), f"pg://u:p@h/db?table=roads&folder={folder}", M.WriteOptions(insert_mode="batch", batch_size=2, extra=CONNECTOR))
    inserts = [x for x in sent() if x[0] == "run" and "VALUES" in x[1]]
    assert [len(x[2]) for x in inserts] == [6, 3] and "$6::geometry" in inserts[0][1]
    assert not any("CREATE TABLE \"public\".\"roads\" " in x[1] or "CREATE INDEX" in x[1] for x in sent() if x[0] == "run")


def test_sql_server_write(spark, fake):
    folder, answers, sent = fake
    P.write_layer(points(spark, 3).coalesce(1), f"mssql://u:p@h/db?table=roads&folder={folder}", M.WriteOptions(create_index=M.CreateIndex.ALWAYS, extra=CONNECTOR))
    runs = [x[1] for x in sent() if x[0] == "run"]
    assert runs[0].startswith("CREATE TABLE [dbo].[roads]") and "varbinary(max)" in runs[1] and runs[2].startswith("INSERT INTO [roads_")
    assert "geometry::STGeomFromWKB([geom], 4326)" in runs[3] and runs[4].startswith("DROP TABLE [roads_") and "BOUNDING_BOX" in runs[5]
    P.write_layer(points(spark, 3).coalesce(1), f"mssql://u:p@h/db?table=roads&folder={folder}", M.WriteOptions(insert_mode="batch", extra=CONNECTOR))
    assert any("geometry::STGeomFromWKB(@P3, @P4)" in x[1] and len(x[2]) == 12 for x in sent() if x[0] == "run")


def test_postgis_read(spark, fake):
    folder, answers, sent = fake
    shape = "0x" + G.ewkb_encode(G.wkb_encode((1, (1.0, 2.0))), 3857).hex()
    answers(
        ("information_schema.columns", [["id", "int8", 64, 0], ["amount", "numeric", 10, 2], ["geom", "geometry", None, None]]),
        ("geometry_columns", [[3857, "POINT"]]),
        ("count(*)", [[2]]),
        ("ORDER BY ctid", [[1, 3, shape], [2, None, None]]),
    )
    df = P.read_layer(spark, f"pg://h/db?table=roads&folder={folder}", M.ReadOptions(where="id < 9", extra=CONNECTOR))
    meta = M.GeometryMeta.from_json(df.schema["geom"].metadata[M.GEOMETRY_KEY])
    assert (meta.geometry_type, meta.crs.epsg_code(), df.schema["amount"].dataType.simpleString()) == ("Point", 3857, "decimal(10,2)")
    assert [(r.id, r.amount and str(r.amount), r.geom and bytes(r.geom)) for r in df.collect()] == [(1, "3.00", G.wkb_encode((1, (1.0, 2.0)))), (2, None, None)]
    assert [x[1] for x in sent()][-1] == 'SELECT "id", "amount", ST_AsEWKB("geom") AS "geom" FROM "public"."roads" WHERE id < 9 ORDER BY ctid LIMIT 2 OFFSET 0'
    with pytest.raises(M.SchemaError):
        P.read_layer(spark, f"pg://h/db?table=roads&folder={folder}", M.ReadOptions(select=("nothing",), extra=CONNECTOR))


def test_sql_server_read_takes_the_srid_of_the_values(spark, fake):
    folder, answers, sent = fake
    answers(("information_schema.columns", [["id", "int", 10, 0], ["shape", "geography", None, None]]), ("STSrid", [[4326, "LineString"]]), ("STAsBinary", [[7, "0x" + G.wkb_encode((1, (1.0, 2.0))).hex()]]))
    df = P.read_layer(spark, f"mssql://h/db?table=roads&folder={folder}", M.ReadOptions(extra=CONNECTOR))
    meta = M.GeometryMeta.from_json(df.schema["shape"].metadata[M.GEOMETRY_KEY])
    assert (meta.geometry_type, meta.crs.epsg_code()) == ("LineString", 4326)
    assert [(r.id, bytes(r["shape"])) for r in df.collect()] == [(7, G.wkb_encode((1, (1.0, 2.0))))]


def test_a_database_without_its_python_driver_is_an_error(spark):
    if "psycopg" in sys.modules:
        pytest.skip("psycopg is there")
    with pytest.raises(M.DriverError):
        P.read_layer(spark, "pg://h/db?table=roads")
