"""GeoPackage and SpatiaLite files, on the sqlite3 of the standard library.

Geometry blobs are decoded and encoded here; no SQLite extension is needed, and none is used: a spatial index
(R*Tree) is not created, asking for one with create-index=always is an error. Tables are read in ranges of rowid.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import sqlite3
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs as G
from ..functions.columns import st_as_gpkg, st_as_spatialite, st_bbox
from ..model import Capabilities, CreateIndex, CreateTable, Crs, CrsError, DriverError, FormatError, GeometryMeta, OnLoss, ReadOptions, SchemaError, Uri, WriteOptions, as_geometry, query_options, quoted, require_geometry, type_of
from ..operators import crs_texts, loss
from ..operators.text import parse_timestamp, table_name
from . import files, ranged

CAPABILITIES = Capabilities(supports_blob=True)
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300
OWN_SRS = 100_000
TO_SPARK = {"BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "MEDIUMINT": "int", "INT": "bigint", "INTEGER": "bigint", "FLOAT": "float", "DOUBLE": "double", "REAL": "double", "NUMERIC": "double", "TEXT": "string", "BLOB": "binary", "DATE": "date", "DATETIME": "timestamp_ntz"}


def spark_type(declared: str) -> str:
    base = re.sub(r"\s*\(.*\)", "", declared or "").strip().upper()
    if not base:
        raise SchemaError("a column has no declared type")
    return TO_SPARK.get(base, "string")


def sqlite_type(kind: T.DataType) -> str:
    for cls, name in ((T.BooleanType, "BOOLEAN"), (T.ByteType, "TINYINT"), (T.ShortType, "SMALLINT"), (T.IntegerType, "MEDIUMINT"), (T.LongType, "INTEGER"), (T.FloatType, "FLOAT"), (T.DoubleType, "DOUBLE"), (T.StringType, "TEXT"), (T.BinaryType, "BLOB"), (T.DateType, "DATE"), (T.TimestampType, "DATETIME"), (T.TimestampNTZType, "DATETIME"), (T.DecimalType, "TEXT")):
        if isinstance(kind, cls):
            return name
    raise SchemaError(f"SQLite cannot hold {kind.simpleString()}")


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def coerce(value, kind: str):
    """SQLite's dynamic values to the declared type; null stays null, what does not parse is an error."""
    if value is None:
        return None
    try:
        if kind == "string":
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else G.number(value) if isinstance(value, float) else str(value)
        if kind == "binary":
            return value if isinstance(value, bytes) else str(value).encode()
        if kind == "boolean":
            return bool(int(value))
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return int(value)
        if kind in ("float", "double"):
            return float(value)
        if kind == "date":
            return dt.date.fromisoformat(str(value)[:10])
        at = parse_timestamp(str(value))
        if at is None:
            raise ValueError
        return at.replace(tzinfo=None)
    except (ValueError, TypeError):
        raise FormatError(f"{value!r} is no {kind}") from None


def _connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FormatError(f"no file {path}")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Flavor:
    """What differs between the two kinds of file."""

    def __init__(self, name, schemes):
        self.NAME, self.SCHEMES, self.CAPABILITIES = name, schemes, CAPABILITIES
        self.gpkg = name == "gpkg"

    def layers(self, db) -> dict[str, tuple]:
        """table: (geometry column, type, srid)."""
        if self.gpkg:
            if db.execute("PRAGMA application_id").fetchone()[0] != APPLICATION_ID:
                raise FormatError("not a GeoPackage: wrong application_id")
            have = {r[0] for r in db.execute("SELECT name FROM sqlite_master")}
            missing = {"gpkg_contents", "gpkg_geometry_columns", "gpkg_spatial_ref_sys"} - have
            if missing:
                raise FormatError(f"not a GeoPackage: no {sorted(missing)}")
            return {t: (c, k, s) for t, c, k, s in db.execute("SELECT g.table_name, g.column_name, g.geometry_type_name, g.srs_id FROM gpkg_geometry_columns g JOIN gpkg_contents c ON c.table_name = g.table_name WHERE c.data_type = 'features'")}
        rows = db.execute("SELECT f_table_name, f_geometry_column, geometry_type, coord_dimension, srid FROM geometry_columns").fetchall()
        for r in rows:
            if str(r[3]) not in ("2", "XY"):
                raise FormatError(f"{r[0]}: only XY geometries are supported")
        return {r[0]: (r[1], G.GEOMETRY_TYPES[r[2]] if 0 <= r[2] <= 7 else "Geometry", r[4]) for r in rows}

    def crs(self, db, srid: int) -> Crs | None:
        if srid <= 0:
            return None
        if self.gpkg:
            wkt2 = any(r[1] == "definition_12_063" for r in db.execute("PRAGMA table_info(gpkg_spatial_ref_sys)"))
            row = db.execute(f"SELECT organization, organization_coordsys_id, definition, {'definition_12_063' if wkt2 else 'NULL'} FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srid,)).fetchone()
            if row is None:
                raise CrsError(f"srs_id {srid} is not defined")
            wkt, flavor = (row[3], "V2") if row[3] and row[3] != "undefined" else (row[2], "V1")
            known = (row[0] or "").upper() == "EPSG"
            return Crs("EPSG" if known else row[0], str(row[1]), wkt if wkt and wkt != "undefined" else None, flavor)
        row = db.execute("SELECT auth_name, auth_srid, srtext FROM spatial_ref_sys WHERE srid = ?", (srid,)).fetchone()
        if row is None:
            raise CrsError(f"srid {srid} is not defined")
        return Crs((row[0] or "").upper() or None, str(row[1]), row[2] or None, "V1" if row[2] else None)

    def pick(self, layers: dict, wanted: str | None) -> str:
        if wanted:
            for t in layers:
                if t == wanted or (not self.gpkg and t.lower() == wanted.lower()):
                    return t
            raise SchemaError(f"no layer {wanted!r}; there are {sorted(layers)}")
        if len(layers) != 1:
            raise SchemaError(f"the file has {len(layers)} layers {sorted(layers)}; name one with ?table=")
        return next(iter(layers))

    def read(self, spark: SparkSession, uri: Uri, options: ReadOptions) -> DataFrame:
        with _connect(uri.path) as db:
            layers = self.layers(db)
            name = self.pick(layers, options.table or query_options(uri.raw).get("table"))
            geometry, shape, srid = layers[name]
            crs = options.src_crs or self.crs(db, srid)
            columns, fields = [], []
            for _, column, declared, not_null, _, pk in db.execute(f"PRAGMA table_info({quote(name)})"):
                if pk and (declared or "").upper() in ("INTEGER", "INT") or column == geometry:
                    continue  # the key is the rowid
                kind = spark_type(declared)
                columns.append((column, kind))
                fields.append(T.StructField(column, type_of(kind), not not_null))
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quote(name)}").fetchone()
            except sqlite3.OperationalError:
                raise SchemaError(f"{name} has no rowid") from None
        schema = T.StructType([*fields, T.StructField(geometry, T.BinaryType(), True)])
        shape = next((t for t in G.GEOMETRY_TYPES if t.upper() == str(shape).upper()), "Geometry")
        layer = {"path": os.path.abspath(uri.path), "table": name, "columns": columns, "geometry": geometry, "gpkg": self.gpkg}
        spans = ranged.ranges(low, high + 1, spark.sparkContext.defaultParallelism) if low is not None else [(0, 0)]
        df = ranged.load(spark, "sqlite", layer, schema, spans)
        return df.select(*[as_geometry(quoted(c), c, GeometryMeta(shape, crs)) if c == geometry else quoted(c) for c in df.columns])

    def read_query(self, spark: SparkSession, uri: Uri, sql: str) -> DataFrame:
        """SpatiaLite's query mode: types from the first row, the geometry is its first SpatiaLite blob; tasks read pages of its rows."""
        from ..operators.filters import validate_query

        validate_query(sql)
        with _connect(uri.path) as db:
            cursor = db.execute(f"SELECT * FROM ({sql}) AS x LIMIT 1")
            names, first = [c[0] for c in cursor.description], cursor.fetchone()
            (n,) = db.execute(f"SELECT count(*) FROM ({sql}) AS x").fetchone()
        if not first:
            raise SchemaError("the query has no rows to take types from")
        geometry = next((i for i, v in enumerate(first) if isinstance(v, bytes) and _is_blob(v)), None)
        if geometry is None:
            raise SchemaError("the query has no geometry column")
        kinds = ["bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "binary" if isinstance(v, bytes) else "string" for v in first]
        meta = GeometryMeta(G.wkb_type(G.spatialite_decode(first[geometry])[0]) or "Geometry")
        columns = [(names[i], kinds[i]) for i in range(len(names)) if i != geometry]
        layer = {"path": os.path.abspath(uri.path), "query": sql, "columns": columns, "geometry": names[geometry], "gpkg": False}
        schema = T.StructType([T.StructField(c, type_of(k)) for c, k in columns] + [T.StructField(names[geometry], T.BinaryType())])
        df = ranged.load(spark, "sqlite", layer, schema, ranged.ranges(0, n, spark.sparkContext.defaultParallelism))
        return df.select(*[as_geometry(quoted(c), c, meta) if c == names[geometry] else quoted(c) for c in df.columns])

    def srid_number(self, crs: Crs | None) -> int:
        """What srid_for() gives, without a file."""
        code = crs.epsg_code() if crs else None
        if code is not None and not -(2**31) <= code < 2**31:
            raise CrsError(f"EPSG:{code} is out of range")
        return code if code is not None else OWN_SRS if self.gpkg and crs is not None and crs.wkt else 0

    def srid_for(self, db, crs: Crs | None, policy: OnLoss) -> int:
        code = crs.epsg_code() if crs else None
        if code is not None:
            wkt = (crs.wkt if crs.wkt_flavor == "V1" else None) or crs_texts.WKT1.get(code, "undefined")
            if self.gpkg:
                db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, NULL)", (f"EPSG:{code}", code, code, wkt))
            else:
                db.execute("INSERT OR IGNORE INTO spatial_ref_sys VALUES (?, 'epsg', ?, ?, '', ?)", (code, code, f"EPSG:{code}", "" if wkt == "undefined" else wkt))
            return code
        if self.gpkg and crs is not None and crs.wkt:
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('custom', ?, 'NONE', ?, ?, NULL)", (OWN_SRS, OWN_SRS, crs.wkt))
            return OWN_SRS
        loss.apply_policy(f"missing-crs-on-{self.NAME}", "crs", policy)
        return 0

    def write(self, df: DataFrame, uri: Uri, options: WriteOptions) -> None:
        geometry, meta = require_geometry(df.schema)
        loss.check_table_strategy(options.overwrite, options.create_table)
        if options.create_index == CreateIndex.ALWAYS:
            raise DriverError(self.NAME, "a spatial index needs an SQLite extension, which is not used here")
        table = options.extra.get("table") or query_options(uri.raw).get("table") or table_name(os.path.splitext(os.path.basename(uri.path))[0]) or "features"
        df = loss.apply_plan(df, loss.plan_losses(df.schema, self.NAME, options.on_loss))
        names = [c for c in df.columns if c != geometry]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        declared = [(c, sqlite_type(kinds[c]), kinds[c]) for c in names]
        if self.gpkg or options.overwrite:
            files.refuse_existing(uri.path, options.overwrite, tuple(uri.path + s for s in ("-wal", "-shm", "-journal") if os.path.exists(uri.path + s)))
        before = uri.path if os.path.exists(uri.path) else None
        db = sqlite3.connect(before or ":memory:")
        try:  # what does not depend on rows is decided here
            exists = before and db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (table,)).fetchone()
        finally:
            db.close()
        if options.create_table == CreateTable.NEVER and not exists:
            raise SchemaError(f"table {table} does not exist")
        flavor, policy, create = self, options.on_loss, options.create_table
        plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType)
        odd = {i for i, c in enumerate(names) if not isinstance(kinds[c], plain)}
        shape, number = quoted(geometry), self.srid_number(meta.crs)
        blob = [st_as_gpkg(shape, number), st_bbox(shape)] if self.gpkg else [st_as_spatialite(shape, F.lit(number))]
        rows = df.select(*[quoted(c) for c in names], *[b.alias(f"_{i}") for i, b in enumerate(blob)])  # shapes are made by all tasks

        def put(batches, path):
            import shutil

            if before:
                shutil.copyfile(before, path)
            db = sqlite3.connect(path)
            db.execute("PRAGMA synchronous = OFF")
            flavor.prepare(db)
            srid = flavor.srid_for(db, meta.crs, policy)
            if exists and create == CreateTable.ALWAYS:
                db.execute(f"DROP TABLE {quote(table)}")
                db.execute("DELETE FROM geometry_columns WHERE f_table_name = ?", (table,))
            if not exists or create == CreateTable.ALWAYS:
                flavor.create(db, table, declared, geometry, meta.geometry_type, srid)
            sql = f"INSERT INTO {quote(table)} ({', '.join(map(quote, [*names, geometry]))}) VALUES ({', '.join('?' * (len(names) + 1))})"
            box, n = None, 0
            for batch in batches:
                columns = [[_stored(v) for v in c.to_pylist()] if i in odd else c.to_pylist() for i, c in enumerate(batch.columns[: len(names) + 1])]
                if flavor.gpkg and (own := _extent(batch.column(len(names) + 1))):
                    box = own if box is None else (*map(min, box[:2], own[:2]), *map(max, box[2:], own[2:]))
                db.executemany(sql, zip(*columns))
                n += batch.num_rows
            if flavor.gpkg and box:
                db.execute("UPDATE gpkg_contents SET min_x = ?, min_y = ?, max_x = ?, max_y = ? WHERE table_name = ?", (*box, table))
            db.commit()
            db.close()
            return n

        files.write_single(rows, uri.path, put)

    def prepare(self, db) -> None:
        if self.gpkg:
            db.execute(f"PRAGMA application_id = {APPLICATION_ID}")
            db.execute(f"PRAGMA user_version = {USER_VERSION}")
            db.executescript("""
                CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
                CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
                CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL);
                INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian SRS', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic SRS', 0, 'NONE', 0, 'undefined', NULL);
            """)
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, ?, NULL)", (crs_texts.WKT1[4326],))
        else:
            db.execute("CREATE TABLE IF NOT EXISTS spatial_ref_sys (srid INTEGER PRIMARY KEY, auth_name TEXT, auth_srid INTEGER, ref_sys_name TEXT, proj4text TEXT, srtext TEXT)")
            db.execute("CREATE TABLE IF NOT EXISTS geometry_columns (f_table_name TEXT, f_geometry_column TEXT, geometry_type INTEGER, coord_dimension INTEGER, srid INTEGER, spatial_index_enabled INTEGER DEFAULT 0, PRIMARY KEY (f_table_name, f_geometry_column))")

    def create(self, db, table, declared, geometry, shape, srid) -> None:
        key = "fid" if self.gpkg else "ogc_fid"
        shape_name = shape.upper() if self.gpkg else "BLOB"
        columns = [f"{quote(key)} INTEGER PRIMARY KEY AUTOINCREMENT", *[f"{quote(c)} {t}" for c, t, _ in declared], f"{quote(geometry)} {shape_name}"]
        db.execute(f"CREATE TABLE {quote(table)} ({', '.join(columns)})")
        if self.gpkg:
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (table, table, srid))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, 0, 0)", (table, geometry, shape.upper(), srid))
        else:
            db.execute("INSERT INTO geometry_columns VALUES (?, ?, ?, 2, ?, 0)", (table.lower(), geometry.lower(), G.GEOMETRY_TYPES.index(shape), srid))


def _is_blob(value: bytes) -> bool:
    try:
        G.spatialite_decode(value)
        return True
    except Exception:
        return False


def _extent(boxes: pa.StructArray) -> tuple | None:
    """Of boxes, some of them null or not finite."""
    sides = [boxes.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(4)]
    known = np.isfinite(sides).all(axis=0)
    return tuple(float(f(s[known])) for f, s in zip((np.min, np.min, np.max, np.max), sides)) if known.any() else None


def _stored(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, Decimal):
        return format(v, "f")
    return v


def batches(layer: dict, low: int, high: int):
    """Rows of rowid in [low, high) as Arrow batches; of a query those at these places."""
    from pyspark.sql.pandas.types import to_arrow_type

    decode = (lambda b: G.gpkg_decode(b)[0]) if layer["gpkg"] else (lambda b: G.spatialite_decode(b)[0])
    kinds = [pa.timestamp("us") if k == "timestamp_ntz" else to_arrow_type(type_of(k)) for _, k in layer["columns"]]
    names = [c for c, _ in layer["columns"]]
    with _connect(layer["path"]) as db:
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        shown = ", ".join(map(quote, [*names, layer["geometry"]]))
        if "query" in layer:  # the same file gives the rows of a query in the same order every time
            cursor = db.execute(f"SELECT {shown} FROM ({layer['query']}) AS x LIMIT ? OFFSET ?", (high - low, low))
        else:
            cursor = db.execute(f"SELECT {shown} FROM {quote(layer['table'])} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (low, high))
        while rows := cursor.fetchmany(ranged.ROWS // 4):
            columns = [pa.array([coerce(r[i], k) for r in rows], t) for i, ((_, k), t) in enumerate(zip(layer["columns"], kinds))]
            columns.append(pa.array([None if r[-1] is None else decode(r[-1]) for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*names, layer["geometry"]])


GPKG = Flavor("gpkg", ("gpkg",))
SPATIALITE = Flavor("spatialite", ("sqlite", "db", "spatialite"))
