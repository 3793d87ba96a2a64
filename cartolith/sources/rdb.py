"""PostGIS and SQL Server: addresses, SQL texts, COPY BINARY, reading in pages and writing by tasks.

Connections come from transport.py. A write runs the table statements, lets every task fill a stage table of its own
(COPY BINARY or INSERT, one transaction a task), and moves the stages of the tasks that count into the table in one
transaction: a task that is lost and runs again leaves no row twice, a failed write none at all. A read asks the
catalogue for columns, SRID and geometry type, and reads pages of an ordered table, or the whole of an unordered query.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import struct
import uuid
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import codecs as G
from ..model import Capabilities, CreateIndex, CreateTable, CrsError, DriverError, FormatError, GeometryMeta, OnLoss, ReadOptions, SchemaError, Crs, Uri, WriteOptions, as_geometry, percent_decode, query_options, quoted, require_geometry, type_of
from ..operators import loss
from ..operators.filters import validate_query
from ..operators.text import rows_in_statement
from . import ranged
from .transport import CONNECTORS, connected

CAPABILITIES = Capabilities(bulk_load=True, supports_blob=True, supports_decimal=True, max_decimal_precision=38)
PG_EPOCH_DAYS, PG_EPOCH_US = 10_957, 946_684_800_000_000
COPY_HEADER, COPY_TRAILER = b"PGCOPY\n\xff\r\n\0" + bytes(8), b"\xff\xff"


@dataclass(frozen=True)
class Address:
    kind: str
    host: str
    port: int
    database: str
    user: str | None
    password: str | None
    schema: str
    table: str | None
    options: dict


def split_table(name: str, default: str) -> tuple[str, str]:
    """schema and table at the first dot."""
    a, dot, b = name.partition(".")
    return (a, b) if dot else (default, name)


def parse_address(raw: str) -> Address:
    u = urlsplit(raw)
    kind = {"postgres": "pg", "postgresql": "pg"}.get(u.scheme.lower(), u.scheme.lower())
    if kind not in ("pg", "mssql"):
        raise FormatError(f"no database address: {raw!r}")
    options = query_options(raw)
    database = percent_decode(u.path.strip("/"))
    if not u.hostname or not database:
        raise FormatError("an address needs a host and a database")
    default = "public" if kind == "pg" else "dbo"
    schema, table = split_table(options["table"], default) if options.get("table") else (options.get("schema", default), None)
    decode = lambda x: percent_decode(x) if x is not None else None
    return Address(kind, u.hostname, u.port or {"pg": 5432, "mssql": 1433}[kind], database, decode(u.username), decode(u.password), schema, table, options)


def quote(name: str, kind: str = "pg") -> str:
    return "[" + name.replace("]", "]]") + "]" if kind == "mssql" else '"' + name.replace('"', '""') + '"'


def literal(value: str, kind: str = "pg") -> str:
    return ("N" if kind == "mssql" else "") + "'" + value.replace("'", "''") + "'"


def qualified(a: Address) -> str:
    return f"{quote(a.schema, a.kind)}.{quote(a.table or '', a.kind)}"


PG_TYPES = ((T.BooleanType, "boolean"), (T.ShortType, "smallint"), (T.IntegerType, "integer"), (T.LongType, "bigint"), (T.FloatType, "real"), (T.DoubleType, "double precision"), (T.StringType, "text"), (T.BinaryType, "bytea"), (T.DateType, "date"), (T.TimestampNTZType, "timestamp"), (T.TimestampType, "timestamptz"))
MSSQL_TYPES = ((T.BooleanType, "bit"), (T.ShortType, "smallint"), (T.IntegerType, "int"), (T.LongType, "bigint"), (T.FloatType, "real"), (T.DoubleType, "float"), (T.StringType, "nvarchar(max)"), (T.BinaryType, "varbinary(max)"), (T.DateType, "date"), (T.TimestampNTZType, "datetime2"), (T.TimestampType, "datetimeoffset"))


def column_type(kind: T.DataType, database: str) -> str:
    if isinstance(kind, T.DecimalType):
        return f"{'numeric' if database == 'pg' else 'decimal'}({kind.precision},{kind.scale})"
    for cls, name in PG_TYPES if database == "pg" else MSSQL_TYPES:
        if isinstance(kind, cls):
            return name
    raise SchemaError(f"{database} cannot hold {kind.simpleString()}")


def spark_type(declared: str, database: str) -> str:
    """Spark type of a database type; numeric without precision is decimal(38,0)."""
    base, _, rest = declared.strip().lower().partition("(")
    base = base.strip()
    if base in ("numeric", "decimal"):
        parts = [p.strip() for p in rest.rstrip(")").split(",")] if rest else []
        ok = all(p.isdigit() for p in parts) and 0 < len(parts) <= 2 and 0 < int(parts[0]) <= 38
        return f"decimal({parts[0]},{parts[1] if len(parts) > 1 else 0})" if ok else "decimal(38,0)"
    names = {
        "pg": {"bool": "boolean", "boolean": "boolean", "int2": "smallint", "smallint": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "bigint": "bigint", "float4": "float", "real": "float", "float8": "double", "double precision": "double", "text": "string", "varchar": "string", "bpchar": "string", "name": "string", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp"},
        "mssql": {"bit": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint", "real": "float", "float": "double", "char": "string", "varchar": "string", "nchar": "string", "nvarchar": "string", "text": "string", "ntext": "string", "binary": "binary", "varbinary": "binary", "image": "binary", "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz", "datetimeoffset": "timestamp"},
    }[database]
    if base not in names:
        raise SchemaError(f"{database} type {declared!r} is not supported")
    return names[base]


def srid_for(meta: GeometryMeta, database: str, policy: OnLoss, geography: bool = False) -> int:
    code = meta.crs.epsg_code() if meta.crs else None
    if code is None:
        loss.apply_policy("missing-crs-on-" + {"pg": "postgis", "mssql": "sqlserver"}[database], "crs", policy)
        return 4326 if geography else 0
    if code >= 2**31:
        raise CrsError(f"EPSG:{code} is out of range")
    return code


def create_table_sql(a: Address, schema: T.StructType, srid: int) -> str:
    geometry, meta = require_geometry(schema)
    columns = [f"{quote(f.name, a.kind)} {column_type(f.dataType, a.kind)}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields if f.name != geometry]
    shape = f"geometry({meta.geometry_type},{srid})" if a.kind == "pg" else a.options.get("geom_type", "geometry")
    return f"CREATE TABLE {qualified(a)} ({', '.join([*columns, f'{quote(geometry, a.kind)} {shape}'])})"


def table_statements(a: Address, schema: T.StructType, srid: int, exists: bool, options: WriteOptions) -> list[str]:
    """What the create-table strategy does before rows are written."""
    loss.check_table_strategy(options.overwrite, options.create_table)
    create, drop = create_table_sql(a, schema, srid), f"DROP TABLE {qualified(a)}"
    if not exists:
        if options.create_table == CreateTable.NEVER:
            raise SchemaError(f"table {a.table} does not exist")
        return [create]
    if options.overwrite:
        return [drop, create]
    if options.create_table == CreateTable.ALWAYS:
        if a.kind == "pg":
            raise SchemaError(f"table {a.table} exists")
        return [drop, create]
    return []


def index_statements(a: Address, geometry: str, srid: int, created: bool, strategy: CreateIndex) -> list[str]:
    name = quote(f"{a.table}_{geometry}_idx", a.kind)
    if a.kind == "pg":
        wanted = strategy == CreateIndex.ALWAYS or strategy == CreateIndex.AUTO and created
        return [f"CREATE INDEX {name} ON {qualified(a)} USING GIST ({quote(geometry)})"] if wanted else []
    if strategy != CreateIndex.ALWAYS:
        return []
    sql = f"CREATE SPATIAL INDEX {name} ON {qualified(a)} ({quote(geometry, 'mssql')})"
    if a.options.get("geom_type", "geometry") == "geography":
        return [sql]
    box = {4326: "-180, -90, 180, 90", 3857: "-20037508.34, -20037508.34, 20037508.34, 20037508.34"}.get(srid)
    if box is None:
        raise DriverError("sqlserver", f"no bounding box for an index in EPSG:{srid}")
    return [f"{sql} WITH (BOUNDING_BOX = ({box}))"]


def select_sql(a: Address, columns: list[str], geometry: str, where: str | None = None) -> str:
    """The read statement, with the geometry as EWKB (pg) or WKB and SRID (mssql), where it stands in the list."""
    q = lambda c: quote(c, a.kind)
    shown = lambda c: q(c) if c != geometry else f"ST_AsEWKB({q(c)}) AS {q(c)}" if a.kind == "pg" else f"{q(c)}.STAsBinary() AS {q(c)}"
    sql = f"SELECT {', '.join(map(shown, columns))} FROM {qualified(a)}"
    return sql + (f" WHERE {where}" if where and where.strip() else "")


def query_sql(sql: str, columns: list[str], geometry: str) -> str:
    validate_query(sql)
    shown = [f"ST_AsEWKB({quote(c)}) AS {quote(c)}" if c == geometry else quote(c) for c in columns]
    return f"SELECT {', '.join(shown)} FROM ({sql}) AS x"


def insert_sql(a: Address, columns: list[str], geometry: str, rows: int) -> str:
    names = ", ".join(quote(c, a.kind) for c in [*columns, geometry])
    if a.kind == "pg":
        width = len(columns) + 1
        values = [f"({', '.join(f'${r * width + i + 1}' + ('::geometry' if i == width - 1 else '') for i in range(width))})" for r in range(rows)]
    else:
        width, shape = len(columns) + 2, a.options.get("geom_type", "geometry")
        values = [f"({', '.join([*[f'@P{r * width + i + 1}' for i in range(width - 2)], f'{shape}::STGeomFromWKB(@P{r * width + width - 1}, @P{r * width + width})'])})" for r in range(rows)]
    return f"INSERT INTO {qualified(a)} ({names}) VALUES {', '.join(values)}"


def insert_rows(kind: str, attributes: int) -> int:
    return rows_in_statement(32_767, 16, attributes + 1) if kind == "pg" else rows_in_statement(2_100, 16, attributes + 2)


def copy_sql(a: Address, columns: list[str], geometry: str) -> str:
    return f"COPY {qualified(a)} ({', '.join(quote(c) for c in [*columns, geometry])}) FROM STDIN (FORMAT BINARY)"


def staging_statements(a: Address, schema: T.StructType, srid: int, stage: str | None = None) -> dict[str, str]:
    """SQL Server's bulk path: a staging table, then INSERT .. SELECT with STGeomFromWKB."""
    geometry, _ = require_geometry(schema)
    attributes = [f for f in schema.fields if f.name != geometry]
    names, stage = [quote(f.name, "mssql") for f in attributes], quote(stage or f"#{a.table}_staging", "mssql")
    shape, g = a.options.get("geom_type", "geometry"), quote(geometry, "mssql")
    columns = [f"{n} {column_type(f.dataType, 'mssql')} NULL" for n, f in zip(names, attributes)] + [f"{g} varbinary(max) NULL"]
    return {
        "create": f"CREATE TABLE {stage} ({', '.join(columns)})",
        "move": f"INSERT INTO {qualified(a)} ({', '.join([*names, g])}) SELECT {', '.join([*names, f'CASE WHEN {g} IS NULL THEN NULL ELSE {shape}::STGeomFromWKB({g}, {srid}) END'])} FROM {stage}",
        "truncate": f"TRUNCATE TABLE {stage}",
    }


def numeric_bytes(value: Decimal, scale: int) -> bytes:
    """COPY's numeric: base-10000 digits around the decimal point, more digits than scale are cut off."""
    if not value.is_finite():
        raise SchemaError("NaN is no numeric")
    sign, digits, exponent = value.as_tuple()
    unscaled = int("".join(map(str, digits)))
    shift = exponent + scale
    unscaled = unscaled * 10**shift if shift >= 0 else unscaled // 10**-shift
    if unscaled >= 10**38:
        raise SchemaError("numeric overflow")
    if unscaled == 0:
        return struct.pack(">hhHH", 0, 0, 0, scale)
    pad = -scale % 4
    n, groups = unscaled * 10**pad, []
    while n:
        n, low = divmod(n, 10_000)
        groups.append(low)
    weight = len(groups) - 1 - (scale + pad) // 4
    while groups and groups[0] == 0:
        groups.pop(0)
    return struct.pack(f">hhHH{len(groups)}h", len(groups), weight, 0x4000 if sign else 0, scale, *reversed(groups))


def field_bytes(value, kind: T.DataType) -> bytes:
    """One COPY field with its length; null is -1."""
    if value is None:
        return struct.pack(">i", -1)
    if isinstance(kind, T.DecimalType):
        data = numeric_bytes(value, kind.scale)
    elif isinstance(kind, T.DateType):
        data = struct.pack(">i", (value - dt.date(1970, 1, 1)).days - PG_EPOCH_DAYS)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        delta = value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)
        data = struct.pack(">q", (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds - PG_EPOCH_US)
    elif isinstance(kind, T.StringType):
        data = value.encode("utf-8")
    elif isinstance(kind, T.BinaryType):
        data = bytes(value)
    else:
        form = {T.BooleanType: "?", T.ShortType: "h", T.IntegerType: "i", T.LongType: "q", T.FloatType: "f", T.DoubleType: "d"}.get(type(kind))
        if form is None:
            raise SchemaError(f"COPY cannot hold {kind.simpleString()}")
        data = struct.pack(">" + form, value)
    return struct.pack(">i", len(data)) + data


def copy_row(values, kinds, wkb: bytes | None, srid: int) -> bytes:
    shape = struct.pack(">i", -1) if wkb is None else field_bytes(G.ewkb_encode(wkb, srid) if srid else wkb, T.BinaryType())
    return struct.pack(">h", len(values) + 1) + b"".join(map(field_bytes, values, kinds)) + shape


def encode_copy(df: DataFrame, srid: int, chunk: int = 65_536) -> DataFrame:
    """COPY BINARY payload in chunks of about so many bytes (a row a chunk: 1), made in parallel; header and trailer go around all of them."""
    geometry, _ = require_geometry(df.schema)
    names, kinds = [f.name for f in df.schema.fields if f.name != geometry], [f.dataType for f in df.schema.fields if f.name != geometry]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names] or [[]]
            chunks, now = [], bytearray()
            for i, wkb in enumerate(batch.column(geometry).to_pylist()):
                now += copy_row([c[i] for c in columns] if names else [], kinds, wkb, srid)
                if len(now) >= chunk:
                    chunks.append(bytes(now))
                    now.clear()
            yield pa.RecordBatch.from_arrays([pa.array([*chunks, bytes(now)] if now else chunks, pa.binary())], ["chunk"])

    return df.mapInArrow(run, "chunk binary")


def columns_sql(a: Address) -> str:
    """Name, type, precision and scale of the table's columns."""
    kind = "udt_name" if a.kind == "pg" else "data_type"
    where = f"table_schema = {literal(a.schema, a.kind)} AND table_name = {literal(a.table or '', a.kind)}"
    return f"SELECT column_name, {kind}, numeric_precision, numeric_scale FROM information_schema.columns WHERE {where} ORDER BY ordinal_position"


def geometry_statements(a: Address, geometry: str) -> list[str]:
    """SRID and geometry type: what the catalogue says, then what the first value says."""
    g, table = quote(geometry, a.kind), qualified(a)
    if a.kind == "mssql":
        return [f"SELECT TOP 1 {g}.STSrid, {g}.STGeometryType() FROM {table} WHERE {g} IS NOT NULL"]
    where = f"f_table_schema = {literal(a.schema)} AND f_table_name = {literal(a.table or '')} AND f_geometry_column = {literal(geometry)}"
    return [f"SELECT srid, type FROM geometry_columns WHERE {where}", f"SELECT ST_SRID({g}), GeometryType({g}) FROM {table} WHERE {g} IS NOT NULL LIMIT 1"]


def page_sql(kind: str, sql: str, order: str, low: int, high: int) -> str:
    if kind == "pg":
        return f"{sql} ORDER BY {order} LIMIT {high - low} OFFSET {low}"
    return f"{sql} ORDER BY {order} OFFSET {low} ROWS FETCH NEXT {high - low} ROWS ONLY"


def batches(layer: dict, low: int, high: int):
    """Rows [low, high) of a layer that Database.read() described, or all rows without an order."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    a = Address(**layer["address"])
    sql = page_sql(a.kind, layer["sql"], layer["order"], low, high) if layer["order"] else layer["sql"]
    with connected(layer["connector"], a) as db:
        rows = db.rows(sql) if high > low else []
    columns = []
    for i, (name, kind) in enumerate(layer["columns"]):
        values = [r[i] for r in rows]
        if name == layer["geometry"]:
            values = [None if v is None else bytes(v) if a.kind == "mssql" else G.ewkb_strip(bytes(v))[0] for v in values]
        elif kind.startswith("decimal"):
            places = Decimal(1).scaleb(-type_of(kind).scale)
            values = [None if v is None else Decimal(v).quantize(places) for v in values]
        columns.append(pa.array(values, to_arrow_type(type_of(kind))))
    yield pa.RecordBatch.from_arrays(columns, [n for n, _ in layer["columns"]])


def _params(kind: str, values: tuple, wkb: bytes | None, srid: int) -> tuple:
    if kind == "mssql":
        return (*values, wkb, srid)
    return (*values, None if wkb is None else G.ewkb_encode(wkb, srid) if srid else wkb)


class Database:
    def __init__(self, name: str, scheme: str):
        self.NAME, self.SCHEMES, self.CAPABILITIES, self.kind = name, (scheme,), CAPABILITIES, scheme

    def _connector(self, extra: dict) -> str:
        return extra.get("connector", CONNECTORS[self.kind])

    def _described(self, db, a: Address, options: ReadOptions) -> list[tuple[str, str]]:
        """Names and Spark types of all columns; a geometry's type is geometry."""
        if options.query:
            validate_query(options.query)
            view = dataclasses.replace(a, schema="pg_temp", table="cartolith_query")
            db.run(f"CREATE TEMP VIEW {quote(view.table)} AS {options.query}")
            rows = db.rows(columns_sql(view).replace("table_schema = 'pg_temp'", "table_schema LIKE 'pg_temp%'"))
        else:
            rows = db.rows(columns_sql(a))
        if not rows:
            raise SchemaError(f"no table {a.table}")
        out = []
        for name, kind, precision, scale in rows:
            if kind.lower() in ("geometry", "geography"):
                out.append((name, "geometry"))
            else:
                exact = kind.lower() in ("numeric", "decimal") and precision
                out.append((name, spark_type(f"{kind}({precision},{scale or 0})" if exact else kind, self.kind)))
        return out

    def read(self, spark: SparkSession, uri: Uri, options: ReadOptions) -> DataFrame:
        """extra: connector; order_by, an SQL expression that orders rows without ties, for pages of a query or an SQL Server table."""
        a = parse_address(uri.raw)
        if self.kind == "mssql" and (options.where or options.select or options.query):
            raise DriverError(self.NAME, "where, select and query are not supported")
        if options.query and (options.where or options.select):
            raise SchemaError("query excludes where and select")
        connector, crs, shape = self._connector(options.extra), options.src_crs, "Geometry"
        with connected(connector, a) as db:
            columns = self._described(db, a, options)
            if options.select:
                known = dict(columns)
                missing = [c for c in options.select if c not in known]
                if missing:
                    raise SchemaError(f"no columns {missing}")
                columns = [(c, known[c]) for c in options.select]
            geometry = next((n for n, k in columns if k == "geometry"), None)
            if geometry is None:
                raise SchemaError("no geometry column")
            names = [n for n, _ in columns]
            sql = query_sql(options.query, names, geometry) if options.query else select_sql(a, names, geometry, options.where)
            for statement in [] if options.query else geometry_statements(a, geometry):
                found = db.rows(statement)
                if found and found[0][0]:
                    crs = crs or Crs.epsg(int(found[0][0]))
                    shape = next((x for x in G.GEOMETRY_TYPES if x.upper() == str(found[0][1]).upper()), "Geometry")
                    break
            order = options.extra.get("order_by") or ("ctid" if self.kind == "pg" and not options.query else None)
            (n,) = db.rows(f"SELECT count(*) FROM ({sql}) AS x")[0] if order else (1,)
        kinds = [(c, "binary" if c == geometry else k) for c, k in columns]
        layer = {"address": dataclasses.asdict(a), "connector": connector, "sql": sql, "order": order, "columns": kinds, "geometry": geometry}
        schema = T.StructType([T.StructField(c, type_of(k)) for c, k in kinds])
        df = ranged.load(spark, "rdb", layer, schema, ranged.ranges(0, n, spark.sparkContext.defaultParallelism))
        meta = GeometryMeta(shape, crs)
        return df.select(*[as_geometry(quoted(c), c, meta) if c == geometry else quoted(c) for c in df.columns])

    def write(self, df: DataFrame, uri: Uri, options: WriteOptions) -> None:
        """extra: connector. insert_mode auto and bulk use COPY or a staging table of WKB, batch uses INSERT."""
        a, schema = parse_address(uri.raw), df.schema
        if a.table is None:
            raise SchemaError("an address to write to needs a table")
        geometry, meta = require_geometry(schema)
        srid = srid_for(meta, self.kind, options.on_loss, a.options.get("geom_type") == "geography")
        connector, bulk, run_id = self._connector(options.extra), options.insert_mode != "batch", uuid.uuid4().hex[:12]
        names = [f.name for f in schema.fields if f.name != geometry]
        columns = ", ".join(quote(c, a.kind) for c in [*names, geometry])
        with connected(connector, a) as db:
            exists = bool(db.rows(columns_sql(a)))
            created = table_statements(a, schema, srid, exists, options)
            for statement in created:
                db.run(statement)
            db.commit()
        load = _loader(a, schema, srid, connector, bulk, options.batch_size or insert_rows(self.kind, len(names)), run_id)
        made = df.mapInArrow(load, "stage string, rows long").collect()
        with connected(connector, a) as db:
            for stage in [r["stage"] for r in made]:
                if a.kind == "mssql" and bulk:
                    db.run(staging_statements(a, schema, srid, stage)["move"])
                else:
                    db.run(f"INSERT INTO {qualified(a)} ({columns}) SELECT {columns} FROM {qualified(dataclasses.replace(a, table=stage))}")
                db.run(f"DROP TABLE {qualified(dataclasses.replace(a, table=stage)) if not (a.kind == 'mssql' and bulk) else quote(stage, a.kind)}")
            for statement in index_statements(a, geometry, srid, bool(created), options.create_index):
                db.run(statement)
            db.commit()


def _loader(a: Address, schema: T.StructType, srid: int, connector: str, bulk: bool, batch: int, run_id: str):
    """What a task does with its rows: fill a stage table of its own in one transaction, and tell its name."""
    geometry, _ = require_geometry(schema)
    names, kinds = [f.name for f in schema.fields if f.name != geometry], [f.dataType for f in schema.fields if f.name != geometry]

    def rows_of(batches):
        for b in batches:
            values = [b.column(c).to_pylist() for c in names]
            for i, wkb in enumerate(b.column(geometry).to_pylist()):
                yield tuple(v[i] for v in values), wkb

    def payload(rows):
        now = bytearray(COPY_HEADER)
        for values, wkb in rows:
            now += copy_row(list(values), kinds, wkb, srid)
            if len(now) >= 65_536:
                yield bytes(now)
                now.clear()
        yield bytes(now) + COPY_TRAILER

    def run(arriving):
        import itertools

        import pyarrow as pa
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        stage = f"{a.table}_{run_id}_{task.partitionId()}_{task.taskAttemptId()}"
        at = dataclasses.replace(a, table=stage)

        def counted():
            nonlocal n
            for row in rows_of(arriving):
                n += 1
                yield row

        with connected(connector, a) as db:
            if a.kind == "pg":
                db.run(f"CREATE TABLE {qualified(at)} (LIKE {qualified(a)})")
            elif bulk:
                db.run(staging_statements(a, schema, srid, stage)["create"])
            else:
                db.run(f"SELECT TOP 0 * INTO {qualified(at)} FROM {qualified(a)}")
            if a.kind == "pg" and bulk:
                db.copy(copy_sql(at, names, geometry), payload(counted()))
            else:
                rows = counted()
                while part := list(itertools.islice(rows, batch)):
                    if bulk:
                        marks = ", ".join(f"({', '.join('?' for _ in range(len(names) + 1))})" for _ in part)
                        sql = f"INSERT INTO {quote(stage, a.kind)} ({', '.join(quote(c, a.kind) for c in [*names, geometry])}) VALUES {marks}"
                        db.run(sql, tuple(v for values, wkb in part for v in (*values, wkb)))
                    else:
                        db.run(insert_sql(at, names, geometry, len(part)), tuple(v for values, wkb in part for v in _params(a.kind, values, wkb, srid)))
            db.commit()
        yield pa.RecordBatch.from_arrays([pa.array([stage]), pa.array([n], pa.int64())], ["stage", "rows"])

    return run


POSTGIS = Database("postgis", "pg")
SQLSERVER = Database("sqlserver", "mssql")
