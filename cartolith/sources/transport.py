"""Connections to databases, opened by the driver and by tasks.

A connector is a function, named "module:function" so that tasks can import it, that takes an address and gives an
object with rows(sql), run(sql, parameters), copy(sql, chunks), commit() and close(). CONNECTORS has one for each kind
of database; it needs that database's Python driver, which this repository does not bring.
"""

from __future__ import annotations

import importlib
from contextlib import contextmanager

from ..model import DriverError

CONNECTORS = {"pg": "cartolith.sources.transport:postgres", "mssql": "cartolith.sources.transport:sqlserver"}


class Connection:
    """Over a DB-API connection."""

    def __init__(self, connection):
        self.connection, self.cursor = connection, connection.cursor()

    def rows(self, sql: str) -> list[tuple]:
        self.cursor.execute(sql)
        return self.cursor.fetchall()

    def run(self, sql: str, parameters=()) -> None:
        self.cursor.execute(sql, *([parameters] if parameters else []))

    def copy(self, sql: str, chunks) -> None:
        with self.cursor.copy(sql) as out:
            for chunk in chunks:
                out.write(chunk)

    def commit(self) -> None:
        self.connection.commit()

    def close(self) -> None:
        self.connection.close()


def _module(name: str, kind: str):
    try:
        return importlib.import_module(name)
    except ImportError:
        raise DriverError(kind, f"needs the Python module {name}, or another connector") from None


def postgres(a) -> Connection:
    psycopg = _module("psycopg", "postgis")
    # numbered parameters ($1) as the statements have them
    return Connection(psycopg.connect(host=a.host, port=a.port, dbname=a.database, user=a.user, password=a.password, cursor_factory=psycopg.RawCursor))


def sqlserver(a) -> Connection:
    pyodbc = _module("pyodbc", "sqlserver")
    login = "Trusted_Connection=yes" if a.options.get("trusted_connection", "").lower() in ("yes", "true", "1") else f"UID={a.user};PWD={{{(a.password or '').replace('}', '}}')}}}"
    if a.options.get("auth"):
        login += f";Authentication={a.options['auth']}"
    return Connection(pyodbc.connect(f"Driver={{ODBC Driver 18 for SQL Server}};Server={a.host},{a.port};Database={a.database};{login};TrustServerCertificate=yes"))


@contextmanager
def connected(connector: str, a):
    """A connection; what was not committed is undone."""
    module, _, function = connector.partition(":")
    connection = getattr(importlib.import_module(module), function)(a)
    try:
        yield connection
    finally:
        connection.close()
