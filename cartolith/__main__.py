"""Command line: convert, info, schema, drivers. Errors go to standard error with status 1."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from .model import CreateIndex, CreateTable, Crs, LayerError, OnLoss, ReadOptions, WriteOptions, log, parse_uri
from .plans import convert as P


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cartolith", description=__doc__)
    top.add_argument("-v", "--verbose", action="count", default=0)
    top.add_argument("-q", "--quiet", action="store_true")
    verbs = top.add_subparsers(dest="verb", required=True)
    c = verbs.add_parser("convert")
    c.add_argument("src")
    c.add_argument("dst")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--partitioned", action="store_true")
    c.add_argument("--create-table", choices=[x.value for x in CreateTable], default=CreateTable.IF_NOT_EXISTS.value)
    c.add_argument("--create-index", choices=[x.value for x in CreateIndex], default=CreateIndex.AUTO.value)
    c.add_argument("--on-loss", choices=[x.value for x in OnLoss], default=OnLoss.ERROR.value)
    c.add_argument("--encoding")
    c.add_argument("--batch-size", type=int)
    c.add_argument("--src-crs")
    c.add_argument("--reproject")
    c.add_argument("--insert-mode", choices=["auto", "bulk", "batch"], default="auto")
    c.add_argument("--where")
    c.add_argument("--select")
    c.add_argument("--query")
    for name in ("info", "schema"):
        v = verbs.add_parser(name)
        v.add_argument("src")
        v.add_argument("--src-crs")
        if name == "schema":
            v.add_argument("--format", choices=["json", "text"], default="json")
            v.add_argument("--pretty", action="store_true")
    d = verbs.add_parser("drivers")
    d.add_argument("--format", choices=["json", "text"], default="text")
    d.add_argument("--pretty", action="store_true")
    return top


def run(spark, a: argparse.Namespace) -> str:
    """Does what the arguments say; returns the text to print."""
    if a.verb == "drivers":
        rows = [{"name": d.NAME, "schemes": list(d.SCHEMES), "capabilities": d.CAPABILITIES.to_dict()} for d in P.registry.drivers()]
        return json.dumps(rows, indent=2 if a.pretty else None) if a.format == "json" else "\n".join(f"{r['name']}: {', '.join(r['schemes'])}" for r in rows)
    crs = Crs.parse(a.src_crs) if a.src_crs else None
    if a.verb == "convert":
        if a.query and (a.where or a.select):
            raise LayerError("--query excludes --where and --select")
        read = ReadOptions(crs, a.where, tuple(x.strip() for x in a.select.split(",")) if a.select else None, a.query, a.encoding)
        write = WriteOptions(a.overwrite, OnLoss(a.on_loss), CreateTable(a.create_table), CreateIndex(a.create_index), a.encoding, a.batch_size, a.insert_mode, a.partitioned)
        P.convert(spark, a.src, a.dst, read, write, a.reproject)
        return ""
    if a.verb == "info":
        return "\n".join(f"{r['key']}: {r['value']}" for r in P.info(spark, a.src, ReadOptions(crs)).collect())
    df = P.read_layer(spark, a.src, ReadOptions(crs))
    if a.format == "json":
        return P.schema_json(df, P.registry.select_driver(parse_uri(a.src)).NAME, a.pretty)
    return "\n".join(f"{r['ordinal']} {r['name']}: {r['data_type']} {(r['metadata'] or '')[:100]}".rstrip() for r in P.schema_frame(df).collect())


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig()
    log.setLevel(logging.ERROR if a.quiet else [logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("cartolith").getOrCreate()
        if text := run(spark, a):
            print(text)
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
