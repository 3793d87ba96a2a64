"""Exact-path output files and plain row sinks shared by the writers.

A single output file is written by one task under a temporary name next to its place and renamed by the
driver, so that a task that runs twice or fails leaves no half-written file; executors and driver must share
that folder. Directory outputs (partitioned=True) keep one file for each partition and scale with the cluster.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid

from pyspark.sql import DataFrame

from ..model import IoError


def refuse_existing(path: str, overwrite: bool, also: tuple = ()) -> None:
    for p in (path, *also):
        if os.path.exists(p):
            if not overwrite:
                raise IoError(f"{p} exists; overwrite is off")
            shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)


def write_single(df: DataFrame, path: str, write, suffixes: tuple = ("",)) -> int:
    """write(batches, temporary path) runs in one task and returns the rows; all files path + suffix are renamed.

    What the rows are made of runs in as many tasks as df has: each leaves its rows in an Arrow file next to the path,
    and the one task reads those in the order of the partitions.
    """
    stem = f"{path}.{uuid.uuid4().hex}"

    def spill(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, writer = f"{stem}.{uuid.uuid4().hex}.part", None
        for batch in batches:
            writer = writer or pa.ipc.new_stream(part, batch.schema)
            writer.write_batch(batch)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([part])], ["id", "file"])

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        parts = [r["file"] for r in sorted(df.mapInArrow(spill, "id long, file string").collect())]

        def run(batches):
            import pyarrow as pa

            for _ in batches:
                pass

            def rows():
                for part in parts:
                    with pa.OSFile(part) as f:
                        yield from pa.ipc.open_stream(f)

            temporary = f"{stem}.{uuid.uuid4().hex}.tmp"
            n = write(rows(), temporary)
            yield pa.RecordBatch.from_arrays([pa.array([temporary]), pa.array([n], pa.int64())], ["file", "rows"])

        (made,) = df.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "file string, rows long").collect()
    finally:
        for part in glob.glob(glob.escape(stem) + ".*.part"):
            os.remove(part)
    for suffix in suffixes:
        if os.path.exists(made["file"] + suffix):
            os.replace(made["file"] + suffix, path + suffix)
    return made["rows"]


def scratch(spark, name: str) -> str:
    """A path for an intermediate file that executors and driver share: in spark.checkpoint.dir where that is set."""
    import tempfile
    from urllib.parse import urlsplit

    base = urlsplit(spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir())
    if base.scheme not in ("", "file"):
        raise IoError(f"{base.geturl()} is no folder that Python can write to; layers of single files need one")
    folder = f"{base.path}/cartolith-layers/{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}"
