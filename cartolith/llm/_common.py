"""What the corpus operators share: shared storage, sizing and the Python path of executors."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + os.path.join(tempfile.gettempdir(), "cartolith-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs no more than the tasks it ran, and gives the
    optimiser real sizes. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cartolith/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._written_to)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done: its cleaner does so when the driver's memory is collected,
    which may be long after."""
    gc.collect()  # lets go of the plans that Python holds
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(df: DataFrame, key: str, n: int) -> list:
    """The n rows of df with the smallest keys, at the driver: no more, however many keys tie.

    The key is a hash of all that tells rows apart, so that rows of one key are alike. The keys are ranked first,
    by themselves, so that no task sends more than n numbers; then only the rows wanted are read.
    """
    keys = [r[0] for r in df.select(key).orderBy(key).limit(n).collect()]
    if not keys:
        return []
    last = keys[-1]
    return df.where(F.col(key) < last).collect() + df.where(F.col(key) == last).limit(keys.count(last)).collect()


def fresh(name: str, columns) -> str:
    """A column name that is not in columns (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shards_for(rows: int, per_shard: int) -> int:
    """How many shards of about per_shard rows hold so many rows: grows with the input, at least 1."""
    return max(1, -(-rows // per_shard))


def by_hash(column, shards: int):
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")
