"""Cutting the lineage of loops, and what loops share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only where none is set and all work is done here."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_graphloom_loops", None):
        sc._graphloom_loops = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return sc._graphloom_loops


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind, which else stay until the driver happens to collect its garbage."""
    with _lock:
        held = spark.__dict__.setdefault("_graphloom_swept", [0, None])
        if not held[0]:
            held[1] = spark.conf.get(_SWEEP, None)
            spark.conf.set(_SWEEP, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.unset(_SWEEP) if held[1] is None else spark.conf.set(_SWEEP, held[1])


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: the next round of a loop starts from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loop-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of dealt() gets, about, at most.
ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df of so many rows by its columns by, in more parts than the session's if one would have over ROWS rows."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def bucketed(df: DataFrame, rows: int, by: str) -> DataFrame:
    """cut(df), of so many rows; if they are more than ROWS, in buckets by a column, so that a loop's joins on it move only the other side."""
    spark = df.sparkSession
    if rows <= ROWS:
        return cut(df)
    name, parts = f"loop_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(parts, by).write.bucketBy(parts, by).option("path", path).saveAsTable(name)
    atexit.register(_drop, spark, path)
    return spark.table(name)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df by its columns by in as many parts as the session's: for rows that cost much more work than their bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM has gone
        pass
