"""Shared storage for intermediate tables.

Lineage is cut only with tables in the folder that the session names in
``spark.checkpoint.dir``: every executor and the driver can read them, so a
lost executor costs a reread and never a result.
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset in a
    local session a temporary folder takes its place and is set as the
    checkpoint folder of the context.  On a cluster it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="verdance-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/verdance/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    note(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def note(path: str) -> None:
    """Enter a table in the lists of all open ``recorded`` blocks of this thread."""
    for made in getattr(_scopes, "open", []):
        made.append(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are written inside the block, for the caller to drop once nothing reads them any more."""
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield made
    finally:
        _scopes.open = [x for x in _scopes.open if x is not made]


def release(spark: SparkSession) -> None:
    """Have both garbage collectors run, on which Spark drops the shuffle files of plans that nobody holds any more; by itself it asks for that every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_tables(spark: SparkSession, made: list[str]) -> None:
    """Delete the tables of a list and unused shuffle files, empty the list, and take its tables off all open lists."""
    gone = set(made)
    for path in gone:
        drop_path(spark, path)
    for held in [made, *getattr(_scopes, "open", [])]:
        held[:] = [x for x in held if x not in gone]
    release(spark)


def result_only(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, as a table, without the tables that it made on the way."""
    with recorded() as made:
        out = build()
    out = materialize(out, label)
    drop_tables(spark, made)
    return out
