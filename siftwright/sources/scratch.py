"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) gets a folder of its own; on a cluster it is an error, since
    executors would not see the driver's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_siftwright_scratch", None)
        if path is None:
            if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = spark._siftwright_scratch = tempfile.mkdtemp(prefix="siftwright-")
            atexit.register(shutil.rmtree, path, True)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftwright/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def _shuffles_end_with_the_query(spark: SparkSession):
    """Inside, a query's shuffle files go as soon as it ends: what it wrote is a table, nothing reads them again."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    A lost executor costs a re-read of these files, never a recomputation of what led to them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_end_with_the_query(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwright_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of tables written by :func:`materialise` that no later step reads."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._siftwright_path)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
