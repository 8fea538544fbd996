"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor never loses them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A token is a run of anything but the six ASCII white-space characters.
TOKEN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``. Where that is unset a local master gets a temporary one;
    on a cluster it is an error, as executors do not share their temporary folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/siftwell-{spark.sparkContext.applicationId}"


_scope: ContextVar[str] = ContextVar("scope", default="tables")


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Intermediate tables made inside go to a folder of their own, which ``drop_scope`` deletes."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def drop_scope(spark: SparkSession, name: str) -> None:
    _delete(spark, f"{shared_dir(spark)}/{name}")


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{_scope.get()}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it back."""
    path = table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` from which everything is computed and stored."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results computed from them must be stored by then."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
