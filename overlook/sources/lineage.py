"""Cutting lineage in iterations: a table in the shared folder, which any executor can read again."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A path of its own in the folder that the session names in spark.checkpoint.dir (one of our own only where it is unset)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="overlook-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/overlook/{uuid.uuid4().hex}"
    if (held := _HELD.get()) is not None:
        held.append(path)
    return path


#: Paths given out since the innermost `swept` began.
_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def swept(spark: SparkSession):
    """Deletes, at its end and after an error too, all tables that were written inside: results must have been written elsewhere, or collected, by then."""
    held: list[str] = []
    token = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(token)
        for path in held:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to a folder that all nodes share and read back."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
