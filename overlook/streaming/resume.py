"""A search that can be stopped and taken up again: a stream with a checkpoint, batches written once, and a guard on what it is a search of."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class IdentityChanged(ValueError):
    """The input or the settings differ from those of the run that is kept; nothing was changed."""


def identity(**parts) -> str:
    """A hash of everything that the results depend on: settings, seals of the inputs, the version of the rule."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def guard(spark: SparkSession, folder: str, mark: str) -> bool:
    """Whether the folder holds a run of this identity; a new folder is marked with it, and another identity raises."""
    place, store = _file(spark, f"{folder}/identity")
    if store.exists(place):
        with_ = store.open(place)
        kept = bytes(with_.readAllBytes()).decode()
        with_.close()
        if kept != mark:
            raise IdentityChanged(f"{folder} holds the results of other inputs or settings; use another folder")
        return True
    out = store.create(place, False)
    out.write(bytearray(mark.encode()))
    out.close()
    return False


def resumed(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], folder: str, mark: str, batches: int | None = None) -> DataFrame:
    """The results of `evaluate` over all batches of a stream so far, from a run that may have been stopped any number of times.

    Each batch goes to a folder of its number, overwritten whole if the batch is run again after a stop, so that a row is neither lost nor
    there twice; the stream's checkpoint tells which batches are done, and its state goes on where it stopped. `batches`, if given, stops the run after so many.
    """
    spark = stream.sparkSession
    guard(spark, folder, mark)
    done = 0

    def keep(batch: DataFrame, number: int) -> None:
        nonlocal done
        evaluate(batch).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        done += 1
        if done == batches:
            raise _Stop

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if done != batches:
            raise
    finally:
        query.stop()
    return results(spark, folder)


class _Stop(Exception):
    pass


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/results").parquet(f"{folder}/results")
