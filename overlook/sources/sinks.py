"""Results as CSV, canonical JSON and an append-only log, each written in parallel by Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in order of first appearance; what a part lacks is NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tile_table(points: DataFrame, z: int, size: int = 256) -> DataFrame:
    """(z, x, y, n, pixels) of points (lon, lat, value): for each web tile its pixels (px, py, value) in order, the largest value of a pixel standing for it; a tile holds size * size pixels at most."""
    fx = (F.col("lon") + 180) / 360 * 2**z
    fy = (1 - F.log(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / math.pi) / 2 * 2**z
    place = points.select(F.floor(fx * size).alias("gx"), F.floor(fy * size).alias("gy"), "value")
    pixel = place.groupBy("gx", "gy").agg(F.max("value").alias("value"))
    own = pixel.select(F.floor(F.col("gx") / size).cast("int").alias("x"), F.floor(F.col("gy") / size).cast("int").alias("y"), (F.col("gx") % size).cast("int").alias("px"), (F.col("gy") % size).cast("int").alias("py"), "value")
    return own.groupBy("x", "y").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("py", "px", "value"))).alias("pixels")).select(F.lit(z).alias("z"), "x", "y", "n", "pixels")


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def canonical(df: DataFrame) -> Column:
    """A row as JSON whose keys are sorted, with NULLs kept: equal rows give equal texts, whatever the order of columns."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def to_json(df: DataFrame, path: str) -> None:
    df.select(canonical(df).alias("value")).write.mode("overwrite").text(path)


def digests(df: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of each row's canonical JSON."""
    return df.select(key, F.sha2(canonical(df), 256).alias("sha256"))


def log_metrics(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; nothing that is there changes."""
    df.write.mode("append").json(path)


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the least order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("one")).select("one.*")
