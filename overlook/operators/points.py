"""Returns of a point cloud: columns, voxels and ground bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cropped(returns: DataFrame, observers: DataFrame, radius: float, bucket: float = 256.0, unit: float = 1.0, height_unit: float = 1.0) -> DataFrame:
    """returns (x, y, z, class, withheld) within the radius of observers (id, ox, oy), one scan for all: noise (7, 18) and withheld returns go. Coordinates in other units are brought to metres by `unit` and `height_unit`."""
    if unit != 1 or height_unit != 1:
        returns = returns.withColumns({"x": F.col("x") * unit, "y": F.col("y") * unit, "z": F.col("z") * height_unit})
    b = lambda v: F.floor(v / bucket).cast("long")
    o = observers.withColumn("bi", F.explode(F.sequence(b(F.col("ox") - radius), b(F.col("ox") + radius)))).withColumn("bj", F.explode(F.sequence(b(F.col("oy") - radius), b(F.col("oy") + radius))))
    p = returns.where(~F.col("class").isin(7, 18) & ~F.coalesce("withheld", F.lit(False))).withColumn("bi", b(F.col("x"))).withColumn("bj", b(F.col("y")))
    j = p.join(o, ["bi", "bj"]).withColumn("dx", F.col("x") - F.col("ox")).withColumn("dy", F.col("y") - F.col("oy"))
    return j.where(F.col("dx") ** 2 + F.col("dy") ** 2 <= radius**2).select("id", "dx", "dy", "z", "class")


def columns(returns: DataFrame, side: float = 2.0) -> DataFrame:
    """(i, j, height, n): highest return over the ground in each column (dx, dy, z, ground), under half a metre 0."""
    h = F.max(F.col("z") - F.col("ground"))
    return returns.groupBy(F.floor(F.col("dx") / side).alias("i"), F.floor(F.col("dy") / side).alias("j")).agg(F.when(h < 0.5, 0.0).otherwise(h).alias("height"), F.count("*").alias("n"))


def voxels(returns: DataFrame, side: float = 1.0) -> DataFrame:
    """(i, j, k, n): cells with four or more distinct returns, or two or three and at least two strong ones among the 26 around."""
    p = returns.select("dx", "dy", "z").distinct()
    cell = p.groupBy(*(F.floor(F.col(v) / side).cast("long").alias(a) for v, a in (("dx", "i"), ("dy", "j"), ("z", "k")))).agg(F.count("*").alias("n"))
    strong, weak = cell.where("n >= 4"), cell.where("n between 2 and 3")
    around = F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), (F.col("k") + c).alias("k")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a or b or c))
    backed = strong.select(F.explode(around).alias("x")).select("x.*").groupBy("i", "j", "k").agg(F.count("*").alias("s")).where("s >= 2")
    return strong.unionByName(weak.join(backed.drop("s"), ["i", "j", "k"]))


def first_in_bin(returns: DataFrame, side: float = 0.25) -> DataFrame:
    """(i, j, seq, z): the first return, in source order, of each bin."""
    return returns.groupBy(F.floor(F.col("dx") / side).cast("long").alias("i"), F.floor(F.col("dy") / side).cast("long").alias("j")).agg(F.min("seq").alias("seq"), F.min_by("z", "seq").alias("z"))


def class_counts(crop: DataFrame) -> DataFrame:
    """(id, class, n) of the returns kept for each observer."""
    return crop.groupBy("id", "class").agg(F.count("*").alias("n"))
