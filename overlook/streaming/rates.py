"""Transfer rates over the last half minute: batch windows and a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(events: DataFrame, by: str, seconds: int = 30, least: int = 3) -> DataFrame:
    """events (by, ts, value) with the sum of the last seconds and its rate; no rate before `least` seconds have passed.

    Time is cut into spans of `seconds`, a task's part each: what an event looks back on is its own span up to it and the end of the span before, whose
    events are there under the time until which they count. Both are running sums, so work grows with the events however dense they are.
    """
    width = seconds * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.withColumn("__t", t).withColumn("__key", F.col("__t")).withColumn("__span", F.floor(F.col("__t") / F.lit(width))).withColumn("__own", F.lit(True))
    kept = {by, "value"}
    past = own.where("__t is not null").select(
        *(F.col(c) if c in kept else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns), "__t", (F.col("__key") + width).alias("__key"), (F.col("__span") + 1).alias("__span"), F.lit(False).alias("__own")
    )
    part = Window.partitionBy(by, "__span")
    here = part.orderBy("__key").rangeBetween(Window.unboundedPreceding, 0)
    before = part.orderBy(F.desc("__key")).rangeBetween(Window.unboundedPreceding, 0)
    e = own.union(past)
    mine = lambda c: F.when(F.col("__own"), F.col(c))
    theirs = lambda c: F.when(~F.col("__own"), F.col(c))
    e = e.withColumns({"__a": F.sum(mine("value")).over(here), "__b": F.sum(theirs("value")).over(before), "__first": F.min(mine("__t")).over(here), "__from": F.min(theirs("__t")).over(before)}).where("__own")
    total = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).otherwise(F.col("__a") + F.col("__b"))
    e = e.withColumn("total", total).withColumn("__lasted", (F.col("__t") - F.coalesce("__from", "__first")) / 1e6)
    return e.withColumn("rate", F.when(F.col("__lasted") >= least, F.col("total") / F.col("__lasted"))).select(*events.columns, "total", "rate")


def windowed(stream: DataFrame, by: str, late: str = "30 seconds", width: str = "30 seconds", slide: str = "10 seconds") -> DataFrame:
    """Counts and sums of sliding windows, later rows than the watermark left out; for batch frames and streams alike."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
