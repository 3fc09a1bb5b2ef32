"""Deterministic ranks, agreement of ranks, spread selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut


def sum_before(df: DataFrame, order: list[Column], weight: Column, out: str) -> DataFrame:
    """df with the sum of `weight` over all rows before each row of a total order: rows are dealt by range and written, summed inside their ranges, and each range adds what the ranges before it hold. One row a range is all that meets in a task."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.withColumn("__w", weight.cast("long")).repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    totals = dealt.groupBy("__p").agg(F.sum("__w").alias("__t"))
    lower = totals.select("__p", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = F.sum("__w").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(out, F.coalesce(inside, F.lit(0))).join(lower, "__p").withColumn(out, F.col(out) + F.col("__b")).select(*df.columns, out)


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1..n in a total order, without a task that holds all rows."""
    return sum_before(df, order, F.lit(1), out).withColumn(out, (F.col(out) + 1).cast("int"))


def dense_rank_by(df: DataFrame, score: str, key: str, group: str | None = None, digits: int | None = None, out: str = "rank") -> DataFrame:
    """1..n by descending score (rounded, if digits are given) and ascending key; NULL scores come last. Without a group the order is global; with one, rows are ranked by group and order over all and each group's first rank is taken off, so that no task holds a group."""
    s = F.round(score, digits) if digits is not None else F.col(score)
    order = [s.desc_nulls_last(), F.col(key)]
    if group is None:
        return ranked(df, order, out)
    every = cut(ranked(df, [F.col(group), *order], "__n"))
    first = every.groupBy(F.col(group).alias("__g")).agg((F.min("__n") - 1).alias("__first"))
    return every.join(first, F.col(group).eqNullSafe(F.col("__g"))).select(*df.columns, (F.col("__n") - F.col("__first")).cast("int").alias(out))


def top_per_group(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The k best of each group with their rank; Spark cuts groups to k rows before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def habitat_order(df: DataFrame) -> DataFrame:
    """Rank by effective area (unknown last), matching area, visible area, id."""
    return ranked(df, [F.col("effective").desc_nulls_last(), F.col("matching").desc(), F.col("visible").desc(), F.col("id")])


#: Classes of foreground cover, in order.
COVER_ORDER = ("low mapped tree cover", "other known cover", "insufficient coverage")


def three_mode_rank(df: DataFrame) -> DataFrame:
    """Rank of candidates (id, raw, and the columns of their mode): by habitat where df has `effective`, else by matching area where it has `matching`, else by foreground class (`foreground`; one that isn't in COVER_ORDER raises); then by more area in sight, then by id."""
    if "effective" in df.columns:
        return habitat_order(df.withColumnRenamed("raw", "visible")).withColumnRenamed("visible", "raw")
    if "matching" in df.columns:
        return ranked(df, [F.desc("matching"), F.desc("raw"), F.col("id")])
    place = F.array_position(F.array(*(F.lit(c) for c in COVER_ORDER)), F.col("foreground"))
    place = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("no class of foreground cover: "), F.coalesce("foreground", F.lit("null")))).cast("long"))
    return ranked(df, [place, F.desc("raw"), F.col("id")])


def filter_order(df: DataFrame) -> DataFrame:
    """Rank of filter results (id, qualifies, matching, original): those that qualify first."""
    return ranked(df, [F.col("qualifies").desc(), F.desc("matching"), F.desc("original"), F.col("id")])


def two_orderings(now: DataFrame, history: DataFrame) -> DataFrame:
    """now (id, matching, raw) with established_rank among the rows of today and historical_rank among all rows of the run (id, matching, raw), where no matching area counts as all in sight."""
    a = ranked(now, [F.desc("matching"), F.desc("raw"), F.col("id")], "established_rank")
    b = ranked(history, [F.coalesce("matching", "raw").desc(), F.desc("raw"), F.col("id")], "historical_rank").select("id", "historical_rank")
    return a.join(b, "id", "left")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean: counts of each value alone are ordered."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    ranks = sum_before(counts, [F.col(value)], F.col("__n"), "__below").select(value, (F.col("__below") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, value)


def agreement(df: DataFrame, a: str, b: str, key: str, k: int = 10) -> DataFrame:
    """Spearman's correlation with average ranks (NULL if a side is constant) and the share of the k best in common."""
    r = cut(average_rank(average_rank(cut(df), a, "__ra"), b, "__rb"))
    best = lambda v: r.orderBy(F.desc(v), key).limit(k).select(key)
    common = best(a).join(best(b), key).agg(F.count("*").alias("__c"))
    rho = F.try_divide(F.covar_pop("__ra", "__rb"), F.stddev_pop("__ra") * F.stddev_pop("__rb"))
    out = r.agg(rho.alias("spearman"), F.count("*").alias("__n")).crossJoin(common)
    return out.select("spearman", F.when(F.col("__n") > 0, F.col("__c") / k).alias("top_overlap"))


def spread_by_group(df: DataFrame, group: str, order: str, key: str, separation: float, count: int) -> DataFrame:
    """In each group, going down by score, rows (x, y) at `separation` or more from all rows taken so far, `count` at most: a round takes each group's best row by aggregation and leaves out what is near it, so that no task holds a group."""
    none = F.col(order).isNull() | F.isnan(F.col(order).cast("double"))
    place = F.struct(none.alias("none"), F.when(~none, -F.col(order)).alias("down"), F.col(key).alias("key"))
    left = cut(df)
    picks = []
    for n in range(1, count + 1):
        best = cut(left.groupBy(group).agg(F.min_by(F.struct(*df.columns), place).alias("one")).select("one.*"))
        picks.append(best.withColumn("pick", F.lit(n)))
        taken = best.select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col("x").alias("__x"), F.col("y").alias("__y"))
        gap = (F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2
        left = left.join(taken, F.col(group).eqNullSafe(F.col("__g"))).where((F.col(key) != F.col("__k")) & (gap >= separation**2) & ~F.isnan(gap)).select(*df.columns)
        if n % 8 == 0:
            left = cut(left)
    return reduce(DataFrame.union, picks) if picks else df.limit(0).withColumn("pick", F.lit(0))


def median_rank(ranks: DataFrame, key: str) -> DataFrame:
    """ranks (scenario, key, rank): rows in order of their median rank, then key."""
    m = ranks.groupBy(key).agg(F.median("rank").alias("median_rank"))
    return ranked(m, [F.col("median_rank"), F.col(key)], "place")
