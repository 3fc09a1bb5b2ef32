"""Overlap and greedy coverage of masks, tables of (id, cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut
from . import packed


def overlaps(masks: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard, of_smaller) of pairs a < b that share a cell.

    Cells that lie in the same masks are one cell with a weight: they are told by count and hashes of their
    masks, without lists, so that many cells under many masks make pairs once.
    """
    m = masks.select("id", "cell").distinct()
    size = m.groupBy("id").agg(F.count("*").alias("n"))
    alike = m.groupBy("cell").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2")).where("k > 1")
    one = alike.groupBy("k", "h1", "h2").agg(F.min("cell").alias("cell"), F.count("*").alias("w")).select("cell", "w")
    left = m.join(one, "cell")
    pairs = left.select("cell", "w", F.col("id").alias("a")).join(left.select("cell", F.col("id").alias("b")), "cell").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("shared"))
    out = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("of_smaller"))


def counts(masks: DataFrame) -> DataFrame:
    """One row: cells in any mask, in two or more, in one alone."""
    per = masks.groupBy("cell").agg(F.count_distinct("id").alias("n"))
    return per.agg(F.count("*").alias("union_cells"), F.count_if(F.col("n") >= 2).alias("shared_cells"), F.count_if(F.col("n") == 1).alias("unique_cells"))


def greedy(masks: DataFrame, ranks: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
    """(step, id, gain) of the masks that in turn add the most weight of uncovered cells, k at most, until none adds any; ties go to the better rank.

    Masks that only count cells, by whole numbers, go as bitmaps; weighted ones as cells: a round is an anti-join with what is covered so
    far and one aggregation. The round's winner, one row, comes to the driver. Rounds are few by contract (collections hold up to a handful of sites).
    """
    spark = masks.sparkSession
    bits = weights is None and dict(masks.dtypes)["cell"] in ("smallint", "int", "bigint")
    if bits:
        m = packed.packed(masks)
    else:
        m = masks.select("id", "cell").distinct()
        m = m.join(weights, "cell") if weights is not None else m.withColumn("w", F.lit(1.0))
    order = ranks.groupBy("id").agg(F.min("rank").alias("rank"))
    m = cut(m.join(order.select("id"), "id", "left_semi"))  # every round reads it again
    chosen: list = []
    rows = []
    for step in range(1, k + 1):
        left, taken = (m.where(~F.col("id").isin(chosen)), m.where(F.col("id").isin(chosen))) if chosen else (m, m.limit(0))
        if bits:
            gains = packed.added(left, packed.union(taken)) if chosen else packed.sizes(left).withColumnRenamed("n", "gain")
        else:
            left = left.join(taken.select("cell").distinct(), "cell", "left_anti") if chosen else left
            gains = left.groupBy("id").agg(F.sum("w").alias("gain"))
        best = gains.where("gain > 0").join(order, "id").orderBy(F.desc(F.round("gain", 9)), "rank").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["id"])
        rows.append((step, best[0]["id"], float(best[0]["gain"])))
    kind = masks.schema["id"].dataType.simpleString()
    return spark.createDataFrame(rows, f"step int, id {kind}, gain double")


COLLECTED = "step int, role string, id {id}, total_cells long, additional_cells long, overlap_percent double, total_effective double, additional_effective double, total_priority double, additional_priority double, weighted_overlap_percent double"


def collected(masks: DataFrame, sites: DataFrame, kept: list, size: int, separation: float = 0.0, weights: DataFrame | None = None) -> DataFrame:
    """A collection of `size` sites: those kept first, then in turn the eligible site that adds the most, until none adds any.

    sites (id, rank, x, y, eligible); masks (id, cell); weights (cell, w, priority), or every cell counts one.
    Kept sites count towards the size even if they have no mask (their figures are NULL). A site nearer
    than the separation to any site of the collection is left out; ties go to the better rank, then the id.
    overlap_percent is the share of a site's cells that were covered before it, weighted_overlap_percent that of
    its weight (NULL without weights, or without any weight). `initial_totals` says what the kept sites cover. Collections hold a handful
    of sites: a round is one aggregation, and its winner comes to the driver.
    """
    spark = masks.sparkSession
    m = masks.select("id", "cell").distinct()
    m = m.join(weights.select("cell", "w", "priority"), "cell", "left") if weights is not None else m.withColumn("w", F.lit(None).cast("double")).withColumn("priority", F.lit(None).cast("double"))
    m = cut(m)
    sums = [F.count("*").alias("cells"), F.sum(F.coalesce("w", F.lit(0.0))).alias("w"), F.sum(F.coalesce("priority", F.lit(0.0))).alias("priority")]
    if weights is None:
        sums[1:] = [F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("priority")]
    gain = "w" if weights is not None else "cells"
    sizes = m.groupBy("id").agg(*sums)
    members: list = []
    places: list[tuple[float, float]] = []
    rows = []

    def added(only: DataFrame) -> DataFrame:
        left = m.join(only, "id", "left_semi")
        return left.join(m.where(F.col("id").isin(members)).select("cell").distinct(), "cell", "left_anti").groupBy("id").agg(*sums) if members else left.groupBy("id").agg(*sums)

    def take(role: str, one: str, new) -> None:
        total = sizes.where(F.col("id") == one).first()
        known = total is not None
        n, more = (total["cells"], new["cells"] if new else 0) if known else (None, None)
        of = lambda row, k: (row[k] if row else 0.0) if known and weights is not None else None
        rows.append((len(rows) + 1, role, one, n, more, 100.0 * (n - more) / n if n else None, of(total, "w"), of(new, "w"), of(total, "priority"), of(new, "priority"), 100.0 * (of(total, "w") - of(new, "w")) / of(total, "w") if of(total, "w") else None))
        members.append(one)

    for one in kept:
        site = sites.where(F.col("id") == one)
        take("kept", one, added(site.select("id")).first())
        places += [(r["x"], r["y"]) for r in site.select("x", "y").collect()]  # one row
    while len(members) < size:
        free = sites.where(F.col("eligible") & ~F.col("id").isin(members)) if members else sites.where("eligible")
        for x, y in places:
            free = free.where((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 >= separation**2)
        best = added(free.select("id")).where(F.col(gain) > 0).join(free, "id").orderBy(F.desc(F.round(gain, 9)), "rank", "id").limit(1).collect()
        if not best:
            break
        take("suggested", best[0]["id"], best[0])
        places.append((best[0]["x"], best[0]["y"]))
    return spark.createDataFrame(rows, COLLECTED.format(id=masks.schema["id"].dataType.simpleString()))


def initial_totals(masks: DataFrame, collection: DataFrame, layers: DataFrame, area: float) -> DataFrame:
    """One row with `totals` of the sites that were kept (initial_*) and of the whole collection (step, role, id): what the suggestions add is their difference."""
    m = masks.select("id", "cell")
    kept = totals(m.join(collection.where("role = 'kept'").select("id"), "id", "left_semi"), layers, area)
    whole = totals(m.join(collection.select("id"), "id", "left_semi"), layers, area)
    names = {c: c.replace("combined", "initial") for c in kept.columns if c.startswith("combined")}
    return kept.select(*(F.col(a).alias(b) for a, b in names.items())).crossJoin(whole)  # one row by one row


def totals(masks: DataFrame, layers: DataFrame, area: float) -> DataFrame:
    """One row over all cells in any mask (id, cell): cells, effective and priority sums, scorable and unknown area of layers (cell, w, priority, known), and whether anything was scored."""
    union = masks.select("cell").distinct().join(layers, "cell", "left")
    known = F.coalesce("known", F.lit(False))
    return union.agg(
        F.count("*").alias("combined_cells"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("combined_effective"),
        F.coalesce(F.sum("priority"), F.lit(0.0)).alias("combined_priority"),
        (F.count_if(known) * area).alias("scorable"),
        (F.count_if(~known) * area).alias("habitat_unknown"),
        F.when(F.count_if(known) > 0, "scored").otherwise("insufficient_data").alias("status"),
    )


def marginal(masks: DataFrame, order: DataFrame) -> DataFrame:
    """Gain of each mask when they are added in a given order (id, step): cells whose first mask it is. No rounds."""
    m = masks.select("id", "cell").distinct().join(order, "id")
    first = m.groupBy("cell").agg(F.min_by("id", "step").alias("id"))
    return order.join(first.groupBy("id").agg(F.count("*").alias("gain")), "id", "left").select("id", "step", F.coalesce("gain", F.lit(0)).alias("gain"))
