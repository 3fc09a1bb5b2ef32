"""Habitat features of cover at two neighbourhoods, and metrics over visible cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terrain import disk, disk_sums
from .filters import known

WEIGHTS = (0.1, 0.45, 0.25, 0.2)
TREE_PENALTY, SHRUB_PENALTY = 0.9, 0.65


def patches(grid: DataFrame, flag: str, out: str) -> DataFrame:
    """grid with `out`: the flag where at least three flagged cells hang together by edges. Three cells hang together just if some cell has two flagged neighbours, itself or one next to it: two local sums, no iteration."""
    f = F.col(flag).cast("int")
    around = F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))

    def spread(df, value, agg):
        return df.where(F.col(value) > 0).select(F.posexplode(around).alias("k", "x"), value).select("k", "x.r", "x.c", value).groupBy("r", "c").agg(agg.alias("__s"))

    degree = spread(grid.select("r", "c", f.alias("__f")), "__f", F.sum(F.when(F.col("k") > 0, F.col("__f")).otherwise(0)))
    own = grid.join(degree, ["r", "c"], "left").withColumn("__d", F.when(F.col(flag), F.coalesce("__s", F.lit(0))).otherwise(0)).drop("__s")
    most = spread(own.select("r", "c", "__d"), "__d", F.max("__d"))
    return own.join(most, ["r", "c"], "left").withColumn(out, F.col(flag) & (F.coalesce("__s", F.lit(0)) >= 2)).drop("__d", "__s")


def features(grid: DataFrame, res: float, local: float, landscape: float) -> DataFrame:
    """tree, shrub, browse, mixed, cover, known of every cell (unknown cover counts as 0)."""
    ok = known(F.col("tree")) & known(F.col("shrub"))
    g = grid.select("r", "c", ok.alias("ok"), F.when(ok, F.col("tree")).otherwise(0.0).alias("t"), F.when(ok, F.col("shrub")).otherwise(0.0).alias("b"))
    g = g.withColumn("is_cover", F.col("ok") & (F.greatest("t", "b") >= 0.35)).withColumn("is_open", F.col("ok") & (F.col("t") <= 0.2) & (F.col("b") >= 0.05))
    g = patches(patches(g, "is_cover", "cov"), "is_open", "opn")
    sums = {"n": F.col("ok").cast("int"), "cc": (F.col("cov") & F.col("ok")).cast("int")}
    near = disk_sums(g, local, res, {**sums, "oc": (F.col("opn") & F.col("ok")).cast("int")})
    far = disk_sums(g, landscape, res, sums).toDF("r", "c", "fn", "fc")
    g = g.select("r", "c", "ok", "t", "b").join(near, ["r", "c"]).join(far, ["r", "c"])
    share = lambda total, n: F.col(total) / F.greatest(F.col(n), F.lit(1.0))
    cap = lambda x: F.least(x / 0.3, F.lit(1.0))
    support = (F.col("n") / len(disk(local, res)) >= 0.8 - 1e-9) & (F.col("fn") / len(disk(landscape, res)) >= 0.8 - 1e-9)
    return g.select(
        "r", "c", F.col("t").alias("tree"), F.col("b").alias("shrub"), (F.col("b") / (F.col("b") + 0.15)).alias("browse"), (cap(share("oc", "n")) * cap(share("cc", "n"))).alias("mixed"), cap(share("fc", "fn")).alias("cover"), (F.col("ok") & support).alias("known")
    )


def evaluate(f: DataFrame, weights=WEIGHTS, tree_penalty=TREE_PENALTY, shrub_penalty=SHRUB_PENALTY) -> DataFrame:
    """f with h (habitat) and g (how well it can be looked into)."""
    a, b, c, d = (w / sum(weights) for w in weights)
    h = a + b * F.col("browse") + c * F.col("mixed") + d * F.col("cover")
    return f.withColumn("h", h).withColumn("g", (1 - tree_penalty * F.col("tree")) * (1 - shrub_penalty * F.col("shrub")))


def metrics(cells: DataFrame, by: str, area: float, h_min: float, g_min: float) -> DataFrame:
    """cells (by, visible, matching, known, h, g): areas in m2; effective is NULL where nothing can be scored."""
    m = F.col("visible") & F.col("matching")
    k = m & F.col("known")
    total = lambda flag, v=F.lit(1.0): F.sum(F.when(flag, v).otherwise(0.0)) * area
    n = F.count_if(k)
    return cells.groupBy(by).agg(
        F.when(n > 0, total(k, F.col("h") * F.col("g"))).alias("effective"),
        total(F.col("visible")).alias("visible"),
        total(m).alias("matching"),
        total(k).alias("scorable"),
        total(m & ~F.col("known")).alias("habitat_unknown"),
        total(k & (F.col("h") >= h_min)).alias("high_habitat"),
        total(k & (F.col("h") >= h_min) & (F.col("g") >= g_min)).alias("priority"),
        F.avg(F.when(k, F.col("g"))).alias("mean_g"),
    )
