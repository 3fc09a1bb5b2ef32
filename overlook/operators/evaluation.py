"""Evaluation tables over visible cells and over scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import bearing
from ..sources.lineage import cut
from ..sources.terrain import coarsen
from .attention import knapsack, polar_patches
from .filters import known
from .ranking import ranked
from .visibility import banded, viewsheds


def cover_classes(cells: DataFrame, by: str, area: float) -> DataFrame:
    """cells (by, tree, shrub): visible area by class of tree cover, which must add up to the whole (`closes`), mean shrub and unknown share."""
    ok = known(F.col("tree"))
    total = lambda flag: F.sum(F.when(flag, area).otherwise(0.0))
    out = cells.groupBy(by).agg(
        (F.count("*") * area).alias("raw"),
        total(ok & (F.col("tree") < 0.1)).alias("open"),
        total(ok & (F.col("tree") >= 0.1) & (F.col("tree") < 0.4)).alias("partial"),
        total(ok & (F.col("tree") >= 0.4)).alias("dense"),
        total(~ok).alias("unknown"),
        F.avg(F.when(known(F.col("shrub")), F.col("shrub"))).alias("mean_shrub"),
        F.avg((~(ok & known(F.col("shrub")))).cast("int")).alias("unknown_share"),
    )
    return out.withColumn("closes", F.abs(F.col("open") + F.col("partial") + F.col("dense") + F.col("unknown") - F.col("raw")) < 1e-9)


def directional(cells: DataFrame, by: str, rings: list[tuple[float, float]], width: int = 30) -> DataFrame:
    """cells (by, dx, dy, tree): mean cover and unknown share by half-open ring and sector, empty ones kept as unknown."""
    spark = cells.sparkSession
    d = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    ring = F.lit(None).cast("double")
    for inner, outer in rings:
        ring = F.when((d >= inner) & (d < outer), inner).otherwise(ring)
    start = (F.floor(bearing(F.col("dx"), F.col("dy")) / width) * width).cast("int")
    ok = known(F.col("tree"))
    found = cells.select(by, ring.alias("inner"), start.alias("start"), F.when(ok, F.col("tree")).alias("t"), (~ok).cast("int").alias("u")).where("inner is not null")
    found = found.groupBy(by, "inner", "start").agg(F.count("*").alias("cells"), F.avg("t").alias("mean_tree"), F.avg("u").alias("unknown_share"))
    every = spark.createDataFrame([(float(a), s) for a, _ in rings for s in range(0, 360, width)], "inner double, start int")
    every = cells.select(by).distinct().join(F.broadcast(every))  # a fixed list of bins
    out = every.join(found, [by, "inner", "start"], "left")
    return out.select(by, "inner", "start", F.coalesce("cells", F.lit(0)).alias("cells"), "mean_tree", F.coalesce("unknown_share", F.lit(1.0)).alias("unknown_share"))


def by_support(cells: DataFrame, by: str, supports: dict[str, Column], area: float) -> DataFrame:
    """One row a candidate and support mask: cells of one scan counted under each mask in turn."""
    named = F.filter(F.array(*(F.when(flag, F.lit(n)) for n, flag in supports.items())), lambda x: x.isNotNull())
    return cells.select(by, F.col("d"), F.explode(named).alias("support")).groupBy(by, "support").agg((F.count("*") * area).alias("visible"), F.sum(F.when(F.col("d") <= 1000, area).otherwise(0.0)).alias("near"))


def quadrant_draws(points: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, east, north, id): in every replicate one point of each quadrant about the middle of the extent, by the least draw."""
    mid = points.agg(((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"))  # one row
    q = points.join(F.broadcast(mid)).select("id", (F.col("x") >= F.col("mx")).alias("east"), (F.col("y") >= F.col("my")).alias("north"))
    q = q.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("id").cast("string")))
    return q.groupBy("replicate", "east", "north").agg(F.min_by("id", draw).alias("id"))


def cross_scores(scores: DataFrame, k: int) -> DataFrame:
    """scores (arm, id, score): each arm's k best, scored by every arm (nominator, evaluator, mean)."""
    best = scores.withColumn("n", F.row_number().over(Window.partitionBy("arm").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k).select(F.col("arm").alias("nominator"), "id")
    return best.join(scores.select(F.col("arm").alias("evaluator"), "id", "score"), "id").groupBy("nominator", "evaluator").agg(F.avg("score").alias("mean"))


def distinct_leaders(scores: DataFrame, arms: list[str]) -> DataFrame:
    """For each arm in turn its best id that no earlier arm took: an anti-join and a top-one for each of a fixed list of arms."""
    taken = scores.select("id").limit(0)
    out = None
    for k, arm in enumerate(arms):
        left = scores.where(F.col("arm") == arm).join(taken, "id", "left_anti")
        best = left.orderBy(F.desc("score"), "id").limit(1).select(F.lit(k).alias("place"), "arm", "id")
        out = best if out is None else out.union(best)
        taken = taken.union(best.select("id"))
    return out


def alternatives_near(points: DataFrame, chosen: DataFrame, separation: float) -> DataFrame:
    """chosen (id, x, y) with the unchosen points (id, x, y, rank) within the separation, as an array in order of rank; a bucket join."""
    b = lambda v: F.floor(v / separation).cast("long")
    c = chosen.select(F.col("id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    c = c.withColumn("bi", F.explode(F.sequence(b(F.col("sx")) - 1, b(F.col("sx")) + 1))).withColumn("bj", F.explode(F.sequence(b(F.col("sy")) - 1, b(F.col("sy")) + 1)))
    left = points.join(chosen.select("id"), "id", "left_anti").withColumn("bi", b(F.col("x"))).withColumn("bj", b(F.col("y")))
    near = left.join(c, ["bi", "bj"]).where((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 < separation**2)
    return near.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("alternatives"))


def sampled_per(cells: DataFrame, by: str, key: list[str], k: int, seed: int) -> DataFrame:
    """k rows of each group by a draw that depends on the row and seed alone."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string"), *(F.col(c).cast("string") for c in key)))
    return cells.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(draw))).where(F.col("__n") <= k).drop("__n")


def openings(cells: DataFrame, labels: DataFrame, by: str, k: int = 2) -> DataFrame:
    """The k largest components of each group: cells (by, r, c, node), labels (by, node, label); with the member nearest to the centre of mass."""
    j = cells.join(labels, [by, "node"])
    mid = j.groupBy(by, "label").agg(F.count("*").alias("n"), F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    top = mid.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "label"))).where(F.col("place") <= k)
    d = (F.col("r") - F.col("mr")) ** 2 + (F.col("c") - F.col("mc")) ** 2
    return j.join(top, [by, "label"]).groupBy(by, "label", "n", "place").agg(F.min(F.struct(F.round(d, 9).alias("d"), "r", "c")).alias("m")).select(by, "label", "n", "place", "m.r", "m.c")


def far_apart(points: DataFrame, leaders: int, count: int) -> DataFrame:
    """(place, id): the `leaders` best scores, then again and again the point farthest from all chosen, ties by id. A round keeps each point's least distance as a column and brings one row to the driver."""
    spark = points.sparkSession
    chosen = points.orderBy(F.desc("score"), "id").limit(leaders).select("id", "x", "y").collect()
    while len(chosen) < count:
        d = F.least(*(((F.col("x") - p["x"]) ** 2 + (F.col("y") - p["y"]) ** 2) for p in chosen), F.lit(float("inf")))
        best = points.where(~F.col("id").isin([p["id"] for p in chosen])).orderBy(F.desc(d), "id").limit(1).select("id", "x", "y").collect()
        if not best:
            break
        chosen += best
    return spark.createDataFrame([(i, p["id"]) for i, p in enumerate(chosen, 1)], f"place int, id {points.schema['id'].dataType.simpleString()}")


def parents(points: DataFrame, count: int, leaders: int = 3, by_direction: int = 6, apart: float = 400.0) -> DataFrame:
    """(place, id) of points (id, x, y, score, directional): the `leaders` best scores; up to `by_direction` in all by directional score, `apart` from all chosen; then the farthest from all chosen, as long as it is `apart`. Ties by id; a round brings one row to the driver."""
    spark = points.sparkSession
    p = cut(points.select("id", "x", "y", "score", "directional"))
    chosen = p.orderBy(F.desc_nulls_last("score"), "id").limit(leaders).select("id", "x", "y").collect()
    while chosen and len(chosen) < max(count, by_direction):
        near = F.array_min(F.array(*((F.col("x") - q["x"]) ** 2 + (F.col("y") - q["y"]) ** 2 for q in chosen)))
        left = p.where(~F.col("id").isin([q["id"] for q in chosen])).withColumn("near", near).where(F.col("near") >= apart**2)
        order = F.desc_nulls_last("directional") if len(chosen) < by_direction else F.desc("near")
        best = left.orderBy(order, "id").limit(1).select("id", "x", "y").collect()
        if not best:
            break
        chosen += best
    return spark.createDataFrame([(i, q["id"]) for i, q in enumerate(chosen, 1)], f"place int, id {points.schema['id'].dataType.simpleString()}")


#: Cover (tree, shrub, herb) that stands for unknown cover at its least and at its most.
UNKNOWN_COVER = {"open": (0.0, 0.3, 0.3), "dense": (1.0, 0.6, 0.0)}


def assumed_cover(cells: DataFrame, kind: str, uncertain: Column) -> DataFrame:
    """cells (tree, shrub, herb, ...) whose uncertain ones are taken as open or as dense."""
    return cells.withColumns({c: F.when(uncertain, F.lit(v)).otherwise(F.col(c)) for c, v in zip(("tree", "shrub", "herb"), UNKNOWN_COVER[kind])})


def cover_bounds(cells: DataFrame, by: str, score: Column, uncertain: Column, area: float) -> DataFrame:
    """(by, dense, open, unknown_share): a sum of scores over cells if all unknown cover were dense, and if it were open."""
    cover = ("tree", "shrub", "herb")
    rows = cells.withColumns({"__u": F.coalesce(uncertain, F.lit(True)), **{f"__{c}": F.col(c) for c in cover}})
    for k in ("dense", "open"):
        rows = assumed_cover(rows, k, F.col("__u")).withColumn(f"__{k}", score * area).withColumns({c: F.col(f"__{c}") for c in cover})
    return rows.groupBy(by).agg(*(F.sum(f"__{k}").alias(k) for k in ("dense", "open")), F.avg(F.col("__u").cast("int")).alias("unknown_share"))


def median_colours(cells: DataFrame, pixels: DataFrame, fallback: tuple[int, int, int]) -> DataFrame:
    """cells (id, r, c) with the colour of the 3 x 3 pixels (r, c, red, green, blue, alpha) around: three quarters their median, a quarter the fallback; the fallback where none is opaque."""
    around = F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    near = cells.select("id", F.explode(around).alias("k")).select("id", "k.r", "k.c").join(pixels.where("alpha > 0"), ["r", "c"])
    m = near.groupBy("id").agg(*(F.median(n).alias(n) for n in ("red", "green", "blue")))
    mixed = [F.coalesce(F.rint(0.75 * F.col(n) + 0.25 * f), F.lit(float(f))).cast("int").alias(n) for n, f in zip(("red", "green", "blue"), fallback)]
    return cells.select("id").join(m, "id", "left").select("id", *mixed)


def evaluation_rows(cells: DataFrame, by: str, area: float, budget: float, rate: float = 0.02, overhead: float = 0.5, width: int = 30, band: float = 500.0, radius: float = 3000.0) -> DataFrame:
    """One row for each candidate from its visible cells (by, dx, dy, d, tree, shrub, reward): area in sight, within and beyond 1 km, with low cover, share of unknown cover, and the best score of patches that the time budget buys. Two aggregations of one scan."""
    unknown = ~(known(F.col("tree")) & known(F.col("shrub")))
    total = lambda flag: F.sum(F.when(flag, area).otherwise(0.0))
    rows = cells.groupBy(by).agg(
        (F.count("*") * area).alias("raw"),
        total(F.col("d") <= 1000).alias("within_1km"),
        total(F.col("d") > 1000).alias("beyond_1km"),
        total(~unknown & (F.col("tree") < 0.1)).alias("low_cover"),
        F.avg(unknown.cast("int")).alias("unknown_share"),
    )
    best = knapsack(polar_patches(cells, by, width, band, radius, area), by, budget, rate, overhead)
    return rows.join(best.withColumnRenamed("score", "selective"), by, "left")


def group_quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, mean, a column a share) of known values, quantiles exact and by linear interpolation: rows are ranked by group and value over ranges, and only the two rows at each share are looked at, so that no task holds a group."""
    known_ = df.select(by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    r = cut(ranked(known_, [F.col(by), F.col("v")], "__n"))
    g = r.groupBy(F.col(by).alias("__g")).agg(F.min("__n").alias("__first"), F.count("*").alias("n"))
    g = g.join(known_.groupBy(F.col(by).alias("__m")).agg(F.avg("v").alias("mean")), F.col("__g").eqNullSafe(F.col("__m"))).drop("__m")
    places = {k: s * (F.col("n") - 1) for k, s in shares.items()}
    j = r.join(g, F.col(by).eqNullSafe(F.col("__g"))).withColumn("__k", F.col("__n") - F.col("__first"))
    near = [F.max(F.when(F.col("__k") == f(at).cast("int"), F.col("v"))).alias(f"__{k}{i}") for k, at in places.items() for i, f in enumerate((F.floor, F.ceil))]
    out = j.groupBy(by, "n", "mean").agg(*near)
    between = lambda k, at: F.when(F.floor(at) == F.ceil(at), F.col(f"__{k}0")).otherwise((F.ceil(at) - at) * F.col(f"__{k}0") + (at - F.floor(at)) * F.col(f"__{k}1"))
    return out.select(by, "n", "mean", *(between(k, at).alias(k) for k, at in places.items()))


def delta_summary(pairs: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """(by, n, mean, median, p05, p95) of b - a over rows where both are known; quantiles are exact, by linear interpolation."""
    return group_quantiles(pairs.select(by, (F.col(b) - F.col(a)).alias("d")), by, "d", {"median": 0.5, "p05": 0.05, "p95": 0.95})


def target_shares(cells: DataFrame, flags: list[str]) -> DataFrame:
    """One row: for each flag the share of target cells that carry it; unknown flags are left out of the mean."""
    return cells.where("target").agg(*(F.avg(F.col(f).cast("int")).alias(f) for f in flags))


def nearest_automated(points: DataFrame, bucket: float) -> DataFrame:
    """(id, near, distance) of each manual point (id, grp, x, y): the nearest other point, ties by id.

    A search in growing squares of buckets: points without an answer that is surely the nearest go on with twice the reach, until none is left.
    """
    auto = points.where("grp <> 'manual'").select(F.col("id").alias("near"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    left = points.where("grp = 'manual'").select("id", "x", "y")
    box = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    span = max([v or 0.0 for v in box])
    out, reach = None, bucket
    while True:
        b = lambda v: F.floor(v / reach).cast("long")  # noqa: B023, E731
        p = left.withColumn("bi", F.explode(F.sequence(b(F.col("x")) - 1, b(F.col("x")) + 1))).withColumn("bj", F.explode(F.sequence(b(F.col("y")) - 1, b(F.col("y")) + 1)))
        near = p.join(auto.withColumn("bi", b(F.col("nx"))).withColumn("bj", b(F.col("ny"))), ["bi", "bj"])
        d = F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)
        best = near.groupBy("id").agg(F.min(F.struct(d.alias("distance"), "near")).alias("m")).select("id", "m.near", "m.distance")
        sure = cut(best.where(F.col("distance") <= reach) if reach <= span else best)
        out = sure if out is None else out.union(sure)
        left = cut(left.join(sure.select("id"), "id", "left_anti"))
        if reach > span or not left.take(1):
            return out
        reach *= 2


def waypoint(seat: DataFrame, grid: DataFrame, radius: float, res: float, eye: float, target: float) -> DataFrame:
    """One observer (id, r0, c0) computed anew over a grid (r, c, z, tree, shrub): bands of what is in sight and its cover classes."""
    seen = viewsheds(seat, grid, radius, res, eye, target)
    seen = seen.join(grid.select("r", "c", "tree", "shrub"), ["r", "c"])
    return banded(seen, res).join(cover_classes(seen, "id", res * res / 1e6), "id")


def resolution_control(seats: DataFrame, grid: DataFrame, factor: int, radius: float, res: float, eye: float, target: float) -> DataFrame:
    """(id, fine, coarse, relative): area in sight of seats (id, r0, c0) on the grid and on means of factor x factor cells."""
    fine = banded(viewsheds(seats, grid, radius, res, eye, target), res).select("id", F.col("area_km2").alias("fine"))
    low = seats.select("id", F.floor(F.col("r0") / factor).cast("int").alias("r0"), F.floor(F.col("c0") / factor).cast("int").alias("c0"))
    coarse = banded(viewsheds(low, coarsen(grid, factor, ["z"]), radius, res * factor, eye, target), res * factor).select("id", F.col("area_km2").alias("coarse"))
    return fine.join(coarse, "id").withColumn("relative", F.try_divide(F.col("coarse"), F.col("fine")) - 1)


def chosen_for_review(scores: DataFrame, arms: list[str], draws: DataFrame, ranks: DataFrame) -> DataFrame:
    """(place, role, id): each arm's best unseen id (scores: arm, id, score), then the first unseen of the random draw (n, id), then of all others the one of least median rank (ranks: id, rank)."""
    first = distinct_leaders(scores, arms).select("place", F.col("arm").alias("role"), "id")
    drawn = draws.join(first.select("id"), "id", "left_anti").orderBy("n").limit(1).select(F.lit(len(arms)).alias("place"), F.lit("stratified_random").alias("role"), "id")
    taken = first.union(drawn)
    steady = ranks.groupBy("id").agg(F.median("rank").alias("m")).join(taken.select("id"), "id", "left_anti").orderBy("m", "id").limit(1)
    return taken.union(steady.select(F.lit(len(arms) + 1).alias("place"), F.lit("median_rank").alias("role"), "id"))
