"""Candidate pools: spaced points drawn from several pools in turn, with the provenance of every draw.

The rule is sequential: a point is taken unless an earlier one lies within the spacing, and then the earliest of these gets its provenance. First
come manual points, then one point of each stratum, then the pools in turn: a pool draws in its own order until one of its points is taken, or TRIES
draws failed. Spark finds, for each pool, the next points that no taken one rules out; a batch of BATCH of them a pool is all that comes to the driver,
which plays the turns out. What lies between two of them in a pool's order has failed, and is counted, not listed. Failed draws get their
provenance to its points at the end, by one join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..sources.lineage import cut
from .candidates import drawn

#: Draws of a pool in one turn, and points of a pool that come to the driver in one round.
TRIES, BATCH = 100, 512
BACKGROUND, STRATIFIED = "background", "background_stratified"


def _stratum(at: Column, low: int, high: int, side: int) -> Column:
    """Which of `side` runs of about equal length holds a row: the longer runs come first."""
    n = high - low + 1
    short, longer = divmod(n, side)
    o = at - low
    if not short:
        return o
    edge = longer * (short + 1)
    return F.when(o < edge, F.floor(o / (short + 1))).otherwise(longer + F.floor((o - edge) / short)).cast("int")


def strata(cells: DataFrame, side: int, seed: int) -> DataFrame:
    """(sr, sc, r, c): one cell by the least draw of each of side x side strata of the cells' bounding box."""
    r0, r1, c0, c1 = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if r0 is None:
        return cells.select(F.lit(0).alias("sr"), F.lit(0).alias("sc"), "r", "c").limit(0)
    s = cells.select(_stratum(F.col("r"), r0, r1, side).alias("sr"), _stratum(F.col("c"), c0, c1, side).alias("sc"), "r", "c", drawn(["r", "c"], seed).alias("draw"))
    best = s.groupBy("sr", "sc").agg(F.min(F.struct("draw", "r", "c")).alias("m"))
    return best.select("sr", "sc", "m.r", "m.c")


class _Taken:
    """Points taken so far, in order, found by buckets as wide as the spacing."""

    def __init__(self, spacing: float):
        self.spacing, self.rows, self.at = spacing, [], {}

    def near(self, r: float, c: float) -> int | None:
        """The earliest point within the spacing."""
        i, j = math.floor(r / self.spacing), math.floor(c / self.spacing)
        close = [k for a in (-1, 0, 1) for b in (-1, 0, 1) for k in self.at.get((i + a, j + b), ()) if (self.rows[k][0] - r) ** 2 + (self.rows[k][1] - c) ** 2 < self.spacing**2]
        return min(close, default=None)

    def add(self, r: float, c: float, provenance: str) -> bool:
        k = self.near(r, c)
        if k is not None:
            self.rows[k][2].add(provenance)
            return False
        self.at.setdefault((math.floor(r / self.spacing), math.floor(c / self.spacing)), []).append(len(self.rows))
        self.rows.append((r, c, {provenance}))
        return True


def _clear(pools: DataFrame, taken: DataFrame, spacing: float, keep: str) -> DataFrame:
    """pools (r, c, ...) within the spacing of a taken point (r2, c2, ...), or without those: a join on buckets."""
    b = lambda v: F.floor(v / spacing).cast("long")
    near = taken.withColumn("bi", F.explode(F.sequence(b(F.col("r2")) - 1, b(F.col("r2")) + 1))).withColumn("bj", F.explode(F.sequence(b(F.col("c2")) - 1, b(F.col("c2")) + 1)))
    here = pools.withColumn("bi", b(F.col("r"))).withColumn("bj", b(F.col("c")))
    close = [here.bi == near.bi, here.bj == near.bj, (here.r - near.r2) ** 2 + (here.c - near.c2) ** 2 < spacing**2]
    return here.join(F.broadcast(near), close, keep).drop("bi", "bj")


def _held(cells: DataFrame, points: DataFrame) -> DataFrame:
    """The cells (r, c, ...) of a bounded number of points (r, c): it is the points that go to every task, whatever the plan takes the cells for."""
    return cells.join(F.broadcast(points.select("r", "c")), ["r", "c"], "left_semi")


def pooled(cells: DataFrame, pools: list[str], count: int, spacing: float, seed: int, manual: list[tuple[str, int, int]] = (), side: int | None = None) -> DataFrame:
    """(id, r, c, provenance) of `count` candidates among allowed cells (r, c, a boolean column for each of `pools`), no two nearer than `spacing` cells.

    The result is that of going through all draws one by one (see above), in any partitioning. A pool of the name BACKGROUND has all cells and
    may lack its column. Each taken point also gets the pools that hold its cell, but for the background. Manual points (name, r, c) outside the cells raise, as
    does a pool of candidates that can't be filled: `count` is a bound on what the driver holds.
    """
    cells = cut(cells.select("r", "c", *(F.col(p).alias(f"is_{p}") if p in cells.columns else F.lit(True).alias(f"is_{p}") for p in pools)))
    taken = _Taken(spacing)
    spark = cells.sparkSession
    if manual:
        asked = spark.createDataFrame(list(manual), "name string, r int, c int")
        lost = asked.join(_held(cells, asked), ["r", "c"], "left_anti").orderBy("name").limit(3).collect()
        if lost:
            raise ValueError("manual points outside the domain: " + ", ".join(x["name"] for x in lost))
    for name, r, c in manual:
        if len(taken.rows) < count or taken.near(r, c) is not None:
            taken.add(r, c, f"manual:{name}")
    side = max(2, int(math.sqrt(count * 0.4))) if side is None else side
    for x in strata(cells, side, seed).orderBy("sr", "sc").collect():  # side x side rows
        if len(taken.rows) < count or taken.near(x.r, x.c) is not None:
            taken.add(x.r, x.c, STRATIFIED)
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("pool"), F.col(f"is_{p}").alias("holds")) for k, p in enumerate(pools))))
    draws = cells.select("r", "c", named.alias("x")).where("x.holds").select("r", "c", "x.pool").withColumn("draw", drawn(["pool", "r", "c"], seed))
    draws = ranked(draws, [F.col("pool"), F.col("draw"), F.col("r"), F.col("c")], "n")
    sizes = {r.pool: (r.low, r.n) for r in draws.groupBy("pool").agg(F.min("n").alias("low"), F.count("*").alias("n")).collect()}
    draws = cut(draws.select("r", "c", "pool", (F.col("n") - F.create_map(*(F.lit(v) for k, (low, _) in sizes.items() for v in (k, low)))[F.col("pool")] if sizes else F.col("n")).cast("long").alias("i")))
    cursor = {k: 0 for k in range(len(pools))}
    total = {k: sizes[k][1] if k in sizes else 0 for k in cursor}
    turn, open_ = 0, draws
    while len(taken.rows) < count and any(cursor[k] < total[k] for k in cursor):
        known = spark.createDataFrame([(int(r), int(c)) for r, c, _ in taken.rows], "r2 int, c2 int")
        left = open_.where(F.col("i") >= F.create_map(*(F.lit(v) for k in cursor for v in (k, cursor[k])))[F.col("pool")])
        open_ = cut(_clear(left, known, spacing, "left_anti"))
        batch: dict[int, list] = {k: [] for k in cursor}
        first = F.row_number().over(_by_pool())
        for x in open_.withColumn("k", first).where(F.col("k") <= BATCH).orderBy("pool", "i").collect():
            batch[x.pool].append((x.i, x.r, x.c))
        ends = {k: len(v) < BATCH for k, v in batch.items()}  # the pool has no more open points than these
        place = {k: 0 for k in cursor}
        failed = 0  # pools in a row that are at their end
        while len(taken.rows) < count and failed < len(pools):
            k = turn % len(pools)
            mine = batch[k]
            while place[k] < len(mine) and taken.near(mine[place[k]][1], mine[place[k]][2]) is not None:
                place[k] += 1
            if place[k] == len(mine) and not ends[k]:
                break  # more of this pool's points are needed
            at = mine[place[k]][0] if place[k] < len(mine) else total[k]
            turn += 1
            if cursor[k] >= total[k]:
                failed += 1
            elif at < min(cursor[k] + TRIES, total[k]):
                cursor[k], failed = at + 1, 0
                taken.add(*mine[place[k]][1:], pools[k])
            else:
                cursor[k], failed = min(cursor[k] + TRIES, total[k]), 0
        else:
            if failed >= len(pools):
                break
    if len(taken.rows) < count:
        raise ValueError(f"only {len(taken.rows)} of {count} candidates are {spacing} cells apart: ask for fewer, or nearer ones")
    while turn % len(pools):  # the round in which the last point was taken is played out: its draws fail
        cursor[turn % len(pools)] = min(cursor[turn % len(pools)] + TRIES, total[turn % len(pools)])
        turn += 1
    rows = spark.createDataFrame([(n, int(r), int(c), sorted(p)) for n, (r, c, p) in enumerate(taken.rows)], "n int, r int, c int, own array<string>")
    # draws that failed up to each pool's last turn give their pool to the earliest point near them
    tried = draws.where(F.col("i") < F.create_map(*(F.lit(v) for k in cursor for v in (k, cursor[k])))[F.col("pool")])
    near = _clear(tried, rows.select(F.col("r").alias("r2"), F.col("c").alias("c2"), "n"), spacing, "inner")
    names = F.array(*(F.lit(p) for p in pools))
    given = near.groupBy("pool", "i").agg(F.min("n").alias("n")).groupBy("n").agg(F.collect_set(names[F.col("pool")]).alias("given"))
    holds = F.filter(F.array(*(F.when(F.col(f"is_{p}"), F.lit(p)) for p in pools if p != BACKGROUND)), lambda x: x.isNotNull())
    out = rows.join(given, "n", "left").join(_held(cells, rows), ["r", "c"], "left").withColumn("held", holds)
    every = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("given", F.array().cast("array<string>")), F.coalesce("held", F.array().cast("array<string>")))))
    return out.select(F.format_string("C%04d", F.col("n") + 1).alias("id"), "r", "c", every.alias("provenance"))


def _by_pool():
    from pyspark.sql import Window

    return Window.partitionBy("pool").orderBy("i")
