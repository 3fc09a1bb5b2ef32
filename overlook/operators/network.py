"""Line networks: names, junctions, shortest paths, profiles, and paths over grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terrain import gaussian_taps
from ..sources.lineage import cut
from .search import settled

#: Words that name a kind of way, not the way.
KIND_WORDS = ("ROAD", "RD", "TRAIL", "TR", "CR", "FS", "NFSR", "NFST")


def route_id(v: Column) -> Column:
    """Upper case, trimmed; the 7 or 9 before three digits goes."""
    s = F.upper(F.trim(F.coalesce(v, F.lit(""))))
    return F.when(s.rlike("^[79][0-9]{3}$"), F.substring(s, 2, 3)).otherwise(s)


def route_name(v: Column) -> Column:
    words = F.split(F.replace(F.upper(F.coalesce(v, F.lit(""))), F.lit("-"), F.lit(" ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*KIND_WORDS)), " ")


def season_covers(interval: Column, first: Column, last: Column) -> Column:
    """Whether MM/DD-MM/DD of the first date's year holds both dates; malformed intervals and dates give false."""
    day = lambda k: F.try_to_date(F.concat(F.date_format(first, "yyyy"), F.lit("/"), F.regexp_extract(interval, r"^(\d{2}/\d{2})-(\d{2}/\d{2})$", k)), "yyyy/MM/dd")
    return F.coalesce((day(1) <= first) & (first <= last) & (last <= day(2)), F.lit(False))


def edges_of(segments: DataFrame) -> DataFrame:
    """Undirected edges (u, v, length, records, motor) of segments (record, ax, ay, bx, by, motor): ends rounded to centimetres are junctions, crossings aren't; equal segments join their records."""
    at = lambda x, y: F.concat_ws(",", F.round(x, 2).cast("decimal(18,2)").cast("string"), F.round(y, 2).cast("decimal(18,2)").cast("string"))
    s = segments.withColumn("a", at("ax", "ay")).withColumn("b", at("bx", "by")).where("a <> b")
    s = s.select("record", "motor", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2).alias("length"))
    return s.groupBy("u", "v").agg(F.min("length").alias("length"), F.array_sort(F.collect_set("record")).alias("records"), F.bool_or("motor").alias("motor"))


def repairs(ends: DataFrame, vertices: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Gaps to close: ends (record, x, y, rid, name) and vertices (record, x, y, rid, name) of other records within the tolerance, by equal ids or equal names; the grid join meets 3 x 3 buckets."""
    b = lambda v: F.floor(v / tolerance).cast("long")
    e = ends.select(F.col("record").alias("r1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("rid").alias("i1"), F.col("name").alias("n1"))
    e = e.withColumn("bi", F.explode(F.sequence(b(F.col("x1")) - 1, b(F.col("x1")) + 1))).withColumn("bj", F.explode(F.sequence(b(F.col("y1")) - 1, b(F.col("y1")) + 1)))
    v = vertices.withColumn("bi", b(F.col("x"))).withColumn("bj", b(F.col("y")))
    j = e.join(v, ["bi", "bj"]).where("r1 <> record").withColumn("gap", F.sqrt((F.col("x") - F.col("x1")) ** 2 + (F.col("y") - F.col("y1")) ** 2)).where((F.col("gap") > 0) & (F.col("gap") <= tolerance))
    same = ((route_id(F.col("i1")) != "") & (route_id(F.col("i1")) == route_id(F.col("rid")))) | ((route_name(F.col("n1")) != "") & (route_name(F.col("n1")) == route_name(F.col("name"))))
    return j.where(same).select("r1", "record", "x1", "y1", "x", "y", "gap").distinct()


def shortest(edges: DataFrame, sources: DataFrame, rounds: int | None = None, motor_only: bool = False, patch=None) -> DataFrame:
    """(node, distance, previous) of every node that is reached from any source; previous is the node before it, NULL at a source.

    Relaxation by rounds: only nodes that came closer in the last round are joined with the edges, and the
    search ends when none did. A limit of rounds, if given, raises when it is met before that. With `patch`, a rule that
    puts near nodes together, a task searches a patch of them, and there is no limit.
    """
    e = edges.where("motor") if motor_only else edges
    if patch is not None:
        e = e.select("u", "v", "length").withColumn("x", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).select("x.u", "x.v", F.col("length").alias("cost"))
        return settled(e, sources.select(F.lit(0).alias("scenario"), "node", F.lit(0.0).alias("distance")).distinct(), patch).select("node", "distance", "previous")
    both = cut(e.select("u", "v", "length").union(e.select("v", "u", "length")).toDF("node", "v", "length"))
    kind = edges.schema["u"].dataType.simpleString()
    now = sources.select("node").distinct().select("node", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("previous"), F.lit(True).alias("fresh"))
    done = 0
    while True:
        step = now.where("fresh").join(both, "node").select(F.col("v").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), F.col("node").alias("previous"), F.lit(True).alias("fresh"))
        known = now.select("node", "distance", "previous", F.lit(False).alias("fresh"))
        best = known.union(step).groupBy("node").agg(F.min(F.struct("distance", "fresh", "previous")).alias("m"))  # what is known stays on ties
        now = cut(best.select("node", "m.distance", "m.previous", "m.fresh"))
        done += 1
        if not now.where("fresh").take(1):
            return now.select("node", "distance", "previous")
        if done == rounds:
            raise ValueError(f"nodes still come closer after {rounds} rounds")


def followed(found: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, target, k, node) from each target (by, target, node) back along `previous` of found (by, node, previous); k counts from the target.

    Jumps double: a round joins all nodes known so far with jumps as long as what is known of each way, and then joins the jumps with
    themselves, so rounds grow with the logarithm of the longest way.
    """
    jump = cut(found.select(*by, "node", "previous").where("previous is not null"))
    out = cut(targets.select(*by, "target", F.lit(0).alias("k"), "node").join(found.select(*by, "node"), [*by, "node"], "left_semi").select(*by, "target", "k", "node"))
    reach = 1
    while True:
        new = cut(out.join(jump, [*by, "node"]).select(*by, "target", (F.col("k") + reach).alias("k"), F.col("previous").alias("node")))
        if not new.take(1):
            return out
        out = cut(out.union(new))
        far = jump.select(*by, F.col("node").alias("previous"), F.col("previous").alias("far"))
        jump = cut(jump.join(far, [*by, "previous"]).select(*by, "node", F.col("far").alias("previous")))
        reach *= 2


def traced(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, k, node) from each target (node) back to its source along `previous`; k counts from the target."""
    return followed(found, targets.select(F.col("node").alias("target"), "node"), [])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) with the smallest node that is reached over edges (u, v) between nodes: large-star and small-star steps until no link changes, which takes rounds in proportion to the logarithm of a path's length."""
    own = nodes.select("node").distinct()
    links = edges.select("u", "v").join(own.toDF("u"), "u", "left_semi").join(own.toDF("v"), "v", "left_semi")
    now = cut(_downward(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    mark = _links_mark(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        new = _links_mark(now)
        if new == mark:
            break
        mark = new
    return nodes.select("node").join(now.toDF("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _downward(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node a to the smaller node b."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _links_mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node joins the smallest node around it."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _downward(links.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours join the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(moved.union(least))


def smoothed(stations: DataFrame, sigma: float = 1.0) -> DataFrame:
    """stations (id, k, z) with heights smoothed along each line, its ends mirrored; a line with an unknown height has none. A line's stations are one array."""
    taps = gaussian_taps(sigma)
    lines = stations.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("a"))
    n = F.size("a")

    def one(i):
        total = F.lit(0.0)
        for o, w in taps:
            at = F.pmod(i + o, 2 * n)
            total = total + F.get(F.col("a"), F.when(at >= n, 2 * n - 1 - at).otherwise(at))["z"] * w
        return F.struct(F.get(F.col("a"), i)["k"].alias("k"), total.alias("z"))

    whole = F.when(~F.exists("a", lambda x: x["z"].isNull()), F.transform(F.sequence(F.lit(0), n - 1), one))
    return lines.select("id", F.explode(F.coalesce(whole, F.transform("a", lambda x: F.struct(x["k"].alias("k"), F.lit(None).cast("double").alias("z"))))).alias("x")).select("id", "x.k", "x.z")


def profile(stations: DataFrame) -> DataFrame:
    """(id, gain, loss, covered) along stations (id, k, z): sums of rises and falls, NULL unless every station has a height."""
    from pyspark.sql import Window

    d = F.col("z") - F.lag("z").over(Window.partitionBy("id").orderBy("k"))
    s = stations.withColumn("dz", d).groupBy("id").agg(F.sum(F.greatest("dz", F.lit(0.0))).alias("up"), F.sum(F.greatest(-F.col("dz"), F.lit(0.0))).alias("down"), F.avg(F.col("z").isNotNull().cast("int")).alias("covered"))
    return s.select("id", F.when(F.col("covered") == 1, F.coalesce("up", F.lit(0.0))).alias("gain"), F.when(F.col("covered") == 1, F.coalesce("down", F.lit(0.0))).alias("loss"), "covered")


#: Cells of a side of the tiles that least-cost searches work on.
PATCH = 64
STEPS8 = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)


def slopes(z: np.ndarray, inside: np.ndarray, res: float) -> np.ndarray:
    """Degrees at the cells inside a rim of one: central differences, one-sided at the grid's edge, unknown beside an unknown cell."""
    part, here = [], z[1:-1, 1:-1]
    for ahead, behind in (((slice(2, None), slice(1, -1)), (slice(None, -2), slice(1, -1))), ((slice(1, -1), slice(2, None)), (slice(1, -1), slice(None, -2)))):
        a, b = inside[ahead], inside[behind]
        part.append((np.where(a, z[ahead], here) - np.where(b, z[behind], here)) / (np.maximum(a.astype(int) + b, 1) * res))
    return np.degrees(np.arctan(np.hypot(*part)))


def step_costs(z: np.ndarray, flag: np.ndarray, tree: np.ndarray, shrub: np.ndarray, res: float, weights: tuple[float, float, float, float] | None, max_slope: float) -> dict[tuple[int, int], np.ndarray]:
    """For each of eight steps (a, b) what it costs to come to a cell n from its settled neighbour m = n + (a, b); infinite where it can't be done. Arrays have a rim of two cells, results one of one; flag is 1 for cells that may be entered, 0 for others, NaN outside the grid.

    With weights (slope, tree, shrub, gain) it is the walk from n to m, towards the target: the steepest
    of both cells and the step itself counts, for the price and for the limit alike; unknown cover counts
    as full. Without, it is the walk from m to n, priced by the slope of n, over cells within the limit.
    No step cuts a corner.
    """
    slope, ok = slopes(z, np.isfinite(flag), res), flag == 1
    z, tree, shrub = (np.where(np.isfinite(x), x, f)[1:-1, 1:-1] for x, f in ((z, np.nan), (tree, 1.0), (shrub, 1.0)))
    ok = ok[1:-1, 1:-1] & np.isfinite(z) & np.isfinite(slope)
    if weights is None:
        ok &= (slope <= max_slope) & (z > 0)
    size = len(z)
    out = {}
    for a, b in STEPS8:
        n = (slice(max(0, -a), size - max(0, a)), slice(max(0, -b), size - max(0, b)))
        m = (slice(max(0, a), size - max(0, -a)), slice(max(0, b), size - max(0, -b)))
        free = ok[n] & ok[m]
        if a and b:
            free &= ok[m[0], n[1]] & ok[n[0], m[1]]
        length = res * math.hypot(a, b)
        rise = z[m] - z[n]
        grade = np.degrees(np.arctan(np.abs(rise) / length))
        if weights is None:
            free &= grade <= max_slope
            cost = length * (1 + (slope[n] / 15) ** 2)
        else:
            ws, wt, wb, wg = weights
            steep = np.maximum(np.maximum(slope[n], slope[m]), grade)
            free &= steep <= max_slope
            cost = length * (1 + ws * (steep / 15) ** 2 + wt * (tree[n] + tree[m]) / 2 + wb * (shrub[n] + shrub[m]) / 2) + 10 * wg * np.maximum(0, rise)
        out[a, b] = np.full(z.shape, np.inf)
        out[a, b][n] = np.where(free, cost, np.inf)
    return out


def settle(cost: np.ndarray, steps: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Least costs inside the rim, given the costs on it and any inside, for searches side by side (rows, columns, searches): passes down, up, right and left, each from a line to the next, until nothing improves."""
    rows, cols = cost.shape[:2]
    down, across = slice(1, rows - 1), slice(1, cols - 1)
    w = {k: v[:, :, None] for k, v in steps.items()}
    cost, left = cost.copy(), np.arange(cost.shape[2])
    while len(left):
        before = cost[:, :, left]
        now = before.copy()
        for a, lines in ((-1, range(1, rows - 1)), (1, range(rows - 2, 0, -1))):
            for i in lines:
                for b in (0, -1, 1):
                    np.minimum(now[i, across], now[i + a, 1 + b : cols - 1 + b] + w[a, b][i, across], out=now[i, across])
        for b, lines in ((-1, range(1, cols - 1)), (1, range(cols - 2, 0, -1))):
            for j in lines:
                for a in (0, -1, 1):
                    np.minimum(now[down, j], now[1 + a : rows - 1 + a, j + b] + w[a, b][down, j], out=now[down, j])
        cost[:, :, left] = now
        left = left[(now < before).any(axis=(0, 1))]
    return cost


def patches_of(grid: DataFrame, side: int = PATCH) -> DataFrame:
    """grid (area, r, c, z, ok, tree, shrub) as tiles (area, tr, tc, z, ok, tree, shrub): arrays of side + 4 cells each way, a rim of two around the tile; what isn't there is NaN."""
    t = lambda x: F.floor(x / side).cast("int")
    dealt = grid.select("area", "r", "c", "z", "ok", "tree", "shrub").withColumn("tr", F.explode(F.sequence(t(F.col("r") - 2), t(F.col("r") + 2)))).withColumn("tc", F.explode(F.sequence(t(F.col("c") - 2), t(F.col("c") + 2))))

    def pack(key, cells: pd.DataFrame) -> pd.DataFrame:
        if not ((cells.r // side == key[1]) & (cells.c // side == key[2])).any():  # the rim of others alone
            return pd.DataFrame(columns=["area", "tr", "tc", "z", "ok", "tree", "shrub"], dtype=object)
        at = (cells.r - key[1] * side + 2, cells.c - key[2] * side + 2)
        layers = {n: np.full((side + 4, side + 4), np.nan) for n in ("z", "ok", "tree", "shrub")}
        for n, a in layers.items():
            a[at] = cells[n].astype(float)
        return pd.DataFrame({"area": [key[0]], "tr": [key[1]], "tc": [key[2]], **{n: [a.ravel()] for n, a in layers.items()}})

    kind = grid.schema["area"].dataType.simpleString()
    return dealt.groupBy("area", "tr", "tc").applyInPandas(pack, f"area {kind}, tr int, tc int, z array<double>, ok array<double>, tree array<double>, shrub array<double>")


#: Searches of one tile that are settled side by side, and those that share a task.
SEARCHES, TOGETHER = 16, 256
SHARED = ["area", "tr", "tc", "__p"]


def _shared(rows: DataFrame, keys: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (scenario, area, tr, tc, ...) and tiles (area, tr, tc, ...) under common keys, `TOGETHER` scenarios of a tile or so each; keys has the rows' scenario, area, tr and tc, once each."""
    parts = keys.groupBy("area", "tr", "tc").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).cast("int").alias("__n"))
    mine = rows.join(parts, ["area", "tr", "tc"]).withColumn("__p", F.pmod(F.xxhash64("scenario"), F.col("__n")).cast("int")).drop("__n")
    return mine, tiles.join(parts, ["area", "tr", "tc"]).withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def cost_surfaces(scenarios: DataFrame, grid: DataFrame, res: float, max_slope: float = 30.0, side: int = PATCH) -> DataFrame:
    """(scenario, tr, tc, cost) for scenarios (scenario, area, tr, tc: the cell searched from; ws, wt, wb, wg, or NULL ws for plain connectors): least costs of every tile that is reached, infinite where a cell isn't.

    A task settles the searches of one tile; costs that fell on a tile's edge go to the tiles beside it, which
    settle again. The search ends when no edge improves, so rounds follow the tiles that paths cross, and no
    task holds more than a tile, however large an area is.
    """
    tiles = cut(patches_of(grid, side))
    key = ["scenario", "tr", "tc"]
    t = lambda x: F.floor(x / side).cast("int")
    asked = scenarios.select("scenario", "area", "ws", "wt", "wb", "wg")
    news = scenarios.select("scenario", t(F.col("tr")).alias("tr"), t(F.col("tc")).alias("tc"), F.col("tr").alias("r"), F.col("tc").alias("c"), F.lit(0.0).alias("cost"))

    def relax(came: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"scenario": [], "tr": [], "tc": [], "cost": [], "sent": []}
        if not len(tile) or not len(came):
            return pd.DataFrame(out, dtype=object)
        w = tile.iloc[0]
        whole = {n: np.asarray(w[n]).reshape(side + 4, side + 4) for n in ("z", "ok", "tree", "shrub")}
        open_ = ((whole["ok"] == 1) & np.isfinite(whole["z"]))[1:-1, 1:-1]
        # cells that may be entered, and a cell around them
        (r0, r1), (c0, c1) = ((max(0, x[0] - 1), min(side + 2, x[-1] + 2)) if len(x) else (0, 2) for x in (np.flatnonzero(open_.any(axis=k)) for k in (1, 0)))
        rim = np.zeros((side, side), bool)
        rim[[0, -1]], rim[:, [0, -1]] = True, True
        for weights, g in came.groupby(["ws", "wt", "wb", "wg"], dropna=False, sort=False):
            steps = step_costs(whole["z"], whole["ok"], whole["tree"], whole["shrub"], res, None if pd.isna(weights[0]) else weights, max_slope)
            steps = {k: v[r0:r1, c0:c1] for k, v in steps.items()}
            for lo in range(0, len(g), SEARCHES):
                part = g.iloc[lo : lo + SEARCHES]
                cost = np.full((side + 2, side + 2, len(part)), np.inf)
                old = np.full((side, side, len(part)), np.inf)
                for k, (known, rs, cs, to) in enumerate(zip(part.cost, part.rs, part.cs, part.costs)):
                    if known is not None:
                        old[:, :, k] = cost[1:-1, 1:-1, k] = np.asarray(known).reshape(side, side)
                    at = (np.asarray(rs) - w.tr * side + 1, np.asarray(cs) - w.tc * side + 1)
                    np.minimum.at(cost[:, :, k], at, np.where(open_[at], np.asarray(to), np.inf))
                cost[r0:r1, c0:c1] = settle(cost[r0:r1, c0:c1], steps)
                new = cost[1:-1, 1:-1]
                for k, scenario in enumerate(part.scenario):
                    r, c = np.nonzero(rim & (new[:, :, k] < old[:, :, k]))
                    out["scenario"].append(scenario)
                    out["tr"].append(w.tr)
                    out["tc"].append(w.tc)
                    out["cost"].append(new[:, :, k].ravel())
                    out["sent"].append([{"r": int(i + w.tr * side), "c": int(j + w.tc * side), "cost": float(x)} for i, j, x in zip(r, c, new[r, c, k])])
        return pd.DataFrame(out)

    state = None
    done = 0
    while True:
        # a row for each search of a tile; searches of one tile share a task
        came = news.groupBy(*key).agg(F.collect_list(F.struct("r", "c", "cost")).alias("x")).select(*key, F.col("x.r").alias("rs"), F.col("x.c").alias("cs"), F.col("x.cost").alias("costs")).join(asked, "scenario")
        came = came.join(state, key, "left") if state is not None else came.withColumn("cost", F.lit(None).cast("array<double>"))
        mine, theirs = _shared(came, news.select(*key).distinct().join(asked.select("scenario", "area"), "scenario"), tiles)
        out = cut(mine.groupBy(*SHARED).cogroup(theirs.groupBy(*SHARED)).applyInPandas(relax, "scenario string, tr int, tc int, cost array<double>, sent array<struct<r: int, c: int, cost: double>>"))
        fresh = out.select(*key, "cost")
        state = fresh if state is None else state.join(fresh.select(*key), key, "left_anti").union(fresh)
        done += 1
        if done % 4 == 0:
            state = cut(state)
        edge = out.select(*key, F.explode("sent").alias("x")).select(*key, "x.*")
        beside = edge.withColumn("nr", F.explode(F.array_distinct(F.array(t(F.col("r") - 1), t(F.col("r") + 1))))).withColumn("nc", F.explode(F.array_distinct(F.array(t(F.col("c") - 1), t(F.col("c") + 1)))))
        news = beside.where("nr <> tr or nc <> tc").select("scenario", F.col("nr").alias("tr"), F.col("nc").alias("tc"), "r", "c", "cost")
        news = news.join(asked.select("scenario", "area"), "scenario").join(tiles.select("area", "tr", "tc"), ["area", "tr", "tc"], "left_semi").drop("area")  # beyond an area's edge nothing is asked
        if not news.take(1):
            return state


def approaches(scenarios: DataFrame, grid: DataFrame, starts: DataFrame, res: float, max_slope: float = 30.0, side: int = PATCH, state: DataFrame | None = None) -> DataFrame:
    """(scenario, start, cost) for scenarios (scenario, area, tr, tc, ws, wt, wb, wg) over grid (area, r, c, z, ok, tree, shrub) and starts (area, start, r, c); NULL where a start isn't reached. state: their `cost_surfaces`, where these are there already."""
    state = cost_surfaces(scenarios, grid, res, max_slope, side) if state is None else state
    t = lambda x: F.floor(x / side).cast("int")
    asked = starts.select("area", "start", "r", "c").join(scenarios.select("scenario", "area"), "area").withColumn("tr", t(F.col("r"))).withColumn("tc", t(F.col("c")))
    cost = F.get("cost", ((F.col("r") - F.col("tr") * side) * side + F.col("c") - F.col("tc") * side).cast("int"))
    return asked.join(state, ["scenario", "tr", "tc"], "left").select("scenario", "start", F.when(cost < float("inf"), cost).alias("cost"))


def connectors(pairs: DataFrame, grid: DataFrame, res: float, max_slope: float = 30.0, side: int = PATCH) -> DataFrame:
    """(id, cost) of the least-cost walk between two cells: pairs (id, area, r0, c0, r1, c1); length priced by one plus the square of the slope over 15 degrees, over cells and steps within the limit."""
    from_ = pairs.select(F.col("id").cast("string").alias("scenario"), "area", F.col("r0").alias("tr"), F.col("c0").alias("tc"), *(F.lit(None).cast("double").alias(w) for w in ("ws", "wt", "wb", "wg")))
    state = cost_surfaces(from_, grid.select("area", "r", "c", "z", "ok", F.lit(0.0).alias("tree"), F.lit(0.0).alias("shrub")), res, max_slope, side)
    t = lambda x: F.floor(x / side).cast("int")
    to = pairs.select("id", F.col("id").cast("string").alias("scenario"), t(F.col("r1")).alias("tr"), t(F.col("c1")).alias("tc"), (F.pmod("r1", F.lit(side)) * side + F.pmod("c1", F.lit(side))).cast("int").alias("at"))
    cost = F.get("cost", F.col("at"))
    return to.join(state, ["scenario", "tr", "tc"], "left").select("id", F.when(cost < float("inf"), cost).alias("cost"))


def solved(costs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Objectives solved: costs (objective, start, cost) of approaches and mapped (start, cost) of the ways to each departure: the cheapest departure of every objective, ties by name; objectives that choose the same departure at the same approach share a row (start, objectives, cost)."""
    both = costs.join(mapped.select("start", F.col("cost").alias("way")), "start").where("cost is not null and way is not null")
    best = both.groupBy("objective").agg(F.min(F.struct((F.col("cost") + F.col("way")).alias("cost"), "start")).alias("m")).select("objective", "m.start", "m.cost")
    return best.groupBy("start").agg(F.array_sort(F.collect_list("objective")).alias("objectives"), F.min("cost").alias("cost"))


#: Least weights of tree and shrub under brush avoidance.
BRUSH = 3.0


def objectives(spark, weights: tuple[float, float, float, float]) -> DataFrame:
    """(objective, ws, wt, wb, wg): as asked, by distance alone, and keeping away from brush."""
    ws, wt, wb, wg = map(float, weights)
    return spark.createDataFrame([("Recommended", ws, wt, wb, wg), ("Shortest distance", 0.0, 0.0, 0.0, 0.0), ("Brush avoidance", ws, max(BRUSH, wt), max(BRUSH, wb), wg)], "objective string, ws double, wt double, wb double, wg double")


def inserted_vertices(ends: DataFrame, segments: DataFrame, tolerance: float = 5.0, detour: float = 2.0) -> DataFrame:
    """(record, k, x, y, at) of junctions to insert into segments (record, k, ax, ay, bx, by, rid, name): where ends (record, x, y, rid, name) of other records project onto the record's nearest segment within the tolerance, by equal ids, equal names, or within `detour` metres by names that differ in DETOUR alone; `at` is the distance along the segment."""
    b = lambda v: F.floor(v / tolerance).cast("long")
    e = ends.select(F.col("record").alias("r1"), F.col("x").alias("px"), F.col("y").alias("py"), route_id(F.col("rid")).alias("i1"), route_name(F.col("name")).alias("n1"))
    e = e.withColumn("bi", b(F.col("px"))).withColumn("bj", b(F.col("py")))
    s = segments.select("record", "k", "ax", "ay", "bx", "by", route_id(F.col("rid")).alias("i2"), route_name(F.col("name")).alias("n2"))
    s = s.withColumn("bi", F.explode(F.sequence(b(F.least("ax", "bx") - tolerance), b(F.greatest("ax", "bx") + tolerance)))).withColumn("bj", F.explode(F.sequence(b(F.least("ay", "by") - tolerance), b(F.greatest("ay", "by") + tolerance))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-18))))
    j = e.join(s, ["bi", "bj"]).where("r1 <> record").withColumn("t", t).withColumn("x", F.col("ax") + F.col("t") * dx).withColumn("y", F.col("ay") + F.col("t") * dy).withColumn("at", F.col("t") * F.sqrt(dx * dx + dy * dy))
    j = j.withColumn("gap", F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2)).where(F.col("gap") <= tolerance)
    less = lambda n: F.replace(n, F.lit(" DETOUR"), F.lit(""))
    same = ((F.col("i1") != "") & (F.col("i1") == F.col("i2"))) | ((F.col("n1") != "") & ((F.col("n1") == F.col("n2")) | ((less(F.col("n1")) == less(F.col("n2"))) & (F.col("gap") <= detour))))
    best = j.where(same).groupBy("r1", "px", "py", "record").agg(F.min(F.struct("gap", "k", "x", "y", "at")).alias("m"))
    return best.select("record", "m.k", "m.x", "m.y", "m.at").distinct()


def with_evidence(roads: DataFrame, evidence: DataFrame, first, last) -> DataFrame:
    """roads (record, rid, ...) with motor: whether an evidence row (rid, vehicle, season) of the same id is open for all dates, and how many rows it has; roads without evidence stay, unopened."""
    open_ = (F.col("vehicle") == "open") & season_covers(F.col("season"), first, last)
    g = evidence.groupBy(F.col("rid").alias("__rid")).agg(F.bool_or(F.coalesce(open_, F.lit(False))).alias("motor"), F.count("*").alias("evidence"))
    return roads.join(g, F.col("rid") == F.col("__rid"), "left").drop("__rid").withColumn("motor", F.coalesce("motor", F.lit(False))).withColumn("evidence", F.coalesce("evidence", F.lit(0)))


#: Departures that a search takes.
MOST_DEPARTURES = 100_000


def departures(segments: DataFrame, target: tuple[float, float], reach: float = 1609.344, step: float = 20.0, pinned: tuple[float, float] | None = None, most: int = MOST_DEPARTURES) -> DataFrame:
    """(x, y) stations every `step` metres along segments (ax, ay, bx, by, and `line` if several make one), ends included, and each line's nearest point, all within reach of the target.

    A pinned departure joins them if it lies on a segment, and raises otherwise, as do more than `most` stations.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    at = lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - F.col("ax")) * dx + (y - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    line = F.col("line") if "line" in segments.columns else F.struct("ax", "ay", "bx", "by")
    near = segments.select(line.alias("line"), "ax", "ay", "bx", "by", at(F.lit(float(target[0])), F.lit(float(target[1]))).alias("t")).select("line", F.round(F.col("ax") + F.col("t") * dx, 6).alias("x"), F.round(F.col("ay") + F.col("t") * dy, 6).alias("y"))
    near = near.groupBy("line").agg(F.min(F.struct(((F.col("x") - target[0]) ** 2 + (F.col("y") - target[1]) ** 2).alias("d"), "x", "y")).alias("m")).select("m.x", "m.y")
    long = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    s = segments.withColumn("len", long).where("len > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.col("len") / step).cast("int"))))
    t = F.least(F.col("i") * step, F.col("len")) / F.col("len")
    p = s.select(F.round(F.col("ax") + t * (F.col("bx") - F.col("ax")), 6).alias("x"), F.round(F.col("ay") + t * (F.col("by") - F.col("ay")), 6).alias("y"))
    p = p.union(near).where((F.col("x") - target[0]) ** 2 + (F.col("y") - target[1]) ** 2 <= reach * reach)
    if pinned is not None:
        x, y = F.lit(float(pinned[0])), F.lit(float(pinned[1]))
        t = at(x, y)
        on = segments.where((F.col("ax") + t * dx - x) ** 2 + (F.col("ay") + t * dy - y) ** 2 < 1e-12)
        if not on.take(1):
            raise ValueError("the pinned departure lies on no mapped way")
        p = p.union(segments.sparkSession.createDataFrame([tuple(map(float, pinned))], "x double, y double"))
    p = p.distinct()
    n = p.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} departures: narrow the search")
    return p


def nearest_vertex(points: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """(id, gap, node, nx, ny): the nearest of vertices (node, x, y) to each of points (id, x, y), ties to the smaller node. Buckets are as wide as the reach, which doubles for points that have found none, until every point has one."""
    v = cut(vertices.select("node", F.col("x").alias("nx"), F.col("y").alias("ny")).distinct())
    left, out = cut(points.select("id", "x", "y")), None
    if not v.take(1):
        return left.select("id", F.lit(None).cast("double").alias("gap"), F.lit(None).cast(vertices.schema["node"].dataType).alias("node"), F.lit(None).cast("double").alias("nx"), F.lit(None).cast("double").alias("ny"))
    while True:
        b = lambda c: F.floor(F.col(c) / reach).cast("long")  # noqa: B023, E731
        wide = left.withColumn("bi", F.explode(F.sequence(b("x") - 1, b("x") + 1))).withColumn("bj", F.explode(F.sequence(b("y") - 1, b("y") + 1)))
        j = wide.join(v.withColumn("bi", b("nx")).withColumn("bj", b("ny")), ["bi", "bj"]).withColumn("gap", F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2))
        found = cut(j.where(F.col("gap") <= reach).groupBy("id").agg(F.min(F.struct("gap", "node", "nx", "ny")).alias("m")).select("id", "m.*"))
        out = found if out is None else out.union(found)
        left = cut(left.join(found.select("id"), "id", "left_anti"))
        if not left.take(1):
            return out
        reach *= 2


def merged_labels(paths: DataFrame) -> DataFrame:
    """Objectives (objective, path, cost) that found the same path become one row with their labels in order."""
    return paths.groupBy("path").agg(F.array_sort(F.collect_set("objective")).alias("objectives"), F.min("cost").alias("cost"))


def path_summary(steps: DataFrame) -> DataFrame:
    """steps (id, length, slope, tree, shrub, rise, ws, wt, wb, wg): the parts of each path's cost, length-weighted mean cover over known steps, unknown share of the length."""
    n, known = F.col("length"), F.col("tree").isNotNull() & F.col("shrub").isNotNull()
    part = lambda v: F.sum(v)
    return steps.groupBy("id").agg(
        part(n).alias("distance"),
        part(n * F.col("ws") * (F.col("slope") / 15) ** 2).alias("slope_part"),
        part(n * F.col("wt") * F.coalesce("tree", F.lit(1.0))).alias("tree_part"),
        part(n * F.col("wb") * F.coalesce("shrub", F.lit(1.0))).alias("shrub_part"),
        part(10 * F.col("wg") * F.greatest("rise", F.lit(0.0))).alias("gain_part"),
        F.try_divide(F.sum(F.when(known, n * F.col("tree"))), F.sum(F.when(known, n))).alias("mean_tree"),
        (F.sum(F.when(~known, n).otherwise(0.0)) / F.sum(n)).alias("unknown_share"),
    )


def _parts_of_tiles(open_: DataFrame, res: float, limit: float, side: int = PATCH) -> tuple[DataFrame, DataFrame]:
    """Cells (node, r, c, z) as (node, r, c, part), part being the least node that a cell hangs together with inside its tile, and the links (u, v) of parts of different tiles: only these are left for rounds of components."""
    t = lambda x: F.floor(x / side).cast("int")
    sent = open_.select("r", "c", "node", "z").withColumn("tr", F.explode(F.array_distinct(F.array(t(F.col("r") - 1), t(F.col("r")), t(F.col("r") + 1))))).withColumn("tc", F.explode(F.array_distinct(F.array(t(F.col("c") - 1), t(F.col("c")), t(F.col("c") + 1)))))

    def one(key, cells: pd.DataFrame) -> pd.DataFrame:
        n = side + 2
        i, j = (cells.r - key[0] * side + 1).to_numpy(), (cells.c - key[1] * side + 1).to_numpy()
        z, node = np.full((n, n), np.nan), np.full((n, n), np.iinfo(np.int64).max)
        z[i, j], node[i, j] = cells.z, cells.node
        have, inner = np.isfinite(z), np.zeros((n, n), bool)
        inner[1:-1, 1:-1] = True
        steps = []
        for a, b in STEPS8:
            m = (slice(max(0, -a), n - max(0, a)), slice(max(0, -b), n - max(0, b)))
            o = (slice(max(0, a), n - max(0, -a)), slice(max(0, b), n - max(0, -b)))
            free = have[m] & have[o]
            if a and b:
                free &= have[o[0], m[1]] & have[m[0], o[1]]
            with np.errstate(invalid="ignore"):
                free &= np.degrees(np.arctan(np.abs(z[o] - z[m]) / (res * math.hypot(a, b)))) <= limit
            steps.append((m, o, free))
        # a part goes by the least node in the tile; labels of labels are followed, so that long ways take few rounds
        at = np.arange(n * n).reshape(n, n)
        label = at.copy()
        while True:
            new = label.copy()
            for m, o, free in steps:
                ok = free & inner[m] & inner[o]
                np.minimum(new[m], np.where(ok, new[o], n * n), out=new[m])
            new = new.ravel()[new]
            if (new == label).all():
                break
            label = new
        mine = have & inner
        name = np.full(n * n, np.iinfo(np.int64).max)
        np.minimum.at(name, label[mine], node[mine])
        out = [pd.DataFrame({"node": node[mine], "r": np.nonzero(mine)[0] + key[0] * side - 1, "c": np.nonzero(mine)[1] + key[1] * side - 1, "part": name[label[mine]], "to": pd.array([None] * int(mine.sum()), "Int64")})]
        for m, o, free in steps:
            over = free & inner[m] & ~inner[o]
            if over.any():
                out.append(pd.DataFrame({"node": node[m][over], "r": 0, "c": 0, "part": name[label[m][over]], "to": pd.array(node[o][over], "Int64")}))
        return pd.concat(out)

    both = cut(sent.groupBy("tr", "tc").applyInPandas(one, "node long, r int, c int, part long, to long"))
    own = both.where("to is null").select("node", "r", "c", "part")
    links = both.where("to is not null").select("part", F.col("to").alias("node")).distinct().join(own.select("node", F.col("part").alias("v")), "node")
    return own, links.select(F.col("part").alias("u"), "v").distinct()


def connections(cells: DataFrame, seats: DataFrame, departures_: DataFrame, res: float, limits: tuple[float, ...] = (25.0, 30.0, 35.0)) -> DataFrame:
    """(id, status, limit) of seats (id, r, c): the first slope limit at which they hang together with a departure (r, c) over cells (r, c, z, slope, ok), or why not. Components of the grid for a fixed list of limits; diagonal steps don't cut corners."""
    out = None
    here = cells.select("r", "c", "z", "slope", "ok")
    for limit in limits:
        open_ = here.where(F.col("ok") & F.col("z").isNotNull() & (F.col("slope") <= limit)).withColumn("node", F.col("r").cast("long") * (1 << 31) + F.col("c"))
        own, links = _parts_of_tiles(open_, res, limit)
        parts = components(links, own.select(F.col("part").alias("node")).distinct()).withColumnRenamed("node", "part")
        label = own.join(parts, "part").select("r", "c", "label")
        reached = label.join(departures_.select("r", "c").distinct(), ["r", "c"]).select("label").distinct()
        found = seats.join(label, ["r", "c"]).join(reached, "label", "left_semi").select("id", F.lit(limit).alias("limit"))
        out = found if out is None else out.union(found)
    best = out.groupBy("id").agg(F.min("limit").alias("limit"))
    where = seats.join(here, ["r", "c"], "left").join(best, "id", "left")
    status = F.when(F.col("limit").isNotNull(), "connected").when(F.col("z").isNull(), "no terrain").when(~F.col("ok"), "outside the domain").when(F.col("slope") > limits[-1], "too steep").otherwise("no connection")
    return where.select("id", status.alias("status"), "limit")


def screened(found: DataFrame, cover: DataFrame, limit: float) -> DataFrame:
    """(id, status, reason, limit, next_limit) of a screen: found by `connections` (id, status, limit) over several limits, of which `limit` is the one asked for, and cover (id, complete), whether mapped ways are known all around a seat.

    A seat that hangs together with a departure is connected, however little is known of the ways. One that does so at a steeper limit alone is not, and has
    that limit as its next. Without a connection a seat is unavailable, not disconnected, where terrain or ways are unknown.
    """
    j = found.join(cover, "id", "left")
    near = F.coalesce(F.col("limit") <= limit, F.lit(False))
    cut_off = F.col("status").isin("connected", "no connection")
    reason = F.when(near, None).when(F.col("status") == "no terrain", "missing_terrain").when(cut_off & ~F.coalesce("complete", F.lit(False)), "network_coverage").when(F.col("status") == "outside the domain", "outside").when(F.col("status") == "too steep", "slope").otherwise("disconnected")
    status = F.when(near, "connected").when(reason.isin("missing_terrain", "network_coverage"), "unavailable").otherwise("no connection")
    return j.select("id", status.alias("status"), reason.alias("reason"), F.when(near, F.col("limit")).alias("limit"), F.when(~near, F.col("limit")).alias("next_limit"))


def eligible(candidates: DataFrame, screened: DataFrame) -> DataFrame:
    """Candidates (id, ...) that the screen (id, status) found connected."""
    return candidates.join(screened.where("status = 'connected'").select("id").distinct(), "id", "left_semi")
