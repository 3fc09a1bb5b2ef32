"""Predicates with a matching side and an unknown side, and polygon masks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terrain import disk, disk_sums, octant


def known(v):
    """Cover that lies in 0..1."""
    return F.coalesce((v >= 0) & (v <= 1), F.lit(False))


def criteria(grid: DataFrame, ranges: dict[str, tuple[float, float]], octants: list[int] | None = None) -> DataFrame:
    """r, c, matching, unknown. ranges: closed ranges by column (slope, aspect and z as they stand, tree and shrub in percent); octants of `aspect`.

    A cell matches if every enabled criterion is known and met; it is unknown if any enabled one is unknown.
    """
    have = F.col("z").isNotNull()
    matching, unknown = have, ~have
    for name, (lo, hi) in ranges.items():
        v = F.col(name)
        ok = known(v) if name in ("tree", "shrub") else v.isNotNull()
        v = v * 100 if name in ("tree", "shrub") else v
        matching = matching & ok & F.coalesce((v >= lo) & (v <= hi), F.lit(False))
        unknown = unknown | ~ok
    if octants:
        ok = F.col("aspect").isNotNull()
        matching = matching & ok & F.coalesce(octant(F.col("aspect")).isin(octants), F.lit(False))
        unknown = unknown | ~ok
    return grid.select("r", "c", matching.alias("matching"), unknown.alias("unknown"))


def standing(grid: DataFrame, radius: float, res: float, percent: float) -> DataFrame:
    """r, c, eligible: four fifths of the disk known, and mean tree cover below the threshold."""
    ok = known(F.col("tree"))
    s = disk_sums(grid, radius, res, {"n": ok.cast("int"), "total": F.when(ok, F.col("tree")).otherwise(0.0)})
    return s.select("r", "c", ((F.col("n") / len(disk(radius, res)) >= 0.8) & (F.col("total") / F.greatest(F.col("n"), F.lit(1.0)) < percent / 100 - 1e-7)).alias("eligible"))


def polygon_mask(points: DataFrame, edges: DataFrame, band: float) -> DataFrame:
    """points (px, py, ...) inside polygons given by edges (poly, ax, ay, bx, by), rings and holes alike: odd crossings.

    Edges go to the bands of y that they span, points to their own band, so the join is an equi-join.
    """
    cut = lambda y: F.floor(y / band).cast("long")
    spans = edges.where("ay <> by").withColumn("band", F.explode(F.sequence(cut(F.least("ay", "by")), cut(F.greatest("ay", "by")))))
    at = points.withColumn("band", cut(F.col("py")))
    crosses = ((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))) & (F.col("px") < (F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    hit = at.join(spans, "band").where(crosses)
    return hit.groupBy("poly", *points.columns).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def access(points: DataFrame, evidence: DataFrame, require_verified: bool, max_hike_km: float | None, max_gain_m: float | None) -> DataFrame:
    """points that the supplied evidence (id, reachable, evidence, hike_km, gain_m) doesn't rule out; limits need verified rows."""
    j = points.join(evidence, "id", "left")
    verified = F.coalesce((F.col("reachable") == "verified") & (F.length("evidence") > 0), F.lit(False))
    ok = ~F.coalesce(F.col("reachable").isin("prohibited", "denied", "excluded"), F.lit(False))
    if require_verified:
        ok = ok & verified
    for name, limit in (("hike_km", max_hike_km), ("gain_m", max_gain_m)):
        if limit is not None:
            ok = ok & verified & F.coalesce(F.col(name) <= limit, F.lit(False))
    return j.where(ok).select(*points.columns, verified.alias("verified"))


#: Points of a bucket that share a task.
POINTS = 1 << 16
#: Points of a part of a bucket that are held against its segments one by one.
FEW = 32


def _nearest(x: np.ndarray, y: np.ndarray, seg: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, nx and ny of the nearest of segments (ax, ay, bx, by: rows of seg) to each point, infinite beyond `most`. The points are quartered until few are left; of the segments, a quarter keeps those
    that may be nearest to one of its points: no farther from its middle than the nearest one and twice its half diagonal."""
    found, nx, ny = np.full(len(x), np.inf), np.full(len(x), np.nan), np.full(len(x), np.nan)

    def held(px, py, k):
        ax, ay, bx, by = seg[k].T
        dx, dy = bx - ax, by - ay
        t = np.maximum(0.0, np.minimum(1.0, ((px - ax) * dx + (py - ay) * dy) / np.maximum(dx * dx + dy * dy, 1e-18)))
        qx, qy = ax + t * dx, ay + t * dy
        return np.sqrt((px - qx) ** 2 + (py - qy) ** 2), qx, qy

    open_ = [(np.arange(len(x)), np.arange(len(seg)))]
    while open_:
        at, k = open_.pop()
        lo_x, hi_x, lo_y, hi_y = x[at].min(), x[at].max(), y[at].min(), y[at].max()
        far = math.hypot(hi_x - lo_x, hi_y - lo_y) / 2
        if len(at) > FEW or far == 0:
            mx, my = (lo_x + hi_x) / 2, (lo_y + hi_y) / 2
            d = held(mx, my, k)[0]
            k = k[d <= min(d.min() + 2 * far, most + far) * (1 + 1e-9) + 1e-6]
            if not len(k):
                continue
        if len(at) > FEW and far > 0:
            quarter = (x[at] > mx) * 2 + (y[at] > my)
            open_ += [(at[quarter == q], k) for q in range(4) if (quarter == q).any()]
            continue
        for i in at[:1] if far == 0 else at:
            d, qx, qy = held(x[i], y[i], k)
            least = d.min()
            if least <= most:
                ties = np.flatnonzero(d == least)
                j = ties[np.lexsort((qy[ties], qx[ties]))[0]]
                same = at if far == 0 else i
                found[same], nx[same], ny[same] = least, qx[j], qy[j]
    return found, nx, ny


def nearest_segment(points: DataFrame, segments: DataFrame, bucket: float, most: float) -> DataFrame:
    """points (id, x, y, z) with the nearest point of segments (ax, ay, bx, by) within `most` metres: (id, distance, nx, ny); NULLs if none is."""
    return points.join(_segments_found(points, segments, bucket, most), "id", "left")


def _segments_found(points: DataFrame, segments: DataFrame, bucket: float, most: float) -> DataFrame:
    """(id, distance, nx, ny) of the points that have a segment within `most` metres.

    Segments go to the buckets around their bounding box, points to their own bucket, and meet as arrays: no row a pair. Of equal distances the least (nx, ny) counts.
    """
    b = lambda v: F.floor(v / bucket).cast("long")
    ends = ("ax", "ay", "bx", "by")
    s = segments.select(*(F.col(c).cast("double").alias(c) for c in ends)).distinct().where(" and ".join(f"{c} is not null and not isnan({c})" for c in ends))
    s = s.withColumn("bi", F.explode(F.sequence(b(F.least("ax", "bx") - most), b(F.greatest("ax", "bx") + most)))).withColumn("bj", F.explode(F.sequence(b(F.least("ay", "by") - most), b(F.greatest("ay", "by") + most))))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumn("bi", b(F.col("x"))).withColumn("bj", b(F.col("y")))
    p = p.join(s.select("bi", "bj").distinct(), ["bi", "bj"], "left_semi")
    parts = p.groupBy("bi", "bj").agg(F.ceil(F.count("*") / F.lit(POINTS)).cast("int").alias("__n"))
    p = p.join(parts, ["bi", "bj"]).withColumn("__p", F.pmod(F.xxhash64("x", "y"), F.col("__n")).cast("int")).drop("__n")
    s = s.join(parts, ["bi", "bj"]).withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")

    def one(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({"id": [], "distance": [], "nx": [], "ny": []})
        d, nx, ny = _nearest(here.x.to_numpy(), here.y.to_numpy(), there[list(ends)].to_numpy(), most)
        return pd.DataFrame({"id": here.id, "distance": d, "nx": nx, "ny": ny})[d <= most]

    by = ["bi", "bj", "__p"]
    best = p.groupBy(*by).cogroup(s.groupBy(*by)).applyInPandas(one, f"id {points.schema['id'].dataType.simpleString()}, distance double, nx double, ny double")
    return best.groupBy("id").agg(F.min(F.struct("distance", "nx", "ny")).alias("m")).select("id", "m.*")


def network_access(points: DataFrame, segments: DataFrame, heights: DataFrame, x0: float, y0: float, res: float, bucket: float, most: float, distance_m: float | None = None, height_m: float | None = None) -> DataFrame:
    """points (id, x, y) with their nearest line point and what follows from it: (id, status, distance, height, nx, ny).

    height is how far the point lies above the line point, never below none, from the cells (r, c, z) that hold
    them; NULL if either is unknown. status: excluded beyond a limit, unknown where the height limit can't be
    told, or where no segment lies within `most`, qualifies otherwise.
    """
    cell = lambda x, y: (F.floor((y0 - y) / res).cast("int"), F.floor((x - x0) / res).cast("int"))
    best = _segments_found(points.select("id", "x", "y"), segments, bucket, most)  # only these have a line point: without, NULL cells would all share a task

    def raised(df, x, y, name):
        r, c = cell(F.col(x), F.col(y))
        return df.withColumn("__r", r).withColumn("__c", c).join(heights.select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("z").alias(name)), ["__r", "__c"], "left").drop("__r", "__c")

    at = raised(points.select("id", "x", "y"), "x", "y", "__zp").join(raised(best, "nx", "ny", "__zn"), "id", "left")
    height = F.greatest(F.lit(0.0), F.col("__zp") - F.col("__zn"))
    height = F.when(F.col("__zp").isNotNull() & F.col("__zn").isNotNull(), height)
    far = F.lit(False) if distance_m is None else F.col("distance") > distance_m
    high = F.lit(False) if height_m is None else F.coalesce(height > height_m, F.lit(False))
    blind = F.lit(False) if height_m is None else height.isNull()
    status = F.when(F.col("distance").isNull(), "unknown").when(far | high, "excluded").when(blind, "unknown").otherwise("qualifies")
    return at.select("id", status.alias("status"), "distance", height.alias("height"), "nx", "ny")


def excluded_cells(grid: DataFrame, segments: DataFrame, x0: float, y0: float, res: float, bucket: float, most: float, distance_m: float | None = None, height_m: float | None = None) -> DataFrame:
    """Cells (r, c) of a grid (r, c, z) whose centre the network rules out for sampling: `network_access` for each of them. Kept as cells, not as polygons."""
    p = grid.select(F.struct("r", "c").alias("id"), (x0 + (F.col("c") + 0.5) * res).alias("x"), (y0 - (F.col("r") + 0.5) * res).alias("y"))
    out = network_access(p, segments, grid, x0, y0, res, bucket, most, distance_m, height_m)
    return out.where("status <> 'qualifies'").select("id.r", "id.c", "status")


def layer_mask(points: DataFrame, edges: DataFrame, band: float, repaired: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mask, log) of a layer of polygons: points inside any of them, once each, and for polygons whose edges came repaired (poly, ax, ay, bx, by), how many points the repair changed."""
    own = polygon_mask(points, edges, band)
    if repaired is None:
        return own.drop("poly").distinct(), own.select("poly").limit(0).withColumn("changed", F.lit(0).cast("long"))
    fixed = repaired.select("poly").distinct()
    new = polygon_mask(points, repaired, band)
    old = own.join(fixed, "poly", "left_semi")
    changed = old.exceptAll(new).unionByName(new.exceptAll(old)).groupBy("poly").agg(F.count("*").alias("changed"))
    log = fixed.join(changed, "poly", "left").select("poly", F.coalesce("changed", F.lit(0)).alias("changed"))
    return own.join(fixed, "poly", "left_anti").unionByName(new).drop("poly").distinct(), log


def domains(grid: DataFrame, observers: DataFrame, targets: DataFrame, excluded: DataFrame) -> DataFrame:
    """grid (r, c, ...) with observer and target: two independent domains (r, c), less the excluded cells. Heights stay, for what isn't a target still hides what is."""
    flag = lambda cells, name: cells.select("r", "c").distinct().join(excluded.select("r", "c").distinct(), ["r", "c"], "left_anti").withColumn(name, F.lit(True))
    out = grid.join(flag(observers, "observer"), ["r", "c"], "left").join(flag(targets, "target"), ["r", "c"], "left")
    return out.withColumn("observer", F.coalesce("observer", F.lit(False))).withColumn("target", F.coalesce("target", F.lit(False)))


def low_cover(visible: DataFrame, limit: float = 0.1) -> DataFrame:
    """Visible cells with known shrub and known tree cover below the limit."""
    return visible.where(known(F.col("tree")) & (F.col("tree") < limit) & known(F.col("shrub")))


def recommendable(candidates: DataFrame) -> DataFrame:
    """Candidates that may be recommended: not placed by hand, standing allowed (NULL: allowed), something that matches in sight (NULL: anything in sight), effective habitat above none where habitat was scored."""
    seen = F.coalesce("matching", "raw") > 0
    habitat = ~F.col("habitat") | (F.coalesce("effective", F.lit(0.0)) > 0)
    return candidates.where((F.col("grp") != "manual") & F.coalesce("standing", F.lit(True)) & F.coalesce(seen, F.lit(False)) & F.coalesce(habitat, F.lit(True)))


def dilated(cells: DataFrame, radius: float, res: float) -> DataFrame:
    """Cells (r, c) within the radius of any of the cells, centre to centre."""
    around = F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in disk(radius, res)))
    return cells.select("r", "c").distinct().select(F.explode(around).alias("x")).select("x.*").distinct()


def clipped(segments: DataFrame, cells: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """(id, k, ax, ay, bx, by, inside) of segments (id, ax, ay, bx, by) cut where they cross a row or column of the grid; inside tells whether the piece runs in one of the cells (r, c). Pieces that come twice, whichever way they run, are kept once an id."""

    def cuts(a, b):
        lo, hi = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
        lines = F.when((hi >= lo) & (a != b), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda v: (v - a) / (b - a))

    col, row = (lambda x: (F.col(x) - x0) / res), (lambda y: (y0 - F.col(y)) / res)
    ts = F.array_sort(F.array_distinct(F.transform(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts(col("ax"), col("bx")), cuts(row("ay"), row("by"))), lambda t: F.round(t, 12))))
    s = segments.select("id", "ax", "ay", "bx", "by", ts.alias("ts"))
    s = s.select("*", F.posexplode(F.arrays_zip(F.slice("ts", 1, F.size("ts") - 1).alias("t0"), F.slice("ts", 2, F.size("ts") - 1).alias("t1"))).alias("k", "t"))
    on = lambda t: ((F.col("ax") + t * (F.col("bx") - F.col("ax"))), (F.col("ay") + t * (F.col("by") - F.col("ay"))))
    (px, py), (qx, qy), (mx, my) = on(F.col("t.t0")), on(F.col("t.t1")), on((F.col("t.t0") + F.col("t.t1")) / 2)
    pieces = s.select("id", "k", px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"), F.floor((y0 - my) / res).cast("int").alias("r"), F.floor((mx - x0) / res).cast("int").alias("c"))
    held = pieces.join(cells.select("r", "c").distinct().withColumn("inside", F.lit(True)), ["r", "c"], "left")
    ends = F.array_sort(F.array(F.struct(F.round("px", 6).alias("x"), F.round("py", 6).alias("y")), F.struct(F.round("qx", 6).alias("x"), F.round("qy", 6).alias("y"))))
    first = held.groupBy("id", ends.alias("ends")).agg(F.min(F.struct("k", "px", "py", "qx", "qy", F.coalesce("inside", F.lit(False)).alias("inside"))).alias("m"))
    return first.select("id", "m.k", F.col("m.px").alias("ax"), F.col("m.py").alias("ay"), F.col("m.qx").alias("bx"), F.col("m.qy").alias("by"), "m.inside")


def covered_segments(segments: DataFrame, cells: DataFrame, x0: float, y0: float, res: float, max_slope: float) -> DataFrame:
    """(id, covered) of segments (id, ax, ay, bx, by): every cell they run through is one of the cells (r, c, z, slope) with known height and a slope within the limit, and the way from end to end isn't steeper."""
    ok = cells.where(F.col("z").isNotNull() & (F.col("slope") <= max_slope))
    inside = clipped(segments, ok, x0, y0, res).groupBy("id").agg(F.bool_and("inside").alias("inside"))
    s = segments.join(inside, "id", "left")
    for k in "ab":
        s = s.withColumn("r", F.floor((y0 - F.col(f"{k}y")) / res).cast("int")).withColumn("c", F.floor((F.col(f"{k}x") - x0) / res).cast("int")).join(ok.select("r", "c", F.col("z").alias(f"z{k}")), ["r", "c"], "left").drop("r", "c")
    long = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    grade = F.when(long > 0, F.degrees(F.atan(F.abs(F.col("za") - F.col("zb")) / long))).otherwise(0.0)
    return s.select("id", F.coalesce(F.col("inside") & (grade <= max_slope), F.lit(False)).alias("covered"))
