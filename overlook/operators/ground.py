"""Ground between measured points: Delaunay triangles made tile by tile, and heights on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut

#: Metres of a tile, of an edge at most, of a circle round a triangle at most, and of a bin that gives one measured point.
SIDE, EDGE, WIDEST, BIN = 64.0, 5.0, 250.0, 0.25
#: Points are moved by up to this, by their own coordinates, so that no four lie on one circle and every tile makes the same triangles.
SHIFT = 1e-5


def one_a_bin(points: DataFrame, size: float = BIN) -> DataFrame:
    """(x, y, z): of all measured points in a bin one, the least; no height is averaged."""
    b = lambda c: F.floor(F.col(c) / size)
    return points.groupBy(b("x").alias("bx"), b("y").alias("by")).agg(F.min(F.struct("x", "y", "z")).alias("m")).select("m.*")


def shifted(xy: np.ndarray) -> np.ndarray:
    """The points moved a little, each by a hash of where it is."""
    h = xy.astype(np.float64).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h[:, 0] ^= np.roll(h, 1, axis=1)[:, 0] >> np.uint64(7)
    h[:, 1] ^= h[:, 0] >> np.uint64(11)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return xy + ((h >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5) * 2 * SHIFT


def _in_circle(a, b, c, p) -> bool:
    """Whether p lies inside the circle through a, b, c, which run counter-clockwise."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


def triangulated(xy: np.ndarray) -> np.ndarray:
    """(n, 3): the Delaunay triangles of points in general position. Points go in one by one, along strips, so that each is found by a short walk from the last; what its place spoils is a hole that it fans out in."""
    if len(xy) < 3:
        return np.zeros((0, 3), np.int64)
    low, high = xy.min(0), xy.max(0)
    wide = 1e4 * max(float((high - low).max()), 1.0)
    mid = (low + high) / 2
    p = [*map(tuple, xy.tolist()), (mid[0] - wide, mid[1] - wide), (mid[0] + wide, mid[1] - wide), (mid[0], mid[1] + wide)]
    n = len(xy)
    corner, beside = [(n, n + 1, n + 2)], [[-1, -1, -1]]  # beside[t][i] lies across from corner i
    strips = max(1, int(math.sqrt(n / 4)))
    strip = np.minimum((xy[:, 1] - low[1]) / max(float(high[1] - low[1]), 1e-9) * strips, strips - 1).astype(int)
    order = np.lexsort((np.where(strip % 2, -xy[:, 0], xy[:, 0]), strip))
    alive, at = {0}, 0
    for v in order.tolist():
        q = p[v]
        while True:  # towards the side that has the point on its other hand
            t = corner[at]
            for i in range(3):
                a, b = p[t[(i + 1) % 3]], p[t[(i + 2) % 3]]
                if (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) < 0:
                    at = beside[at][i]
                    break
            else:
                break
        hole, stack, rim = {at}, [at], []
        while stack:
            t = stack.pop()
            for i in range(3):
                o = beside[t][i]
                if o in hole:
                    continue
                if o >= 0 and _in_circle(*(p[c] for c in corner[o]), q):
                    hole.add(o)
                    stack.append(o)
                else:
                    rim.append((corner[t][(i + 1) % 3], corner[t][(i + 2) % 3], o, t))
        rim = [e for e in rim if e[2] not in hole]
        first = len(corner)
        starts = {}
        for k, (a, b, o, t) in enumerate(rim):
            corner.append((v, a, b))
            beside.append([o, -1, -1])
            starts[a] = first + k
            if o >= 0:
                beside[o][beside[o].index(t)] = first + k
        for k, (_, b, _, _) in enumerate(rim):
            beside[first + k][1] = starts[b]
            beside[starts[b]][2] = first + k
        alive -= hole
        alive |= set(range(first, len(corner)))
        at = first
    out = [corner[t] for t in alive if max(corner[t]) < n]
    return np.array(out, np.int64).reshape(len(out), 3)


def circles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, radii) of the circles through three points each."""
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        o = np.stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu], axis=1) / d[:, None]
    return a + o, np.hypot(*o.T)


CORNERS = [f"{v}{x}" for v in "abc" for x in "xyz"]


def ground_triangles(points: DataFrame, edge: float = EDGE, side: float = SIDE, widest: float = WIDEST) -> DataFrame:
    """(ax, ay, az, bx, .., cz): the Delaunay triangles of all points (x, y, z; one a place) whose edges are at most `edge` and whose circle's radius is at most `widest` (flatter ones hold no ground), counter-clockwise from their least corner.

    A task has the points of a tile and of `edge` metres around it. A triangle belongs to the tile of its least corner, and has all corners there; as its circle is empty of all points, it is
    one of that task's triangles, so none is missing and none is there twice. A task may make others whose circle reaches beyond its points: these are held against the points there, and go if
    any lies inside.
    """
    pts = cut(points.select(*(F.col(c).cast("double").alias(c) for c in "xyz")))
    t = lambda v: F.floor(v / side).cast("long")
    dealt = pts.withColumn("tx", F.explode(F.sequence(t(F.col("x") - edge), t(F.col("x") + edge)))).withColumn("ty", F.explode(F.sequence(t(F.col("y") - edge), t(F.col("y") + edge))))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        xyz = g[["x", "y", "z"]].to_numpy()
        xyz = xyz[np.lexsort((xyz[:, 1], xyz[:, 0]))]
        moved = shifted(np.ascontiguousarray(xyz[:, :2]))
        low = np.array([g.tx.iloc[0], g.ty.iloc[0]]) * side
        tri = triangulated(moved)
        roll = tri.argmin(1)  # points are in order, so the least corner has the least number
        tri = np.stack([tri[np.arange(len(tri)), (roll + k) % 3] for k in range(3)], axis=1)
        a, b, c = (xyz[tri[:, k], :2] for k in range(3))
        far = np.max([np.hypot(*(x - y).T) for x, y in ((a, b), (b, c), (c, a))], axis=0) if len(tri) else np.zeros(0)
        own = (np.floor(a / side) * side == low).all(axis=1)
        centre, radius = circles(*(moved[tri[:, k]] for k in range(3)))
        keep = own & (far <= edge) & (radius <= widest)
        tri, centre, radius = tri[keep], centre[keep], radius[keep]
        sure = ((centre - radius[:, None] >= low - edge) & (centre + radius[:, None] <= low + side + edge)).all(axis=1)
        out = {n: xyz[tri[:, k // 3], k % 3] for k, n in enumerate(CORNERS)}
        return pd.DataFrame({**out, "ox": centre[:, 0], "oy": centre[:, 1], "radius": radius, "sure": sure})

    made = dealt.groupBy("tx", "ty").applyInPandas(one, ", ".join(f"{n} double" for n in [*CORNERS, "ox", "oy", "radius"]) + ", sure boolean")
    made = cut(made)
    doubt = made.where("not sure").withColumn("tx", F.explode(F.sequence(t(F.col("ox") - F.col("radius")), t(F.col("ox") + F.col("radius"))))).withColumn("ty", F.explode(F.sequence(t(F.col("oy") - F.col("radius")), t(F.col("oy") + F.col("radius")))))
    # tiles without points say nothing: only those that hold some are compared
    here = pts.withColumn("tx", t(F.col("x"))).withColumn("ty", t(F.col("y")))
    meets = doubt.join(here, ["tx", "ty"])
    corner = [(F.col("x") == F.col(f"{v}x")) & (F.col("y") == F.col(f"{v}y")) for v in "abc"]
    inside = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 < (F.col("radius") - 4 * SHIFT) ** 2
    spoiled = meets.where(inside & ~corner[0] & ~corner[1] & ~corner[2]).select(*CORNERS).distinct()
    return made.select(*CORNERS).join(spoiled, CORNERS, "left_anti")


def ground_heights(triangles: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """(r, c, z) of a lattice (x = x0 + c res, y = y0 - r res) wherever it lies on a triangle; on an edge, the triangle of the least corners counts."""
    lo = lambda axis: F.least(*(F.col(f"{v}{axis}") for v in "abc"))
    hi = lambda axis: F.greatest(*(F.col(f"{v}{axis}") for v in "abc"))
    down = F.sequence(F.ceil((y0 - hi("y")) / res - 1e-9).cast("long"), F.floor((y0 - lo("y")) / res + 1e-9).cast("long"))
    across = F.sequence(F.ceil((lo("x") - x0) / res - 1e-9).cast("long"), F.floor((hi("x") - x0) / res + 1e-9).cast("long"))
    some = (F.ceil((y0 - hi("y")) / res - 1e-9) <= F.floor((y0 - lo("y")) / res + 1e-9)) & (F.ceil((lo("x") - x0) / res - 1e-9) <= F.floor((hi("x") - x0) / res + 1e-9))
    at = triangles.where(some).withColumn("r", F.explode(down)).withColumn("c", F.explode(across)).withColumn("px", x0 + F.col("c") * res).withColumn("py", y0 - F.col("r") * res)
    d = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    u = ((F.col("px") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("py") - F.col("ay"))) / F.when(d != 0, d)
    v = ((F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")) - (F.col("px") - F.col("ax")) * (F.col("by") - F.col("ay"))) / F.when(d != 0, d)
    on = at.withColumn("u", u).withColumn("v", v).where("u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9")
    z = F.col("az") + F.col("u") * (F.col("bz") - F.col("az")) + F.col("v") * (F.col("cz") - F.col("az"))
    first = F.row_number().over(Window.partitionBy("r", "c").orderBy(*CORNERS))
    return on.withColumn("z", z).withColumn("n", first).where("n = 1").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "z")
