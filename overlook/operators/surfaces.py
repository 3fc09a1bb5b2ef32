"""Closed surfaces around cells, and ground between measured points."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import rounded_distance
from ..functions.scoring import curvature_drop

#: The surface lies this far outside of the cells, so that cells that touch share one; edges are rounded by ROUND; a node that no cell reaches is FAR away.
MARGIN, ROUND, FAR = 0.001, 0.25, 10.0
#: Lattice places count from here, 20 bits each.
ORIGIN = 1 << 19

#: A cube's six tetrahedra: the ways from its first corner to its last along one axis after the other. Corners are bits (x, y, z).
TETRAHEDRA = tuple((0, 1 << a, 1 << a | 1 << b, 7) for a, b, _ in permutations(range(3)))
TRIANGLES = "ka long, kb long, kc long, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz")


def _node(i, j, k):
    return ((i + ORIGIN) << 40) | ((j + ORIGIN) << 20) | (k + ORIGIN)


def lattice_field(centres: DataFrame, side: float, step: float) -> DataFrame:
    """(i, j, k, v): distance to the nearest rounded cell at each place of a global lattice of `step` metres that any of centres (x, y, z) reaches; a place's cells meet by a minimum before the shuffle."""
    n = -int(-1 // step)
    o = F.sequence(F.lit(-n), F.lit(n))
    near = centres.select(*((F.rint(F.col(c) - 0.5) + 0.5).alias(c) for c in "xyz")).distinct()
    near = near.select(*(F.rint(F.col(c) / step).cast("long").alias(f"c{c}") for c in "xyz"), F.explode(o).alias("a")).withColumn("b", F.explode(o)).withColumn("d", F.explode(o))
    v = rounded_distance(F.col("a") * step, F.col("b") * step, F.col("d") * step, side, ROUND)
    return near.select((F.col("cx") + F.col("a")).alias("i"), (F.col("cy") + F.col("b")).alias("j"), (F.col("cz") + F.col("d")).alias("k"), v.alias("v")).groupBy("i", "j", "k").agg(F.min("v").alias("v"))


def _triangles(step: float, level: float):
    """Triangles of the cubes (i, j, k, v: eight values, those of corners x + 2y + 4z) that the level passes. Vertices lie on lattice edges and are named by them, so that cubes that share an edge share its vertex, bit for bit."""
    corner = np.array([[b & 1, b >> 1 & 1, b >> 2 & 1] for b in range(8)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            values = np.stack(rows.v.to_numpy())
            base = rows[["i", "j", "k"]].to_numpy(np.int64)

            def vertex(at: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """(name, place) of the crossing between two corners of each cube; a corner's bits are part of the other's."""
                low, high = np.minimum(one, two), np.maximum(one, two)
                a = base[at] + corner[low]  # noqa: B023
                fa, fb = values[at, low], values[at, high]  # noqa: B023
                t = (level - fa) / (fb - fa)
                return _node(*a.T) * 8 + (low ^ high), (a + t[:, None] * corner[low ^ high]) * step

            out = []
            for tet in TETRAHEDRA:
                tet = np.array(tet)
                inside = values[:, tet] < level
                # a tetrahedron's hand: the sign of its edges' product
                hand = np.linalg.det((corner[tet[1:]] - corner[tet[0]]).astype(float)) > 0
                for count in (1, 2, 3):
                    at = np.flatnonzero(inside.sum(1) == count)
                    if not len(at):
                        continue
                    # corners in an order that puts those inside first, by even permutations
                    order = np.argsort(~inside[at], axis=1, kind="stable")
                    odd = np.array([sum(p[x] > p[y] for x in range(4) for y in range(x + 1, 4)) % 2 for p in order], bool)
                    p = tet[order]
                    flip = odd ^ (not hand)
                    if count == 1:
                        tris = [((0, 1), (0, 2), (0, 3))]
                    elif count == 3:
                        tris = [((3, 0), (3, 1), (3, 2))]
                    else:
                        tris = [((0, 2), (0, 3), (1, 2)), ((1, 2), (0, 3), (1, 3))]
                    for tri in tris:
                        ends = [vertex(at, p[:, x], p[:, y]) for x, y in tri]
                        one, two, three = ends
                        keys = np.stack([one[0], np.where(flip, three[0], two[0]), np.where(flip, two[0], three[0])], axis=1)
                        places = np.concatenate([one[1], np.where(flip[:, None], three[1], two[1]), np.where(flip[:, None], two[1], three[1])], axis=1)
                        out.append((keys, places))
            if out:
                keys, places = np.concatenate([k for k, _ in out]), np.concatenate([x for _, x in out])
                yield pd.DataFrame({**{f"k{c}": keys[:, n] for n, c in enumerate("abc")}, **{f"{v}{x}": places[:, 3 * n + m] for n, v in enumerate("abc") for m, x in enumerate("xyz")}})

    return run


def foliage_surface(centres: DataFrame, side: float, step: float, level: float = MARGIN) -> DataFrame:
    """(ka, kb, kc, ax..cz): triangles, seen from outside counter-clockwise, of the closed surface around rounded cells of `side` metres about centres (x, y, z) snapped to whole metres.

    The distance field lives on one lattice for all; each cube of it that the surface passes is cut into tetrahedra, so that every edge of a triangle lies in
    exactly two of them, whatever task made them: there are no tiles that could part, and no volume is held anywhere. ka, kb, kc name
    vertices.
    """
    field = lattice_field(centres, side, step)
    corners = F.array(*(F.struct(F.lit(b).alias("b"), *((F.col(c) - (b >> n & 1)).alias(c) for n, c in enumerate("ijk"))) for b in range(8)))
    each = field.select("v", F.explode(corners).alias("x")).select("x.*", "v")
    at = F.map_from_entries(F.collect_list(F.struct("b", "v")))
    cubes = each.groupBy("i", "j", "k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), at.alias("at"))
    cubes = cubes.where((F.col("low") < level) & ((F.col("high") >= level) | (F.col("n") < 8)))
    values = F.array(*(F.coalesce(F.element_at("at", F.lit(b)), F.lit(FAR)) for b in range(8)))
    return cubes.select("i", "j", "k", values.alias("v")).mapInPandas(_triangles(step, level), TRIANGLES)


def seen_from(centres: DataFrame, back: bool = False, k: float = 6 / 7) -> DataFrame:
    """Points (x, y, z) about an observer at the origin with the earth's curvature taken out of their heights, or put back."""
    drop = curvature_drop(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), k)
    return centres.withColumn("z", F.col("z") - drop if back else F.col("z") + drop)


def open_edges(triangles: DataFrame) -> DataFrame:
    """(u, v, n): edges that don't lie in two triangles that run along them in opposite ways; none if the surface is closed."""
    ends = F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("ka", "kb"), ("kb", "kc"), ("kc", "ka"))))
    e = triangles.select(F.explode(ends).alias("e")).select("e.*")
    way = F.when(F.col("u") < F.col("v"), 1).otherwise(-1)
    return e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"), F.sum(way).alias("sum")).where("n <> 2 or sum <> 0").select("u", "v", "n")
