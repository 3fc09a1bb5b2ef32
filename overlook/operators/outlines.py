"""Cells to polygons: tiles trace the rings of their cells, and only chains that go on in other tiles are put in order by pointer jumping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut
from .network import components

#: A cell's four sides in turn: the way along each and the corner it starts from, as (row, column). What lies outside of a side is what lies ahead of the one before.
AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
#: Half of a number's bits are for the row.
ROW = 1 << 31
#: Cells along a tile.
SIDE = 128


def _chains(nxt: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, last, closed): edges in order of their chain and of their place in it, each one's last edge, and whether its chain is a ring, which then starts at its least name. nxt: the edge that follows, -1 where none is here."""
    far, least, ended = np.where(nxt >= 0, nxt, np.arange(len(nxt))), name, -1
    while True:
        new = np.minimum(least, least[far])
        far = far[far]
        now = np.count_nonzero(nxt[far] < 0)
        if now == ended and (new == least).all():
            break
        least, ended = new, now
    closed = nxt[far] >= 0
    nxt = np.where(closed & (name[nxt] == least), -1, nxt)  # rings are cut before their least edge
    far, left = np.where(nxt >= 0, nxt, np.arange(len(nxt))), (nxt >= 0).astype(int)
    while (nxt[far] >= 0).any():
        left, far = left + left[far], far[far]
    return np.lexsort((-left, far)), far, closed


def _parts(right: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The least place (row by row) that each cell hangs together with: right and down say whether it does with the cell on that side."""
    label = np.arange(len(right) * right.shape[1]).reshape(right.shape)
    top = label.size
    while True:
        new = label.copy()
        for here, there, joined in ((np.s_[:, :-1], np.s_[:, 1:], right[:, :-1]), (np.s_[:-1], np.s_[1:], down[:-1])):
            np.minimum(new[here], np.where(joined, new[there], top), out=new[here])
            np.minimum(new[there], np.where(joined, new[here], top), out=new[there])
        new = new.ravel()[new]
        if (new == label).all():
            return label
        label = new


TRACED = "what int, chain long, i int, r int, c int, part long, loose boolean, closed boolean, hole boolean, next long, least long, n int, twice long"


def _traced(cells: DataFrame, by: str | None, side: int) -> DataFrame:
    """What tiles find of their own cells (r, c), of which those hang together that have one value of `by`: corners (what = 0) of chains of edges, chains (1) that go on or that belong to a part which does, and sides (2) that a part shares with another tile's: from cell `chain` to cell `next`.

    A side that no cell of the same value shares is an edge. It is followed by the one round the cell ahead, if there is one; where two cells touch in a
    corner alone, by the next edge of its own cell, so that such cells lie in different rings. Cells go to the tiles around too, as a rim of one.
    """
    t = lambda x: F.floor(x / side).cast("int")
    around = lambda x: F.explode(F.array_distinct(F.array(t(F.col(x) - 1), t(F.col(x)), t(F.col(x) + 1))))
    sent = cells.select("r", "c", (F.col(by) if by else F.lit(0)).alias("v")).withColumn("tr", around("r")).withColumn("tc", around("c"))
    names = [x.split()[0] for x in TRACED.split(", ")]

    def one(key, mine: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * side, int(key[1]) * side
        v = np.zeros((side + 2, side + 2), int)
        v[mine.r.to_numpy() - r0 + 1, mine.c.to_numpy() - c0 + 1] = pd.factorize(mine.v, use_na_sentinel=False)[0] + 1
        own = v[1:-1, 1:-1]
        if not own.any():
            return pd.DataFrame(columns=names)
        like = {(a, b): (own > 0) & (v[1 + a : side + 1 + a, 1 + b : side + 1 + b] == own) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        label = _parts(like[0, 1], like[1, 0])
        part = lambda x: (r0 + x // side) * ROW + c0 + x % side
        over = [(y, x, d) for d, edge in (((-1, 0), np.s_[:1]), ((1, 0), np.s_[-1:]), ((0, -1), np.s_[:, :1]), ((0, 1), np.s_[:, -1:])) for y, x in zip(*np.nonzero(np.where(_only(edge, side), like[d], False)))]
        loose = np.zeros(side * side, bool)
        loose[[label[y, x] for y, x, _ in over]] = True
        found = []
        for k, (a, b) in enumerate(AHEAD):
            oa, ob = AHEAD[k - 1]
            y, x = np.nonzero((own > 0) & ~like[oa, ob])
            on, round_ = like[a, b][y, x], like[a, b][y, x] & like[a + oa, b + ob][y, x]
            turned = ~(like[-a, -b][y, x] & ~like[oa - a, ob - b][y, x])
            found.append((y, x, np.full(len(y), k), y + on * a + round_ * oa, x + on * b + round_ * ob, (k + np.where(round_, 3, np.where(on, 0, 1))) % 4, turned))
        y, x, k, ny, nx, nk, turned = (np.concatenate(f) for f in zip(*found))
        corner = np.array(CORNERS)
        name = lambda y, x, k: ((r0 + y + corner[k, 0]) * ROW + c0 + x + corner[k, 1]) * 4 + k
        place = np.full((4, side + 2, side + 2), -1)
        place[k, y + 1, x + 1] = np.arange(len(k))
        edge, follows = name(y, x, k), name(ny, nx, nk)
        order, last, closed = _chains(place[nk, ny + 1, nx + 1], edge)
        last, edge, turned = last[order], edge[order], turned[order].astype(int)
        starts = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        chain = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        before = np.cumsum(turned) - turned
        i = before - before[starts][chain]
        ar, ac = r0 + y[order] + corner[k[order], 0], c0 + x[order] + corner[k[order], 1]
        br, bc = ar + np.array(AHEAD)[k[order], 0], ac + np.array(AHEAD)[k[order], 1]
        least = np.minimum.reduceat(edge, starts)
        twice = np.add.reduceat(ac * br - bc * ar, starts)
        at = label[y[order], x[order]][starts]
        whole = pd.DataFrame({"what": 1, "chain": edge[starts], "i": i[edge == least[chain]], "r": 0, "c": 0, "part": part(at), "loose": loose[at], "closed": closed[last[starts]], "hole": twice < 0, "next": follows[last[starts]], "least": least, "n": np.add.reduceat(turned, starts), "twice": twice})
        bends = turned == 1
        here = chain[bends]
        corners = pd.DataFrame({"what": 0, "chain": edge[starts][here], "i": i[bends], "r": ar[bends], "c": ac[bends], **{n: whole[n].to_numpy()[here] for n in ("part", "loose", "closed", "hole")}, "next": 0, "least": 0, "n": 0, "twice": 0})
        sides = pd.DataFrame([(2, (r0 + y) * ROW + c0 + x, 0, 0, 0, part(int(label[y, x])), True, False, False, (r0 + y + a) * ROW + c0 + x + b, 0, 0, 0) for y, x, (a, b) in over], columns=names)
        return pd.concat([corners, whole[whole.loose], *([sides] if len(sides) else [])])[names]

    return sent.groupBy("tr", "tc").applyInPandas(one, TRACED)


def _only(edge, side: int) -> np.ndarray:
    """A mask of one line of a tile."""
    out = np.zeros((side, side), bool)
    out[edge] = True
    return out


def _rings(chains: DataFrame) -> DataFrame:
    """(chain, ring, before): the ring of each chain (chain, next, least, n), named by its least edge, and how many corners lie before it from the chain that holds this edge. Jumps double, so rounds grow with the logarithm of a ring's chains."""
    now = cut(chains.select("chain", F.col("next").alias("far"), F.col("least").alias("ring")))
    while True:
        ahead = now.select(F.col("chain").alias("far"), F.col("far").alias("far2"), F.col("ring").alias("ring2"))
        new = cut(now.join(ahead, "far").select("chain", F.col("far2").alias("far"), F.least("ring", "ring2").alias("ring")))
        if not new.join(now.select("chain", F.col("ring").alias("was")), "chain").where("ring <> was").take(1):
            break
        now = new
    of = chains.join(now.select("chain", "ring"), "chain")
    first = of.where("least = ring").select("ring", F.col("chain").alias("first"))
    jump = cut(of.join(first, "ring").select("chain", "ring", F.when(F.col("next") != F.col("first"), F.col("next")).alias("far"), F.col("n").cast("long").alias("left")))
    while jump.where("far is not null").take(1):
        ahead = jump.select(F.col("chain").alias("far"), F.col("far").alias("far2"), F.col("left").alias("left2"))
        jump = cut(jump.join(ahead, "far", "left").select("chain", "ring", F.col("far2").alias("far"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    total = jump.groupBy("ring").agg(F.max("left").alias("total"))
    return jump.join(total, "ring").select("chain", "ring", (F.col("total") - F.col("left")).alias("before"))


def outlines(cells: DataFrame, x0: float, y0: float, res: float, by: str | None = None, side: int = SIDE) -> DataFrame:
    """(poly, ring, hole, k, x, y): rings of the polygons that cells (r, c) of a north-up grid form, corners in order, k from 0, without those between two edges of one direction.

    A polygon is the cells that hang together by their sides, and that have one value of the column `by`, if it is given; it is named by the least of them. Its outer ring goes round it, its holes run the other way.
    """
    found = cut(_traced(cells, by, side))
    corners = found.where("what = 0")
    out = corners.where("closed and not loose").select(F.col("part").alias("poly"), F.col("chain").alias("ring"), "hole", F.col("i").cast("long").alias("k"), "r", "c")
    sides = found.where("what = 2").select(F.col("chain").alias("here"), F.col("next").alias("there"), "part")
    if sides.take(1):
        links = sides.select(F.col("part").alias("u"), F.col("there").alias("here")).join(sides.select("here", F.col("part").alias("v")).distinct(), "here").select("u", "v").distinct()
        polys = components(links, sides.select(F.col("part").alias("node")).distinct()).select(F.col("node").alias("part"), F.col("label").alias("poly"))
        chains = found.where("what = 1").select("chain", "next", "least", "n", "i", "twice", "part", "closed")
        placed = _rings(cut(chains.where("not closed").select("chain", "next", "least", "n"))).union(chains.where("closed").select("chain", "chain", F.lit(0).cast("long")))
        placed = cut(placed)
        of = chains.join(placed, "chain")
        # the least edge need not be its chain's first: places count from its corner
        rings = of.groupBy("ring").agg(F.sum("n").alias("total"), (F.sum("twice") < 0).alias("hole"), F.max(F.when(F.col("least") == F.col("ring"), F.col("i"))).alias("i0"), F.first("part").alias("part")).join(polys, "part").drop("part")
        rest = corners.where("loose").select("chain", "i", "r", "c").join(placed.hint("merge"), "chain").join(rings.hint("merge"), "ring")
        out = out.union(rest.select("poly", "ring", "hole", F.pmod(F.col("before") + F.col("i") - F.col("i0"), F.col("total")).cast("long").alias("k"), "r", "c"))
    return out.select("poly", "ring", "hole", "k", (x0 + F.col("c") * res).alias("x"), (y0 - F.col("r") * res).alias("y"))


def ring_edges(corners: DataFrame) -> DataFrame:
    """(poly, ax, ay, bx, by) of outlines (poly, ring, k, x, y), as `filters.polygon_mask` takes them."""
    order = Window.partitionBy("ring").orderBy("k")
    first = corners.where("k = 0").select("ring", F.col("x").alias("fx"), F.col("y").alias("fy"))
    to = corners.withColumn("bx", F.lead("x").over(order)).withColumn("by", F.lead("y").over(order)).join(first, "ring")
    return to.select("poly", F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce("bx", "fx").alias("bx"), F.coalesce("by", "fy").alias("by"))
