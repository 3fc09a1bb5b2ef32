"""Rings of cells, and masks as bitmaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.operators import coverage, filters, outlines, packed


def cells(spark, mask):
    return spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "r int, c int")


def parts_of(mask):
    """Cells that hang together by their sides, by flood fill."""
    left, out = set(zip(*map(lambda a: a.tolist(), np.nonzero(mask)))), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            r, c = stack.pop()
            part.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    stack.append(n)
        out.append(frozenset(part))
    return set(out)


@pytest.mark.parametrize("seed", range(3))
def test_rings_give_the_cells_back(spark, seed):
    mask = np.random.default_rng(seed).random((18, 15)) < (0.45, 0.6, 0.8)[seed]
    out = outlines.outlines(cells(spark, mask), 100.0, 500.0, 10.0).cache()
    points = spark.createDataFrame([(r, c, 105.0 + c * 10, 495.0 - r * 10) for r in range(-1, 19) for c in range(-1, 16)], "r int, c int, px double, py double")
    back = {}
    for x in filters.polygon_mask(points, outlines.ring_edges(out), 20.0).collect():
        back.setdefault(x.poly, set()).add((x.r, x.c))
    assert {frozenset(v) for v in back.values()} == parts_of(mask)
    rings = {}
    for x in out.orderBy("k").collect():
        rings.setdefault((x.poly, x.ring, x.hole), []).append((x.k, x.x, x.y))
    outer = {}
    for (poly, _, hole), way in rings.items():
        assert [k for k, *_ in way] == list(range(len(way))) and len(way) >= 4
        turn = [(b[1] - a[1], b[2] - a[2]) for a, b in zip(way, way[1:] + way[:1])]
        assert all((dx == 0) != (dy == 0) for dx, dy in turn)  # along the grid
        assert all((a[0] == 0) != (b[0] == 0) for a, b in zip(turn, turn[1:] + turn[:1]))  # every corner is one
        area = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(way, way[1:] + way[:1]))
        assert (area > 0) == hole  # y runs up: outer rings are clockwise
        outer[poly] = outer.get(poly, 0) + (not hole)
    assert set(outer.values()) == {1}


@pytest.mark.parametrize("side", [4, 7, 64])
def test_tiles_give_the_same_rings(spark, side):
    """Every way to cut the cells into tiles: the same rings, corners and places, for cells of several values."""
    values = np.random.default_rng(5).integers(0, 3, (23, 19))
    values[2:20, 4] = 0
    df = spark.createDataFrame([(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(values) if v < 2], "r int, c int, v int")
    key = lambda out: sorted(map(tuple, out.collect()))
    got = key(outlines.outlines(df, 0.0, 0.0, 1.0, "v", side))
    assert got == key(outlines.outlines(df.repartition(3), 0.0, 0.0, 1.0, "v", 200))
    area = {}
    for e in outlines.ring_edges(outlines.outlines(df, 0.0, 0.0, 1.0, "v", side)).collect():
        area[e.poly] = area.get(e.poly, 0) + (e.bx * e.ay - e.ax * e.by) / 2
    parts = [p for v in (0, 1) for p in parts_of(values == v)]
    assert area == {min(r * (1 << 31) + c for r, c in p): len(p) for p in parts}


def test_a_long_ring_and_no_cells(spark):
    mask = np.zeros((60, 60), bool)
    mask[::4] = True
    for i, r in enumerate(range(0, 56, 4)):
        mask[r : r + 4, 59 if i % 2 else 0] = True  # a serpentine
    out = outlines.outlines(cells(spark, mask), 0.0, 0.0, 1.0)
    assert out.select("poly").distinct().count() == out.select("ring").distinct().count() == 1
    assert outlines.outlines(cells(spark, mask[:0]), 0.0, 0.0, 1.0).collect() == []


def masks(spark, seed, n=40, span=200_000):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = rng.integers(-span, span)
        rows += [(f"m{i}", int(c)) for c in at + rng.integers(0, span // 4, 300)]
    rows += [(f"m{i}", 77) for i in range(0, n, 3)] + rows[:50]
    return spark.createDataFrame(rows, "id string, cell long")


def test_bitmaps_equal_the_cells(spark):
    m = masks(spark, 1)
    p = packed.packed(m).cache()
    key = lambda df: sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert key(packed.unpacked(p)) == key(m.distinct())
    assert key(packed.sizes(p)) == key(m.distinct().groupBy("id").agg(F.count("*").alias("n")))
    assert key(packed.counts(p)) == key(coverage.counts(m))
    for block in (packed.CHUNK, 7):
        assert key(packed.overlaps(p, block)) == key(coverage.overlaps(m))
    some = m.where("id in ('m1', 'm3', 'm5')")
    want = m.distinct().join(some.select("cell").distinct(), "cell", "left_anti").groupBy("id").agg(F.count("*").alias("gain"))
    got = packed.added(p, packed.union(p.where("id in ('m1', 'm3', 'm5')")))
    assert {k: v for k, v in key(got) if v} == dict(key(want))
    none = packed.packed(m.limit(0))
    assert key(packed.counts(none)) == [(0, 0, 0)] and packed.overlaps(none).collect() == []


def test_overlaps_of_bitmaps_shuffle_less(spark):
    """Forty masks of the same 30,000 cells: rows a mask and bucket, not a mask and cell."""
    m = spark.range(40).select(F.col("id").cast("string").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29_999).cast("long"))).alias("cell"))
    p = packed.packed(m)
    assert p.count() == 40
    out = packed.overlaps(p)
    assert out.count() == 780 and {r.shared for r in out.collect()} == {30_000}
