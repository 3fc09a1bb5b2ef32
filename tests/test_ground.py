"""Delaunay triangles of tiles against all triples of points."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.operators import ground


def brute(xy, edge, widest):
    """Triples whose circle holds no other point, by shifted places."""
    m = ground.shifted(np.ascontiguousarray(xy))
    tri = np.array(list(itertools.combinations(range(len(xy)), 3)))
    o, r = ground.circles(*(m[tri[:, k]] for k in range(3)))
    far = np.max([np.hypot(*(xy[tri[:, i]] - xy[tri[:, j]]).T) for i, j in ((0, 1), (1, 2), (2, 0))], axis=0)
    keep = (far <= edge) & (r <= widest)
    tri, o, r = tri[keep], o[keep], r[keep]
    gap = np.hypot(m[None, :, 0] - o[:, 0, None], m[None, :, 1] - o[:, 1, None]) - r[:, None]
    np.put_along_axis(gap, tri, np.inf, axis=1)
    return {frozenset(map(tuple, xy[t])) for t in tri[(gap > 0).all(axis=1)]}


def frame(spark, xy):
    return spark.createDataFrame([(float(x), float(y), float(2 * x - 3 * y + 7)) for x, y in xy], "x double, y double, z double")


def found(df):
    rows = df.collect()
    assert all((r.bx - r.ax) * (r.cy - r.ay) - (r.cx - r.ax) * (r.by - r.ay) >= -1e-6 for r in rows)
    out = [frozenset(((r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy))) for r in rows]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("kind", ["scattered", "grid", "hole"])
def test_tiles_make_the_triangles_of_all_points(spark, kind):
    rng = np.random.default_rng(4)
    xy = rng.uniform(-9, 12, (90, 2))
    if kind == "grid":  # four on a circle everywhere
        xy = np.stack(np.meshgrid(np.arange(-4.0, 5.0), np.arange(-4.0, 5.0)), axis=2).reshape(-1, 2)
    if kind == "hole":
        xy = xy[np.hypot(xy[:, 0] - 2, xy[:, 1] - 2) > 5]
    want = brute(xy, 5.0, 250.0)
    for side in (6.0, 7.5, 100.0):
        assert found(ground.ground_triangles(frame(spark, xy), side=side).repartition(3)) == want


def test_heights_of_a_plane_have_no_gaps_at_tile_borders(spark):
    rng = np.random.default_rng(9)
    xy = np.unique(rng.uniform(0, 40, (3000, 2)).round(3), axis=0)
    tri = ground.ground_triangles(frame(spark, xy), side=10.0)
    z = {(r.r, r.c): r.z for r in ground.ground_heights(tri, 0.0, 40.0, 1.0).collect()}
    assert all((r, c) in z for r in range(2, 39) for c in range(2, 39))
    assert all(abs(v - (2 * c - 3 * (40 - r) + 7)) < 1e-6 for (r, c), v in z.items())


def test_long_edges_hold_no_ground_and_bins_keep_measured_points(spark):
    far = frame(spark, [(0, 0), (6, 0), (0, 6), (2, 2.5)])
    assert found(ground.ground_triangles(far)) == set()
    p = spark.createDataFrame([(0.01, 0.02, 5.0), (0.2, 0.1, 9.0), (0.3, 0.1, 7.0), (-0.01, 0.1, 1.0)], "x double, y double, z double")
    assert sorted(tuple(r) for r in ground.one_a_bin(p).collect()) == [(-0.01, 0.1, 1.0), (0.01, 0.02, 5.0), (0.3, 0.1, 7.0)]
    assert ground.ground_triangles(p.limit(0)).collect() == [] and ground.ground_triangles(p.limit(2)).select(F.count("*")).first()[0] == 0
