"""Closed surfaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.operators import surfaces


def distance(points, centres, side):
    q = np.abs(points[:, None] - centres[None]) - (side / 2 - surfaces.ROUND)
    return (np.linalg.norm(np.maximum(q, 0), axis=2) + np.minimum(q.max(axis=2), 0) - surfaces.ROUND).min(axis=1)


def crossings(triangles, point, way):
    """How often a ray meets triangles, by signed volumes."""
    a, b, c = (triangles[:, 3 * n : 3 * n + 3] for n in range(3))
    e1, e2, s = b - a, c - a, point - a
    h = np.cross(way, e2)
    det = (e1 * h).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u, q = (s * h).sum(1) / det, np.cross(s, e1)
        v, t = (way * q).sum(1) / det, (e2 * q).sum(1) / det
        return int(((u >= 0) & (v >= 0) & (u + v <= 1) & (t > 0)).sum())


@pytest.mark.parametrize("side, step", [(1.0, 0.25), (1.5, 0.5), (2.0, 0.25)])
def test_surface_is_closed_and_parity_is_the_sign_of_the_distance(spark, side, step):
    rng = np.random.default_rng(int(side * 4))
    centres = np.unique(rng.integers(-4, 5, (60, 3)), axis=0) + 0.5
    centres = np.concatenate([centres, [[30.5, 0.5, 0.5], [31.5, 0.5, 0.5], [31.5, 1.5, 1.5]]])
    df = spark.createDataFrame([tuple(map(float, c + 0.2)) for c in centres], "x double, y double, z double").repartition(5)
    out = surfaces.foliage_surface(df, side, step).cache()
    assert surfaces.open_edges(out).count() == 0
    t = np.array(out.select(*(f"{v}{x}" for v in "abc" for x in "xyz")).collect())
    a, b, c = t[:, :3], t[:, 3:6], t[:, 6:]
    volume = (a * np.cross(b, c)).sum() / 6
    assert volume > 0  # triangles look outwards
    names = {}
    for r in out.collect():
        for k, p in ((r.ka, (r.ax, r.ay, r.az)), (r.kb, (r.bx, r.by, r.bz)), (r.kc, (r.cx, r.cy, r.cz))):
            assert names.setdefault(k, p) == p  # one place, bit for bit
    points = np.concatenate([rng.uniform(-6, 7, (300, 3)), centres[rng.integers(0, len(centres), 100)] + rng.uniform(-0.3, 0.3, (100, 3))])
    d = distance(points, centres, side)
    clear = np.abs(d) > step / 2  # further from the surface than the lattice can move it
    assert (d[clear] < 0).sum() > 20
    way = np.array([0.37, 0.61, 0.71])
    for p, x in zip(points[clear], d[clear]):
        assert (crossings(t, p, way) % 2 == 1) == (x < 0)


def test_one_cell_and_none(spark):
    one = spark.createDataFrame([(0.4, 0.6, 0.5), (0.5, 0.5, 0.7)], "x double, y double, z double")  # both snap to one cell
    out = surfaces.foliage_surface(one, 1.0, 0.25)
    assert surfaces.open_edges(out).count() == 0
    v = {k for r in out.collect() for k in (r.ka, r.kb, r.kc)}
    edges, faces = out.count() * 3 // 2, out.count()
    assert len(v) - edges + faces == 2  # a sphere
    assert surfaces.foliage_surface(one.limit(0), 1.0, 0.25).collect() == []


def test_a_missing_triangle_shows(spark):
    out = surfaces.foliage_surface(spark.createDataFrame([(0.5, 0.5, 0.5)], "x double, y double, z double"), 1.5, 0.5).cache()
    less = out.subtract(out.orderBy("ka", "kb", "kc").limit(1))
    assert surfaces.open_edges(less).count() == 3


def test_curvature_goes_and_comes_back(spark):
    p = spark.createDataFrame([(3000.0, 400.0, 50.0), (0.0, 0.0, 1.0)], "x double, y double, z double")
    up = surfaces.seen_from(p)
    assert up.select(F.max("z")).first()[0] > 50.5
    assert all(abs(a.z - b.z) < 1e-9 for a, b in zip(surfaces.seen_from(up, back=True).collect(), p.collect()))
