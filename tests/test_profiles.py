"""Lines from any place, sweeps of attention, entries and sealed networks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.operators import attention, network, visibility
from overlook.sources import vectors


def height(z, pr, pc):
    """On the two triangles of each square of centres, cut from its first corner."""
    i, j = min(int(pr), len(z) - 2), min(int(pc), z.shape[1] - 2)
    a, b = pr - i, pc - j
    return z[i, j] * (1 - b) + z[i, j + 1] * (b - a) + z[i + 1, j + 1] * a if a <= b else z[i, j] * (1 - a) + z[i + 1, j + 1] * b + z[i + 1, j] * (a - b)


def test_moved_profiles_miss_no_rise(spark):
    rng = np.random.default_rng(5)
    z = 50 + rng.uniform(0, 6, (12, 15))
    g = spark.createDataFrame([(i, j, float(z[i, j])) for i, j in np.ndindex(z.shape)], "r int, c int, z double")
    rows = [(k, *map(float, rng.uniform(0, 11, 1)), *map(float, rng.uniform(0, 14, 1)), *map(float, rng.uniform(0, 11, 1)), *map(float, rng.uniform(0, 14, 1)), 58.0 if k % 3 == 0 else None) for k in range(25)]
    rows.append((99, 2.0, 3.0, 2.0, 9.0, None))  # along a row of centres
    got = {r.id: r for r in visibility.moved_profile(spark.createDataFrame(rows, "id int, pr0 double, pc0 double, pr double, pc double, z0 double"), g, 12, 15, 10.0, 1.7, 0.8).collect()}
    for k, r0, c0, r1, c1, z0 in rows:
        t = np.linspace(0, 1, 12_001)[1:-1]
        ground = np.array([height(z, r0 + x * (r1 - r0), c0 + x * (c1 - c0)) for x in t])
        start = (height(z, r0, c0) if z0 is None else z0) + 1.7
        gap = start * (1 - t) + (height(z, r1, c1) + 0.8) * t - ground
        r = got[k]
        assert r.distance == pytest.approx(10 * math.dist((r0, c0), (r1, c1))) and r.complete
        n = max(2, math.ceil(r.distance / 2.5))  # samples begin and end a quarter of a cell from the ends, or nearer
        inner = gap[(t >= 1 / n) & (t <= 1 - 1 / n)]
        assert gap.min() - 0.02 <= r.clearance <= inner.min() + 1e-6  # exact crossings lie between dense samples
        assert (r.result == "modeled ground obstruction") == (r.first_t is not None) == (r.clearance < -1e-6)
        if r.first_t is not None:
            assert height(z, r0 + r.first_t * (r1 - r0), c0 + r.first_t * (c1 - c0)) > start * (1 - r.first_t) + (height(z, r1, c1) + 0.8) * r.first_t
            begins = t[np.argmax(gap < -1e-6)]  # the ground rises above the line after the last sample that was clear
            assert r.first_t - 1 / n - 1e-6 <= begins <= r.first_t + 1e-3
    holes = g.withColumn("z", F.when((F.col("r") != 2) | (F.col("c") != 6), F.col("z")))
    one = spark.createDataFrame(rows[-1:], "id int, pr0 double, pc0 double, pr double, pc double, z0 double")
    assert visibility.moved_profile(one, holes, 12, 15, 10.0, 1.7, 0.8).first().result == "incomplete data"
    with pytest.raises(Exception, match="a target at its observer: 1"):
        visibility.moved_profile(spark.createDataFrame([(1, 2.0, 2.0, 2.0, 2.005, None)], "id int, pr0 double, pc0 double, pr double, pc double, z0 double"), g, 12, 15, 10.0, 1.7, 0.8).collect()


def test_attention_scenarios(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 2, float(x), float(y), float(s), float(w), 0.8) for i, (x, y, s, w) in enumerate(zip(rng.uniform(-1900, 1900, 120), rng.uniform(-1900, 1900, 120), rng.random(120), rng.random(120)))]
    p = spark.createDataFrame(rows, "id int, dx double, dy double, summer double, winter double, other double")
    out = {(r.id, r.scenario): (r.strategy, r.score) for r in attention.scenarios(p, [0.0, 0.5], [15.0, 30.0], 0.01).collect()}
    assert len(out) == 2 * (2 * 2 * 3 + 6)
    for i in (0, 1):
        for mix in (0.0, 0.5):
            full = sum(((1 - mix) * s + mix * w) * o * 0.01 for k, _, _, s, w, o in rows if k == i)
            for b in (15, 30):
                at = f"winter{mix:g}_minutes{b}"
                assert out[i, f"none_{at}"] == ("none", pytest.approx(full))
                assert out[i, f"uniform_{at}"][1] == pytest.approx(full * min(1, b * 0.02 / 0.6))
                assert out[i, f"selective_{at}"][1] <= full
        own = p.withColumn("reward", (F.col("summer") + F.col("winter")) / 2 * F.col("other"))
        for name, change in attention.CHANGES.items():
            patches = attention.polar_patches(own, "id", change.get("width", 30), 500.0, 2000.0, 0.01)
            want = attention.knapsack(patches, "id", 30.0, change.get("rate", 0.02), change.get("overhead", 0.5)).where(F.col("id") == i).first().score
            assert out[i, name] == ("selective_sensitivity", pytest.approx(want))


def test_entries_snap_to_the_nearest_vertex_however_far(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(0, 1000, (60, 2))
    p = np.concatenate([rng.uniform(0, 1000, (40, 2)), [[90_000.0, -40_000.0], v[3]]])
    got = {r.id: (r.node, r.gap) for r in network.nearest_vertex(spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id int, x double, y double"), spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)], "node int, x double, y double"), 7.0).collect()}
    d = np.hypot(*(p[:, None] - v[None]).transpose(2, 0, 1))
    assert {k: n for k, (n, _) in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert all(g == pytest.approx(d[k].min()) for k, (_, g) in got.items())


def test_departures_have_the_nearest_point_and_the_pinned_one(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 0.0), (0, 100.0, 0.0, 100.0, 30.0), (1, 0.0, 50.0, 7.0, 50.0)], "line int, ax double, ay double, bx double, by double")
    at = lambda **k: {(r.x, r.y) for r in network.departures(s, (33.0, 10.0), 60.0, **k).collect()}
    assert at() == {(0.0, 0.0), (20.0, 0.0), (40.0, 0.0), (60.0, 0.0), (80.0, 0.0), (33.0, 0.0), (0.0, 50.0), (7.0, 50.0)}
    assert at(pinned=(100.0, 11.5)) - at() == {(100.0, 11.5)}
    with pytest.raises(ValueError, match="lies on no mapped way"):
        at(pinned=(50.0, 1.0))
    with pytest.raises(ValueError, match="more than 5 departures"):
        at(most=5)


def test_networks_are_parsed_again(spark):
    line = lambda x: '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [%s, 1]]}}]}' % x
    files = lambda a, b: spark.createDataFrame([("a", line(a)), ("b", line(b))], "path string, content string")
    sealed = files(1, 2)
    seals, kept = sealed.select("path", F.sha2("content", 256).alias("sha256")), vectors.geojson_lines(sealed)
    assert vectors.verified_network(sealed, seals, kept).count() == 4
    with pytest.raises(ValueError, match="source changed: b"):
        vectors.verified_network(files(1, 3), seals, kept)
    with pytest.raises(ValueError, match="source changed: b"):
        vectors.verified_network(sealed.where("path = 'a'"), seals, kept)
    with pytest.raises(ValueError, match="what its source gives: a"):
        vectors.verified_network(sealed, seals, kept.withColumn("lon", F.when(F.col("path") == "a", F.col("lon") + 1).otherwise(F.col("lon"))))
