"""Rules that must not fail in silence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.functions import terrain
from overlook.operators import attention, ranking
from overlook.plans import candidates
from overlook.sources import terrain as grids


def test_symmetric_keeps_a_cell_for_each_parent_and_raises_beyond_the_budget(spark):
    leaders = spark.createDataFrame([("a", "A1", 1, 55.0, -55.0), ("a", "A2", 2, 75.0, -55.0), ("a", "A3", 3, 15.0, -55.0), ("m", "M1", 1, 55.0, -55.0)], "grp string, id string, rank int, x double, y double")
    allowed = grids.cells(spark, 20, 20)
    out = candidates.symmetric(leaders, allowed, 0.0, 0.0, 10.0, 20, 10, centres=2).collect()
    want = []
    for grp, parent, x, y in (("a", "A1", 55, -55), ("a", "A2", 75, -55), ("m", "M1", 55, -55)):
        for dx in range(-20, 21, 10):
            for dy in range(-20, 21, 10):
                r, c = (-y - dy) // 10, (x + dx) // 10
                if (dx or dy) and dx * dx + dy * dy <= 400 and 0 <= r < 20 and 0 <= c < 20:
                    want.append((f"R{len(want) + 1:04d}", grp, parent, r, c))
    assert sorted(tuple(r) for r in out) == want
    with pytest.raises(ValueError, match="more than 30"):
        candidates.symmetric(leaders, allowed, 0.0, 0.0, 10.0, 20, 10, centres=2, most=30)


def test_knapsack_refuses_unknown_areas(spark):
    for area in (None, -1.0, float("nan")):
        p = spark.createDataFrame([("g", 1, 0.1, 2.0), ("g", 2, area, 3.0)], "grp string, patch int, full_km2 double, reward double")
        for run in (attention.knapsack, attention.chosen):
            with pytest.raises(Exception, match="area is unknown or negative"):
                run(p, "grp", 10.0).collect()


def test_unknown_foreground_class_raises(spark):
    rows = [("a", 2.0, ranking.COVER_ORDER[0]), ("b", 1.0, "meadow")]
    with pytest.raises(Exception, match="meadow"):
        ranking.three_mode_rank(spark.createDataFrame(rows, "id string, raw double, foreground string")).collect()
    with pytest.raises(Exception, match="null"):
        ranking.three_mode_rank(spark.createDataFrame([("b", 1.0, None)], "id string, raw double, foreground string")).collect()
    assert ranking.three_mode_rank(spark.createDataFrame(rows[:1], "id string, raw double, foreground string")).count() == 1


@pytest.mark.parametrize("share", [0.0, 0.25, 0.6, 0.999, 1.0])
def test_quantile_by_ranges_is_exact(spark, share):
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=3001), np.repeat([1.0, 2.0, 1e6], 700), rng.normal(size=500) * 1e-12 + 5, np.zeros(900), [3.5]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        assert terrain.quantile(df, "v", share, bins=16) == pytest.approx(np.quantile(values, share), rel=1e-12, abs=1e-12)
    assert terrain.quantile(spark.createDataFrame([(None,)], "v double"), "v", share) is None


def test_ridges_bend_more_than_the_allowed_cells(spark):
    g = grids.cells(spark, 40, 40).withColumn("z", 90 * F.sin(F.col("c") / 4.0) * F.cos(F.col("r") / 5.0))
    allowed = g.where("c < 23").select("r", "c")
    out = terrain.landforms(g, 30.0, allowed).collect()
    sharp = np.quantile([r.bend for r in out if r.c < 23], 0.6)
    assert any(r.ridge for r in out)
    for r in out:
        assert r.ridge == (r.c < 23 and r.tpi > 8 and r.bend > sharp)
        assert r.c < 23 or not (r.bench or r.shoulder)


def test_exports_of_other_inputs_and_imports_beyond_the_limit_raise(spark):
    from overlook.plans import catalog
    from overlook.sources import vectors

    lines = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2)], "scenario string, mark string, k int")
    marks = lambda *rows: spark.createDataFrame(list(rows), "scenario string, mark string")
    assert vectors.fresh(lines, marks(("s1", "a"), ("s2", "b"), ("s3", "c"))).count() == 2
    for now in (marks(("s1", "a"), ("s2", "x")), marks(("s1", "a"))):
        with pytest.raises(Exception, match="inputs changed since it was computed: s2"):
            vectors.fresh(lines, now).collect()
    v = spark.range(10).selectExpr("id as k")
    assert vectors.limited(v, 10).count() == 10
    with pytest.raises(ValueError, match="10 vertices are more than 9"):
        vectors.limited(v, 9)
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 90.0, 0.0, 110.0, 10.0), (3, -5.0, 0.0, 3.0, 3.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    held = spark.createDataFrame([("roads", -50.0, -50.0, 100.0, 100.0), ("trails", -1.0, -1.0, 200.0, 20.0), ("roads", 80.0, -9.0, 120.0, 20.0)], "kind string, ex0 double, ey0 double, ex1 double, ey1 double")
    for tile in (7.0, 1000.0):
        assert {r.id: r.complete for r in catalog.complete_cover(boxes, held, ["roads", "trails"], tile).collect()} == {1: True, 2: True, 3: False}


def test_square_sums_and_stress(spark):
    from overlook.functions import scoring

    rng = np.random.default_rng(3)
    z = rng.random((9, 7))
    whole = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(9) for j in range(7)], "r int, c int, z double")
    for r in terrain.square_sums(whole, 2, {"s": F.col("z"), "n": F.lit(1)}).collect():
        part = z[max(0, r.r - 2) : r.r + 3, max(0, r.c - 2) : r.c + 3]
        assert r.n == part.size and r.s == pytest.approx(part.sum())
    f = spark.createDataFrame([(3, 10), (0, 0)], "hits int, n int").select(scoring.stress_factor(F.col("hits"), F.col("n"), 0.5).alias("f")).collect()
    assert [r.f for r in f] == [0.85, 0.5]
    with pytest.raises(ValueError):
        scoring.stress_factor(F.col("a"), F.col("b"), 1.5)


def test_tables_of_iterations_go_when_swept(spark, tmp_path):
    import os

    from overlook.operators import network
    from overlook.sources import lineage

    folder = os.path.dirname(lineage.fresh_folder(spark)).removeprefix("file:")
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    e = spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long")
    with lineage.swept(spark):
        network.components(e, spark.range(10).toDF("node")).write.parquet(str(tmp_path / "kept"))
        assert there() > before
    assert there() == before and spark.read.parquet(str(tmp_path / "kept")).count() == 10
    with pytest.raises(ValueError), lineage.swept(spark):
        lineage.cut(spark.range(3))
        raise ValueError
    assert there() == before
