"""Fixtures of the orders, collections, evaluation rows, access rules, rays over triangles and source rules."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.functions import scoring
from overlook.operators import attention, coverage, evaluation, filters, network, ranking, visibility
from overlook.plans import candidates, catalog
from overlook.sources import sinks, vectors
from overlook.sources import terrain as grids


def masks_of(spark, masks):
    return spark.createDataFrame([(i, int(c)) for i, cells in masks.items() for c in cells], "id string, cell long")


def sites_of(spark, ids, places=None, eligible=None):
    places, eligible = places or {}, eligible or {}
    return spark.createDataFrame([(i, k, *map(float, places.get(i, (k * 1000, 0))), eligible.get(i, True)) for k, i in enumerate(ids)], "id string, rank int, x double, y double, eligible boolean")


def test_collections(spark):
    m = masks_of(spark, {"A": range(10), "B": range(9), "C": range(10, 18)})
    out = coverage.collected(m, sites_of(spark, "ABC"), [], 2).collect()
    assert [(r.id, r.additional_cells, r.overlap_percent) for r in out] == [("A", 10, 0.0), ("C", 8, 0.0)]
    out = coverage.collected(m, sites_of(spark, "ABCU"), ["A", "U"], 3).collect()
    assert [(r.role, r.id, r.total_cells) for r in out] == [("kept", "A", 10), ("kept", "U", None), ("suggested", "C", 8)]
    assert coverage.totals(m.where("id <> 'B'"), spark.createDataFrame([], "cell long, w double, priority double, known boolean"), 1.0).first().combined_cells == 18
    same = masks_of(spark, {"A": (0, 1), "B": (0, 1)})
    assert [r.id for r in coverage.collected(same, sites_of(spark, "ABC"), [], 5).collect()] == ["A"]
    half = coverage.collected(masks_of(spark, {"A": (0, 1), "B": (1, 2)}), sites_of(spark, "AB"), [], 2).collect()
    assert (half[1].additional_cells, half[1].overlap_percent) == (1, 50.0)
    ranked = coverage.collected(masks_of(spark, {"A": (0, 1), "B": (0, 1), "C": (2,)}), sites_of(spark, "BAC"), [], 3).collect()
    assert [r.id for r in ranked] == ["B", "C"]
    near = coverage.collected(m, sites_of(spark, "ABC", {"C": (50, 0)}), [], 2, 100.0).collect()
    assert [r.id for r in near] == ["A"]
    barred = coverage.collected(m, sites_of(spark, "ABC", eligible={"A": False}), [], 1).collect()
    assert [r.id for r in barred] == ["B"]
    weights = spark.createDataFrame([(c, 100.0 if c == 17 else 1.0, float(c == 17)) for c in range(18)], "cell long, w double, priority double")
    heavy = coverage.collected(m, sites_of(spark, "ABC"), [], 2, weights=weights).collect()
    assert [(r.id, r.additional_effective, r.additional_priority) for r in heavy] == [("C", 107.0, 1.0), ("A", 10.0, 0.0)]


def test_overlaps_of_alike_cells(spark):
    rng = np.random.default_rng(3)
    sets = {f"m{k}": set(rng.choice(60, 25, replace=False).tolist()) | {100, 101, 102} for k in range(6)}
    got = {(r.a, r.b): r.shared for r in coverage.overlaps(masks_of(spark, sets)).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}


def test_orders(spark):
    c = spark.createDataFrame([("dense", 10.0, "other known cover"), ("clear", 1.0, "low mapped tree cover"), ("unknown", 20.0, "insufficient coverage")], "id string, raw double, foreground string")
    assert [r.id for r in ranking.three_mode_rank(c).orderBy("rank").collect()] == ["clear", "dense", "unknown"]
    f = spark.createDataFrame([("a", False, 9.0, 9.0), ("b", True, 1.0, 1.0), ("c", True, 1.0, 2.0)], "id string, qualifies boolean, matching double, original double")
    assert [r.id for r in ranking.filter_order(f).orderBy("rank").collect()] == ["c", "b", "a"]


def test_review_choice(spark):
    scores = spark.createDataFrame([("x", "a", 3.0), ("x", "b", 2.0), ("y", "a", 9.0), ("y", "c", 1.0)], "arm string, id string, score double")
    out = evaluation.chosen_for_review(scores, ["x", "y"], spark.createDataFrame([(0, "a"), (1, "d")], "n int, id string"), spark.createDataFrame([("a", 1), ("b", 5), ("b", 3), ("e", 2)], "id string, rank int"))
    assert [(r.role, r.id) for r in out.orderBy("place").collect()] == [("x", "a"), ("y", "c"), ("stratified_random", "d"), ("median_rank", "e")]


def test_evaluation_row_has_the_best_patches(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 2), float(x), float(y), float(math.hypot(x, y)), float(t), 0.2, float(r)) for k, (x, y, t, r) in enumerate(zip(*(rng.uniform(-900, 900, (2, 80))), rng.random(80), rng.random(80)))]
    v = spark.createDataFrame(rows, "id int, dx double, dy double, d double, tree double, shrub double, reward double")
    out = {r.id: r for r in evaluation.evaluation_rows(v, "id", 1e-4, 6.0).collect()}
    best = {r.id: r.score for r in attention.knapsack(attention.polar_patches(v, "id", 30, 500.0, 3000.0, 1e-4), "id", 6.0).collect()}
    assert all(abs(out[k].selective - best[k]) < 1e-12 and best[k] > 0 for k in (0, 1))
    assert all(abs(out[k].raw - out[k].within_1km - out[k].beyond_1km) < 1e-12 for k in (0, 1))
    with pytest.raises(Exception, match="negative"):
        attention.knapsack(spark.createDataFrame([(1, 1, 0.1, -1.0)], "g int, patch int, full_km2 double, reward double"), "g", 1.0).collect()
    assert abs(spark.range(1).select(scoring.mixed_season(F.lit(0.2), F.lit(0.6), 0.25, F.lit(0.5))).first()[0] - 0.15) < 1e-12


def test_network_access_fixture(spark):
    """A line at y = 190 below a point at (110, 110): 80 m away, no higher; without lines nothing is known."""
    g = grids.cells(spark, 20, 20).withColumn("z", F.when((F.col("r") == 9) & (F.col("c") == 11), 130.0).when(F.col("r") != 3, 100.0))
    line = spark.createDataFrame([(0.0, 190.0, 200.0, 190.0)], "ax double, ay double, bx double, by double")
    p = spark.createDataFrame([("flat", 115.0, 115.0), ("high", 115.0, 105.0), ("blind", 115.0, 165.0)], "id string, x double, y double")
    go = lambda lines, **limits: {r.id: r for r in filters.network_access(p, lines, g, 0.0, 200.0, 10.0, 100.0, 150.0, **limits).collect()}
    out = go(line, distance_m=80.0, height_m=10.0)
    assert (out["flat"].status, out["flat"].distance, out["flat"].height) == ("qualifies", 75.0, 0.0)
    assert (out["high"].status, out["high"].height) == ("excluded", 30.0) and (out["blind"].status, out["blind"].height) == ("unknown", None)
    assert go(line)["blind"].status == "qualifies" and go(line, distance_m=10.0)["blind"].status == "excluded"
    assert {r.status for r in go(line.limit(0)).values()} == {"unknown"}


def test_segments_on_a_grid(spark):
    g = grids.cells(spark, 6, 6).withColumn("z", F.lit(5.0)).withColumn("slope", F.when((F.col("r") == 2) & (F.col("c") == 3), 40.0).otherwise(3.0))
    s = spark.createDataFrame([("free", 5.0, 55.0, 55.0, 55.0), ("through", 5.0, 35.0, 55.0, 35.0), ("outside", 5.0, 55.0, 75.0, 55.0), ("point", 5.0, 5.0, 5.0, 5.0)], "id string, ax double, ay double, bx double, by double")
    out = {r.id: r.covered for r in filters.covered_segments(s, g, 0.0, 60.0, 10.0, 30.0).collect()}
    assert out == {"free": True, "through": False, "outside": False, "point": True}
    pieces = filters.clipped(s.where("id = 'free'"), g, 0.0, 60.0, 10.0).collect()
    assert len(pieces) == 6 and all(r.inside for r in pieces) and abs(sum(math.dist((r.ax, r.ay), (r.bx, r.by)) for r in pieces) - 50) < 1e-9


def test_crossings_miss_no_rise(spark):
    """Exact crossings against very dense samples of the same triangles."""
    rng = np.random.default_rng(8)
    z = rng.random((12, 12)) * 30
    g = spark.createDataFrame([(int(i), int(j), float(z[i, j])) for i, j in np.ndindex(z.shape)], "r int, c int, z double")
    ends = [(k, *map(int, rng.integers(0, 12, 4))) for k in range(30)]
    pairs = spark.createDataFrame([e for e in ends if e[1:3] != e[3:5]], "id int, r0 int, c0 int, r int, c int")
    got = {r.id: r for r in visibility.crossings(pairs, g, 12, 12, 10.0, 20.0, 15.0, 0.0).collect()}
    for k, r0, c0, r, c in ends:
        if (r0, c0) == (r, c):
            continue
        t = np.linspace(0, 1, 20001)[1:-1]
        pr, pc = r0 + t * (r - r0), c0 + t * (c - c0)
        i, j = np.minimum(np.floor(pr), 10).astype(int), np.minimum(np.floor(pc), 10).astype(int)
        fr, fc = pr - i, pc - j
        a, b, d, e = z[i, j], z[i, j + 1], z[i + 1, j], z[i + 1, j + 1]
        ground = np.where(fr <= fc, a * (1 - fc) + b * (fc - fr) + e * fr, a * (1 - fr) + e * fc + d * (fr - fc))
        gap = (z[r0, c0] + 20) * (1 - t) + (z[r, c] + 15) * t - ground
        inner = got[k].clearance
        if inner is not None:  # neighbours have no crossing between them; the ends lie 20 and 15 above ground
            assert abs(min(inner, 15.0) - min(float(gap.min()), 15.0)) < 0.05 and min(inner, 15.0) <= gap.min() + 1e-9
            assert (got[k].first_t is not None) == (inner < 0)


def test_whole_masks_hold_the_claim(spark):
    seen = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 5, 5)], "id int, r int, c int")
    targets = grids.cells(spark, 2, 2)
    assert visibility.whole_masks(seen, targets, spark.createDataFrame([(1, 0.02)], "id int, km2 double"), 0.01).count() == 2
    with pytest.raises(Exception, match="area differs"):
        visibility.whole_masks(seen, targets, spark.createDataFrame([(1, 0.03)], "id int, km2 double"), 0.01).collect()


def test_buckets_change_no_hit(spark):
    rng = np.random.default_rng(4)
    boxes = spark.createDataFrame([("a", *map(float, rng.uniform(-20, 20, 3)), float(rng.uniform(1, 6))) for _ in range(60)], "area string, x double, y double, z double, side double")
    rays = spark.createDataFrame([(k, "a", *map(float, rng.uniform(-25, 25, 6))) for k in range(40)], "id int, area string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    key = lambda df: sorted((r.id, r.hits, round(r.first_t, 9)) for r in df.collect())
    assert key(visibility.slab_hits(boxes, rays)) == key(visibility.slab_hits(boxes, rays, 5.0)) != []


def test_candidates_around_and_dense(spark):
    with pytest.raises(ValueError):
        candidates.lattice(spark, 0, 0, 500, 20, 0, 0, 10)
    r = candidates.recall_of_best(spark.createDataFrame([(1, 4.0)], "id int, score double"), spark.createDataFrame([(1, 2.0)], "id int, score double")).first()
    assert (r.dense_best, r.pool_best, r.relative) == (4.0, 2.0, 1.0)


def test_source_rules(spark, tmp_path):
    replies = [("ok", '{"features": []}'), ("xml", "<?xml version='1.0'?><ows:ExceptionReport><ows:ExceptionText>No such layer</ows:ExceptionText></ows:ExceptionReport>"), ("service", "<ServiceException>bad box</ServiceException>"), ("json", '{"error": {"message": "token needed"}}'), ("broken", "{oops"), ("none", ""), ("page", "<html>hi</html>"), ("data", "II*binary")]
    out = {r.id: r.fault for r in catalog.faulty_documents(spark.createDataFrame(replies, "id string, content string")).collect()}
    assert out.keys() == {"xml", "service", "json", "broken", "none", "page"} and "token needed" in out["json"]
    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,0.5 2,0.5 2,1 1,0.5</coordinates></LinearRing></innerBoundaryIs></Polygon><Polygon><outerBoundaryIs><LinearRing><coordinates>9,9 10,9 10,10 9,9</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("doc.kml", kml)
    (tmp_path / "a.kmz").write_bytes(packed.getvalue())
    files = vectors.kmz_texts(spark.read.format("binaryFile").load(str(tmp_path / "a.kmz")).select("path", "content"))
    v = vectors.kml_polygons(files).groupBy("feature", "part").agg(F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in v) == [(0, 0, 4), (0, 1, 4), (1, 0, 4)]
    with pytest.raises(Exception, match="bounded size"):
        vectors.kmz_texts(spark.read.format("binaryFile").load(str(tmp_path / "a.kmz")).select("path", "content"), 10).collect()
    edge = spark.createDataFrame([(1, 5.0, 25.0)], "id int, x double, y double")
    with pytest.raises(Exception, match="outside the grid"):
        grids.sample_nearest(grids.cells(spark, 2, 2).withColumn("z", F.lit(1.0)), edge, 0.0, 20.0, 10.0, "error").collect()
    assert spark.range(1).select(*grids.cell_cut(F.lit(-3.0), F.lit(24.0), 0.0, 20.0, 10.0), *grids.cell_of(F.lit(-3.0), F.lit(24.0), 0.0, 20.0, 10.0)).first()[:] == (0, 0, -1, -1)


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(2, 0.5)], "id int, score double")
    both = sinks.union_by_name([a, b])
    sinks.to_csv(both, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == [("1", "x", None), ("2", None, "0.5")]
    sinks.to_json(both, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert [list(json.loads(x)) for x in lines] == [["id", "name", "score"]] * 2
    swapped = both.select("score", "name", "id")
    assert {r.sha256 for r in sinks.digests(both, "id").collect()} == {r.sha256 for r in sinks.digests(swapped, "id").collect()}
    for k in range(2):
        sinks.log_metrics(spark.createDataFrame([(f"stage{k}", k * 1.5)], "stage string, seconds double"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_objectives_keep_away_from_brush(spark):
    out = {r.objective: (r.wt, r.wb) for r in network.objectives(spark, (1.0, 0.5, 4.0, 1.0)).collect()}
    assert out == {"Recommended": (0.5, 4.0), "Shortest distance": (0.0, 0.0), "Brush avoidance": (3.0, 4.0)}
