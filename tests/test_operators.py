"""Small fixtures with results worked out by hand or by exhaustive search."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.functions import geo, scoring, terrain
from overlook.operators import attention, coverage, filters, habitat, network, points, ranking, visibility
from overlook.plans import candidates
from overlook.sources import terrain as grids
from overlook.sources import vectors
from overlook.streaming import rates


def flat(spark, n, z=0.0):
    return grids.cells(spark, n, n).withColumn("z", F.lit(z))


def seat(spark, r, c):
    return spark.createDataFrame([(1, r, c)], "id int, r0 int, c0 int")


def test_flat_disk_area_and_ridge(spark):
    g = flat(spark, 41)
    seen = visibility.viewsheds(seat(spark, 20, 20), g, 150, 10, 1.7, 0.8, 0.0)
    area = visibility.banded(seen, 10).first()
    assert abs(area.area_km2 - math.pi * 0.15**2) < 0.004 and abs(area.area_km2 - area.band_1km) < 1e-12
    ridge = grids.cells(spark, 61, 61).withColumn("z", F.when(F.col("c").between(25, 26), 10.0).otherwise(0.0))
    for eye, target, hidden in ((1.7, 0.8, True), (40.0, 0.8, False), (1.7, 40.0, False)):
        seen = {(r.r, r.c) for r in visibility.viewsheds(seat(spark, 30, 20), ridge, 250, 10, eye, target, 0.0).collect()}
        assert ((30, 32) not in seen) == hidden and (30, 23) in seen


def test_viewshed_forms_agree_and_curvature_hides(spark):
    g = grids.rolling(spark, 40)
    fast = {(r.r, r.c) for r in visibility.viewsheds(seat(spark, 18, 21), g, 170, 10, 1.7, 0.8, tile=16).collect()}
    pairs = visibility.targets_within(seat(spark, 18, 21), g.select("r", "c"), 170, 10, tile=16).drop("d")
    slow = {(r.r, r.c) for r in visibility.rays(pairs, g, 40, 40, 10, 1.7, 0.8).where("clearance is null or clearance >= 0").collect()}
    assert fast == slow
    far = flat(spark, 61)
    n = [visibility.viewsheds(seat(spark, 30, 30), far, 290, 10, 0.0, 0.0, k).count() for k in (0.0, 1.0)]
    assert n[0] > n[1]


def test_gradient_at_edges_matches_numpy(spark):
    z = np.random.default_rng(1).normal(size=(7, 9))
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(7) for j in range(9)], "r int, c int, z double")
    gy, gx = np.gradient(z, 5.0)
    for r in terrain.gradient(df, "z", 5.0).collect():
        assert abs(r.gx - gx[r.r, r.c]) < 1e-12 and abs(r.gy - gy[r.r, r.c]) < 1e-12


def test_disk_sums_and_nearby_cover(spark):
    z = np.random.default_rng(2).random((12, 15))
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(12) for j in range(15)], "r int, c int, v double")
    for r in terrain.disk_sums(df, 35, 10, {"s": F.col("v"), "n": F.lit(1)}).collect():
        cells = [(r.r + a, r.c + b) for a, b in terrain.disk(35, 10) if 0 <= r.r + a < 12 and 0 <= r.c + b < 15]
        assert abs(r.s - sum(z[i, j] for i, j in cells)) < 1e-9 and r.n == len(cells)


def test_target_criteria_fixture(spark):
    df = grids.cells(spark, 5, 5).withColumn("z", 2000.0 + 10 * F.col("r")).withColumn("tree", F.when((F.col("r") == 2) & (F.col("c") == 2), None).otherwise(0.2)).withColumn("shrub", F.lit(0.3))
    df = terrain.gradient(df, "z", 10.0).withColumn("slope", terrain.slope_of(F.col("gx"), F.col("gy"))).withColumn("aspect", terrain.aspect_of(F.col("gx"), F.col("gy")))
    out = {(r.r, r.c): (r.matching, r.unknown) for r in filters.criteria(df, {"z": (2020, 2030), "slope": (44, 46), "tree": (10, 25), "shrub": (20, 40)}, [0]).collect()}
    assert {k for k, v in out.items() if v[0]} == {(r, c) for r in (2, 3) for c in range(5)} - {(2, 2)}
    assert [k for k, v in out.items() if v[1]] == [(2, 2)]


def test_uniform_habitat_values(spark):
    df = grids.cells(spark, 41, 41).withColumn("tree", F.lit(0.8)).withColumn("shrub", F.lit(0.02))
    r = habitat.evaluate(habitat.features(df, 30.0, 90, 270)).where("r = 20 and c = 20").first()
    assert r.known and abs(r.h - (0.1 + 0.45 * (0.02 / 0.17) + 0.2)) < 1e-9 and abs(r.g - (1 - 0.72) * (1 - 0.013)) < 1e-9


def test_patches_of_three(spark):
    cells = {(0, 0), (0, 1), (0, 2), (3, 3), (3, 4), (5, 0), (6, 0), (6, 1), (8, 8)}
    df = grids.cells(spark, 10, 10).withColumn("f", F.concat_ws(",", "r", "c").isin([f"{r},{c}" for r, c in cells]))
    assert {(r.r, r.c) for r in habitat.patches(df, "f", "p").where("p").collect()} == {(0, 0), (0, 1), (0, 2), (5, 0), (6, 0), (6, 1)}


def test_knapsack_equals_exhaustive_search(spark):
    rows = [(1, i, a, v) for i, (a, v) in enumerate(zip((0.011, 0.022, 0.035, 0.01), (0.3, 0.8, 0.9, 0.1)))]
    df = spark.createDataFrame(rows, "g int, patch int, full_km2 double, reward double")
    cost = [max(1, math.ceil((a / 0.02 + 0.5) / 0.25 - 1e-9)) for _, _, a, _ in rows]
    for budget in (0, 0.75, 1, 2.5, 4, 10):
        best = max(sum(rows[i][3] for i in s) for k in range(5) for s in itertools.combinations(range(4), k) if sum(cost[i] for i in s) <= math.floor(budget / 0.25 + 1e-9))
        assert abs(attention.knapsack(df, "g", budget).first().score - best) < 1e-9


def test_chosen_patches_are_the_best_and_add_up(spark):
    rows = [(1, i, a, v) for i, (a, v) in enumerate(zip((0.011, 0.022, 0.035, 0.01, 0.05), (0.3, 0.8, 0.9, 0.1, 0.85)))]
    df = spark.createDataFrame(rows, "g int, patch int, full_km2 double, reward double")
    cost = [max(1, math.ceil((a / 0.02 + 0.5) / 0.25 - 1e-9)) * 0.25 for _, _, a, _ in rows]
    for budget in (0, 0.75, 2.5, 4, 5.5, 20):
        best = max(sum(rows[i][3] for i in s) for k in range(6) for s in itertools.combinations(range(5), k) if sum(cost[i] for i in s) <= budget + 1e-9)
        got = attention.chosen(df, "g", budget).first()
        assert abs(got.score - best) < 1e-9 and abs(sum(rows[i][3] for i in got.patches) - best) < 1e-9
        assert got.minutes == sum(cost[i] for i in got.patches) <= budget


def test_ranks_in_groups_with_unknowns(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, None, 1.0), (4, "a", 2.0), (5, None, 3.0)], "id int, g string, s double")
    got = {r.id: r["rank"] for r in ranking.dense_rank_by(df, "s", "id", "g").collect()}
    assert got == {1: 1, 4: 2, 2: 3, 5: 1, 3: 2}


def test_verified_load_refuses_other_bytes(spark, tmp_path):
    for name, v in (("z", 5.0), ("mask", 1.0)):
        spark.createDataFrame([(0, 0, v), (0, 1, v + 1)], "r int, c int, value double").coalesce(1).write.parquet(str(tmp_path / name))
    files = spark.read.format("binaryFile").load([str(tmp_path / n) for n in ("z", "mask")]).select("path", "content")
    manifest = spark.createDataFrame(files.select("path", F.sha2("content", 256).alias("sha256")).collect())
    layers = {n: str(tmp_path / n) for n in ("z", "mask")}
    assert sorted(map(tuple, grids.load_verified(spark, files, manifest, layers).collect())) == [(0, 0, 5.0, 1.0), (0, 1, 6.0, 2.0)]
    with pytest.raises(ValueError, match="not as sealed"):
        grids.load_verified(spark, files, manifest.withColumn("sha256", F.lit("0")), layers)


def test_polar_patches_fixture(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 1.0), (1, 1.0, 10.0, 0.2), (1, 0.0, 510.0, 0.4)], "g int, dx double, dy double, reward double")
    out = {r.patch: r for r in attention.polar_patches(df, "g", 30, 500, 2000, 1e-4).collect()}
    assert len(out) == 48 and abs(sum(r.full_km2 for r in out.values()) - 4 * math.pi) < 1e-9
    assert abs(out[0].reward - 0.00012) < 1e-12 and abs(out[12].reward - 0.00004) < 1e-12


def test_greedy_fixtures(spark):
    def go(masks, k, weights=None):
        m = spark.createDataFrame([(i, c) for i, cells in masks.items() for c in cells], "id string, cell long")
        ranks = spark.createDataFrame([(i, k) for k, i in enumerate(masks)], "id string, rank int")
        return [(r.id, r.gain) for r in coverage.greedy(m, ranks, k, weights).collect()]

    assert go({"A": range(10), "B": range(9), "C": range(10, 18)}, 2) == [("A", 10.0), ("C", 8.0)]
    assert go({"A": (0, 1), "B": (0, 1)}, 5) == [("A", 2.0)]
    assert go({"A": (0, 1), "B": (1, 2)}, 2) == [("A", 2.0), ("B", 1.0)]


def test_rank_modes_and_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 1.0 + 1e-14)], "id string, s double")
    assert [r.id for r in ranking.dense_rank_by(df, "s", "id", digits=12).orderBy("rank").collect()] == ["a", "b", "d", "c"]
    h = spark.createDataFrame([("x", None, 5.0, 5.0), ("y", 1.0, 1.0, 9.0), ("z", 1.0, 2.0, 1.0)], "id string, effective double, matching double, visible double")
    assert [r.id for r in ranking.habitat_order(h).orderBy("rank").collect()] == ["z", "y", "x"]
    m = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 3), ("s2", "b", 2)], "scenario string, id string, rank int")
    assert [r.id for r in ranking.median_rank(m, "id").orderBy("place").collect()] == ["a", "b"]
    same = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 5.0)], "id int, a double, b double")
    assert ranking.agreement(same, "a", "b", "id", 1).first().spearman is None


def test_wilson_and_curves(spark):
    row = spark.range(1).select(*scoring.wilson(F.lit(0), F.lit(0)), *(scoring.distance_response(F.lit(d)) for d in (0.0, 250.0, 1500.0, 9e9)), *(scoring.uniform_score(F.lit(r), F.lit(a), 30, 0.02) for r, a in ((0.6, 0.6), (0.66, 1.2), (1.0, 0.0)))).first()
    assert tuple(row[:2]) == (0.0, 1.0) and np.allclose(row[2:6], [1, 0.975, 0.475, 0.25]) and np.allclose(row[6:], [0.6, 0.33, 0.0])


def test_spaced_equals_going_through_in_order(spark):
    g = grids.cells(spark, 30, 30).withColumn("draw", candidates.drawn(["r", "c"], 7))
    kept = []
    for r in sorted(g.collect(), key=lambda r: (r.draw, r.r, r.c)):
        if all((r.r - a) ** 2 + (r.c - b) ** 2 >= 25 for a, b in kept):
            kept.append((r.r, r.c))
    assert sorted(kept) == sorted((r.r, r.c) for r in candidates.spaced(g, 5.0).collect())


def test_refined_goes_round_the_leaders(spark):
    leaders = spark.createDataFrame([("C1", 1, 200.0, -200.0), ("C2", 2, 600.0, -600.0)], "id string, rank int, x double, y double")
    out = candidates.refined(leaders, spark.createDataFrame([(0, 0)], "r int, c int"), grids.cells(spark, 100, 100), 0.0, 0.0, 10.0, 6).orderBy("id").collect()
    assert [r.id for r in out] == [f"R{i:04d}" for i in range(1, 7)] and [r.parent for r in out[:4]] == ["C1", "C2", "C1", "C2"]


def relaxed(z, ok, tree, shrub, res, target, weights, limit):
    """Least costs to the target over a whole grid, cell by cell until nothing improves: the steepest of both cells and the step prices and limits a move."""
    gy, gx = np.gradient(z, res)
    slope = np.degrees(np.arctan(np.hypot(gx, gy)))
    ok = ok & np.isfinite(z) & np.isfinite(slope)
    t, s = np.where(np.isfinite(tree), tree, 1.0), np.where(np.isfinite(shrub), shrub, 1.0)
    cost = np.full(z.shape, np.inf)
    cost[target] = 0 if ok[target] else np.inf
    rows, cols = z.shape
    moved = True
    while moved:
        moved = False
        for i, j in itertools.product(range(rows), range(cols)):
            for a, b in network.STEPS8:
                p, q = i + a, j + b
                if not (0 <= p < rows and 0 <= q < cols and ok[i, j] and ok[p, q]) or (a and b and not (ok[i, q] and ok[p, j])):
                    continue
                length, rise = res * math.hypot(a, b), z[i, j] - z[p, q]
                steep = max(slope[i, j], slope[p, q], math.degrees(math.atan2(abs(rise), length)))
                if steep <= limit:
                    new = cost[i, j] + length * (1 + weights[0] * (steep / 15) ** 2 + weights[1] * (t[i, j] + t[p, q]) / 2 + weights[2] * (s[i, j] + s[p, q]) / 2) + 10 * weights[3] * max(0, rise)
                    if new < cost[p, q] - 1e-9:
                        cost[p, q], moved = new, True
    return cost


def cells_of(spark, z, ok, tree, shrub):
    rows = [("a", int(i), int(j), None if np.isnan(z[i, j]) else float(z[i, j]), bool(ok[i, j]), None if np.isnan(tree[i, j]) else float(tree[i, j]), None if np.isnan(shrub[i, j]) else float(shrub[i, j])) for i, j in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "area string, r int, c int, z double, ok boolean, tree double, shrub double")


def test_approach_costs_equal_relaxation_across_tiles(spark):
    rng = np.random.default_rng(6)
    z, ok = rng.random((13, 11)) * 6, rng.random((13, 11)) > 0.15
    z[9, 8], ok[3, 3] = np.nan, True
    tree, shrub = rng.random((13, 11)), np.full((13, 11), np.nan)
    asked = {"one": (1.0, 0.5, 0.5, 1.0), "far": (0.0, 0.0, 0.0, 0.0)}
    s = spark.createDataFrame([(k, "a", 3, 3, *w) for k, w in asked.items()], "scenario string, area string, tr int, tc int, ws double, wt double, wb double, wg double")
    g = cells_of(spark, z, ok, tree, shrub)
    got = {(r.scenario, r.start): r.cost for r in network.approaches(s, g, g.select("area", F.concat_ws("-", "r", "c").alias("start"), "r", "c"), 20.0, 30.0, side=4).collect()}
    for k, w in asked.items():
        want = relaxed(z, ok, tree, shrub, 20.0, (3, 3), w, 30.0)
        for i, j in np.ndindex(z.shape):
            a, b = got[k, f"{i}-{j}"], want[i, j]
            assert (a is None) == (not np.isfinite(b)) and (a is None or abs(a - b) < 1e-6), (k, i, j)


def test_approach_fixtures_climb_and_limit(spark):
    """A ramp of 3 m a step of 20 m: uphill costs 30 more than downhill, and a limit of 5 degrees stops both."""
    z = np.tile(np.arange(12) * 3.0, (12, 1))
    g = cells_of(spark, z, z >= 0, np.full(z.shape, 0.0), np.full(z.shape, 0.0))
    s = spark.createDataFrame([("up", "a", 1, 2, 1.0, 1.0, 1.0, 1.0), ("down", "a", 1, 1, 1.0, 1.0, 1.0, 1.0)], "scenario string, area string, tr int, tc int, ws double, wt double, wb double, wg double")
    starts = spark.createDataFrame([("a", "low", 1, 1), ("a", "high", 1, 2)], "area string, start string, r int, c int")
    cost = {(r.scenario, r.start): r.cost for r in network.approaches(s, g, starts, 20.0, 30.0).collect()}
    assert abs(cost["up", "low"] - cost["down", "high"] - 30) < 1e-9 and cost["up", "high"] == cost["down", "low"] == 0
    none = {(r.scenario, r.start): r.cost for r in network.approaches(s, g, starts, 20.0, 5.0).collect()}
    assert none["up", "low"] is None and none["down", "high"] is None


def test_connectors(spark):
    flat5 = np.full((5, 5), 10.0)
    nan = np.full((5, 5), np.nan)
    pair = spark.createDataFrame([("p", "a", 2, 0, 2, 4)], "id string, area string, r0 int, c0 int, r1 int, c1 int")
    go = lambda ok, z=flat5: network.connectors(pair, cells_of(spark, z, ok, nan, nan), 20.0, side=4).first().cost
    assert abs(go(flat5 > 0) - 80) < 1e-9
    wall = flat5 > 0
    wall[:, 2] = False
    assert go(wall) is None
    corner = np.zeros((5, 5), bool)
    corner[[2, 1, 2, 1, 2], [0, 1, 2, 3, 4]] = True
    assert go(corner) is None  # diagonal steps alone
    ramp = 10 + np.tile(np.arange(5) * 4.0, (5, 1))
    steep = math.degrees(math.atan(0.2))
    assert abs(go(flat5 > 0, ramp) - 80 * (1 + (steep / 15) ** 2)) < 1e-9


def test_shortest_and_spaced_run_to_the_end(spark):
    path = spark.createDataFrame([(str(i), str(i + 1), 1.0, True) for i in range(44)], "u string, v string, length double, motor boolean")
    source = spark.createDataFrame([("0",)], "node string")
    found = network.shortest(path, source)
    assert {r.node: r.distance for r in found.collect()} == {str(i): float(i) for i in range(45)}
    assert [r.node for r in network.traced(found, spark.createDataFrame([("3",)], "node string")).orderBy("k").collect()] == ["3", "2", "1", "0"]
    with pytest.raises(ValueError):
        network.shortest(path, source, 16)
    line = spark.range(84).select(F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), (F.col("id") / 100).alias("draw"))
    assert sorted(r.c for r in candidates.spaced(line, 2.0).collect()) == list(range(0, 84, 2))
    with pytest.raises(ValueError):
        candidates.spaced(line, 2.0, 5)


def test_network_names_seasons_and_crossings(spark):
    row = spark.range(1).select(network.route_id(F.lit(" 7123 ")), network.route_id(F.lit("81a")), network.route_name(F.lit("Sun-Creek FS Road")), *(network.season_covers(F.lit(s), F.lit("2026-10-24").cast("date"), F.lit(e).cast("date")) for s, e in (("07/01-12/31", "2026-11-01"), ("07/01-10/31", "2026-11-01"), ("02/30-12/31", "2026-11-01"), ("open", "2026-11-01")))).first()
    assert tuple(row) == ("123", "81A", "SUN CREEK", True, False, False, False)
    s = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 0.0, True), (2, 10.0, -10.0, 10.0, 10.0, False), (3, 20.0, 0.0, 0.0, 0.0, False)], "record int, ax double, ay double, bx double, by double, motor boolean")
    e = network.edges_of(s).orderBy("u").collect()
    assert len(e) == 2 and sorted(map(tuple, (r.records for r in e))) == [(1, 3), (2,)]
    near = spark.createDataFrame([(1, 0.0, 0.0, "7100", "A"), (2, 0.0, 3.0, "100", "B"), (3, 0.0, 5.1, "100", "C")], "record int, x double, y double, rid string, name string")
    assert {(r.r1, r.record) for r in network.repairs(near, near).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_grid_contract_and_manifest(spark):
    meta = spark.createDataFrame([("ok", 1, "m", 0.0, 10.0, -10.0, 100, 100, 0), ("bad", 2, "ft", 1.0, 10.0, -20.0, 3000, 3000, 4)], "id string, bands int, unit string, rotation double, dx double, dy double, rows int, cols int, unknown_cells int")
    assert {(r.id, r.fault) for r in grids.contract(meta).collect()} == {("bad", f) for f in ("bands", "unit", "rotated", "square", "size", "no_data")}
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    want = spark.createDataFrame([("a", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b", "0"), ("c", "0")], "path string, sha256 string")
    assert {r.path for r in grids.verified(files, want).collect()} == {"b", "c"}


def test_vector_formats_round_trip(spark, tmp_path):
    line = [(-107.1, 38.5), (-107.0, 38.6), (-106.9, 38.55)]
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"w"},"geometry":{"type":"LineString","coordinates":[[-107.1,38.5],[-107.0,38.6],[-106.9,38.55]]}},{"type":"Feature","properties":{"id":"p1"},"geometry":{"type":"Point","coordinates":[-107.0,38.5]}},{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]],[[1,0.5],[2,0.5],[2,1],[1,0.5]]]}}]}')
    (tmp_path / "b.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><LineString><coordinates>-107.1,38.5,0 -107.0,38.6,0\n-106.9,38.55,0</coordinates></LineString></Placemark></kml>')
    (tmp_path / "c.gpx").write_text('<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="38.5" lon="-107.0"><name>p1</name></wpt><trk><trkseg><trkpt lat="38.5" lon="-107.1"/><trkpt lat="38.6" lon="-107.0"/><trkpt lat="38.55" lon="-106.9"/></trkseg></trk></gpx>')
    (tmp_path / "d.kml").write_text("<!DOCTYPE x><kml><LineString><coordinates>1,1 2,2</coordinates></LineString></kml>")
    (tmp_path / "e.csv").write_text("id,longitude,latitude\np1,-107.0,38.5\np1,-200,38\n")
    read = lambda name: vectors.whole_files(spark, str(tmp_path / name))
    for f in (vectors.geojson_lines(read("a.geojson")), vectors.kml_lines(read("b.kml")), vectors.gpx_lines(read("c.gpx"))):
        assert [(r.lon, r.lat) for r in f.orderBy("k").collect()] == line
    with pytest.raises(Exception, match="declares types"):
        vectors.kml_lines(read("d.kml")).collect()
    (tmp_path / "f.geojson").write_text('{"type":"FeatureCollection","crs":{"type":"name"},"features":[]}')
    with pytest.raises(Exception, match="plain feature collection"):
        vectors.geojson_lines(read("f.geojson")).collect()
    assert [(r.id, r.lon, r.lat) for r in vectors.geojson_points(read("a.geojson")).collect()] == [(r.id, r.lon, r.lat) for r in vectors.gpx_waypoints(read("c.gpx")).collect()] == [("p1", -107.0, 38.5)]
    assert {r.fault for r in vectors.point_faults(vectors.csv_waypoints(spark, str(tmp_path / "e.csv"))).collect()} == {"repeated id", "coordinates"}
    with pytest.raises(ValueError):
        vectors.csv_waypoints(spark, str(tmp_path / "e.csv"), ("id", "rationale"))
    v = vectors.geojson_polygons(read("a.geojson"))
    edges = vectors.segments(v, ["feature", "part"]).withColumn("poly", F.lit(1))
    pts = spark.createDataFrame([(1, 3.0, 1.0), (2, 1.8, 0.7), (3, 5.0, 5.0)], "id int, px double, py double")
    assert [r.id for r in filters.polygon_mask(pts, edges, 1.0).collect()] == [1]
    named = vectors.geojson_lines(read("a.geojson")).select(F.lit("L").alias("id"), "k", "lon", "lat")
    out = vectors.to_geojson_line(named, "id").select(F.lit("mem").alias("path"), F.concat(F.lit('{"type":"FeatureCollection","features":['), "geojson", F.lit("]}")).alias("content"))
    assert [(r.lon, r.lat) for r in vectors.geojson_lines(out).orderBy("k").collect()] == line
    assert "&amp;" in vectors.to_gpx_waypoint(spark.createDataFrame([("a&b", 1.0, 2.0)], "id string, lon double, lat double")).first().gpx
    assert vectors.to_kml_ring(named, "id").first().kml.startswith("<LinearRing><coordinates>-107.1000000,38.5000000,0 ")


def test_projection_known_values(spark):
    e, n = geo.utm(F.lit(-105.0), F.lit(40.0), 13)
    e2, n2 = geo.utm(F.lit(-108.0), F.lit(0.0), 13)
    row = spark.range(1).select(e, n, e2, n2, geo.utm_zone(F.lit(-107.5))).first()
    assert abs(row[0] - 500000) < 1e-6 and abs(row[1] - 4427757.2187) < 1e-3 and abs(row[2] - 166021.4431) < 1e-3 and abs(row[3]) < 1e-6 and row[4] == 13


def test_point_cloud_fixtures(spark):
    rows = [(float(i) / 4, 1.0, 0.5) for i in range(4)] + [(0.0, 1.0, 0.5)] * 10
    assert [(r.i, r.n) for r in points.voxels(spark.createDataFrame(rows, "dx double, dy double, z double")).collect()] == [(0, 4)]
    cloud = spark.createDataFrame([(10.0, 10.0, 5.0, 2, False), (10.0, 10.0, 5.0, 7, False), (10.0, 10.0, 5.0, 5, True), (900.0, 0.0, 1.0, 2, False)], "x double, y double, z double, class int, withheld boolean")
    seats = spark.createDataFrame([("a", 0.0, 0.0), ("b", 20.0, 0.0)], "id string, ox double, oy double")
    assert sorted((r.id, r.dx) for r in points.cropped(cloud, seats, 308.0).collect()) == [("a", 10.0), ("b", -10.0)]


def test_boxes_and_triangles(spark):
    box = spark.createDataFrame([(1, 5.0, 1.0, 0.0, 1.0)], "area int, x double, y double, z double, side double")
    ray = spark.createDataFrame([(7, 1, 0.0, 1.0, 0.0, 10.0, 1.0, 0.0)], "id int, area int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    r = visibility.slab_hits(box, ray).first()
    assert r.hits == 1 and abs(r.first_t - 0.45) < 1e-12 and not r.starts_inside
    corners = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
    faces = [(0, 1, 2), (0, 2, 3), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
    mesh = spark.createDataFrame([(1, *(float(v) for k in f for v in corners[k])) for f in faces], "area int, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz"))
    rays = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.3, 5.0, 0.0, 0.0), (2, 1, -4.0, 0.2, 0.3, 8.0, 0.0, 0.0)], "id int, area int, ox double, oy double, oz double, dx double, dy double, dz double")
    out = {r.id: r for r in visibility.triangle_hits(mesh, rays).collect()}
    assert out[1].inside and not out[2].inside and abs(out[2].first_t - 3 / 8) < 1e-9


def test_access_rules(spark):
    p = spark.createDataFrame([(i,) for i in range(5)], "id int")
    e = spark.createDataFrame([(0, "prohibited", "x", 1.0, 1.0), (1, "verified", "x", 3.0, 1.0), (2, "verified", "", 1.0, 1.0), (3, "verified", "x", 9.0, 1.0)], "id int, reachable string, evidence string, hike_km double, gain_m double")
    ids = lambda *a: sorted(r.id for r in filters.access(p, e, *a).collect())
    assert ids(False, None, None) == [1, 2, 3, 4] and ids(True, None, None) == [1, 3] and ids(False, 5.0, None) == [1]


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rates.windowed(stream, "event_type", "1 hour", "1 hour", "30 minutes").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("rates")) == key(rates.windowed(events, "event_type", "1 hour", "1 hour", "30 minutes"))


def test_catalog_rules(spark):
    from overlook.plans import catalog

    want = spark.createDataFrame([("r", "https://Host.org/a?LAYER=1&bbox=1,2&fmt=tif")], "id string, url string")
    held = spark.createDataFrame([("h1", "https://host.org/a?fmt=tif&bbox=9,9&layer=1"), ("h2", "https://host.org/a?fmt=png&layer=1"), ("h3", "https://host.org/b?fmt=tif&layer=1")], "entry string, url string")
    assert [r.entry for r in catalog.reusable(want, held).collect()] == ["h1"]
    good, bad = catalog.quarantined(spark.createDataFrame([("a", '{"id":"1","kind":"x"}'), ("b", '{"id":"1"}'), ("c", "{broken")], "path string, content string"), ["id", "kind"])
    assert [r.path for r in good.collect()] == ["a"] and sorted(r.path for r in bad.collect()) == ["b", "c"]
    hosts = catalog.bytes_by_host(spark.createDataFrame([("https://a.org/x", 100, False), ("https://a.org/y", 50, None), ("https://b.org/z", 70, True)], "url string, bytes long, cached boolean"))
    assert [(r.host, r.bytes, r.suggested_mb) for r in hosts.collect()] == [("a.org", 150, 10)]
    t = catalog.seconds_to_fetch(hosts, spark.createDataFrame([("a.org", 10.0)], "host string, rate double"), 1.0).first()
    assert abs(t.minimum_s - 10) < 1e-9 and abs(t.maximum_s - 30) < 1e-9 and t.measured


def test_two_largest_openings(spark):
    from overlook.operators import evaluation

    cells = spark.createDataFrame([("g", r, c, r * 10 + c) for r, c in ((0, 0), (0, 1), (0, 2), (5, 5), (5, 6), (8, 8))], "id string, r int, c int, node long")
    labels = spark.createDataFrame([("g", 0, 0), ("g", 1, 0), ("g", 2, 0), ("g", 55, 55), ("g", 56, 55), ("g", 88, 88)], "id string, node long, label long")
    out = evaluation.openings(cells, labels, "id").orderBy("place").collect()
    assert [(r.n, r.r, r.c) for r in out] == [(3, 0, 1), (2, 5, 5)]


def test_vegetation_ray_fixtures(spark):
    def flags(cells, rows=5, cols=25, at=((2, 3), (2, 23)), z=100.0):
        g = flat(spark, 25, z).where(F.col("r") < rows).withColumn("height", F.lit(0.0))
        for (r, c), h in cells.items():
            g = g.withColumn("height", F.when((F.col("r") == r) & (F.col("c") == c), F.lit(h).cast("double")).otherwise(F.col("height")))
        (a, b), (e, f) = at
        p = spark.createDataFrame([(1, a, b, e, f)], "id int, r0 int, c0 int, r int, c int")
        x = visibility.vegetation_rays(p, g, rows, 25, 10.0).first()
        return (x.observer, x.intermediate, x.target, x.unknown, x.terrain)

    assert flags({}) == (False,) * 5
    assert flags({(2, 5): 3.0}) == (True, False, False, False, False)
    assert flags({(2, 12): 3.0}) == (False, True, False, False, False)
    assert flags({(2, 23): 4.0}) == (False, False, True, False, False)
    assert flags({(2, 12): None}) == (False, False, False, True, False)
    assert flags({(2, 3): 9.0}) == (False,) * 5


def test_polyhedron_is_the_box(spark):
    n = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    faces = spark.createDataFrame([(1, 1, *map(float, v), sum(a * b for a, b in zip(v, (5.0, 1.0, 0.0))) + 0.5) for v in n], "area int, body int, nx double, ny double, nz double, k double")
    rays = spark.createDataFrame([(7, 1, 0.0, 1.0, 0.0, 10.0, 0.0, 0.0), (8, 1, 0.0, 3.0, 0.0, 10.0, 0.0, 0.0)], "id int, area int, ox double, oy double, oz double, dx double, dy double, dz double")
    out = visibility.polyhedron_hits(faces, rays).collect()
    assert [(r.id, r.hits) for r in out] == [(7, 1)] and abs(out[0].first_t - 0.45) < 1e-12


def test_connections_equal_a_flood_fill(spark):
    rng = np.random.default_rng(5)
    z, ok = rng.random((9, 10)) * 14, rng.random((9, 10)) > 0.2
    gy, gx = np.gradient(z, 10.0)
    slope = np.degrees(np.arctan(np.hypot(gx, gy)))
    cells = spark.createDataFrame([(i, j, float(z[i, j]), float(slope[i, j]), bool(ok[i, j])) for i in range(9) for j in range(10)], "r int, c int, z double, slope double, ok boolean")
    seats = cells.select((F.col("r") * 10 + F.col("c")).alias("id"), "r", "c")
    got = {r.id: (r.status, r.limit) for r in network.connections(cells, seats, spark.createDataFrame([(0, 0), (0, 5)], "r int, c int"), 10.0, (25.0, 35.0)).collect()}
    want = {}
    for limit in (35.0, 25.0):
        free = ok & (slope <= limit)
        todo = [s for s in ((0, 0), (0, 5)) if free[s]]
        seen = set(todo)
        while todo:
            i, j = todo.pop()
            for a, b in network.STEPS8:
                p, q = i + a, j + b
                if 0 <= p < 9 and 0 <= q < 10 and free[p, q] and (p, q) not in seen and not (a and b and not (free[i, q] and free[p, j])):
                    if math.degrees(math.atan(abs(z[i, j] - z[p, q]) / (10 * math.hypot(a, b)))) <= limit:
                        seen.add((p, q))
                        todo.append((p, q))
        for i, j in seen:
            want[i * 10 + j] = limit
    assert {k: v[1] for k, v in got.items() if v[0] == "connected"} == want
    assert all(v[0] == "outside the domain" for k, v in got.items() if not ok[k // 10, k % 10])


def test_components_and_connections_of_long_arms(spark):
    """A U whose arms hold 200 cells, with row-major ids: labels that are settled in each arm meet at the bottom, and the smaller one goes up the whole arm."""
    u = [(r, c) for r in range(200) for c in (0, 19)] + [(200, c) for c in range(20)]
    at = set(u)
    edges = [(r * 20 + c, p * 20 + q) for r, c in u for p, q in ((r + 1, c), (r, c + 1)) if (p, q) in at]
    nodes = spark.createDataFrame([(r * 20 + c,) for r, c in u] + [(9000,), (9001,)], "node long")
    got = {r.node: r.label for r in network.components(spark.createDataFrame(edges + [(9000, 9001), (9001, 9500), (19, 9500)], "u long, v long"), nodes).collect()}
    assert got == {**{r * 20 + c: 0 for r, c in u}, 9000: 9000, 9001: 9000}
    cells = spark.createDataFrame([(r, c, 0.0, 0.0, (r, c) in at) for r in range(201) for c in range(20)], "r int, c int, z double, slope double, ok boolean")
    seats = spark.createDataFrame([("top", 0, 19), ("between", 0, 5)], "id string, r int, c int")
    got = {r.id: (r.status, r.limit) for r in network.connections(cells, seats, spark.createDataFrame([(0, 0)], "r int, c int"), 10.0, (25.0,)).collect()}
    assert got == {"top": ("connected", 25.0), "between": ("outside the domain", None)}


def test_global_ranks_and_spread_use_more_than_one_task(spark):
    rows = [(i, i % 3 and float(i * 37 % 50) or None, float(i * 7 % 90), float(i * 11 % 70), "a" if i % 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, score double, x double, y double, grp string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranking.dense_rank_by(df, "score", "id")
        assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    down = lambda r: (r[1] is None, -(r[1] or 0), r[0])
    assert [r.id for r in out.orderBy("rank").collect()] == [r[0] for r in sorted(rows, key=down)] and out.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (1, 400, 400)
    got = ranking.spread_by_group(df, "grp", "score", "id", 30.0, 4)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for g in ("a", None):
        kept = []
        for r in sorted((r for r in rows if r[4] == g), key=down):
            if len(kept) < 4 and all((r[2] - q[2]) ** 2 + (r[3] - q[3]) ** 2 >= 900 for q in kept):
                kept.append(r)
                want.append((g, r[0], len(kept)))
    assert sorted(map(str, ((r.grp, r.id, r.pick) for r in got.collect()))) == sorted(map(str, want))
