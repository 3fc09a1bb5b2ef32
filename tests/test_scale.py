"""What only larger tables show: numbers that leave their type, tables that a plan takes for small, work that grows with copies."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook import queries


def moved(tmp_path, sf_dir, tables, by):
    """Small tables under keys that lie `by` further on, as the later rows of a larger table have them."""
    folder = str(tmp_path / "moved")
    (tmp_path / "moved").mkdir()
    for t, key in tables.items():
        duckdb.sql(f"COPY (SELECT * REPLACE ({key} + {by} AS {key}) FROM '{sf_dir}/{t}.parquet') TO '{folder}/{t}.parquet'")
    return folder


def marked_cells(folder, extra="true"):
    """Cells of the pattern by plain Python numbers."""
    keys = [k for (k,) in duckdb.sql(f"SELECT o_orderkey FROM '{folder}/orders.parquet'").fetchall()]
    cells = [divmod(k, queries.COLS) for k in keys]
    return {(r, c) for r, c in cells if (r * r * 3 + c * 7 + r * c * 2) % 5 < 3}


def test_component_sizes_of_far_rows(spark, sf_dir, tmp_path):
    folder = moved(tmp_path, sf_dir, {"orders": "o_orderkey"}, 2_000_000)
    got = queries.QUERIES["component_sizes"](spark, folder).collect()
    left, want = marked_cells(folder), []
    while left:
        stack, part = [left.pop()], []
        while stack:
            r, c = stack.pop()
            part.append(r * queries.COLS + c)
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left and (n[0] // 10, n[1] // 10) == (r // 10, c // 10):
                    left.remove(n)
                    stack.append(n)
        want.append((min(part), len(part)))
    assert sorted((x.label, x.n) for x in got) == sorted(want)


def test_cell_outlines_of_far_rows(spark, sf_dir, tmp_path):
    folder = moved(tmp_path, sf_dir, {"orders": "o_orderkey"}, 2_000_000)
    got = queries.QUERIES["cell_outlines"](spark, folder).agg({"area": "sum"}).first()[0]
    assert got == duckdb.sql(f"SELECT count(*) FROM '{folder}/orders.parquet'").fetchall()[0][0]  # every cell, no part of the table


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_exploded_stations_are_not_sent_to_every_task(spark, sf_dir):
    from overlook.sources import terrain as grids

    g = grids.cells(spark, 40, 40).withColumn("z", F.col("r") * 2.0 + F.col("c"))
    p = spark.range(20).select("id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k")).select(F.struct("id", "k").alias("id"), (F.col("k") * 1.2).alias("pr"), (F.col("id") * 1.5).alias("pc"))
    for f in (grids.sample_bilinear, grids.corner_triangles):
        out = f(g, p, 40, 40)
        assert broadcasts(out) == 0
        assert all(abs(x.z - (x.pr * 2 + x.pc)) < 1e-9 for x in out.collect())
    assert broadcasts(queries.QUERIES["route_profile"](spark, sf_dir)) == 0


def test_a_grid_beyond_the_contract_becomes_several_rasters(spark, tmp_path):
    from overlook.sources import raster
    from overlook.sources import terrain as grids

    g = grids.cells(spark, 50, 37).withColumn("z", F.col("r") * 100.0 + F.col("c"))
    for most, n in ((37 * 16, 4), (8 * 20, 7 * 3), (10**6, 1)):
        folder = f"{tmp_path}/{most}"
        areas = raster.write_areas(g, folder, 8, 0.0, 0.0, 10.0, most=most)
        assert len(areas) == n and sum(r * c for _, _, r, c in areas) == 50 * 37 and max(r * c for _, _, r, c in areas) <= most
        got = raster.read_areas(spark, folder, areas, (7, 40), (3, 34)).collect()
        assert sorted((x.r, x.c) for x in got) == [(r, c) for r in range(7, 40) for c in range(3, 34)] and all(x.z == x.r * 100 + x.c for x in got)
        assert raster.read_areas(spark, folder, areas, (60, 70), (0, 37)).count() == 0
    with pytest.raises(Exception, match="no cells at all in"):
        raster.write_areas(g.where("r < 8 or r >= 32"), f"{tmp_path}/gap", 8, 0.0, 0.0, 10.0, most=37 * 16)


def test_raster_blocks_of_more_cells_than_a_raster_may_hold(spark, sf_dir, tmp_path, monkeypatch):
    from overlook.sources import raster

    assert queries.QUERIES["raster_blocks"](spark, moved(tmp_path, sf_dir, {"orders": "o_orderkey"}, 0)).count() == 13 * 34
    monkeypatch.setattr(raster.write_areas, "__defaults__", ("m", 400))
    assert queries.QUERIES["raster_blocks"](spark, sf_dir).count() == 13 * 34


def test_copies_of_a_box_are_compared_once(spark):
    from overlook.plans import catalog

    q = spark.range(3000).selectExpr("id", "'p' as product", "id % 3 as x0", "0L as y0", "id % 3 + 2 as x1", "2L as y1")
    c = spark.range(4000).selectExpr("id + 7 as entry", "'p' as product", "0L as ex0", "0L as ey0", "3 + id % 2 * 2 as ex1", "4L as ey1")
    out = catalog.covering(q, c)
    assert {(x.id % 3, x.entry) for x in out.collect()} == {(0, 7), (1, 7), (2, 8)} and out.count() == 3000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 4  # both sides are made distinct before they meet


def test_adapted_looks_at_the_least_draws_first(spark, monkeypatch):
    from overlook.plans import candidates
    from overlook.sources import terrain as grids

    g = grids.cells(spark, 60, 50).withColumn("draw", candidates.drawn(["r", "c"], 3))
    whole, sizes = candidates.spaced, []

    def counted(points, spacing, rounds=None):
        sizes.append(points.count())
        return whole(points, spacing, rounds)

    monkeypatch.setattr(candidates, "spaced", counted)
    for wanted, spacings in ((10, (6,)), (10, (60, 7))):
        sizes.clear()
        got = {(x.r, x.c, x.spacing) for x in candidates.adapted(g, wanted, spacings, 5.0).collect()}
        need = int(0.8 * wanted)
        for s in (*spacings, 5.0):
            all_ = whole(g, s).orderBy("draw", "r", "c").collect()
            if len(all_) >= need or s == 5.0:
                break
        assert got == {(x.r, x.c, float(s)) for x in all_[:need]}
        assert sizes[0] < 2 * 64 * need


def test_an_area_of_many_pairs_is_dealt_to_parts(spark, monkeypatch):
    from overlook.operators import visibility

    monkeypatch.setattr(visibility, "SHARE", 7)
    s = spark.range(60).selectExpr("id", "id % 2 as area", "-20D as x0", "id / 6 as y0", "5D as z0", "20D as x1", "id / 6 + 3 as y1", "6D as z1")
    b = spark.range(60, 130).selectExpr("id % 2 as area", "id % 9 as x", "id / 13 as y", "5D as z", "2D as side", "id as body")
    met = visibility._met(s, b, {}, None)
    assert met.count() == 60 * 35  # each pair of an area once
    # the largest key of the join holds a part of an area's boxes
    dealt = visibility._dealt(s, b)[1]
    assert dealt.groupBy("area", "__p").count().agg({"count": "max"}).first()[0] < 35
    want = {x.id: (x.hits, x.first_t) for x in visibility.slab_hits(b, s).collect()}
    faces = F.array(*(F.struct(*(F.lit(float(g * (k == a))).alias(f"n{a}") for a in "xyz"), (g * F.col(k) + 1.0).alias("k")) for k in "xyz" for g in (1, -1)))
    f = b.select("area", "body", "x", "y", "z", F.explode(faces).alias("f")).select("area", "body", "f.*")
    o = s.selectExpr("id", "area", "x0 as ox", "y0 as oy", "z0 as oz", "x1 - x0 as dx", "y1 - y0 as dy", "z1 - z0 as dz")
    out = visibility.polyhedron_hits(f, o)
    got = {x.id: (x.hits, x.first_t) for x in out.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and plan.count("Aggregate [id") == 1  # no row a pair


def test_rays_over_several_tiles_are_sampled_in_the_tiles(spark, monkeypatch):
    import numpy as np

    from overlook.operators import visibility

    monkeypatch.setattr(visibility, "RAYS", 3)
    rng = np.random.default_rng(5)
    n, m = 150, 140
    z = rng.normal(size=(n, m)) * 3
    gone = {(40, 40), (41, 41), (90, 17)}
    grid = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(n) for c in range(m) if (r, c) not in gone], "r int, c int, z double")
    ends = [(0, 0, 149, 139), (149, 3, 2, 138), (64, 64, 64, 0), (63, 139, 128, 139), (5, 64, 140, 64), (30, 30, 50, 50), (10, 10, 11, 10), (127, 127, 128, 128)]
    pairs = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "id int, r0 int, c0 int, r int, c int")
    out = visibility.rays(pairs, grid, n, m, 10.0, 1.7, 0.8)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x.id: x.clearance for x in out.collect()}
    drop = visibility.CURVATURE / (2 * visibility.EARTH)
    for k, (r0, c0, r, c) in enumerate(ends):
        far = np.hypot(r - r0, c - c0)
        steps, d, least = max(3, int(far * 4)), far * 10, np.inf
        for t in np.arange(1, steps) / steps:
            pr, pc = r0 + t * (r - r0), c0 + t * (c - c0)
            i, j = int(np.floor(pr)), int(np.floor(pc))
            corners = [(min(i + a, n - 1), min(j + b, m - 1), (pr - i if a else 1 - pr + i) * (pc - j if b else 1 - pc + j)) for a in (0, 1) for b in (0, 1)]
            corners = [x for x in corners if x[2] > 0 and x[:2] not in gone]
            if corners:
                line = (z[r0, c0] + 1.7) * (1 - t) + (z[r, c] + 0.8 - drop * d**2) * t + drop * (t * d) ** 2
                least = min(least, line - sum(w * z[a, b] for a, b, w in corners))
        assert abs(got[k] - least) < 1e-9


def tables_written(spark, run):
    """How many tables a query writes to the shared folder, rounds of a search among them."""
    from overlook.sources import lineage

    with lineage.swept(spark):
        run().collect()
        return len(lineage._HELD.get())


def test_shortest_paths_take_rounds_by_patches(spark, sf_dir):
    assert tables_written(spark, lambda: queries.QUERIES["network_shortest_path"](spark, sf_dir)) <= 6


def test_patches_settle_what_a_plain_search_finds(spark):
    import random

    from overlook.operators import search

    rng = random.Random(4)
    places = [(float(x), float(y)) for x in range(9) for y in range(9)]
    edges = [(u, v, float(rng.choice([1, 1, 2, 3]))) for u in places for v in places if abs(u[0] - v[0]) + abs(u[1] - v[1]) == 1 and rng.random() < 0.8]
    starts = [("s", places[0]), ("s", places[70]), ("t", places[44])]
    want = set()
    for s in "st":
        label = {n: (0.0, 0, None) for k, n in starts if k == s}
        while True:  # by hops, as an edge at a time would go
            new = dict(label)
            for u, v, c in edges:
                if u in label:
                    x = (label[u][0] + c, label[u][1] + 1, u)
                    if v not in new or x < new[v]:
                        new[v] = x
            if new == label:
                break
            label = new
        want |= {(s, *n, *x[:2], *(x[2] or (None, None))) for n, x in label.items()}
    node = "struct<x: double, y: double>"
    e = spark.createDataFrame(edges, f"u {node}, v {node}, cost double")
    src = spark.createDataFrame([(k, n, 0.0) for k, n in starts], f"scenario string, node {node}, distance double")
    for side in (2.0, 100.0):
        got = search.settled(e, src, search.squares(side)).select("scenario", "node.x", "node.y", "distance", "hops", F.col("previous.x").alias("px"), F.col("previous.y").alias("py"))
        assert {tuple(r) for r in got.collect()} == want


def test_noding_shuffles_no_pairs_and_sends_no_spans_to_every_task(spark):
    from overlook.operators import paths

    ways = spark.createDataFrame([(i, 10.0 * i, 0.0, 10.0 * i + 35.0, 40.0) for i in range(40)], "id int, ax double, ay double, bx double, by double")
    plan = paths.noded(ways, 8.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert not any("HashAggregate(keys=[id" in line and "id2" in line for line in plan.splitlines())


def test_rolling_sums_are_dealt_by_time_and_equal_brute_force(spark):
    import random

    from overlook.streaming import rates

    rng = random.Random(2)
    base = 1_700_000_000_000_000
    times = [base + rng.randrange(0, 200) * 1_000_000 for _ in range(150)] + [base // 30_000_000 * 30_000_000 + k * 30_000_000 for k in range(4)]
    rows = [(i, "ab"[i % 2], t, float(rng.randrange(-50, 50)) if i % 9 else None) for i, t in enumerate(times)] + [(900, "a", None, 2.0), (901, "a", None, 3.0)]
    e = spark.createDataFrame(rows, "id int, k string, us long, value double").select("id", "k", F.timestamp_micros("us").alias("ts"), "value")
    out = rates.rolling(e, "k", 30, 3)
    assert "hashpartitioning(k" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "__span" in plan.split("hashpartitioning(")[1].split(")")[0]
    assert out.columns == ["id", "k", "ts", "value", "total", "rate"]
    got = {r.id: (r.total, r.rate) for r in out.collect()}
    for i, k, t, _ in rows:
        near = [(u, v) for _, k2, u, v in rows if k2 == k and ((t is None and u is None) or (None not in (t, u) and t - 30_000_000 <= u <= t))]
        values = [v for _, v in near if v is not None]
        total = sum(values) if values else None
        span = None if t is None else (t - min(u for u, _ in near)) / 1e6
        assert got[i] == (total, total / span if total is not None and span is not None and span >= 3 else None), i
    assert len(got) == len(rows)


def test_requests_of_one_meaning_are_dealt_to_parts(spark):
    from overlook.plans import catalog

    req = spark.range(3000).select("id", F.lit("https://h.org/w?a=1").alias("url"))
    held = spark.range(70).select(F.col("id").alias("entry"), F.lit("https://h.org/w?a=1&bbox=2").alias("url"))
    out = catalog.reusable(req, held)
    assert out.count() == 210_000 and out.distinct().count() == 210_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k" in plan and "part" in plan.split("SortMergeJoin [k")[1].split("]")[0]


def test_tiles_of_ground_share_few_points():
    from overlook.operators import ground

    assert ((ground.SIDE + 2 * ground.EDGE) / ground.SIDE) ** 2 < 1.4


def test_witnesses_take_rounds_by_patches(spark):
    from overlook.operators import paths

    n = 60
    node = lambda k: F.struct((k * 10.0).alias("x"), F.lit(0.0).alias("y"))
    e = spark.range(n).select(node(F.col("id")).alias("u"), node(F.col("id") + 1).alias("v"))
    one = lambda k, name: spark.range(1).select(F.lit(k).alias(name), node(F.lit(k)).alias("node"))
    assert tables_written(spark, lambda: paths.witnesses(e, one(0, "entry"), one(n, "target"))) < n / 2


def test_nearest_segments_meet_as_arrays_and_equal_brute_force(spark):
    import math
    import random

    from overlook.operators import filters

    rng = random.Random(6)
    at = lambda: (round(rng.gauss(0, 400), 1), round(rng.gauss(0, 300), 1))
    ways = [(*at(), *at()) for _ in range(60)] + [(5.0, 5.0, 5.0, 5.0), (100.0, 0.0, 100.0, 50.0), (140.0, 0.0, 140.0, 50.0)]
    places = [at() for _ in range(400)] + [(120.0, 25.0)] * 40 + [(9000.0, 0.0), (None, 1.0)]
    p = spark.createDataFrame([(i, *q) for i, q in enumerate(places)], "id int, x double, y double")
    s = spark.createDataFrame(ways * 3, "ax double, ay double, bx double, by double")
    out = filters.nearest_segment(p, s, 150.0, 60.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and out.count() == len(places)
    for r in out.collect():
        best = (math.inf, None, None)
        for ax, ay, bx, by in ways if r.x is not None else ():
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((r.x - ax) * dx + (r.y - ay) * dy) / max(dx * dx + dy * dy, 1e-18)))
            nx, ny = ax + t * dx, ay + t * dy
            best = min(best, (math.sqrt((r.x - nx) ** 2 + (r.y - ny) ** 2), nx, ny))
        assert (r.distance, r.nx, r.ny) == (best if best[0] <= 60 else (None, None, None)), r.id


def test_points_without_a_line_point_share_no_task(spark, sf_dir):
    """Cells far from all ways have no line point: a join on its cell would bring all their NULLs to one task."""
    plan = queries.QUERIES["excluded_cells"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(plan) if "Join LeftOuter" in x and "__r" in x]
    for i in joins:
        left = plan[i + 1 :]
        depth = len(plan[i]) - len(plan[i].lstrip(" :+-"))
        left = [x for x in left if len(x) - len(x.lstrip(" :+-")) > depth]
        assert not any("Join LeftOuter, (id" in x for x in left), "\n".join(plan)
    assert len(joins) == 2


def test_spacing_goes_by_tiles_and_equals_going_in_order(spark, monkeypatch):
    from overlook.plans import candidates
    from overlook.sources import terrain as grids

    monkeypatch.setattr(candidates, "SIDE", 5)
    for key in ("hashed", "by row"):
        draw = candidates.drawn(["r", "c"], 11) if key == "hashed" else F.col("r") / 100 + F.col("c") / 10000
        g = grids.cells(spark, 36, 18).withColumn("draw", draw)
        want = []
        for x in g.orderBy("draw", "r", "c").collect():
            if all((x.r - r) ** 2 + (x.c - c) ** 2 >= 9 for r, c in want):
                want.append((x.r, x.c))
        assert sorted((x.r, x.c) for x in candidates.spaced(g, 3.0).collect()) == sorted(want)
    monkeypatch.undo()
    g = grids.cells(spark, 120, 50).withColumn("draw", candidates.drawn(["r", "c"], 7))
    assert tables_written(spark, lambda: candidates.spaced(g, 2.0)) <= 3


def test_searches_of_a_tile_share_its_arrays(spark):
    from overlook.operators import network, paths
    from overlook.sources import terrain as grids

    g = grids.cells(spark, 30, 50).select(F.lit(1).alias("area"), "r", "c", (100 + F.col("r") * 1.5 + F.col("c") % 7).alias("z"), ((F.col("r") * 3 + F.col("c")) % 11 != 0).alias("ok"), F.lit(0.2).alias("tree"), F.lit(0.1).alias("shrub"))
    assert network.patches_of(g).count() == 1  # no tiles that are rim alone
    pairs = spark.range(40).selectExpr("id", "1 as area", "cast(id * 3 % 29 as int) as r0", "cast(id * 7 % 49 as int) as c0", "cast(id * 11 % 29 as int) as r1", "cast(id * 17 % 49 as int) as c1")
    whole = {r.id: r.cost for r in network.connectors(pairs, g, 20.0).collect()}
    assert tables_written(spark, lambda: network.connectors(pairs, g, 20.0)) == 2
    assert sum(v is not None for v in whole.values()) > 20
    walks = paths.connector_paths(pairs, g, 20.0).groupBy("id").agg(F.max("cost").alias("cost")).collect()
    assert {int(r.id): r.cost for r in walks} == {k: v for k, v in whole.items() if v is not None}


def test_connections_leave_only_links_of_tiles_to_components(spark, monkeypatch):
    from overlook.operators import network
    from overlook.sources import terrain as grids

    whole, sizes = network.components, []

    def counted(edges, nodes):
        sizes.append((edges.count(), nodes.count()))
        return whole(edges, nodes)

    monkeypatch.setattr(network, "components", counted)
    g = grids.cells(spark, 130, 20).select("r", "c", F.lit(5.0).alias("z"), F.lit(1.0).alias("slope"), ((F.col("r") != 100) | (F.col("c") == 19)).alias("ok"))
    seats = spark.createDataFrame([("far", 129, 0), ("wall", 100, 3)], "id string, r int, c int")
    got = {r.id: r.status for r in network.connections(g, seats, g.where("r = 0").select("r", "c"), 10.0, (25.0,)).collect()}
    assert got == {"far": "connected", "wall": "outside the domain"}
    assert sizes[0][0] <= 8 and sizes[0][1] <= 4


def written(spark, run):
    """Rows that the stages of a run hand on to others: what its exchanges write."""
    before = set()
    df = run()
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(p.executedPlan())
            continue
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            plan.append(p.plan())
            continue
        if name == "Exchange" and p.id() not in before:
            before.add(p.id())
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        kids = p.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    return sum(found)


def test_crossings_hand_on_rays_not_what_they_cross(spark):
    """A ray of 100 cells crosses some 200 lines; its row goes to the few tiles that it meets, whatever their size, and results are those of one tile."""
    from overlook.operators import visibility
    from overlook.sources import terrain as grids

    g = grids.cells(spark, 66, 130).withColumn("z", 100 + 9 * F.sin(F.col("r") * 0.7) * F.cos(F.col("c") * 0.9)).withColumn("z", F.when((F.col("r") != 40) | (F.col("c") != 77), F.col("z")))
    p = spark.range(400).selectExpr("id", "cast(id * 7 % 66 as int) as r0", "cast(id * 3 % 20 as int) as c0", "cast(65 - id * 11 % 66 as int) as r", "cast(129 - id * 5 % 30 as int) as c")
    edges = [(400, 65, 0, 65, 129), (401, 0, 129, 65, 129), (402, 64, 5, 64, 120), (403, 3, 64, 60, 64), (404, 0, 0, 65, 65), (405, 65, 65, 0, 0), (406, 5, 5, 5, 6), (407, 9, 9, 9, 9)]
    p = p.union(spark.createDataFrame(edges, "id long, r0 int, c0 int, r int, c int"))
    key = lambda rows: sorted((x.id, x.clearance and round(x.clearance, 9), x.first_t, x.borderline, x.complete) for x in rows)
    go = lambda tile: visibility.crossings(p, g, 66, 130, 10.0, 1.7, 0.8, tile=tile)
    want = key(go(256).collect())
    assert [x[0] for x in want] == list(range(407)) and len({x[1] for x in want}) > 300 and not all(x[4] for x in want)
    for tile in (5, 13, 64, 65):
        assert key(go(tile).collect()) == want
    twice = key(visibility.crossings(p.union(p.where("id = 3")), g, 66, 130, 10.0, 1.7, 0.8).collect())
    assert twice == sorted([*want, want[3]])
    assert written(spark, lambda: go(64)) < 408 * 12 + 66 * 130 * 2

    q = p.selectExpr("id", "r0 + 0.25D as pr0", "c0 + 0.5D as pc0", "r - 0.75D as pr", "c - 0.125D as pc", "if(id % 3 = 0, 108D, null) as z0")  # some begin or end outside
    go = lambda tile: visibility.moved_profile(q, g, 66, 130, 10.0, 1.7, 0.8, curvature=0.8, tile=tile)
    key = lambda rows: sorted((x.id, round(x.distance, 9), x.clearance and round(x.clearance, 9), x.first_t, x.borderline, x.complete, x.result) for x in rows)
    want = key(go(256).collect())
    assert len(want) == 408 and 0 < sum(x[5] for x in want) < 400
    for tile in (7, 64):
        assert key(go(tile).collect()) == want
    assert written(spark, lambda: go(64)) < 408 * 24 + 66 * 130 * 3


def kernels_by_hand(z, there, taps):
    """Sums over mirrored cells, one cell and one tap at a time; NaN is unknown, absent cells count nothing."""
    n, m = z.shape
    mirror = lambda i, k: i % (2 * k) if i % (2 * k) < k else 2 * k - 1 - i % (2 * k)
    for axis in (1, 0):
        out = np.zeros_like(z)
        for i, j in np.ndindex(n, m):
            for o, w in taps:
                a, b = (i, mirror(j + o, m)) if axis else (mirror(i + o, n), j)
                out[i, j] += z[a, b] * w if there[a, b] else 0.0
        z = np.where(there, out, 0.0)
    return z


def test_kernels_go_by_blocks_and_equal_sums_cell_by_cell(spark):
    from overlook.functions import terrain

    rng = np.random.default_rng(6)
    z, there = rng.normal(size=(61, 9)), rng.random((61, 9)) > 0.08
    there[0, 0] = there[60, 8] = True
    z[30, 4], there[30, 4] = np.nan, True
    # the grid begins at row -20 and column 5
    g = spark.createDataFrame([(i - 20, j + 5, None if np.isnan(z[i, j]) else float(z[i, j])) for i, j in np.ndindex(z.shape) if there[i, j]], "r int, c int, z double")
    smooth = kernels_by_hand(z, there, terrain.gaussian_taps(1))
    mean = kernels_by_hand(smooth, there, terrain.box_taps(6))
    assert np.isnan(mean[there]).any() and not np.isnan(mean[there]).all()
    for block in (4, 16, 256):
        df = terrain.kernels(g, "z", {"smooth": terrain.gaussian_taps(1), "mean": terrain.box_taps(6)}, block)
        assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(x.r + 20, x.c - 5): (x.smooth, x.mean) for x in df.collect()}
        assert len(got) == there.sum()
        for (i, j), pair in got.items():
            for x, want in zip(pair, (smooth[i, j], mean[i, j])):
                assert x is None if np.isnan(want) else x == pytest.approx(want, abs=1e-12)
    both = terrain.separable(g.withColumn("other", F.lit("o")), "z", terrain.gaussian_taps(1), "smooth")
    assert both.columns == ["r", "c", "z", "other", "smooth"] and {(x.r, x.c): x.smooth for x in both.collect()} == {(i - 20, j + 5): s for (i, j), (s, _) in got.items()}
    assert terrain.kernels(g.limit(0), "z", {"a": terrain.box_taps(3)}).collect() == []


def test_landforms_of_ground_with_gaps_equal_sql_and_meet_the_allowed_cells_once(spark, sf_dir, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/orders.parquet' WHERE o_orderkey % 97 <> 5 AND o_orderkey NOT BETWEEN 260 AND 290) TO '{tmp_path}/orders.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    names = ["r", "c", "slope", "tpi", "bend", "bench", "shoulder", "ridge"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['landform_flags']}) ORDER BY r, c").fetchall()
    out = queries.QUERIES["landform_flags"](spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x) for x in out.select(*names).orderBy("r", "c").collect()]
    assert len(got) == len(want) > 1400
    for a, b in zip(got, want):
        assert a[:2] + a[5:] == b[:2] + b[5:] and a[2:5] == pytest.approx(b[2:5], abs=2e-5)


def most_rows(df):
    """The most rows that a step of the plan gave."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        m = plan.metrics()
        own = [m.apply("numOutputRows").value()] if m.contains("numOutputRows") else []
        return max([*own, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))], default=0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_vegetation_scenarios_make_no_row_a_pair(spark):
    from overlook.operators import visibility

    rng = np.random.default_rng(3)
    centres = [(k % 2, *map(float, rng.normal(0, 6, 2)), 5.0) for k in range(800)] + [(1, None, 2.0, 5.0), (1, float("nan"), 2.0, 5.0)]
    rays = [(k, k % 3, -20.0, y, 5.0, 20.0 if k % 7 else -20.0, y + 3, 6.0) for k, y in enumerate(map(float, rng.normal(0, 6, 900)))] + [(900, 1, None, 1.0, 5.0, 20.0, 4.0, 6.0)]
    b = spark.createDataFrame(centres, "area int, x double, y double, z double")
    s = spark.createDataFrame(rays, "id int, area int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    out = visibility.vegetation_scenarios(b, s)
    assert most_rows(out) <= 4 * 3 * len(rays)  # once 800 a ray
    want = {}
    for scenario, side in visibility.VEGETATION_SIDES.items():
        for i, area, *ends in rays:
            hits, first = 0, None
            for a, *centre in centres:
                if a != area or None in ends or any(v is not None and np.isnan(v) for v in centre):
                    continue
                enter, leave = -np.inf, np.inf
                for lo, hi, v in zip(ends[:3], ends[3:], centre):
                    if v is None and hi - lo == 0:
                        leave = -np.inf
                    elif v is not None and hi - lo == 0:
                        leave = leave if v - side / 2 - lo <= 0 <= v + side / 2 - lo else -np.inf
                    elif v is not None:
                        u, w = sorted(((v - side / 2 - lo) / (hi - lo), (v + side / 2 - lo) / (hi - lo)))
                        enter, leave = max(enter, u), min(leave, w)
                if enter <= leave and leave >= 0 and enter <= 1:
                    hits, first = hits + 1, min(max(enter, 0.0), np.inf if first is None else first)
            want[i, scenario] = (hits, first)
    assert {(x.id, x.scenario): (x.hits, x.first_t) for x in out.collect()} == want


def test_triangle_hits_make_no_row_a_pair(spark):
    from overlook.operators import visibility

    rng = np.random.default_rng(4)
    corner = rng.uniform(-15, 15, (1500, 3))
    mesh = [(k % 2, *map(float, np.concatenate([p, p + rng.normal(0, 3, 3), p + rng.normal(0, 3, 3)]))) for k, p in enumerate(corner)]
    mesh += [(0, 8.0, -3.0, -3.0, 8.0, 3.0, -3.0, 8.0, 0.0, 6.0), (0, 8.0, -3.0, -3.0, 8.0, 3.0, -3.0, 8.0, 0.0, 7.0), (0, *[float("nan")] * 9)]  # crossed in one place, on the line of two buckets
    rays = [(k, k % 3, *map(float, rng.uniform(-15, 15, 3)), *map(float, rng.uniform(-30, 30, 3))) for k in range(600)]
    rays += [(700, 0, -20.0, 0.0, 0.0, 40.0, 0.0, 0.0), (5, 1, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0), (701, 0, -1e6, 0.0, 0.0, 2e6, 0.0, 0.0), (702, 0, None, 0.0, 0.0, 1.0, 0.0, 0.0)]  # also an id of two segments, a long one and one that isn't known
    t = spark.createDataFrame(mesh, "area int, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz"))
    s = spark.createDataFrame(rays, "id int, area int, ox double, oy double, oz double, dx double, dy double, dz double")
    key = lambda df: sorted((x.id, x.crossings, x.first_t, x.inside) for x in df.collect())
    got = key(visibility.triangle_hits(t, s, 8.0))
    assert got == key(visibility.triangle_hits(t, s)) and len(got) > 200
    # 300 triangles one over another, of which each of 300 rays crosses all
    t = spark.range(300).selectExpr("1 as area", "0D as ax", "0D as ay", "id / 300 as az", "6D as bx", "0D as by", "id / 300 as bz", "0D as cx", "6D as cy", "id / 300 as cz")
    s = spark.range(300).selectExpr("id", "1 as area", "1 + id / 300 as ox", "1D as oy", "-1D as oz", "0D as dx", "0D as dy", "3D as dz")
    out = visibility.triangle_hits(t, s, 8.0)
    assert most_rows(out) <= 5000  # once all 90,000 pairs
    assert {x.crossings for x in out.collect()} == {300}


def test_places_round_as_spark_does(spark):
    from overlook.operators import visibility

    rng = np.random.default_rng(6)
    t = np.concatenate([rng.random(2000), (rng.integers(0, 10**7, 2000) + 0.5) / 10**7, [0.0, 1.0, 0.00000005, 0.99999995]])
    want = [x.k for x in spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "i int, t double").orderBy("i").select(F.round("t", 7).alias("k")).collect()]
    assert [float(k) / 10**7 for k in visibility._places(t)] == want


def test_reusable_sources_come_in_short_runs(spark, tmp_path):
    """All pairs of a meaning are the result; their order decides how much room they take in files."""
    from overlook.plans import catalog

    url = "concat('https://h.org/a?layer=', id % 2, '&bbox=', id)"
    held = spark.range(40_000).selectExpr("id * 1000003 as entry", f"{url} as url")
    asked = spark.range(300).selectExpr("id", f"{url} as url")
    lots = catalog._arrays(held.select("entry", (F.col("entry") % 2).alias("k")), "entry", 1).select(F.size("of").alias("n")).collect()
    assert sum(x.n for x in lots) == 40_000 and max(x.n for x in lots) < 2 * catalog.RUN
    out = catalog.reusable(asked, held)
    out.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == 300 * 20_000 and got.where("(entry / 1000003) % 2 <> id % 2").count() == 0
    size = sum(f.stat().st_size for f in (tmp_path / "out").iterdir())
    assert size < 20_000_000, size  # once 42 million bytes
