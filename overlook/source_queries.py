"""Registered queries over sources, sinks, screens, pools, outlines and bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decision_queries import CELL, LAYER, SETS, X0, Y0, _layer, _sets
from .functions import geo, scoring, terrain
from .operators import coverage, evaluation, filters, ground, network, outlines, packed, ranking, surfaces, visibility
from .plans import catalog, pools
from .queries import CELLS, COLS, MARKED, POINT_SQL, RADIUS, ROLLING, RRES, VISIBLE_SQL, _cells, _points, _rolling, _seats, query, table
from .sources import raster, sinks, vectors
from .sources import terrain as grids
from .sources.lineage import fresh_folder
from .streaming import resume


@query("verified_files", "SELECT 'f' || p_partkey AS path, sha256(p_name || CASE WHEN p_partkey % 13 = 0 THEN '!' ELSE '' END) AS expected, CASE WHEN p_partkey % 17 <> 0 THEN sha256(p_name) END AS found FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 17 = 0")
def verified_files(spark, sf_dir):
    """Sealed entries whose content differs or is absent."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("content"), F.col("p_partkey").alias("k"))
    manifest = p.select("path", F.sha2(F.concat("content", F.when(F.col("k") % 13 == 0, "!").otherwise("")), 256).alias("sha256"))
    return grids.verified(p.where("k % 17 <> 0").select("path", F.col("content").cast("binary").alias("content")), manifest)


PLACES = "SELECT s_nationkey AS id, s_suppkey AS k, (s_suppkey * 37 % 360) / 4.0 - 45 AS lon, (s_suppkey * 91 % 280) / 4.0 - 35 AS lat FROM supplier"


def _places(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_nationkey as id", "s_suppkey as k", "(s_suppkey * 37 % 360) / 4D - 45 as lon", "(s_suppkey * 91 % 280) / 4D - 35 as lat")


@query("geojson_round_trip", f"SELECT 'n' || id AS path, row_number() OVER (PARTITION BY id ORDER BY k)::INT - 1 AS k, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM ({PLACES})")
def geojson_round_trip(spark, sf_dir):
    """A line for each nation, written as a GeoJSON feature, read back as a collection."""
    one = vectors.to_geojson_line(_places(spark, sf_dir), "id")
    files = one.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("path"), F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "geojson", F.lit("]}")).alias("content"))
    return vectors.geojson_lines(files).select("path", "k", "lon", "lat")


@query(
    "geojson_rings",
    f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k)::INT - 1 AS n FROM ({PLACES})) SELECT 'n' || id AS path, 0 AS feature, part, n AS k, (lon + part)::DOUBLE AS lon, lat::DOUBLE AS lat FROM p, range(2) t(part)",
)
def geojson_rings(spark, sf_dir):
    """Two rings a nation as one polygon with a hole."""
    ring = F.array_sort(F.collect_list(F.struct("k", "lon", "lat")))
    text = lambda shift: F.concat(F.lit("["), F.array_join(F.transform("ring", lambda p: F.concat(F.lit("["), (p["lon"] + shift).cast("string"), F.lit(", "), p["lat"].cast("string"), F.lit("]"))), ", "), F.lit("]"))
    body = F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": ['), text(0), F.lit(", "), text(1), F.lit("]}}]}"))
    files = _places(spark, sf_dir).groupBy("id").agg(ring.alias("ring")).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("path"), body.alias("content"))
    return vectors.geojson_polygons(files)


@query("gpx_round_trip", f"SELECT k::VARCHAR AS id, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM ({PLACES})")
def gpx_round_trip(spark, sf_dir):
    """A waypoint for each supplier, written and read back."""
    w = vectors.to_gpx_waypoint(_places(spark, sf_dir).select(F.col("k").alias("id"), "lon", "lat"))
    files = w.select(F.col("id").cast("string").alias("path"), F.concat(F.lit('<gpx version="1.1">'), "gpx", F.lit("</gpx>")).alias("content"))
    return vectors.gpx_waypoints(files).select("id", "lon", "lat")


@query(
    "waypoint_faults",
    f"""WITH p AS (SELECT CASE WHEN k % 9 = 0 THEN NULL ELSE (k // 2)::VARCHAR END AS id, CASE WHEN k % 11 = 0 THEN 200.0 ELSE lon END AS lon, lat FROM ({PLACES}))
    SELECT id, CASE WHEN id IS NULL THEN 'no id' ELSE 'repeated id' END AS fault FROM p GROUP BY id HAVING count(*) > 1 OR id IS NULL UNION ALL SELECT id, 'coordinates' FROM p WHERE lon NOT BETWEEN -180 AND 180
    UNION ALL SELECT id, 'outside the area' FROM (SELECT DISTINCT id, lon, lat FROM p) WHERE NOT (lon BETWEEN -20.125 AND 20.125 AND lat BETWEEN -15.125 AND 25.125)""",
)
def waypoint_faults(spark, sf_dir):
    """Waypoints without an id or with a repeated one, out of range, or outside an area."""
    p = _places(spark, sf_dir).selectExpr("if(k % 9 = 0, null, cast(k div 2 as string)) as id", "if(k % 11 = 0, 200D, lon) as lon", "lat")
    ring = [(-20.125, -15.125), (20.125, -15.125), (20.125, 25.125), (-20.125, 25.125)]
    edges = spark.createDataFrame([(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], "poly int, ax double, ay double, bx double, by double")
    return vectors.point_faults(p, edges, 10.0)


_URL = "'https://h' || k % 3 || '.org/wms?' || CASE WHEN k % 2 = 0 THEN 'layers=L' || k % 7 || '&fmt=tif' ELSE 'FMT=tif&LAYERS=l' || k % 7 END || '&bbox=' || k"


@query("reusable_sources", "SELECT p_partkey AS id, s_suppkey AS entry FROM part JOIN supplier ON p_partkey % 21 = s_suppkey % 21")
def reusable_sources(spark, sf_dir):
    """Requests that mean the same but for the box, however their parameters are written."""
    requests = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("k")).select("id", F.expr(_URL).alias("url"))
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entry"), F.col("s_suppkey").alias("k")).select("entry", F.expr(_URL).alias("url"))
    return catalog.reusable(requests, held)


@query("faulty_replies", "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'no layer ' || s_suppkey WHEN 2 THEN 'a web page' WHEN 3 THEN 'denied' END AS fault FROM supplier WHERE s_suppkey % 5 <> 4")
def faulty_replies(spark, sf_dir):
    k = "cast(s_suppkey as string)"
    content = f"""case s_suppkey % 5 when 0 then ' ' when 1 then concat('<?xml version="1.0"?><ServiceExceptionReport><ServiceException>no layer ', {k}, '</ServiceException></ServiceExceptionReport>') when 2 then '<!DOCTYPE html><html></html>' when 3 then '{{"error": {{"message": "denied"}}}}' else '{{"rows": []}}' end"""
    return catalog.faulty_documents(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", f"{content} as content"))


@query("quarantined_entries", "SELECT 'e' || s_suppkey AS path, CASE WHEN s_suppkey % 4 > 1 THEN s_name END AS name FROM supplier")
def quarantined_entries(spark, sf_dir):
    """Entries of a catalog that parse and have all fields, beside those put aside."""
    content = "case s_suppkey % 4 when 0 then '{\"name\": ' when 1 then to_json(named_struct('name', s_name)) else to_json(named_struct('name', s_name, 'product', s_nationkey)) end"
    good, bad = catalog.quarantined(table(spark, sf_dir, "supplier").selectExpr("concat('e', s_suppkey) as path", f"{content} as content"), ["name", "product"])
    return good.select("path", "name").union(bad.select("path", F.lit(None).cast("string")))


@query("csv_round_trip", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def csv_round_trip(spark, sf_dir):
    path = fresh_folder(spark)
    sinks.to_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), path)
    return spark.read.csv(path, header=True, schema="id long, name string, balance double")


@query("metrics_log", "SELECT o_orderpriority AS stage, count(*) AS n, run::BIGINT AS run FROM orders, range(2) t(run) GROUP BY ALL")
def metrics_log(spark, sf_dir):
    """Two runs that each add their rows to one log."""
    path = fresh_folder(spark)
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"))
    for run in (0, 1):
        sinks.log_metrics(m.withColumn("run", F.lit(run).cast("long")), path)
    return spark.read.schema("stage string, n long, run long").json(path)


@query("class_codes", f"WITH {CELLS}, t AS (SELECT r, c, CASE WHEN (r * 131 + c * 17) % 37 = 0 THEN NULL ELSE ((r * 7 + c * 3) % 110) / 100.0::DOUBLE END AS tree FROM cells) SELECT r, c, CASE WHEN tree IS NULL OR tree > 1 THEN 4 WHEN tree < 0.1 THEN 1 WHEN tree < 0.4 THEN 2 ELSE 3 END AS code FROM t")
def class_codes(spark, sf_dir):
    g = _cells(spark, sf_dir).select("r", "c", F.expr("if((r * 131 + c * 17) % 37 = 0, null, ((r * 7 + c * 3) % 110) / 100D)").alias("tree"))
    return g.select("r", "c", geo.cover_class(F.col("tree")).alias("code"))


@query("uniform_scores", "SELECT p_partkey AS id, round(CASE WHEN p_size > 3 THEN p_retailprice * least(1.0::DOUBLE, 20 * 0.02::DOUBLE / ((p_size - 3) / 10.0::DOUBLE)) ELSE 0 END, 6)::DOUBLE AS score FROM part")
def uniform_scores(spark, sf_dir):
    """What an even look at everything in sight is worth."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("reward"), (F.greatest(F.col("p_size") - 3, F.lit(0)) / 10).alias("km2"))
    return p.select("id", F.round(scoring.uniform_score(F.col("reward"), F.col("km2"), 20.0, 0.02), 6).alias("score"))


@query("stress_factors", "SELECT l_suppkey AS id, round(1 - 0.3::DOUBLE * (count(*) FILTER (l_returnflag = 'R') / count(*)), 9) AS foreground, round(1 - count(*) FILTER (l_discount >= 0.05) / count(*), 9)::DOUBLE AS intervening FROM lineitem GROUP BY 1")
def stress_factors(spark, sf_dir):
    """Penalties by the share of rays that meet cover near the seat, and on the way."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("near"), F.count_if(F.col("l_discount") >= 0.05).alias("way"))
    return n.select("id", F.round(scoring.stress_factor(F.col("near"), F.col("n"), 0.3), 9).alias("foreground"), F.round(scoring.stress_factor(F.col("way"), F.col("n"), 1.0), 9).alias("intervening"))


@query("square_means", f"WITH {ROLLING} SELECT a.r, a.c, round(avg(b.z), 5) AS mean, count(*)::DOUBLE AS n FROM rolling a JOIN range(-3, 4) x(i) ON true JOIN range(-3, 4) y(j) ON true JOIN rolling b ON b.r = a.r + i AND b.c = a.c + j GROUP BY a.r, a.c")
def square_means(spark, sf_dir):
    s = terrain.square_sums(_rolling(spark, sf_dir), 3, {"z": F.col("z"), "n": F.lit(1)})
    return s.select("r", "c", F.round(F.col("z") / F.col("n"), 5).alias("mean"), "n")


@query("rounded_ranks", "SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY round(c_acctbal / 1000) DESC, c_custkey) AS INT) AS rank FROM customer")
def rounded_ranks(spark, sf_dir):
    """Scores that round to the same number tie, and ids decide."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("score"))
    return ranking.dense_rank_by(p, "score", "id", digits=0).select("id", "rank")


@query("sampled_heights", f"WITH {ROLLING}, p AS ({POINT_SQL}) SELECT vec_id AS id, r, c, round(z, 6) AS z FROM p JOIN rolling ON r = floor(({Y0} - y) / {CELL})::INT AND c = floor((x - {X0}) / {CELL})::INT")
def sampled_heights(spark, sf_dir):
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y")
    return grids.sample_nearest(_rolling(spark, sf_dir), p, X0, Y0, CELL).select("id", "r", "c", F.round("z", 6).alias("z"))


@query(
    "covered_segments",
    f"""WITH {CELLS}, s AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 40 + 0.5::DOUBLE) * 10 AS ax, -(s_suppkey * 3 + 0.5::DOUBLE) * 10 AS ay, s_suppkey % 9 AS n FROM supplier), k AS (SELECT id, n, (ax / 10 - 0.5)::INT + i AS c, (-ay / 10 - 0.5)::INT AS r, i FROM s, range(9) t(i) WHERE i <= n),
    h AS (SELECT k.*, cells.price / 10000 AS z, (cells.r * 5 + cells.c * 3) % 11 <> 0 AS ok FROM k LEFT JOIN cells USING (r, c))
    SELECT id, bool_and(coalesce(ok, false)) AND coalesce(any_value(degrees(atan(abs(z0 - z1) / nullif(10 * n, 0)))), 0) <= 30 AS covered FROM (SELECT *, max(z) FILTER (i = 0) OVER (PARTITION BY id) AS z0, max(z) FILTER (i = n) OVER (PARTITION BY id) AS z1 FROM h) GROUP BY id""",
)
def covered_segments(spark, sf_dir):
    """Level segments along rows: every cell they run through may be entered, and the way isn't too steep."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "(s_suppkey * 7 % 40 + 0.5D) * 10 as ax", "-(s_suppkey * 3 + 0.5D) * 10 as ay", "(s_suppkey * 7 % 40 + 0.5D + s_suppkey % 9) * 10 as bx", "-(s_suppkey * 3 + 0.5D) * 10 as by")
    g = _cells(spark, sf_dir).where("(r * 5 + c * 3) % 11 <> 0").select("r", "c", (F.col("price") / 10000).alias("z"), F.lit(1.0).alias("slope"))
    return filters.covered_segments(s, g, 0.0, 0.0, 10.0, 30.0)


@query("verified_masks", f"WITH {VISIBLE_SQL} SELECT id, count(*) AS n FROM clear WHERE (clearance >= 0 OR clearance IS NULL) AND (r + c) % 3 <> 0 GROUP BY id")
def verified_masks(spark, sf_dir):
    """Target cells in sight, taken only if they come to the area that a summary of the same run claims."""
    g = _rolling(spark, sf_dir)
    seen = visibility.viewsheds(_seats(spark, sf_dir), g, RADIUS, RRES, 1.7, 0.8)
    claimed = seen.where("(r + c) % 3 <> 0").groupBy("id").agg((F.count("*") * 1e-4).alias("km2"))
    return visibility.whole_masks(seen.select("id", "r", "c"), g.where("(r + c) % 3 <> 0"), claimed, 1e-4).groupBy("id").agg(F.count("*").alias("n"))


@query(
    "review_choice_median",
    """WITH s AS (SELECT l_returnflag AS arm, l_suppkey AS id, sum(l_quantity) AS score FROM lineitem GROUP BY ALL), a AS (SELECT id FROM s WHERE arm = 'A' ORDER BY score DESC, id LIMIT 1), n AS (SELECT id FROM s WHERE arm = 'N' AND id NOT IN (FROM a) ORDER BY score DESC, id LIMIT 1),
    d AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM a UNION ALL SELECT id FROM n) ORDER BY (s_suppkey * 7919) % 100003 LIMIT 1), t AS (SELECT id FROM a UNION ALL SELECT id FROM n UNION ALL SELECT id FROM d),
    r AS (SELECT arm, id, row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS rank FROM s), m AS (SELECT id FROM r WHERE id NOT IN (FROM t) GROUP BY id ORDER BY median(rank), id LIMIT 1)
    SELECT 0 AS place, 'A' AS role, id FROM a UNION ALL SELECT 1, 'N', id FROM n UNION ALL SELECT 2, 'stratified_random', id FROM d UNION ALL SELECT 3, 'median_rank', id FROM m""",
)
def review_choice_median(spark, sf_dir):
    """Two arms' leaders, a drawn one, and the steadiest of the rest by median rank."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("score"))
    draws = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7919 % 100003).alias("n"))
    ranks = ranking.dense_rank_by(s, "score", "id", group="arm").select("id", "rank")
    return evaluation.chosen_for_review(s, ["A", "N"], draws, ranks)


@query("dated_imagery", "WITH e AS (SELECT s_nationkey AS product, 2010 + s_suppkey % 14 AS year, 'L' || (2010 + s_suppkey % 14) || '-' || s_suppkey AS layer, s_suppkey % 20 AS e FROM supplier) SELECT 'p' || product AS product, arg_max(layer, (year, layer)) AS layer, max(year)::INT AS year FROM e WHERE year <= 2020 AND e <= 8 AND e + 15 >= 12 GROUP BY product")
def dated_imagery(spark, sf_dir):
    """The latest layer of each product that contains a box."""
    y = "2010 + s_suppkey % 14"
    e = table(spark, sf_dir, "supplier").selectExpr("concat('p', s_nationkey) as product", f"cast({y} as int) as year", f"concat('L', {y}, '-', s_suppkey) as layer", "'https://h.org/wms?LAYERS=x' as url", "s_suppkey % 20 as ex0", "0 as ey0", "s_suppkey % 20 + 15 as ex1", "10 as ey1")
    return catalog.annual_layers(e, 2020, (8.0, 1.0, 12.0, 9.0)).select("product", "layer", "year")


@query(
    "screened_seats",
    """WITH f AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'connected' WHEN 1 THEN 'connected' WHEN 2 THEN 'no connection' WHEN 3 THEN 'no terrain' WHEN 4 THEN 'too steep' ELSE 'outside the domain' END AS status, CASE s_suppkey % 6 WHEN 0 THEN 25.0 WHEN 1 THEN 35.0 END AS lim, s_suppkey * 13 % 90 AS x FROM supplier),
    c AS (SELECT *, x + 5 <= 60 AND x >= 20 AS complete FROM f) SELECT id, CASE WHEN lim <= 25 THEN 'connected' WHEN status = 'no terrain' OR (status IN ('connected', 'no connection') AND NOT complete) THEN 'unavailable' ELSE 'no connection' END AS status,
    CASE WHEN lim <= 25 THEN NULL WHEN status = 'no terrain' THEN 'missing_terrain' WHEN status IN ('connected', 'no connection') AND NOT complete THEN 'network_coverage' WHEN status = 'outside the domain' THEN 'outside' WHEN status = 'too steep' THEN 'slope' ELSE 'disconnected' END AS reason,
    CASE WHEN lim <= 25 THEN lim END::DOUBLE AS "limit", CASE WHEN lim > 25 THEN lim END::DOUBLE AS next_limit FROM c""",
)
def screened_seats(spark, sf_dir):
    """A screen whose ways are mapped in part: seats without a connection are unavailable where ways of either kind aren't known all around."""
    s = table(spark, sf_dir, "supplier")
    status = "case s_suppkey % 6 when 0 then 'connected' when 1 then 'connected' when 2 then 'no connection' when 3 then 'no terrain' when 4 then 'too steep' else 'outside the domain' end"
    found = s.selectExpr("s_suppkey as id", f"{status} as status", "case s_suppkey % 6 when 0 then 25D when 1 then 35D end as limit")
    boxes = s.selectExpr("s_suppkey as id", "s_suppkey * 13 % 90 as x0", "3 as y0", "s_suppkey * 13 % 90 + 5 as x1", "8 as y1")
    known = spark.createDataFrame([("roads", 0.0, 0.0, 60.0, 20.0), ("trails", 20.0, 0.0, 99.0, 20.0)], "kind string, ex0 double, ey0 double, ex1 double, ey1 double")
    return network.screened(found, catalog.complete_cover(boxes, known, ["roads", "trails"], 25.0), 25.0)


@query("packed_overlaps", f"WITH m AS ({SETS}), n AS (SELECT id, count(*) AS n FROM m GROUP BY id) SELECT a.id AS a, b.id AS b, count(*) AS shared, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 9) AS jaccard, round(count(*) / least(any_value(x.n), any_value(y.n)), 9) AS of_smaller FROM m a JOIN m b ON a.cell = b.cell AND a.id < b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY a.id, b.id")
def packed_overlaps(spark, sf_dir):
    out = packed.overlaps(packed.packed(_sets(spark, sf_dir)))
    return out.select("a", "b", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("of_smaller", 9).alias("of_smaller"))


@query("packed_counts", f"WITH p AS (SELECT cell, count(DISTINCT id) AS n FROM ({SETS}) GROUP BY cell) SELECT count(*) AS union_cells, count(*) FILTER (n >= 2) AS shared_cells, count(*) FILTER (n = 1) AS unique_cells FROM p")
def packed_counts(spark, sf_dir):
    return packed.counts(packed.packed(_sets(spark, sf_dir)))


@query(
    "collection_start",
    f"""WITH m AS ({SETS}), l AS ({LAYER}), k AS (SELECT DISTINCT cell FROM m WHERE id = 3), u AS (SELECT DISTINCT cell FROM m WHERE id IN (3, 7, 12)), f AS (SELECT count(*) AS initial_cells, round(sum(w), 6) AS initial_effective, sum(priority) AS initial_priority FROM k JOIN l USING (cell))
    SELECT f.*, (SELECT count(*) FROM u) AS combined_cells, (SELECT round(sum(w), 6) FROM u JOIN l USING (cell)) AS combined_effective FROM f""",
)
def collection_start(spark, sf_dir):
    """What the kept site of a collection of three covers, and what all of them do."""
    chosen = spark.createDataFrame([(1, "kept", 3), (2, "suggested", 7), (3, "suggested", 12)], "step int, role string, id long")
    t = coverage.initial_totals(_sets(spark, sf_dir), chosen, _layer(spark, sf_dir), 0.01)
    return t.select("initial_cells", F.round("initial_effective", 6).alias("initial_effective"), "initial_priority", "combined_cells", F.round("combined_effective", 6).alias("combined_effective"))


@query("pool_draws")
def pool_draws(spark, sf_dir):
    """Forty candidates five cells apart from benches, shoulders, ridges and the background, drawn in turn; the tests go through the draws one by one."""
    g = _rolling(spark, sf_dir)
    out = pools.pooled(terrain.landforms(g, 10.0), ["bench", "shoulder", "ridge", pools.BACKGROUND], 40, 5.0, 54)
    return out.select("id", "r", "c", F.array_join("provenance", ",").alias("provenance"))


@query(
    "cell_outlines",
    f"""WITH RECURSIVE {CELLS}, m AS (SELECT r, c, r * 2147483648 + c AS node, r // 10 AS br, c // 10 AS bc, (r * r * 3 + c * 7 + r * c * 2) % 5 < 3 AS marked FROM cells), e AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM m a JOIN m b ON a.br = b.br AND a.bc = b.bc AND a.marked = b.marked AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
    w AS (SELECT node, node AS label FROM m UNION SELECT e.v, w.label FROM w JOIN e ON e.u = w.node), l AS (SELECT node, min(label) AS poly FROM w GROUP BY node), d AS (SELECT u, count(*) AS n FROM e GROUP BY u)
    SELECT poly, count(*)::DOUBLE AS area, sum(4 - coalesce(n, 0))::DOUBLE AS around FROM l LEFT JOIN d ON u = node GROUP BY poly""",
)
def cell_outlines(spark, sf_dir):
    """Area and length of the rings of cells that hang together inside blocks of ten by ten, the marked and the others, from their corners: every cell lies in one polygon."""
    m = _cells(spark, sf_dir).select("r", "c", F.expr(f"(bigint(r div 10) * {COLS // 10} + c div 10) * 2 + int({MARKED})").alias("kind"))
    e = outlines.ring_edges(outlines.outlines(m, 0.0, 0.0, 1.0, "kind"))
    # y runs up, so outer rings go clockwise and holes the other way
    return e.groupBy("poly").agg((F.sum(F.col("bx") * F.col("ay") - F.col("ax") * F.col("by")) / 2).alias("area"), F.sum(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))).alias("around"))


@query("raster_blocks", f"WITH {ROLLING} SELECT r, c, round(z, 6) AS z FROM rolling WHERE r >= 7 AND r < 20 AND c <= 33")
def raster_blocks(spark, sf_dir):
    """The ground written as sealed blocks and read back through the raster source, of which a filter needs a part."""
    path = fresh_folder(spark)
    areas = raster.write_areas(_rolling(spark, sf_dir), path, 16, 0.0, 0.0, RRES)
    g = raster.read_areas(spark, path, areas, (7, 20), (0, 34))
    return g.select("r", "c", F.round("z", 6).alias("z"))


@query("resumed_search", "SELECT o_orderkey AS id, round(o_totalprice * 2, 4) AS score FROM orders")
def resumed_search(spark, sf_dir):
    """Scores of a stream that was stopped after its first batch and taken up again."""
    folder = fresh_folder(spark)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    o.repartition(4, "id").write.parquet(f"{folder}/in")
    mark = resume.identity(input=sf_dir, rule="twice the price")
    for batches in (1, None):
        stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = resume.resumed(stream, lambda b: b.select("id", F.round(F.col("price") * 2, 4).alias("score")), f"{folder}/run", mark, batches)
    return out.select("id", "score")


@query("strata_cells", f"WITH {CELLS}, n AS (SELECT max(r) + 1 AS n FROM cells), s AS (SELECT r, c, (CASE WHEN r < n % 5 * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - n % 5 * (n // 5 + 1)) // (n // 5) END)::INT AS sr, (c // 10)::INT AS sc, md5('9:' || r || ':' || c)[1:12] AS h FROM cells, n) SELECT sr, sc, arg_min(r, h) AS r, arg_min(c, h) AS c FROM s GROUP BY sr, sc")
def strata_cells(spark, sf_dir):
    return pools.strata(_cells(spark, sf_dir), 5, 9)


@query("closed_surfaces", f"WITH p AS ({POINT_SQL}), c AS (SELECT DISTINCT label, round_even(x / 60 - 0.5, 0) AS x, round_even(y / 60 - 0.5, 0) AS y FROM p) SELECT count(*) AS cells, true AS meets_cells, 0 AS open_edges FROM (SELECT DISTINCT x, y FROM c)")
def closed_surfaces(spark, sf_dir):
    """The surface around cells at the points: how many cells there are, whether the surface encloses about their space, and edges that aren't in two triangles."""
    c = _points(spark, sf_dir).select((F.col("x") / 60).alias("x"), (F.col("y") / 60).alias("y"), F.lit(0.5).alias("z"))
    cells = c.select(F.rint(F.col("x") - 0.5).alias("x"), F.rint(F.col("y") - 0.5).alias("y")).distinct().agg(F.count("*").alias("cells"))
    t = surfaces.foliage_surface(c, 1.0, 0.25)
    six = "ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)"
    space = t.agg((F.sum(F.expr(six)) / 6).alias("space"))
    # a rounded cell of one metre holds 0.87 cubic metres; its surface on this lattice a little less
    out = cells.crossJoin(space).crossJoin(surfaces.open_edges(t).agg(F.count("*").cast("int").alias("open_edges")))  # one row each
    return out.select("cells", (F.col("space") / F.col("cells")).between(0.7, 1.1).alias("meets_cells"), "open_edges")


@query("ground_heights", f"WITH {CELLS} SELECT r, c, (2 * (1 + 2 * c) + 3 * (1 + 2 * r) + 7)::DOUBLE AS z FROM cells WHERE c < {COLS} - 1 AND r < (SELECT max(r) FROM cells)")
def ground_heights(spark, sf_dir):
    """Heights between measured points of a plane, one near every second metre: the triangles leave no gap, and give the plane back."""
    near = lambda k: F.pmod(F.floor(F.col("price") * k), F.lit(600)) / 1000 - 0.3
    p = _cells(spark, sf_dir).select((2 * F.col("c") + near(1)).alias("x"), (-(2 * F.col("r") + near(7))).alias("y"))
    tri = ground.ground_triangles(ground.one_a_bin(p.withColumn("z", 2 * F.col("x") - 3 * F.col("y") + 7)))
    return ground.ground_heights(tri, 1.0, -1.0, 2.0).select("r", "c", F.round("z", 6).alias("z"))
