"""More registered queries: orders, evaluation rows, access, collections, masks, bodies, lattices, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geo, scoring
from .operators import attention, coverage, evaluation, filters, network, points, ranking, visibility
from .plans import candidates, catalog
from .queries import ACROSS, CELLS, COLS, COVER, DOWN, DROP, KNAPSACK_SQL, POINT_SQL, ROLLING, SEAT_SQL, VISIBLE_SQL, _cells, _points, _rolling, _rows, _seats, query, searched_sql, table
from .sources import sinks, vectors
from .sources import terrain as grids

CANDIDATES = "SELECT s_suppkey AS id, round(s_acctbal) AS raw, s_nationkey % 5 * 10.0::DOUBLE AS matching, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 6) * 1.0::DOUBLE END AS effective, ['low mapped tree cover', 'other known cover', 'insufficient coverage'][s_nationkey % 3 + 1] AS foreground, s_suppkey % 3 <> 1 AS qualifies FROM supplier"


def _candidates(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    names = F.array(*(F.lit(c) for c in ranking.COVER_ORDER))
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.round("s_acctbal").alias("raw"), (n % 5 * 10.0).alias("matching"), F.when(k % 4 != 0, (k % 6).cast("double")).alias("effective"), F.get(names, (n % 3).cast("int")).alias("foreground"), (k % 3 != 1).alias("qualifies")
    )


@query("rank_by_foreground", f"SELECT id, row_number() OVER (ORDER BY CASE foreground WHEN 'low mapped tree cover' THEN 0 WHEN 'other known cover' THEN 1 ELSE 2 END, raw DESC, id)::INT AS rank FROM ({CANDIDATES})")
def rank_by_foreground(spark, sf_dir):
    return ranking.three_mode_rank(_candidates(spark, sf_dir).select("id", "raw", "foreground")).select("id", "rank")


@query("rank_by_matching", f"SELECT id, row_number() OVER (ORDER BY matching DESC, raw DESC, id)::INT AS rank FROM ({CANDIDATES})")
def rank_by_matching(spark, sf_dir):
    return ranking.three_mode_rank(_candidates(spark, sf_dir).select("id", "raw", "matching")).select("id", "rank")


@query("rank_by_habitat", f"SELECT id, row_number() OVER (ORDER BY effective DESC NULLS LAST, matching DESC, raw DESC, id)::INT AS rank FROM ({CANDIDATES})")
def rank_by_habitat(spark, sf_dir):
    return ranking.three_mode_rank(_candidates(spark, sf_dir).select("id", "raw", "matching", "effective")).select("id", "rank")


@query("filter_result_order", f"SELECT id, row_number() OVER (ORDER BY qualifies DESC, matching DESC, raw DESC, id)::INT AS rank FROM ({CANDIDATES})")
def filter_result_order(spark, sf_dir):
    return ranking.filter_order(_candidates(spark, sf_dir).withColumnRenamed("raw", "original")).select("id", "rank")


@query(
    "two_orderings",
    f"""WITH c AS ({CANDIDATES}), h AS (SELECT id, row_number() OVER (ORDER BY coalesce(effective, raw) DESC, raw DESC, id)::INT AS historical_rank FROM c), e AS (SELECT id, row_number() OVER (ORDER BY matching DESC, raw DESC, id)::INT AS established_rank FROM c WHERE qualifies)
    SELECT id, established_rank, historical_rank FROM e LEFT JOIN h USING (id)""",
)
def two_orderings(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return ranking.two_orderings(c.where("qualifies").select("id", "matching", "raw"), c.select("id", F.col("effective").alias("matching"), "raw")).select("id", "established_rank", "historical_rank")


@query(
    "median_ranks",
    "WITH r AS (SELECT l_partkey AS id, l_linenumber AS rank FROM lineitem), m AS (SELECT id, median(rank) AS median_rank FROM r GROUP BY id) SELECT id, median_rank, row_number() OVER (ORDER BY median_rank, id)::INT AS place FROM m",
)
def median_ranks(spark, sf_dir):
    return ranking.median_rank(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank")), "id")


@query("recommendable", f"SELECT id FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 'manual' ELSE 'auto' END AS grp, CASE id % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS standing, id % 2 = 0 AS habitat, CASE WHEN id % 3 = 0 THEN NULL ELSE matching END AS m FROM ({CANDIDATES})) WHERE grp <> 'manual' AND coalesce(standing, true) AND coalesce(m, raw) > 0 AND (NOT habitat OR coalesce(effective, 0) > 0)")
def recommendable(spark, sf_dir):
    k = F.col("id")
    c = _candidates(spark, sf_dir).withColumn("grp", F.when(k % 7 == 0, "manual").otherwise("auto")).withColumn("standing", F.when(k % 5 == 0, False).when(k % 5 != 1, True)).withColumn("habitat", k % 2 == 0).withColumn("matching", F.when(k % 3 != 0, F.col("matching")))
    return filters.recommendable(c).select("id")


SEEN = "SELECT l_suppkey AS id, l_quantity * 60 - 1500 AS dx, l_linenumber * 400 - 1400 AS dy, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_discount * 5 END AS tree, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax * 5 END AS shrub, l_discount AS summer, l_tax AS winter FROM lineitem"


def _seen(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as id", "l_quantity * 60 - 1500 as dx", "l_linenumber * 400 - 1400 as dy", "if(l_partkey % 9 = 0, null, l_discount * 5) as tree", "if(l_partkey % 11 = 0, null, l_tax * 5) as shrub", "l_discount as summer", "l_tax as winter")


@query(
    "evaluation_rows",
    f"""WITH v AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, tree IS NULL OR tree > 1 OR shrub IS NULL OR shrub > 1 AS unknown FROM ({SEEN}))
    SELECT id, round(count(*) * 1e-4, 6)::DOUBLE AS raw, round(count(*) FILTER (d <= 1000) * 1e-4, 6)::DOUBLE AS within_1km, round(count(*) FILTER (d > 1000) * 1e-4, 6)::DOUBLE AS beyond_1km, round(count(*) FILTER (tree < 0.1 AND NOT unknown) * 1e-4, 6)::DOUBLE AS low_cover, round(avg(unknown::INT), 8) AS unknown_share FROM v GROUP BY id""",
)
def evaluation_rows(spark, sf_dir):
    """The areas of an evaluation row; the score of chosen patches beside them has no SQL and is held against `knapsack` in the tests."""
    v = _seen(spark, sf_dir).withColumn("d", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).withColumn("reward", scoring.mixed_season(F.col("summer"), F.col("winter"), 0.25, 1 - F.col("summer")))
    out = evaluation.evaluation_rows(v, "id", 1e-4, 30.0)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("raw", "within_1km", "beyond_1km", "low_cover")), F.round("unknown_share", 8).alias("unknown_share"))


@query("mixed_season_reward", f"SELECT id, round(sum((0.75 * summer + 0.25 * winter) * (1 - summer)), 6)::DOUBLE AS reward FROM ({SEEN}) GROUP BY id")
def mixed_season_reward(spark, sf_dir):
    reward = scoring.mixed_season(F.col("summer"), F.col("winter"), 0.25, 1 - F.col("summer"))
    return _seen(spark, sf_dir).groupBy("id").agg(F.round(F.sum(reward), 6).alias("reward"))


@query("low_cover_openings", f"SELECT id, count(*) AS n FROM ({SEEN}) WHERE tree BETWEEN 0 AND 1 AND tree < 0.1 AND shrub BETWEEN 0 AND 1 GROUP BY id")
def low_cover_openings(spark, sf_dir):
    return filters.low_cover(_seen(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"))


@query(
    "delta_summary",
    "WITH d AS (SELECT l_suppkey AS id, l_extendedprice / 1000 - l_quantity AS d FROM lineitem) SELECT id, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.05), 6) AS p05, round(quantile_cont(d, 0.95), 6) AS p95 FROM d GROUP BY id",
)
def delta_summary(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as id", "l_quantity as a", "l_extendedprice / 1000 as b")
    return evaluation.delta_summary(p, "a", "b", "id").select("id", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p05", "p95")))


@query("target_shares", "SELECT round(avg((l_discount > 0.05)::INT), 8) AS summer, round(avg(CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE (l_tax > 0.04)::INT END), 8) AS winter FROM lineitem WHERE l_returnflag <> 'R'")
def target_shares(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") != "R").alias("target"), (F.col("l_discount") > 0.05).alias("summer"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_tax") > 0.04).alias("winter"))
    return evaluation.target_shares(c, ["summer", "winter"]).select(F.round("summer", 8).alias("summer"), F.round("winter", 8).alias("winter"))


@query(
    "nearest_automated",
    f"""WITH p AS ({POINT_SQL}), d AS (SELECT m.vec_id AS id, a.vec_id AS near, sqrt((m.x - a.x) * (m.x - a.x) + (m.y - a.y) * (m.y - a.y)) AS distance FROM p m, p a WHERE m.label = 0 AND a.label <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, near) AS k FROM d)
    SELECT id, near, round(distance, 6) AS distance FROM r WHERE k = 1""",
)
def nearest_automated(spark, sf_dir):
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, "manual").otherwise("auto").alias("grp"), "x", "y")
    return evaluation.nearest_automated(p, 100.0).select("id", "near", F.round("distance", 6).alias("distance"))


# a network of straight ways over the points' plane, heights on a coarse grid
WAYS = [(float(a), float(b), float(c), float(d)) for a, b, c, d in ((-3000, -2000, 3000, -1500), (-3000, 500, 0, 900), (0, 900, 3000, -300), (-500, -3000, -400, 3000))]
WAY_SQL = f"w(ax, ay, bx, by_) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)' for a, b, c, d in WAYS)})"
X0, Y0, CELL = -5000.0, 3000.0, 200.0
HEIGHT_SQL = f"{CELLS}, g AS (SELECT r, c, CASE WHEN (r * {COLS} + c) % 17 = 0 THEN NULL ELSE 2000 + 120 * sin(c / 5.0::DOUBLE) + price / 20000 END AS z FROM cells)"
NEAR_SQL = f"""n AS (SELECT p.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t, ax, ay, bx, by_ FROM p, w),
    o AS (SELECT *, ax + t * (bx - ax) AS nx, ay + t * (by_ - ay) AS ny FROM n), k AS (SELECT *, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) AS distance FROM o), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, nx, ny) AS q FROM k WHERE distance <= 900) WHERE q = 1),
    h AS (SELECT p.id, b.distance, greatest(0, u.z - v.z) AS height, u.z IS NOT NULL AND v.z IS NOT NULL AS told FROM p LEFT JOIN b USING (id) LEFT JOIN g u ON u.r = floor(({Y0} - p.y) / {CELL}) AND u.c = floor((p.x - {X0}) / {CELL}) LEFT JOIN g v ON v.r = floor(({Y0} - b.ny) / {CELL}) AND v.c = floor((b.nx - {X0}) / {CELL})),
    s AS (SELECT id, CASE WHEN distance IS NULL THEN 'unknown' WHEN distance > 700 OR (told AND height > 60) THEN 'excluded' WHEN NOT told THEN 'unknown' ELSE 'qualifies' END AS status, distance, CASE WHEN told THEN height END AS height FROM h)"""


def _ways(spark):
    return spark.createDataFrame(WAYS, "ax double, ay double, bx double, by double")


def _heights(spark, sf_dir):
    i = F.col("r") * COLS + F.col("c")
    return _cells(spark, sf_dir).select("r", "c", F.when(i % 17 != 0, 2000 + 120 * F.sin(F.col("c") / 5.0) + F.col("price") / 20000).alias("z"))


@query("network_access", f"WITH p AS (SELECT vec_id AS id, x, y FROM ({POINT_SQL})), {WAY_SQL}, {HEIGHT_SQL}, {NEAR_SQL} SELECT id, status, round(distance, 5) AS distance, round(height, 5) AS height FROM s")
def network_access(spark, sf_dir):
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y")
    out = filters.network_access(p, _ways(spark), _heights(spark, sf_dir), X0, Y0, CELL, 500.0, 900.0, 700.0, 60.0)
    return out.select("id", "status", F.round("distance", 5).alias("distance"), F.round("height", 5).alias("height"))


@query("excluded_cells", f"WITH {HEIGHT_SQL}, p AS (SELECT r * {COLS} + c AS id, {X0} + (c + 0.5) * {CELL} AS x, {Y0} - (r + 0.5) * {CELL} AS y FROM g), {WAY_SQL}, {NEAR_SQL} SELECT (id // {COLS})::INT AS r, (id % {COLS})::INT AS c, status FROM s WHERE status <> 'qualifies'")
def excluded_cells(spark, sf_dir):
    return filters.excluded_cells(_heights(spark, sf_dir), _ways(spark), X0, Y0, CELL, 500.0, 900.0, 700.0, 60.0)


SETS = "SELECT DISTINCT s_nationkey AS id, l_partkey AS cell FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
LAYER = "SELECT p_partkey AS cell, p_size / 50.0::DOUBLE AS w, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS priority, p_size % 6 <> 0 AS known FROM part"


def _sets(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("s_nationkey").alias("id"), F.col("l_partkey").alias("cell")).distinct()


def _layer(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_size") / 50.0).alias("w"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.0).alias("priority"), (F.col("p_size") % 6 != 0).alias("known"))


@query("collection_totals", f"WITH u AS (SELECT DISTINCT cell FROM ({SETS}) WHERE id < 5) SELECT count(*) AS combined_cells, round(sum(w), 6) AS combined_effective, sum(priority) AS combined_priority, round(count(*) FILTER (known) * 0.01, 6)::DOUBLE AS scorable, round(count(*) FILTER (NOT coalesce(known, false)) * 0.01, 6)::DOUBLE AS habitat_unknown, CASE WHEN bool_or(known) THEN 'scored' ELSE 'insufficient_data' END AS status FROM u LEFT JOIN ({LAYER}) USING (cell)")
def collection_totals(spark, sf_dir):
    """The collection of the first five sites."""
    t = coverage.totals(_sets(spark, sf_dir).where("id < 5"), _layer(spark, sf_dir), 0.01)
    return t.select("combined_cells", F.round("combined_effective", 6).alias("combined_effective"), "combined_priority", F.round("scorable", 6).alias("scorable"), F.round("habitat_unknown", 6).alias("habitat_unknown"), "status")


def _collected_sql(kept: list[int], size: int) -> str:
    """Sites lie on a line, 100 m apart, and must be 150 m apart: no neighbours."""
    out = f"WITH m AS (SELECT id, cell, w, priority FROM ({SETS}) JOIN ({LAYER}) USING (cell)), f0 AS (SELECT * FROM m)"
    for i in range(1, size + 1):
        before = f"SELECT id FROM c{i - 1}" if i > 1 else "SELECT NULL::BIGINT AS id"
        free = f"WHERE id = {kept[i - 1]}" if i <= len(kept) else f"WHERE id % 6 <> 5 AND NOT EXISTS (SELECT 1 FROM c{i - 1} q WHERE abs(q.id - f{i - 1}.id) < 2)"
        out += f", p{i} AS (SELECT id, count(*) AS more, sum(w) AS more_w, sum(priority) AS more_p FROM f{i - 1} {free} GROUP BY id ORDER BY round(sum(w), 9) DESC, id LIMIT 1)"
        out += f", c{i} AS (SELECT id FROM p{i} UNION ALL SELECT * FROM ({before}) WHERE id IS NOT NULL), f{i} AS (SELECT * FROM f{i - 1} WHERE cell NOT IN (SELECT cell FROM m JOIN p{i} USING (id)))"
    rows = " UNION ALL ".join(f"SELECT {i}::INT AS step, '{'kept' if i <= len(kept) else 'suggested'}' AS role, * FROM p{i}" for i in range(1, size + 1))
    return out + f""" SELECT step, role, id, count(*) AS total_cells, more AS additional_cells, round(100.0 * (count(*) - more) / count(*), 6)::DOUBLE AS overlap_percent, round(sum(w), 6) AS total_effective, round(more_w, 6) AS additional_effective, sum(priority) AS total_priority, more_p AS additional_priority
        FROM ({rows}) JOIN m USING (id) GROUP BY step, role, id, more, more_w, more_p"""


@query("collected_sites", _collected_sql([3], 4))
def collected_sites(spark, sf_dir):
    m = _sets(spark, sf_dir)
    sites = m.select("id").distinct().select("id", F.col("id").alias("rank"), (F.col("id") * 100.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 6 != 5).alias("eligible"))
    out = coverage.collected(m, sites, [3], 4, 150.0, _layer(spark, sf_dir))
    return out.select("step", "role", "id", "total_cells", "additional_cells", *(F.round(c, 6).alias(c) for c in ("overlap_percent", "total_effective", "additional_effective")), "total_priority", "additional_priority")


@query(
    "vegetation_scenarios",
    f"""WITH p AS ({POINT_SQL}), v(scenario, side) AS (VALUES ('sparse', 1.0), ('medium', 1.5), ('dense', 2.0)), b AS (SELECT label AS area, x / 100 AS x, y / 100 AS y, 5.0 AS z FROM p), s AS (SELECT vec_id AS id, label AS area, -20.0 AS x0, y / 100 AS y0, 5.0 AS z0, 20.0 AS x1, y / 100 + 3 AS y1, 6.0 AS z1 FROM p WHERE label < 2),
    t AS (SELECT id, scenario, (x - side / 2 - x0) / (x1 - x0) AS ax, (x + side / 2 - x0) / (x1 - x0) AS bx, (y - side / 2 - y0) / (y1 - y0) AS ay, (y + side / 2 - y0) / (y1 - y0) AS by_, (z - side / 2 - z0) / (z1 - z0) AS az, (z + side / 2 - z0) / (z1 - z0) AS bz FROM s JOIN b USING (area), v),
    h AS (SELECT id, scenario, greatest(ax, ay, az) AS enter, least(bx, by_, bz) AS leave FROM t), f AS (SELECT id, scenario, count(*) AS hits, round(min(greatest(enter, 0)), 8) AS first_t FROM h WHERE enter <= leave AND leave >= 0 AND enter <= 1 GROUP BY ALL)
    SELECT s.id, v.scenario, coalesce(hits, 0) AS hits, first_t FROM s, v LEFT JOIN f ON f.id = s.id AND f.scenario = v.scenario""",
)
def vegetation_scenarios(spark, sf_dir):
    """Rays of the first two areas against all boxes at three sides."""
    p = _points(spark, sf_dir)
    b = p.selectExpr("label as area", "x / 100 as x", "y / 100 as y", "5D as z")
    s = p.where("label < 2").selectExpr("vec_id as id", "label as area", "-20D as x0", "y / 100 as y0", "5D as z0", "20D as x1", "y / 100 + 3 as y1", "6D as z1")
    return visibility.vegetation_scenarios(b, s).select("id", "scenario", "hits", F.round("first_t", 8).alias("first_t"))


BODY = "SELECT label AS area, vec_id AS body, x / 100 AS x, y / 100 AS y, 5.0::DOUBLE AS z FROM p"


@query(
    "body_hits",
    f"""WITH p AS ({POINT_SQL}), b AS ({BODY}), s AS (SELECT vec_id AS id, label AS area, -20.0 AS x0, y / 100 AS y0, 5.0 AS z0, 40.0 AS dx, 3.0 AS dy, 1.0 AS dz FROM p),
    t AS (SELECT id, (x - 1 - x0) / dx AS ax, (x + 1 - x0) / dx AS bx, (y - 1 - y0) / dy AS ay, (y + 1 - y0) / dy AS by_, (z - 1 - z0) / dz AS az, (z + 1 - z0) / dz AS bz FROM s JOIN b USING (area)), h AS (SELECT id, greatest(ax, ay, az) AS enter, least(bx, by_, bz) AS leave FROM t)
    SELECT id, count(*) AS hits, round(min(greatest(enter, 0)), 8) AS first_t FROM h WHERE enter <= leave AND leave >= 0 AND enter <= 1 GROUP BY id""",
)
def body_hits(spark, sf_dir):
    """Convex bodies by their faces; these are cubes, which the SQL meets by slabs."""
    p = _points(spark, sf_dir)
    faces = F.array(*(F.struct(*(F.lit(float(s * (k == a))).alias(f"n{a}") for a in "xyz"), (s * F.col(k) + 1).alias("k")) for k in "xyz" for s in (1, -1)))
    f = p.selectExpr("label as area", "vec_id as body", "x / 100 as x", "y / 100 as y", "5D as z").select("area", "body", F.explode(faces).alias("f")).select("area", "body", "f.*")
    s = p.selectExpr("vec_id as id", "label as area", "-20D as ox", "y / 100 as oy", "5D as oz", "40D as dx", "3D as dy", "1D as dz")
    return visibility.polyhedron_hits(f, s).select("id", "hits", F.round("first_t", 8).alias("first_t"))


@query(
    "triangle_hits",
    f"""WITH p AS ({POINT_SQL}), b AS (SELECT label AS area, x / 100 AS x, y / 100 AS y FROM p), s AS (SELECT vec_id AS id, label AS area, y / 100 AS oy, 4.0 AS oz FROM p),
    h AS (SELECT id, (x + 20) / 40 AS t, oy - y AS u, oz + 2 * (x + 20) / 40 - 3 AS v FROM s JOIN b USING (area)) SELECT id, count(DISTINCT round(t, 7)) AS crossings, round(min(t), 7) AS first_t, count(DISTINCT round(t, 7)) % 2 = 1 AS inside FROM h WHERE u >= 0 AND v >= 0 AND u / 2 + v / 3 <= 1 AND t BETWEEN 0 AND 1 GROUP BY id""",
)
def triangle_hits(spark, sf_dir):
    """Upright triangles across rays that run along x and climb."""
    p = _points(spark, sf_dir)
    t = p.selectExpr("label as area", "x / 100 as ax", "y / 100 as ay", "3D as az", "x / 100 as bx", "y / 100 + 2 as by", "3D as bz", "x / 100 as cx", "y / 100 as cy", "6D as cz")
    s = p.selectExpr("vec_id as id", "label as area", "-20D as ox", "y / 100 as oy", "4D as oz", "40D as dx", "0D as dy", "2D as dz")
    return visibility.triangle_hits(t, s, 8.0).select("id", "crossings", F.round("first_t", 7).alias("first_t"), "inside")


@query(
    "point_crop",
    "WITH q AS (SELECT event_id, (event_id * 37 % 4000) / 2.0 AS x, (event_id * 91 % 3000) / 2.0 AS y, (event_id % 20)::INT AS class, event_id % 23 = 0 AS withheld FROM events), o(id, ox, oy) AS (VALUES (1, 300.0, 300.0), (2, 500.0, 400.0), (3, 1500.0, 900.0)) SELECT id, class, count(*) AS n FROM q, o WHERE class NOT IN (7, 18) AND NOT withheld AND (x - ox) * (x - ox) + (y - oy) * (y - oy) <= 90000 GROUP BY ALL",
)
def point_crop(spark, sf_dir):
    """One scan for three observers, counted by class."""
    r = table(spark, sf_dir, "events").selectExpr("(event_id * 37 % 4000) / 2.0D as x", "(event_id * 91 % 3000) / 2.0D as y", "1D as z", "cast(event_id % 20 as int) as class", "event_id % 23 = 0 as withheld")
    o = spark.createDataFrame([(1, 300.0, 300.0), (2, 500.0, 400.0), (3, 1500.0, 900.0)], "id int, ox double, oy double")
    return points.cropped(r, o, 300.0).groupBy("id", "class").agg(F.count("*").alias("n"))


#: A leader for each supplier.
LEADER_SQL = "l AS (SELECT 'C' || s_suppkey AS id, (s_suppkey + 1)::INT AS rank, 60.0::DOUBLE + s_suppkey * 37 % 380 AS x, -20.0::DOUBLE - s_suppkey * 30 AS y FROM supplier)"


def _leaders(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("concat('C', s_suppkey) as id", "cast(s_suppkey + 1 as int) as rank", "60D + s_suppkey * 37 % 380 as x", "-20D - s_suppkey * 30 as y")


@query(
    "refined_cells",
    f"""WITH {CELLS}, {LEADER_SQL}, o AS (SELECT dx, dy, dx * dx + dy * dy AS far FROM range(-150, 151, 50) a(dx), range(-150, 151, 50) b(dy)), c AS (SELECT far, dx, dy, rank, id, floor((-y - dy) / 10)::INT AS r, floor((x + dx) / 10)::INT AS c FROM l, o WHERE rank <= 10 AND far BETWEEN 1 AND 22500),
    k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY far, dx, dy, rank) AS q FROM c SEMI JOIN cells USING (r, c) WHERE (r + c) % 7 <> 0), n AS (SELECT *, row_number() OVER (ORDER BY far, dx, dy, rank) AS n FROM k WHERE q = 1) SELECT printf('R%04d', n) AS id, id AS parent, r, c FROM n WHERE n <= 40""",
)
def refined_cells(spark, sf_dir):
    g = _cells(spark, sf_dir)
    return candidates.refined(_leaders(spark, sf_dir), g.where("(r + c) % 7 = 0"), g, 0.0, 0.0, 10.0, 40)


@query(
    "symmetric_cells",
    f"""WITH {CELLS}, {LEADER_SQL}, m AS (SELECT *, CASE WHEN rank % 2 = 0 THEN 'manual' ELSE 'auto' END AS grp FROM l), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank, id) <= 4),
    c AS (SELECT grp, rank, dx, dy, id AS parent, floor((-y - dy) / 10)::INT AS r, floor((x + dx) / 10)::INT AS c FROM f, range(-100, 101, 50) a(dx), range(-100, 101, 50) b(dy) WHERE (dx <> 0 OR dy <> 0) AND dx * dx + dy * dy <= 10000),
    k AS (SELECT grp, rank, parent, r, c, min({{'dx': dx, 'dy': dy}}) AS o FROM c SEMI JOIN cells USING (r, c) GROUP BY ALL) SELECT printf('R%04d', row_number() OVER (ORDER BY grp, rank, parent, o)) AS id, grp, parent, r, c FROM k""",
)
def symmetric_cells(spark, sf_dir):
    leaders = _leaders(spark, sf_dir).withColumn("grp", F.when(F.col("rank") % 2 == 0, "manual").otherwise("auto"))
    return candidates.symmetric(leaders, _cells(spark, sf_dir), 0.0, 0.0, 10.0, 100, 50)


@query(
    "dense_lattice",
    f"""WITH {ROLLING}, k AS (SELECT s_suppkey AS centre, 100.0::DOUBLE + s_suppkey * 7 % 300 AS x, -40.0::DOUBLE - s_suppkey * 25 AS y FROM supplier), p AS (SELECT centre, i, trunc((0 - (y - 60 + (i // 15) * 8)) / 10)::INT AS r, trunc((x - 60 + (i % 15) * 8) / 10)::INT AS c, trunc(-y / 10)::INT AS r0, trunc(x / 10)::INT AS c0 FROM k, range(225) t(i))
    SELECT centre, count(rolling.z) AS n, round(max(rolling.z), 6) AS dense_best, round(max(own.z), 6) AS pool_best, round(max(rolling.z) / max(own.z) - 1, 9) AS relative FROM p LEFT JOIN rolling USING (r, c) LEFT JOIN rolling own ON own.r = r0 AND own.c = c0 GROUP BY centre""",
)
def dense_lattice(spark, sf_dir):
    """How much higher the ground is at the best point of a dense lattice about each centre than at the centre itself."""
    k = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as centre", "100D + s_suppkey * 7 % 300 as x", "-40D - s_suppkey * 25 as y")
    g = _rolling(spark, sf_dir)
    dense = candidates.lattices(k, 120.0, 8.0, 0.0, 0.0, 10.0).join(g, ["r", "c"], "left").groupBy("centre").agg(F.count("z").alias("n"), F.max("z").alias("dense_best"))
    own = k.select("centre", (-F.col("y") / 10).cast("int").alias("r"), (F.col("x") / 10).cast("int").alias("c")).join(g, ["r", "c"], "left").select("centre", F.col("z").alias("pool_best"))
    out = dense.join(own, "centre")
    return out.select("centre", "n", F.round("dense_best", 6).alias("dense_best"), F.round("pool_best", 6).alias("pool_best"), F.round(F.col("dense_best") / F.col("pool_best") - 1, 9).alias("relative"))


_SCENARIOS = (
    [("M1_raw", "raw", None, None), ("M2_habitat", "habitat", None, None), ("M3_glass", "glass", None, None)]
    + [(f"without_{f}", "glass", f, "off") for f in candidates.FEATURES]
    + [(f"{k}_{v}", "glass", k, str(v)) for k, vs in candidates.SENSITIVITIES.items() for v in vs]
    + [(f"stress_{k}", "glass", k, "on") for k in ("foreground", "intervening")]
)


@query(
    "enumerated_scenarios",
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + ")" for v in _SCENARIOS) + """) t(scenario, arm, setting, value)
    UNION ALL SELECT 'canopy_stress_' || h || '.0', 'glass', 'canopy_height', h || '.0' FROM (SELECT DISTINCT p_size AS h FROM part)""",
)
def enumerated_scenarios(spark, sf_dir):
    """The scenarios of a run whose canopy heights are the sizes in use: fifty at most."""
    heights = [float(r.p_size) for r in table(spark, sf_dir, "part").select("p_size").distinct().collect()]
    return candidates.enumerated(spark, tuple(heights))


@query(
    "inserted_vertices",
    f"""WITH p AS ({POINT_SQL}), e AS (SELECT vec_id AS record, x, y, CASE WHEN vec_id % 2 = 0 THEN (7000 + label)::VARCHAR ELSE '' END AS rid, 'Ridge ' || label || CASE WHEN vec_id % 3 = 0 THEN ' Detour' ELSE ' Road' END AS name FROM p), s AS (SELECT record, x - 200 AS ax, y + 40 AS ay, x + 100 AS bx, y - 60 AS by_, CASE WHEN rid <> '' THEN rid[2:] ELSE '' END AS i, upper(name) AS n FROM e),
    d AS (SELECT e.record AS r1, s.record, e.x AS px, e.y AS py, CASE WHEN rid <> '' THEN rid[2:] ELSE '' END AS i1, i AS i2, replace(upper(name), ' ROAD', '') AS n1, replace(n, ' ROAD', '') AS n2, ax, ay, bx, by_, greatest(0, least(1, ((e.x - ax) * 300 + (e.y - ay) * -100) / 100000)) AS t FROM e JOIN s ON e.record <> s.record),
    g AS (SELECT *, ax + t * 300 AS x, ay + t * -100 AS y, t * sqrt(100000) AS "at" FROM d), h AS (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS gap FROM g)
    SELECT DISTINCT record, 0 AS k, round(x, 5) AS x, round(y, 5) AS y, round("at", 5) AS "at" FROM h WHERE gap <= 60 AND ((i1 <> '' AND i1 = i2) OR n1 = n2 OR (replace(n1, ' DETOUR', '') = replace(n2, ' DETOUR', '') AND gap <= 2))""",
)
def inserted_vertices(spark, sf_dir):
    k = F.col("vec_id")
    e = _points(spark, sf_dir).select(k.alias("record"), "x", "y", F.when(k % 2 == 0, (F.col("label") + 7000).cast("string")).otherwise("").alias("rid"), F.concat(F.lit("Ridge "), F.col("label").cast("string"), F.when(k % 3 == 0, " Detour").otherwise(" Road")).alias("name"))
    s = e.select("record", F.lit(0).alias("k"), (F.col("x") - 200).alias("ax"), (F.col("y") + 40).alias("ay"), (F.col("x") + 100).alias("bx"), (F.col("y") - 60).alias("by"), "rid", "name")
    return network.inserted_vertices(e, s, 60.0).select("record", "k", *(F.round(c, 5).alias(c) for c in ("x", "y", "at"))).distinct()


@query(
    "route_evidence",
    """WITH r AS (SELECT p_partkey AS record, (p_partkey % 40)::VARCHAR AS rid FROM part), e AS (SELECT (s_suppkey % 37)::VARCHAR AS rid, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'closed' ELSE 'open' END AS vehicle, CASE WHEN s_suppkey % 2 = 0 THEN '07/01-12/31' ELSE '07/01-10/31' END AS season FROM supplier),
    g AS (SELECT rid, bool_or(coalesce(vehicle = 'open' AND season = '07/01-12/31', false)) AS motor, count(*) AS evidence FROM e GROUP BY rid) SELECT record, r.rid, coalesce(motor, false) AS motor, coalesce(evidence, 0) AS evidence FROM r LEFT JOIN g USING (rid)""",
)
def route_evidence(spark, sf_dir):
    k = F.col("s_suppkey")
    e = table(spark, sf_dir, "supplier").select((k % 37).cast("string").alias("rid"), F.when(k % 3 == 0, None).when(k % 5 == 0, "closed").otherwise("open").alias("vehicle"), F.when(k % 2 == 0, "07/01-12/31").otherwise("07/01-10/31").alias("season"))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), (F.col("p_partkey") % 40).cast("string").alias("rid"))
    return network.with_evidence(r, e, F.lit("2026-10-24").cast("date"), F.lit("2026-11-01").cast("date"))


@query(
    "solved_objectives",
    """WITH c AS (SELECT o_orderpriority AS objective, o_custkey AS start, min(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END) AS cost FROM orders GROUP BY ALL), m AS (SELECT c_custkey AS start, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS way FROM customer), r AS (SELECT *, cost + way AS total, row_number() OVER (PARTITION BY objective ORDER BY cost + way, start) AS k FROM c JOIN m USING (start) WHERE cost IS NOT NULL AND way IS NOT NULL)
    SELECT start, string_agg(objective, '|' ORDER BY objective) AS objectives, round(min(total), 4) AS cost FROM r WHERE k = 1 GROUP BY start""",
)
def solved_objectives(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("objective"), F.col("o_custkey").alias("start")).agg(F.min(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))).alias("cost"))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("start"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("cost"))
    return network.solved(c, m).select("start", F.array_join("objectives", "|").alias("objectives"), F.round("cost", 4).alias("cost"))


TRI_SQL = f"""{ROLLING}, g AS (SELECT r, c, CASE WHEN (r * 7 + c * 11) % 31 = 0 THEN NULL ELSE z END AS z FROM rolling), p AS (SELECT vec_id AS id, 19.0 + x / 150 AS pr, 19.5 + y / 150 AS pc FROM ({POINT_SQL})), q AS (SELECT *, least(greatest(floor(pr), 0), {DOWN} - 2)::INT AS i, least(greatest(floor(pc), 0), {ACROSS} - 2)::INT AS j FROM p),
    h AS (SELECT q.*, pr - i AS fr, pc - j AS fc, a.z AS a, b.z AS b, d.z AS d, e.z AS e FROM q JOIN g a ON a.r = i AND a.c = j JOIN g b ON b.r = i AND b.c = j + 1 JOIN g d ON d.r = i + 1 AND d.c = j JOIN g e ON e.r = i + 1 AND e.c = j + 1)"""


@query("triangle_samples", f"WITH {TRI_SQL} SELECT id, round(CASE WHEN pr >= 0 AND pc >= 0 AND pr <= {DOWN} - 1 AND pc <= {ACROSS} - 1 THEN CASE WHEN fr <= fc THEN a * (1 - fc) + b * (fc - fr) + e * fr ELSE a * (1 - fr) + e * fc + d * (fr - fc) END END, 6) AS z FROM h")
def triangle_samples(spark, sf_dir):
    g = _rolling(spark, sf_dir).withColumn("z", F.when((F.col("r") * 7 + F.col("c") * 11) % 31 != 0, F.col("z")))
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), (19.0 + F.col("x") / 150).alias("pr"), (19.5 + F.col("y") / 150).alias("pc"))
    return grids.corner_triangles(g, p, _rows(g), COLS).select("id", F.round("z", 6).alias("z"))


def _between(a: str, b: str) -> str:
    """t of the whole numbers strictly between a and b."""
    return f"SELECT id, round((v - {a}) / ({b} - {a})::DOUBLE, 12) AS t FROM p, unnest(range(least({a}, {b}) + 1, greatest({a}, {b}))) u(v)"


_SNAP = "CASE WHEN abs({0} - round({0})) < 1e-9 THEN round({0}) ELSE {0} END"


@query(
    "exact_crossings",
    f"""WITH {ROLLING}, {SEAT_SQL}, p AS (SELECT s.id || '-' || g.r || '-' || g.c AS id, r0, c0, g.r, g.c, o.z AS z0, g.z AS z1, sqrt((g.r - r0) * (g.r - r0) + (g.c - c0) * (g.c - c0)) * 10 AS d FROM s JOIN rolling o ON o.r = r0 AND o.c = c0 JOIN rolling g ON abs(g.r - r0) <= 8 AND abs(g.c - c0) <= 8 WHERE (g.r <> r0 OR g.c <> c0) AND sqrt((g.r - r0) * (g.r - r0) + (g.c - c0) * (g.c - c0)) * 10 <= 80),
    t AS (SELECT DISTINCT id, t FROM ({_between('r0', 'r')} UNION ALL {_between('c0', 'c')} UNION ALL {_between('(c0 - r0)', '(c - r)')})),
    x AS (SELECT p.*, t, {_SNAP.format('(r0 + t * (r - r0))')} AS pr, {_SNAP.format('(c0 + t * (c - c0))')} AS pc FROM p JOIN t USING (id)), q AS (SELECT *, least(greatest(floor(pr), 0), {DOWN} - 2)::INT AS i, least(greatest(floor(pc), 0), {ACROSS} - 2)::INT AS j FROM x),
    h AS (SELECT q.*, pr - i AS fr, pc - j AS fc, a.z AS a, b.z AS b, d.z AS dd, e.z AS e FROM q JOIN rolling a ON a.r = i AND a.c = j JOIN rolling b ON b.r = i AND b.c = j + 1 JOIN rolling d ON d.r = i + 1 AND d.c = j JOIN rolling e ON e.r = i + 1 AND e.c = j + 1),
    k AS (SELECT id, t, (z0 + 1.7) * (1 - t) + (z1 + 0.8 - {DROP!r} * d * d) * t + {DROP!r} * (t * d) * (t * d) - CASE WHEN fr <= fc THEN a * (1 - fc) + b * (fc - fr) + e * fr ELSE a * (1 - fr) + e * fc + dd * (fr - fc) END AS gap FROM h), m AS (SELECT id, min(gap) AS clearance, min(t) FILTER (gap < 0) AS first_t FROM k GROUP BY id)
    SELECT p.id, round(clearance, 6) AS clearance, round(first_t, 9) AS first_t, coalesce(abs(clearance) <= 0.05, false) AS borderline, true AS complete FROM p LEFT JOIN m USING (id)""",
)
def exact_crossings(spark, sf_dir):
    """Rays held against every row, column and diagonal they cross; checked in the tests against dense sampling of the same triangles."""
    g = _rolling(spark, sf_dir)
    seats = _seats(spark, sf_dir).join(g.select(F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("z").alias("z0")), ["r0", "c0"])
    pairs = visibility.targets_within(seats, g.withColumnRenamed("z", "z1"), 80.0, 10.0).drop("d").withColumn("id", F.concat_ws("-", "id", "r", "c"))
    return visibility.crossings(pairs, g, _rows(g), COLS, 10.0, 1.7, 0.8).select("id", F.round("clearance", 6).alias("clearance"), F.round("first_t", 9).alias("first_t"), "borderline", "complete")


@query("domains", f"WITH {CELLS}, g AS (SELECT r, c FROM cells) SELECT r, c, (r + c) % 3 = 0 AND (r * c) % 5 <> 0 AS observer, (r - c) % 4 = 0 AND (r * c) % 5 <> 0 AS target FROM g")
def domains(spark, sf_dir):
    g = _cells(spark, sf_dir).select("r", "c")
    return filters.domains(g, g.where("(r + c) % 3 = 0"), g.where("(r - c) % 4 = 0"), g.where("(r * c) % 5 = 0"))


@query(
    "dilated_cells",
    f"WITH {CELLS}, g AS (SELECT r, c FROM cells), s AS (SELECT * FROM g WHERE (r * 7 + c * 13) % 97 = 0) SELECT DISTINCT (s.r + a)::INT AS r, (s.c + b)::INT AS c FROM s, range(-3, 4) x(a), range(-3, 4) y(b) WHERE a * a + b * b <= 9",
)
def dilated_cells(spark, sf_dir):
    return filters.dilated(_cells(spark, sf_dir).select("r", "c").where("(r * 7 + c * 13) % 97 = 0"), 30.0, 10.0)


@query(
    "layer_mask",
    f"""WITH p AS (SELECT vec_id AS id, x, y, label FROM ({POINT_SQL})), b AS (SELECT *, x BETWEEN -900 AND 900 AND y > -700 AND y <= 700 AS one, x > 500 AND x <= 1500 AND y > 0 AND y <= 900 AS old, x > 500 AND x <= 1800 AND y > 0 AND y <= 900 AS new FROM p)
    SELECT 2 AS poly, count(*) FILTER (old <> new) AS changed, count(*) FILTER (one OR new) AS inside FROM b""",
)
def layer_mask(spark, sf_dir):
    """Two boxes, the second one repaired: points inside either, and what the repair changed."""
    box = lambda k, x0, y0, x1, y1: [(k, x0, y0, x1, y0), (k, x1, y0, x1, y1), (k, x1, y1, x0, y1), (k, x0, y1, x0, y0)]
    rows = box(1, -900.0, -700.0, 900.0, 700.0) + box(2, 500.0, 0.0, 1500.0, 900.0)
    ddl = "poly int, ax double, ay double, bx double, by double"
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))
    mask, log = filters.layer_mask(p, spark.createDataFrame(rows, ddl), 100.0, spark.createDataFrame(box(2, 500.0, 0.0, 1800.0, 900.0), ddl))
    return log.crossJoin(mask.agg(F.count("*").alias("inside")))  # one row by one row


@query(
    "snapped_points",
    f"WITH {CELLS}, p AS ({POINT_SQL}), q AS (SELECT vec_id, floor(({Y0} - y) / {CELL})::INT AS r, floor((x - {X0}) / {CELL})::INT AS c FROM p) SELECT 'E_' || vec_id AS id, ({X0} + (c + 0.5) * {CELL})::DOUBLE AS x, ({Y0} - (r + 0.5) * {CELL})::DOUBLE AS y, r, c FROM q SEMI JOIN cells USING (r, c) WHERE (r + c) % 3 <> 0",
)
def snapped_points(spark, sf_dir):
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y")
    return vectors.snapped(p, _cells(spark, sf_dir).select("r", "c").where("(r + c) % 3 <> 0"), X0, Y0, CELL)


@query("annual_layers", "WITH e AS (SELECT 'p' || s_nationkey AS product, 2010 + s_suppkey % 14 AS year, 'L' || (2010 + s_suppkey % 14) AS layer FROM supplier), b AS (SELECT product, max(year) AS year FROM e WHERE year <= 2020 GROUP BY 1) SELECT product, 'L' || year AS layer, year, 'https://h.org/wms?LAYERS=L' || year || '&fmt=tif' AS url FROM b")
def annual_layers(spark, sf_dir):
    y = 2010 + F.col("s_suppkey") % 14
    e = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("product"), y.alias("year"), F.concat(F.lit("L"), y.cast("string")).alias("layer"), F.lit("https://h.org/wms?LAYERS=old&fmt=tif").alias("url"))
    return catalog.annual_layers(e, 2020)


@query("aligned_covers", "WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'tree' ELSE 'shrub' END AS layer, s_nationkey % 3 AS product, 2020 + s_suppkey // 2 % 3 AS year, s_suppkey // 2 % 2 AS x0 FROM supplier) SELECT t.product, t.year, t.id AS tree, b.id AS shrub FROM s t JOIN s b ON t.layer = 'tree' AND b.layer = 'shrub' AND t.product = b.product AND t.year = b.year AND t.x0 = b.x0")
def aligned_covers(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 2 == 0, "tree").otherwise("shrub").alias("layer"), (F.col("s_nationkey") % 3).alias("product"), (2020 + F.floor(k / 2) % 3).alias("year"), (F.floor(k / 2) % 2).alias("x0"), *(F.lit(v).alias(n) for n, v in (("y0", 0.0), ("res", 10.0), ("rows", 100), ("cols", 100))))
    return catalog.aligned_pairs(s)


@query("storage_needed", "SELECT (ceil(sum(length(html)) FILTER (page_id % 4 <> 0) * 3 / 1e6 / 10) * 10)::BIGINT AS storage_mb FROM pages")
def storage_needed(spark, sf_dir):
    return catalog.storage_needed(table(spark, sf_dir, "pages").select(F.length("html").alias("bytes"), (F.col("page_id") % 4 == 0).alias("cached")))


@query("row_digests", """SELECT n_nationkey, sha256('{"n_name":' || to_json(n_name) || ',"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS sha256 FROM nation""")
def row_digests(spark, sf_dir):
    return sinks.digests(table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey"), "n_nationkey")


@query("first_seen", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS at FROM lineitem GROUP BY 1")
def first_seen(spark, sf_dir):
    return sinks.first_seen(table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")), "l_partkey", "at")


@query("pooled_candidates", "SELECT s_suppkey AS id, s_acctbal AS score, NULL::BIGINT AS size FROM supplier UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def pooled_candidates(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    return sinks.union_by_name([a, b])


@query(
    "rounded_distances",
    f"WITH p AS ({POINT_SQL}), q AS (SELECT vec_id, abs(x / 1000) - 0.6 AS a, abs(y / 1000) - 0.6 AS b, 0.2 - 0.6 AS c FROM p) SELECT vec_id, round(sqrt(greatest(a, 0) * greatest(a, 0) + greatest(b, 0) * greatest(b, 0)) + least(greatest(a, b, c), 0) - 0.4, 8) AS distance FROM q",
)
def rounded_distances(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("vec_id", F.round(geo.rounded_distance(F.col("x") / 1000, F.col("y") / 1000, F.lit(0.2), 2.0, 0.4), 8).alias("distance"))


@query(
    "clipped_ways",
    f"""WITH {CELLS}, {WAY_SQL}, c AS (SELECT row_number() OVER () AS k, *, (ax - {X0}) / {CELL} AS ca, (bx - {X0}) / {CELL} AS cb, ({Y0} - ay) / {CELL} AS ra, ({Y0} - by_) / {CELL} AS rb FROM w),
    t AS (SELECT k, 0.0::DOUBLE AS t FROM c UNION SELECT k, 1.0 FROM c UNION SELECT k, round((v - ca) / (cb - ca), 12) FROM c, range(-9, 99) g(v) WHERE v BETWEEN least(ca, cb) AND greatest(ca, cb) UNION SELECT k, round((v - ra) / (rb - ra), 12) FROM c, range(-9, 99) g(v) WHERE v BETWEEN least(ra, rb) AND greatest(ra, rb)),
    s AS (SELECT k, t AS t0, lead(t) OVER (PARTITION BY k ORDER BY t) AS t1 FROM t), m AS (SELECT ax, ay, s.*, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) * (t1 - t0) AS len, floor(ra + (t0 + t1) / 2 * (rb - ra))::INT AS r, floor(ca + (t0 + t1) / 2 * (cb - ca))::INT AS c FROM s JOIN c USING (k) WHERE t1 IS NOT NULL)
    SELECT ax, ay, count(*) AS pieces, round(sum(CASE WHEN (m.r + m.c) % 4 <> 0 AND cells.r IS NOT NULL THEN len ELSE 0 END), 5) AS inside FROM m LEFT JOIN cells ON cells.r = m.r AND cells.c = m.c GROUP BY ALL""",
)
def clipped_ways(spark, sf_dir):
    """Ways cut along the grid: how many pieces, and how long they run inside the domain."""
    s = _ways(spark).withColumn("id", F.struct("ax", "ay"))
    p = filters.clipped(s, _cells(spark, sf_dir).select("r", "c").where("(r + c) % 4 <> 0"), X0, Y0, CELL)
    long = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return p.groupBy("id").agg(F.count("*").alias("pieces"), F.round(F.sum(F.when(F.col("inside"), long).otherwise(0.0)), 5).alias("inside")).select("id.ax", "id.ay", "pieces", "inside")


@query("resolution_control")
def resolution_control(spark, sf_dir):
    """Area in sight at the grid's resolution and on means of 3 x 3 cells; the parts are held to their own checks in the tests."""
    out = evaluation.resolution_control(_seats(spark, sf_dir), _rolling(spark, sf_dir), 3, 80.0, 10.0, 1.7, 0.8)
    return out.select("id", *(F.round(c, 8).alias(c) for c in ("fine", "coarse", "relative")))


_CLASS = "round(count(*) FILTER ({}) * 0.0001::DOUBLE, 8)"


@query(
    "waypoint_recompute",
    f"WITH {VISIBLE_SQL}, {COVER('rolling')} SELECT id, {_CLASS.format('true')} AS area_km2, {_CLASS.format('tree < 0.1')} AS open, {_CLASS.format('tree >= 0.1 AND tree < 0.4')} AS partial, {_CLASS.format('tree >= 0.4')} AS dense, {_CLASS.format('tree IS NULL')} AS unknown, true AS closes FROM clear JOIN cover USING (r, c) WHERE clearance >= 0 OR clearance IS NULL GROUP BY id",
)
def waypoint_recompute(spark, sf_dir):
    out = evaluation.waypoint(_seats(spark, sf_dir), grids.with_cover(_rolling(spark, sf_dir)), 80.0, 10.0, 1.7, 0.8)
    return out.select("id", F.round("area_km2", 8).alias("area_km2"), *(F.round(c, 8).alias(c) for c in ("open", "partial", "dense", "unknown")), "closes")


@query(
    "connector_costs",
    f"""WITH RECURSIVE {searched_sql(30, 'plain')}, e AS MATERIALIZED (SELECT area, u, v, length * (1 + power(slope_b / 15, 2)) AS cost FROM e1 WHERE slope_a <= 30 AND slope_b <= 30 AND grade <= 30),
    p AS (SELECT s_suppkey AS id, s_suppkey // 10 AS area, s_suppkey * 3 % 29 AS r0, s_suppkey * 7 % 49 AS c0, s_suppkey * 11 % 29 AS r1, s_suppkey * 17 % 49 AS c1 FROM supplier),
    d(id, node, cost) USING KEY (id, node) AS (SELECT id, node, 0.0::DOUBLE FROM p JOIN o ON o.area = p.area AND o.r = r0 AND o.c = c0 UNION SELECT d.id, e.v, min(d.cost + e.cost)::DOUBLE FROM d JOIN e ON e.u = d.node LEFT JOIN recurring.d k ON k.id = d.id AND k.node = e.v WHERE k.cost IS NULL OR d.cost + e.cost < k.cost GROUP BY d.id, e.v)
    SELECT p.id, round(d.cost, 5) AS cost FROM p LEFT JOIN g ON g.area = p.area AND g.r = r1 AND g.c = c1 LEFT JOIN d ON d.id = p.id AND d.node = g.node""",
)
def connector_costs(spark, sf_dir):
    """Least-cost walks between pairs of cells, tile by tile; held against relaxation in the tests."""
    g = _rolling(spark, sf_dir).withColumn("ok", (F.col("r") * 3 + F.col("c")) % 11 != 0).withColumn("area", F.expr("r div 30")).withColumn("r", F.col("r") % 30)
    p = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_suppkey div 10 as area", "cast(s_suppkey * 3 % 29 as int) as r0", "cast(s_suppkey * 7 % 49 as int) as c0", "cast(s_suppkey * 11 % 29 as int) as r1", "cast(s_suppkey * 17 % 49 as int) as c1")
    return network.connectors(p, g, 20.0).select("id", F.round("cost", 5).alias("cost"))


def _spaced_sql(spacing: int) -> str:
    return f"""w{spacing}(n, taken) AS (SELECT 0::BIGINT, CAST([] AS STRUCT(r INT, c INT, n BIGINT)[]) UNION ALL SELECT o.n, CASE WHEN len(list_filter(taken, lambda x: (x.r - o.r) * (x.r - o.r) + (x.c - o.c) * (x.c - o.c) < {spacing**2})) = 0 THEN list_append(taken, {{'r': o.r, 'c': o.c, 'n': o.n}}) ELSE taken END FROM w{spacing} w JOIN o ON o.n = w.n + 1),
    s{spacing} AS (SELECT x.r AS r, x.c AS c, x.n AS n FROM (SELECT unnest(taken) AS x FROM w{spacing} WHERE n = (SELECT max(n) FROM o)))"""


@query(
    "adapted_candidates",
    f"""WITH RECURSIVE {CELLS}, o AS MATERIALIZED (SELECT r, c, row_number() OVER (ORDER BY md5('7:' || r || ':' || c)[1:12], r, c) AS n FROM cells), {', '.join(_spaced_sql(k) for k in (15, 10, 7, 5))},
    k AS (SELECT CASE WHEN (SELECT count(*) FROM s15) >= 48 THEN 15 WHEN (SELECT count(*) FROM s10) >= 48 THEN 10 WHEN (SELECT count(*) FROM s7) >= 48 THEN 7 ELSE 5 END AS spacing),
    a AS (SELECT *, 15 AS spacing FROM s15 UNION ALL SELECT *, 10 FROM s10 UNION ALL SELECT *, 7 FROM s7 UNION ALL SELECT *, 5 FROM s5) SELECT r, c, spacing::DOUBLE AS spacing FROM a JOIN k USING (spacing) ORDER BY n LIMIT 48""",
)
def adapted_candidates(spark, sf_dir):
    """Spacing that shrinks until four fifths of the wanted points are there; `spaced` is held against going through in order."""
    g = _cells(spark, sf_dir).withColumn("draw", candidates.drawn(["r", "c"], 7))
    return candidates.adapted(g, 60, (15, 10, 7), 5.0).select("r", "c", "spacing")


TAPS = network.gaussian_taps(1.0)


@query(
    "smoothed_profile",
    f"""WITH s AS (SELECT s_nationkey AS id, s_suppkey AS k, s_acctbal / 100 AS z FROM supplier), i AS (SELECT id, k, z, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM s), t(o, w) AS (VALUES {', '.join(f'({o}, {w!r}::DOUBLE)' for o, w in TAPS)}),
    a AS (SELECT id, k, i, n, w, ((i + o) % (2 * n) + 2 * n) % (2 * n) AS q FROM i, t), m AS (SELECT a.id, a.k, sum(a.w * j.z) AS z FROM a JOIN i j ON j.id = a.id AND j.i = CASE WHEN q >= a.n THEN 2 * a.n - 1 - q ELSE q END GROUP BY ALL),
    d AS (SELECT id, z - lag(z) OVER (PARTITION BY id ORDER BY k) AS dz FROM m) SELECT id, round(coalesce(sum(greatest(dz, 0)), 0), 6)::DOUBLE AS gain, round(coalesce(sum(greatest(-dz, 0)), 0), 6)::DOUBLE AS loss FROM d GROUP BY id""",
)
def smoothed_profile(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as id", "s_suppkey as k", "s_acctbal / 100 as z")
    return network.profile(network.smoothed(s)).select("id", F.round("gain", 6).alias("gain"), F.round("loss", 6).alias("loss"))


def _parents_sql(leaders: int, by_direction: int, count: int, apart: float) -> str:
    out = f"WITH p AS (SELECT vec_id AS id, x, y, x AS score, y - x / 2 AS directional FROM ({POINT_SQL})), c{leaders} AS (SELECT id, x, y, row_number() OVER (ORDER BY score DESC, id)::INT AS place FROM p ORDER BY score DESC, id LIMIT {leaders})"
    for i in range(leaders + 1, count + 1):
        d = "min((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))"
        order = "p.directional" if i <= by_direction else d
        out += f", b{i} AS (SELECT p.id, p.x, p.y, {i}::INT AS place FROM p, c{i - 1} c WHERE p.id NOT IN (SELECT id FROM c{i - 1}) GROUP BY p.id, p.x, p.y, p.directional HAVING {d} >= {apart**2} ORDER BY {order} DESC, p.id LIMIT 1), c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT * FROM b{i})"
    return out + f" SELECT place, id FROM c{count}"


@query("directional_parents", _parents_sql(3, 6, 8, 400.0))
def directional_parents(spark, sf_dir):
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y", F.col("x").alias("score"), (F.col("y") - F.col("x") / 2).alias("directional"))
    return evaluation.parents(p, 8)


@query("eligible_candidates", "SELECT s_suppkey AS id, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def eligible_candidates(spark, sf_dir):
    screened = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), "connected").otherwise("no connection").alias("status"))
    return network.eligible(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey"), screened)


_EASE = lambda t, s: f"CASE WHEN {t} < 0.1 THEN 1.0 WHEN {t} < 0.4 THEN 0.6 ELSE 0.25 END * CASE WHEN {s} > 0.3 THEN 0.75 ELSE 1.0 END"


@query(
    "unknown_cover_bounds",
    f"WITH v AS (SELECT *, tree IS NULL OR shrub IS NULL AS u FROM ({SEEN})) SELECT id, round(sum(CASE WHEN u THEN {_EASE('1.0', '0.6')} ELSE {_EASE('tree', 'shrub')} END) * 1e-2, 6)::DOUBLE AS dense, round(sum(CASE WHEN u THEN {_EASE('0.0', '0.3')} ELSE {_EASE('tree', 'shrub')} END) * 1e-2, 6)::DOUBLE AS open, round(avg(u::INT), 8) AS unknown_share FROM v GROUP BY id",
)
def unknown_cover_bounds(spark, sf_dir):
    v = _seen(spark, sf_dir).withColumn("herb", F.lit(0.1))
    out = evaluation.cover_bounds(v, "id", scoring.searchability(F.col("tree"), F.col("shrub")), F.col("tree").isNull() | F.col("shrub").isNull(), 1e-2)
    return out.select("id", F.round("dense", 6).alias("dense"), F.round("open", 6).alias("open"), F.round("unknown_share", 8).alias("unknown_share"))


PLACE = "c_custkey AS id, (c_custkey * 37 % 4800) / 100.0 - 126 AS lon, (c_custkey * 91 % 4000) / 100.0 + 10 AS lat"


@query("projected_there_and_back", f"SELECT id, round(lon, 8)::DOUBLE AS lon, round(lat, 8)::DOUBLE AS lat FROM (SELECT {PLACE} FROM customer)")
def projected_there_and_back(spark, sf_dir):
    """Every place through its zone's projection and back: the SQL is the place itself."""
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "(c_custkey * 37 % 4800) / 100.0D - 126 as lon", "(c_custkey * 91 % 4000) / 100.0D + 10 as lat")
    zone = geo.utm_zone(F.col("lon"))
    e, n = geo.utm(F.col("lon"), F.col("lat"), zone)
    flat = p.select("id", zone.alias("zone"), e.alias("e"), n.alias("n"))
    lon, lat = geo.lonlat(F.col("e"), F.col("n"), F.col("zone"))
    return flat.select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query(
    "kml_polygons",
    """WITH v AS (SELECT s_nationkey AS id, s_suppkey % 3 AS ring, s_suppkey AS k, (-105 - s_suppkey % 50 / 64.0)::DOUBLE AS lon, (38 + s_suppkey % 70 / 128.0)::DOUBLE AS lat FROM supplier), r AS (SELECT id, ring, CASE WHEN ring = 0 THEN 'outerBoundaryIs' ELSE 'innerBoundaryIs' END AS side, string_agg(printf('%.7f,%.7f,0', lon, lat), ' ' ORDER BY k) AS t FROM v GROUP BY ALL)
    SELECT id, '<Polygon>' || string_agg('<' || side || '><LinearRing><coordinates>' || t || '</coordinates></LinearRing></' || side || '>', '' ORDER BY ring) || '</Polygon>' AS kml FROM r GROUP BY id""",
)
def kml_polygons(spark, sf_dir):
    v = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as id", "s_suppkey % 3 as ring", "s_suppkey as k", "-105 - s_suppkey % 50 / 64.0D as lon", "38 + s_suppkey % 70 / 128.0D as lat")
    return vectors.to_kml_polygon(v, "id")


@query("chosen_patches", f"WITH RECURSIVE {KNAPSACK_SQL} SELECT grp, round(m.v, 6) AS score, m.p[2:] AS patches, m.u * 0.25::DOUBLE AS minutes FROM z")
def chosen_patches(spark, sf_dir):
    """The patches behind `patch_knapsack`'s scores; held against exhaustive search in the tests."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("grp"), F.col("p_partkey").alias("patch"), ((F.col("p_partkey") % 9 + 1) / 100).alias("full_km2"), (F.round(F.col("p_retailprice")) / 1000).alias("reward"))
    return attention.chosen(p, "grp", 10.0).select("grp", F.round("score", 6).alias("score"), F.array_join("patches", ",").alias("patches"), "minutes")


@query(
    "point_classes_in_feet",
    "WITH q AS (SELECT (event_id * 37 % 4000) / 2.0 * 0.3048 AS x, (event_id * 91 % 3000) / 2.0 * 0.3048 AS y, (event_id % 20)::INT AS class, event_id % 23 = 0 AS withheld FROM events), o(id, ox, oy) AS (VALUES (1, 300.03, 300.0), (2, 500.03, 400.0)) SELECT id, class, count(*) AS n FROM q, o WHERE class NOT IN (7, 18) AND NOT withheld AND (x - ox) * (x - ox) + (y - oy) * (y - oy) <= 8100 GROUP BY ALL",
)
def point_classes_in_feet(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr("(event_id * 37 % 4000) / 2.0D as x", "(event_id * 91 % 3000) / 2.0D as y", "1D as z", "cast(event_id % 20 as int) as class", "event_id % 23 = 0 as withheld")
    o = spark.createDataFrame([(1, 300.03, 300.0), (2, 500.03, 400.0)], "id int, ox double, oy double")
    return points.class_counts(points.cropped(r, o, 90.0, unit=geo.FOOT, height_unit=geo.FOOT))


@query(
    "web_tiles",
    f"""WITH p AS (SELECT {PLACE}, c_acctbal AS value FROM customer), g AS (SELECT floor((lon + 180) / 360 * 64 * 256)::BIGINT AS gx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 64 * 256)::BIGINT AS gy, value FROM p), m AS (SELECT gx, gy, max(value) AS value FROM g GROUP BY ALL)
    SELECT 6 AS z, (gx // 256)::INT AS x, (gy // 256)::INT AS y, count(*) AS n, string_agg((gy % 256) || ':' || (gx % 256) || ':' || round(value)::BIGINT, ' ' ORDER BY gy, gx) AS pixels FROM m GROUP BY ALL""",
)
def web_tiles(spark, sf_dir):
    p = table(spark, sf_dir, "customer").selectExpr("(c_custkey * 37 % 4800) / 100.0D - 126 as lon", "(c_custkey * 91 % 4000) / 100.0D + 10 as lat", "c_acctbal as value")
    text = F.transform("pixels", lambda v: F.concat_ws(":", v["py"].cast("string"), v["px"].cast("string"), F.round(v["value"]).cast("long").cast("string")))
    return sinks.tile_table(p, 6).select("z", "x", "y", "n", F.array_join(text, " ").alias("pixels"))
