"""The registered queries over the terrain and selection operators, each beside the SQL that checks it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, scoring, terrain
from .operators import attention, coverage, evaluation, filters, habitat, network, points, ranking, search, visibility
from .plans import candidates, catalog
from .sources import terrain as grids
from .streaming import rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The ground of the queries: a cell for each order, COLS to a row.
COLS, RES = 50, 10.0


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, price): the orders, laid out as a grid that grows by rows."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(k / COLS).cast("int").alias("r"), (k % COLS).cast("int").alias("c"), F.col("o_totalprice").alias("price"))


def _hills(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _cells(spark, sf_dir)
    return g.select("r", "c", (2500 + 60 * F.sin(F.col("c") / 8) * F.cos(F.col("r") / 13) + F.col("price") / 100000).alias("z"))


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _cells(spark, sf_dir)
    return g.select("r", "c", (2100 + 80 * F.sin(F.col("c") / 18) + 50 * F.cos(F.col("r") / 22) + F.col("price") / 200000).alias("z"))


# the same in SQL
CELLS = f"cells AS (SELECT (o_orderkey // {COLS})::INT AS r, (o_orderkey % {COLS})::INT AS c, o_totalprice AS price FROM orders)"
HILLS = f"{CELLS}, hills AS (SELECT r, c, 2500 + 60 * sin(c / 8) * cos(r / 13) + price / 100000 AS z FROM cells)"
ROLLING = f"{CELLS}, rolling AS (SELECT r, c, 2100 + 80 * sin(c / 18) + 50 * cos(r / 22) + price / 200000 AS z FROM cells)"
#: Rows and columns of the ground in SQL.
DOWN, ACROSS = "(SELECT max(r) + 1 FROM cells)", str(COLS)
COVER = lambda src: f"""cover AS (SELECT *, CASE WHEN (r * 131 + c * 17) % 37 = 0 THEN NULL ELSE ((r * 7 + c * 3) % 100) / 100.0::DOUBLE END AS tree,
    CASE WHEN (r * 131 + c * 17) % 41 = 0 THEN NULL ELSE ((r * 5 + c * 11) % 60) / 100.0::DOUBLE END AS shrub, ((r + c * 2) % 50) / 100.0::DOUBLE AS herb FROM {src})"""  # noqa: E731


def GRADIENT(src: str, value: str = "z", res: float = RES, out: str = "graded") -> str:
    part = lambda line, step: (
        f"(coalesce(lead({value}) OVER (PARTITION BY {line} ORDER BY {step}), {value}) - coalesce(lag({value}) OVER (PARTITION BY {line} ORDER BY {step}), {value})) / "
        f"(CASE WHEN lead({value}) OVER (PARTITION BY {line} ORDER BY {step}) IS NULL OR lag({value}) OVER (PARTITION BY {line} ORDER BY {step}) IS NULL THEN 1 ELSE 2 END * {res})"
    )
    return f"{out} AS (SELECT *, {part('r', 'c')} AS gx, {part('c', 'r')} AS gy FROM {src})"


@query(
    "terrain_slope_aspect",
    f"""WITH {HILLS}, {GRADIENT('hills')}
    SELECT r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope,
        round(CASE WHEN sqrt(gx * gx + gy * gy) >= 1e-9 THEN (degrees(atan2(-gx, gy)) + 360) - 360 * floor((degrees(atan2(-gx, gy)) + 360) / 360) END, 6) AS aspect FROM graded""",
)
def terrain_slope_aspect(spark, sf_dir):
    g = terrain.gradient(_hills(spark, sf_dir), "z", RES)
    return g.select("r", "c", F.round(terrain.slope_of(F.col("gx"), F.col("gy")), 6).alias("slope"), F.round(terrain.aspect_of(F.col("gx"), F.col("gy")), 6).alias("aspect"))


def _taps_sql(src: str, value: str, taps, out: str) -> str:
    values = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in taps)
    at = lambda x, n: f"(({x}) % (2 * {n}) + 2 * {n}) % (2 * {n})"
    mirror = lambda x, n: f"(CASE WHEN {at(x, n)} >= {n} THEN 2 * {n} - 1 - {at(x, n)} ELSE {at(x, n)} END)::INT"
    return f"""{out}_t(o, w) AS (VALUES {values}),
    {out}_a AS (SELECT a.r, a.c, t.w, {mirror('a.c + t.o', ACROSS)} AS q FROM {src} a, {out}_t t), {out}_h AS (SELECT a.r, a.c, sum(b.{value} * a.w) AS v FROM {out}_a a JOIN {src} b ON b.r = a.r AND b.c = a.q GROUP BY ALL),
    {out}_b AS (SELECT a.r, a.c, t.w, {mirror('a.r + t.o', 'd.n')} AS q FROM {out}_h a, {out}_t t, (SELECT max(r) + 1 AS n FROM cells) d), {out} AS (SELECT a.r, a.c, sum(b.v * a.w) AS v FROM {out}_b a JOIN {out}_h b ON b.c = a.c AND b.r = a.q GROUP BY ALL)"""


@query(
    "landform_flags",
    f"""WITH {ROLLING}, {_taps_sql('rolling', 'z', terrain.gaussian_taps(3), 'smooth')}, {_taps_sql('smooth', 'v', terrain.box_taps(16), 'mean')},
    {GRADIENT('smooth', 'v', 30.0, 'g1')}, sl AS (SELECT r, c, v, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM g1), {GRADIENT('sl', 'slope', 30.0, 'g2')},
    b AS (SELECT g2.r, g2.c, slope, g2.v - mean.v AS tpi, sqrt(gx * gx + gy * gy) AS bend FROM g2 JOIN mean USING (r, c)), ok AS (SELECT *, (r * 3 + c) % 7 <> 0 AS ok FROM b), q AS (SELECT quantile_cont(bend, 0.6) AS sharp FROM ok WHERE ok)
    SELECT r, c, round(slope, 5) AS slope, round(tpi, 5) AS tpi, round(bend, 5) AS bend, ok AND slope < 12 AND tpi > -10 AS bench, ok AND tpi > 5 AND slope >= 8 AND slope < 30 AS shoulder, ok AND tpi > 8 AND bend > sharp AS ridge FROM ok, q""",
)
def landform_flags(spark, sf_dir):
    g = _rolling(spark, sf_dir)
    g = terrain.landforms(g, 30.0, g.where("(r * 3 + c) % 7 <> 0"))
    return g.select("r", "c", *(F.round(v, 5).alias(v) for v in ("slope", "tpi", "bend")), "bench", "shoulder", "ridge")


SUN = {k: (math.sin(math.radians(a)) * math.cos(math.radians(e)), math.cos(math.radians(a)) * math.cos(math.radians(e)), math.sin(math.radians(e))) for k, (a, e) in scoring.SUNS.items()}


@query(
    "scoring_factors",
    f"""WITH {HILLS}, {COVER('hills')}, {GRADIENT('cover')}, v AS (SELECT *, (25 - c) * {RES}::DOUBLE AS dx, (r - 25) * {RES}::DOUBLE AS dy, 40.0 + (r + c) / 10.0 AS dz FROM graded),
    w AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM v)
    SELECT r, c, round(0.25 + 0.75 * (0.6 * CASE WHEN (r + c) % 3 = 0 THEN 1 ELSE 0 END + 0.4 * CASE WHEN shrub IS NULL THEN NULL ELSE least(greatest((0.5 * shrub + 0.5 * herb) / 0.6, 0), 1) END), 6) AS habitat,
        round((CASE WHEN tree < 0.1 THEN 1.0 WHEN tree < 0.4 THEN 0.6 ELSE 0.25 END) * (CASE WHEN shrub > 0.3 THEN 0.75 ELSE 1 END)::DOUBLE, 6) AS searchability,
        round(CASE WHEN d <= 500 THEN 1 + d * (0.95 - 1) / 500 WHEN d <= 1000 THEN 0.95 + (d - 500) * (0.7 - 0.95) / 500 WHEN d <= 2000 THEN 0.7 + (d - 1000) * (0.25 - 0.7) / 1000 ELSE 0.25 END, 6) AS distance,
        round(0.3 + 0.7 * least(greatest((-gx * dx - gy * dy + dz) / greatest(len * sqrt(gx * gx + gy * gy + 1), 1e-9), 0), 1), 6) AS perspective,
        round((0.5 + 0.5 * least(greatest((-gx * {SUN['morning'][0]!r} - gy * {SUN['morning'][1]!r} + {SUN['morning'][2]!r}) / sqrt(1 + gx * gx + gy * gy), 0), 1))
            * (1 - 0.5 * least(greatest(1 - degrees(acos(least(greatest((dx * {SUN['morning'][0]!r} + dy * {SUN['morning'][1]!r} + dz * {SUN['morning'][2]!r}) / greatest(len, 1e-9), -1), 1))) / 25, 0), 1)), 6) AS light,
        round(least(1.0, 30 * 0.02 / greatest(d / 1000, 1e-12)), 6) AS inspection FROM w""",
)
def scoring_factors(spark, sf_dir):
    g = terrain.gradient(grids.with_cover(_hills(spark, sf_dir)), "z", RES)
    g = g.withColumn("dx", (25 - F.col("c")) * RES).withColumn("dy", (F.col("r") - 25) * RES).withColumn("dz", 40.0 + (F.col("r") + F.col("c")) / 10.0)
    d = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    gx, gy, dx, dy, dz = (F.col(k) for k in ("gx", "gy", "dx", "dy", "dz"))
    out = {
        "habitat": scoring.range_score((F.col("r") + F.col("c")) % 3 == 0, F.col("shrub"), F.col("herb")),
        "searchability": scoring.searchability(F.col("tree"), F.col("shrub")),
        "distance": scoring.distance_response(d),
        "perspective": scoring.perspective(gx, gy, dx, dy, dz),
        "light": scoring.sunlight(gx, gy, dx, dy, dz, "morning"),
        "inspection": scoring.inspection_fraction(d / 1000, 30, 0.02),
    }
    return g.select("r", "c", *(F.round(v, 6).alias(k) for k, v in out.items()))


@query(
    "target_criteria_unknown",
    f"""WITH {HILLS}, {COVER('hills')}, {GRADIENT('cover')}, p AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope,
        CASE WHEN sqrt(gx * gx + gy * gy) >= 1e-9 THEN (degrees(atan2(-gx, gy)) + 360) - 360 * floor((degrees(atan2(-gx, gy)) + 360) / 360) END AS aspect FROM graded),
    q AS (SELECT *, floor(((aspect + 22.5) - 360 * floor((aspect + 22.5) / 360)) / 45) AS oct FROM p)
    SELECT r, c, coalesce(z BETWEEN 2400 AND 2650, false) AND coalesce(slope BETWEEN 2 AND 20, false) AND coalesce(tree BETWEEN 0 AND 1 AND tree * 100 BETWEEN 10 AND 60, false)
        AND coalesce(shrub BETWEEN 0 AND 1 AND shrub * 100 BETWEEN 5 AND 45, false) AND coalesce(oct IN (0, 1, 2, 3, 7), false) AS matching,
        tree IS NULL OR shrub IS NULL OR aspect IS NULL AS unknown FROM q""",
)
def target_criteria_unknown(spark, sf_dir):
    g = terrain.gradient(grids.with_cover(_hills(spark, sf_dir)), "z", RES)
    g = g.withColumn("slope", terrain.slope_of(F.col("gx"), F.col("gy"))).withColumn("aspect", terrain.aspect_of(F.col("gx"), F.col("gy")))
    return filters.criteria(g, {"z": (2400, 2650), "slope": (2, 20), "tree": (10, 60), "shrub": (5, 45)}, [0, 1, 2, 3, 7])


DISK30 = terrain.disk(30, RES)


@query(
    "standing_eligibility",
    f"""WITH {HILLS}, {COVER('hills')}, o(a, b) AS (VALUES {', '.join(map(str, DISK30))}),
    s AS (SELECT x.r, x.c, count(y.tree) AS n, coalesce(sum(y.tree), 0) AS total FROM cover x CROSS JOIN o LEFT JOIN cover y ON y.r = x.r + a AND y.c = x.c + b GROUP BY ALL)
    SELECT r, c, n / {len(DISK30)} >= 0.8 AND total / greatest(n, 1) < 0.5 - 1e-7 AS eligible FROM s""",
)
def standing_eligibility(spark, sf_dir):
    return filters.standing(grids.with_cover(_hills(spark, sf_dir)), 30, RES, 50)


RING = [(50, 50), (420, 100), (390, 1900), (250, 200), (90, 2400)]
HOLE = [(120, 110), (120, 160), (180, 160), (180, 110)]
EDGES = [(0, float(a), float(b), float(c), float(d)) for ring in (RING, HOLE) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])]
EDGE_SQL = f"e(poly, ax, ay, bx, by_) AS (VALUES {', '.join(f'({p}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)' for p, a, b, c, d in EDGES)})"


@query(
    "polygon_mask",
    f"""WITH {HILLS}, {EDGE_SQL}, p AS (SELECT r, c, (c + 0.5) * {RES}::DOUBLE AS px, (r + 0.5) * {RES}::DOUBLE AS py FROM hills)
    SELECT r, c FROM p, e WHERE (ay > py) <> (by_ > py) AND px < (bx - ax) * (py - ay) / (by_ - ay) + ax GROUP BY r, c HAVING count(*) % 2 = 1""",
)
def polygon_mask(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "poly int, ax double, ay double, bx double, by double")
    p = _cells(spark, sf_dir).select("r", "c", ((F.col("c") + 0.5) * RES).alias("px"), ((F.col("r") + 0.5) * RES).alias("py"))
    return filters.polygon_mask(p, edges, 100.0).select("r", "c")


RRES, RADIUS = 10.0, 80.0
#: A seat for each supplier, down the whole grid.
SEAT_SQL = "s AS (SELECT s_suppkey AS id, (s_suppkey * 3 + 1)::INT AS r0, (9 + s_suppkey * 7 % 32)::INT AS c0 FROM supplier)"
DROP = 6 / 7 / (2 * 6378137.0)
def visible_sql(grid: str, seats: str, res: float, radius: float, down: str, across: str, n: str = "") -> str:
    """`clear`: the clearance of every ray of seats (id, r0, c0) within the radius over a grid (r, c, z), sample by sample; n tells the names of two such apart."""
    return f"""p{n} AS (SELECT s.*, g.r, g.c, g.z AS z1, o.z AS z0, sqrt((g.r - r0) * (g.r - r0) + (g.c - c0) * (g.c - c0)) AS far FROM {seats} s JOIN {grid} o ON o.r = r0 AND o.c = c0 JOIN {grid} g ON abs(g.r - r0) <= {int(radius / res)} AND abs(g.c - c0) <= {int(radius / res)}),
    q{n} AS (SELECT *, far * {res} AS d, greatest(3, floor(far * 4)::INT) AS steps FROM p{n} WHERE far * {res} <= {radius}),
    i{n} AS (SELECT *, unnest(range(1, steps)) AS i FROM q{n} WHERE d > 0), t{n} AS (SELECT *, i / steps AS t, r0 + i / steps * (r - r0) AS pr, c0 + i / steps * (c - c0) AS pc FROM i{n}),
    k{n} AS (SELECT t.*, floor(pr)::INT AS fr, floor(pc)::INT AS fc FROM t{n} t),
    h{n} AS (SELECT k.*, (1 - (pr - fr)) * ((1 - (pc - fc)) * a.z + (pc - fc) * b.z) + (pr - fr) * ((1 - (pc - fc)) * e.z + (pc - fc) * f.z) AS z
        FROM k{n} k JOIN {grid} a ON a.r = fr AND a.c = fc JOIN {grid} b ON b.r = fr AND b.c = least(fc + 1, {across} - 1) JOIN {grid} e ON e.r = least(fr + 1, {down} - 1) AND e.c = fc JOIN {grid} f ON f.r = least(fr + 1, {down} - 1) AND f.c = least(fc + 1, {across} - 1)),
    clear{n} AS (SELECT id, r0, c0, r, c, d, min((z0 + 1.7) * (1 - t) + (z1 + 0.8 - {DROP!r} * d * d) * t + {DROP!r} * (t * d) * (t * d) - z) AS clearance FROM h{n} GROUP BY ALL
        UNION ALL SELECT id, r0, c0, r, c, d, NULL FROM q{n} WHERE d = 0)"""


VISIBLE_SQL = f"{ROLLING}, {SEAT_SQL}, {visible_sql('rolling', 's', RRES, RADIUS, DOWN, ACROSS)}"


def _seats(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 3 + 1).cast("int").alias("r0"), (9 + k * 7 % 32).cast("int").alias("c0"))


def _rows(grid: DataFrame) -> int:
    return grid.agg(F.max("r")).first()[0] + 1


@query("ray_clearance", f"WITH {VISIBLE_SQL} SELECT id, r, c, round(d, 6) AS d, round(clearance, 5) AS clearance FROM clear")
def ray_clearance(spark, sf_dir):
    g = _rolling(spark, sf_dir)
    pairs = visibility.targets_within(_seats(spark, sf_dir), g.select("r", "c"), RADIUS, RRES).drop("d")
    out = visibility.rays(pairs, g, _rows(g), COLS, RRES, 1.7, 0.8)
    return out.select("id", "r", "c", F.round("d", 6).alias("d"), F.round("clearance", 5).alias("clearance"))


AREA_SQL = f"WITH {VISIBLE_SQL} SELECT id, round(count(*) * {RRES * RRES / 1e6!r}::DOUBLE, 9) AS area_km2, round(count(*) * {RRES * RRES / 1e6!r}::DOUBLE, 9) AS band_1km, 0.0::DOUBLE AS band_2km, 0.0::DOUBLE AS band_3km, row_number() OVER (ORDER BY count(*) DESC, id) AS rank FROM clear WHERE clearance >= 0 OR clearance IS NULL GROUP BY id"


@query("viewshed_rank", AREA_SQL.replace("row_number()", "CAST(row_number()").replace(" AS rank", " AS INT) AS rank"))
def viewshed_rank(spark, sf_dir):
    """Candidates ranked by visible area, viewsheds computed per candidate over the tiles of its window."""
    seen = visibility.viewsheds(_seats(spark, sf_dir), _rolling(spark, sf_dir), RADIUS, RRES, 1.7, 0.8)
    out = ranking.dense_rank_by(visibility.banded(seen, RRES), "area_km2", "id")
    return out.select("id", *(F.round(v, 9).alias(v) for v in ("area_km2", "band_1km", "band_2km", "band_3km")), "rank")


RADII = [30.0, 55.0, RADIUS]
HALO_SEAT_SQL = f"s AS (SELECT s_suppkey AS id, (8 + s_suppkey * 3 % ({DOWN} - 16))::INT AS r0, (9 + s_suppkey * 7 % 32)::INT AS c0 FROM supplier)"


@query(
    "viewshed_radii",
    f"WITH {VISIBLE_SQL.replace(SEAT_SQL, HALO_SEAT_SQL)} SELECT id, radius, round(count(*) FILTER (d <= radius) * {RRES * RRES / 1e6!r}::DOUBLE, 9) AS area_km2 FROM clear, (VALUES {', '.join(f'({x}::DOUBLE)' for x in RADII)}) a(radius) WHERE clearance >= 0 OR clearance IS NULL GROUP BY id, radius",
)
def viewshed_radii(spark, sf_dir):
    """Visible areas within three radii from one sweep, for seats that have the whole of the largest around them."""
    g = _rolling(spark, sf_dir)
    seats = _seats(spark, sf_dir).withColumn("r0", (8 + F.col("id") * 3 % (_rows(g) - 16)).cast("int"))
    return visibility.by_radius(visibility.viewsheds(seats, g, RADIUS, RRES, 1.7, 0.8, halo=True), RADII, RRES).withColumn("area_km2", F.round("area_km2", 9))


@query(
    "canopy_rays",
    f"""WITH {ROLLING}, {COVER('rolling')}, {SEAT_SQL}, p AS (SELECT s.*, g.r, g.c, g.z AS z1, o.z AS z0, sqrt((g.r - r0) * (g.r - r0) + (g.c - c0) * (g.c - c0)) * {RRES} AS d FROM s JOIN cover o ON o.r = r0 AND o.c = c0 JOIN cover g ON abs(g.r - r0) <= 8 AND abs(g.c - c0) <= 8),
    q AS (SELECT *, greatest(3, floor(d / 5)::INT) AS steps FROM p WHERE d <= {RADIUS} AND d > 0), i AS (SELECT *, unnest(range(1, steps)) AS i FROM q), t AS (SELECT *, i / steps AS t, r0 + i / steps * (r - r0) AS pr, c0 + i / steps * (c - c0) AS pc FROM i),
    k AS (SELECT t.*, floor(pr)::INT AS fr, floor(pc)::INT AS fc, round_even(pr, 0)::INT AS nr, round_even(pc, 0)::INT AS nc FROM t),
    h AS (SELECT k.*, n.tree, (1 - (pr - fr)) * ((1 - (pc - fc)) * a.z + (pc - fc) * b.z) + (pr - fr) * ((1 - (pc - fc)) * e.z + (pc - fc) * f.z) AS z,
        (z0 + 1.7) * (1 - t) + (z1 + 0.8 - {DROP!r} * d * d) * t + {DROP!r} * (t * d) * (t * d) AS line
        FROM k JOIN cover n ON n.r = nr AND n.c = nc JOIN cover a ON a.r = fr AND a.c = fc JOIN cover b ON b.r = fr AND b.c = least(fc + 1, {ACROSS} - 1) JOIN cover e ON e.r = least(fr + 1, {DOWN} - 1) AND e.c = fc JOIN cover f ON f.r = least(fr + 1, {DOWN} - 1) AND f.c = least(fc + 1, {ACROSS} - 1))
    SELECT id, r, c, bool_or(coalesce(tree >= 0.2 AND z + 15 > line, false) AND t * d > 30 AND (1 - t) * d > 30) AS blocked, bool_or(coalesce(tree >= 0.2 AND z + 15 > line, false) AND t * d <= 30) AS foreground, bool_or(tree IS NULL) AS unknown FROM h GROUP BY id, r, c""",
)
def canopy_rays(spark, sf_dir):
    g = grids.with_cover(_rolling(spark, sf_dir))
    pairs = visibility.targets_within(_seats(spark, sf_dir), g.select("r", "c"), RADIUS, RRES).drop("d")
    return visibility.cover_rays(pairs, g, _rows(g), COLS, RRES, 1.7, 0.8, 15.0)


POINT_SQL = "SELECT vec_id, label, embedding[1]::DOUBLE * 10000 AS x, embedding[2]::DOUBLE * 10000 AS y FROM embeddings"


def _points(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 10000
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e(0).alias("x"), e(1).alias("y"))


@query(
    "polar_patches",
    f"""WITH p AS ({POINT_SQL}), q AS (SELECT label, least(floor((degrees(atan2(x, y)) - 360 * floor(degrees(atan2(x, y)) / 360)) / 30), 11) AS s, least(floor(sqrt(x * x + y * y) / 500), 3) AS g, x FROM p),
    f AS (SELECT label, (g * 12 + s)::INT AS patch, count(*) * 0.0001 AS visible_km2, sum(abs(x)) * 0.0001 AS reward FROM q GROUP BY ALL), e AS (SELECT DISTINCT label, unnest(range(48))::INT AS patch FROM p)
    SELECT e.label, e.patch, round(radians(30) * (power((e.patch // 12) * 500.0 + 500, 2) - power((e.patch // 12) * 500.0, 2)) / 2 / 1e6, 6) AS full_km2, round(coalesce(visible_km2, 0), 6)::DOUBLE AS visible_km2, round(coalesce(reward, 0), 4) AS reward FROM e LEFT JOIN f ON e.label = f.label AND e.patch = f.patch""",
)
def polar_patches(spark, sf_dir):
    p = _points(spark, sf_dir).select("label", F.col("x").alias("dx"), F.col("y").alias("dy"), F.abs("x").alias("reward"))
    out = attention.polar_patches(p, "label", 30, 500, 2000, 1e-4)
    return out.select("label", "patch", F.round("full_km2", 6).alias("full_km2"), F.round("visible_km2", 6).alias("visible_km2"), F.round("reward", 4).alias("reward"))


#: The fold over a group's patches, one a step: best rewards, minutes used and patches by units of time.
KNAPSACK_SQL = """i AS MATERIALIZED (SELECT p_size AS grp, p_partkey AS patch, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n, greatest(1, ceil(((p_partkey % 9 + 1) / 100.0::DOUBLE / 0.02::DOUBLE + 0.5::DOUBLE) / 0.25::DOUBLE - 1e-9))::INT AS u, round(p_retailprice) / 1000 AS v FROM part),
    w(grp, n, best) AS (SELECT DISTINCT grp, 0::BIGINT, list_transform(range(41), lambda t: {'v': 0.0::DOUBLE, 'u': 0::INT, 'p': ''}) FROM i
        UNION ALL SELECT w.grp, i.n, list_transform(range(1, 42), lambda t: CASE WHEN t > i.u AND w.best[t - i.u].v + i.v > w.best[t].v + 1e-14 THEN {'v': w.best[t - i.u].v + i.v, 'u': w.best[t - i.u].u + i.u, 'p': w.best[t - i.u].p || ',' || i.patch} ELSE w.best[t] END) FROM w JOIN i ON i.grp = w.grp AND i.n = w.n + 1),
    z AS (SELECT grp, arg_max(best, n)[41] AS m FROM w GROUP BY grp)"""


@query("patch_knapsack", f"WITH RECURSIVE {KNAPSACK_SQL} SELECT grp, round(m.v, 6) AS score FROM z")
def patch_knapsack(spark, sf_dir):
    """Best patches in a time budget, a group for each size of part; held against exhaustive search in the tests too."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("grp"), F.col("p_partkey").alias("patch"), ((F.col("p_partkey") % 9 + 1) / 100).alias("full_km2"), (F.round(F.col("p_retailprice")) / 1000).alias("reward"))
    return attention.knapsack(p, "grp", 10.0).select("grp", F.round("score", 6).alias("score"))


SALES = "SELECT l_suppkey AS id, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS quantity, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY 1"


def _sales(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query(
    "candidate_rank",
    f"""WITH s AS ({SALES}), j AS (SELECT s.id, n_regionkey AS grp, round(revenue, 2) AS score FROM s JOIN supplier ON s.id = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
    SELECT id, grp, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS INT) AS group_rank FROM j""",
)
def candidate_rank(spark, sf_dir):
    j = _sales(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("id") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    j = j.select("id", F.col("n_regionkey").alias("grp"), F.round("revenue", 2).alias("score"))
    return ranking.dense_rank_by(ranking.dense_rank_by(j, "score", "id"), "score", "id", "grp", out="group_rank")


@query(
    "group_leaders",
    f"""WITH s AS ({SALES}), j AS (SELECT s.id, s_nationkey AS grp, round(revenue, 2) AS score FROM s JOIN supplier ON s.id = s_suppkey), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS INT) AS rank FROM j) SELECT * FROM r WHERE rank <= 3""",
)
def group_leaders(spark, sf_dir):
    j = _sales(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("id") == F.col("s_suppkey")).select("id", F.col("s_nationkey").alias("grp"), F.round("revenue", 2).alias("score"))
    return ranking.top_per_group(j, "grp", "score", "id", 3)


@query(
    "rank_agreement",
    f"""WITH s AS (SELECT id, round(revenue, 2) AS a, quantity AS b FROM ({SALES})), r AS (SELECT id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb,
        row_number() OVER (ORDER BY a DESC, id) <= 10 AS ta, row_number() OVER (ORDER BY b DESC, id) <= 10 AS tb FROM s) SELECT round(corr(ra, rb), 8) AS spearman, round(sum((ta AND tb)::INT) / 10, 8) AS top_overlap FROM r""",
)
def rank_agreement(spark, sf_dir):
    s = _sales(spark, sf_dir).select("id", F.round("revenue", 2).alias("a"), F.col("quantity").alias("b"))
    out = ranking.agreement(s, "a", "b", "id")
    return out.select(F.round("spearman", 8).alias("spearman"), F.round("top_overlap", 8).alias("top_overlap"))


@query(
    "wilson_rate",
    f"""WITH s AS ({SALES}), p AS (SELECT id, n, returned, returned / n AS p, 1 + 3.8416 / n AS den FROM s)
    SELECT id, round(greatest(0, (p + 3.8416 / (2 * n)) / den - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / den), 8) AS low, round(least(1, (p + 3.8416 / (2 * n)) / den + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / den), 8) AS high FROM p""",
)
def wilson_rate(spark, sf_dir):
    low, high = scoring.wilson(F.col("returned"), F.col("n"))
    return _sales(spark, sf_dir).select("id", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


MASKS = "SELECT DISTINCT s_nationkey AS id, l_partkey AS cell FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


def _masks(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("s_nationkey").alias("id"), F.col("l_partkey").alias("cell")).distinct()


@query(
    "pairwise_overlap",
    f"""WITH m AS ({MASKS}), n AS (SELECT id, count(*) AS n FROM m GROUP BY id), p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM m x JOIN m y ON x.cell = y.cell AND x.id < y.id GROUP BY ALL)
    SELECT a, b, shared, round(shared / (s.n + t.n - shared), 8) AS jaccard, round(shared / least(s.n, t.n), 8) AS of_smaller FROM p JOIN n s ON s.id = a JOIN n t ON t.id = b""",
)
def pairwise_overlap(spark, sf_dir):
    return coverage.overlaps(_masks(spark, sf_dir)).select("a", "b", "shared", F.round("jaccard", 8).alias("jaccard"), F.round("of_smaller", 8).alias("of_smaller"))


@query("coverage_counts", f"WITH m AS ({MASKS}), c AS (SELECT cell, count(*) AS n FROM m GROUP BY cell) SELECT count(*) AS union_cells, count(*) FILTER (n >= 2) AS shared_cells, count(*) FILTER (n = 1) AS unique_cells FROM c")
def coverage_counts(spark, sf_dir):
    return coverage.counts(_masks(spark, sf_dir))


def _greedy_sql(k: int) -> str:
    out = f"WITH m AS ({MASKS}), left0 AS (SELECT * FROM m)"
    for i in range(1, k + 1):
        out += f", pick{i} AS (SELECT id, count(*) AS gain FROM left{i - 1} GROUP BY id ORDER BY gain DESC, id LIMIT 1), left{i} AS (SELECT * FROM left{i - 1} WHERE cell NOT IN (SELECT cell FROM left{i - 1} JOIN pick{i} USING (id)))"
    return out + " " + " UNION ALL ".join(f"SELECT {i}::INT AS step, id, gain::DOUBLE AS gain FROM pick{i}" for i in range(1, k + 1))


@query("greedy_coverage", _greedy_sql(4))
def greedy_coverage(spark, sf_dir):
    m = _masks(spark, sf_dir)
    return coverage.greedy(m, m.select("id").distinct().withColumn("rank", F.col("id")), 4)


@query("marginal_coverage", f"WITH m AS ({MASKS}), f AS (SELECT cell, min(id) AS id FROM m GROUP BY cell), i AS (SELECT DISTINCT id FROM m) SELECT i.id, i.id::INT AS step, count(f.cell) AS gain FROM i LEFT JOIN f USING (id) GROUP BY ALL")
def marginal_coverage(spark, sf_dir):
    m = _masks(spark, sf_dir)
    return coverage.marginal(m, m.select("id").distinct().withColumn("step", F.col("id").cast("int")))


@query(
    "spread_topk",
    f"""WITH RECURSIVE p AS (SELECT vec_id, label, x, y, row_number() OVER (PARTITION BY label ORDER BY x DESC, vec_id) AS k FROM ({POINT_SQL})),
    w AS (SELECT label, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, NULL::BIGINT AS vec_id, 0 AS n FROM (SELECT DISTINCT label FROM p)
        UNION ALL SELECT w.label, p.k, CASE WHEN ok THEN list_append(kept, {{'x': p.x, 'y': p.y}}) ELSE kept END, CASE WHEN ok THEN p.vec_id END, n + ok::INT
        FROM w JOIN p ON p.label = w.label AND p.k = w.k + 1, LATERAL (SELECT len(list_filter(kept, lambda q: (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) < 640000)) = 0 AND n < 5 AS ok))
    SELECT label, vec_id, n::INT AS pick FROM w WHERE vec_id IS NOT NULL""",
)
def spread_topk(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("score", F.col("x"))
    return ranking.spread_by_group(p, "label", "score", "vec_id", 800.0, 5).select("label", "vec_id", "pick")


@query(
    "nearest_segment",
    f"""WITH p AS ({POINT_SQL}), s AS (SELECT vec_id AS seg, x AS ax, y AS ay, x + 300 AS bx, y + 200 AS by FROM p),
    d AS (SELECT vec_id, ax + t * 300 AS nx, ay + t * 200 AS ny, x, y FROM p, s, LATERAL (SELECT greatest(0, least(1, ((x - ax) * 300 + (y - ay) * 200) / 130000)) AS t)),
    b AS (SELECT vec_id, min(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny))) AS distance FROM d GROUP BY vec_id) SELECT p.vec_id AS id, round(CASE WHEN distance <= 400 THEN distance END, 4) AS distance FROM p JOIN b USING (vec_id)""",
)
def nearest_segment(spark, sf_dir):
    p = _points(spark, sf_dir)
    s = p.select(F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 300).alias("bx"), (F.col("y") + 200).alias("by"))
    return filters.nearest_segment(p.select(F.col("vec_id").alias("id"), "x", "y"), s, 500.0, 400.0).select("id", F.round("distance", 4).alias("distance"))


W_SUM = sum(habitat.WEIGHTS)


def _disk_sql(name: str, radius: float, cols: str) -> str:
    return f"{name}_o(da, de) AS (VALUES {', '.join(map(str, terrain.disk(radius, 30.0)))}), {name} AS (SELECT x.r, x.c, {cols} FROM pat x CROSS JOIN {name}_o LEFT JOIN pat y ON y.r = x.r + da AND y.c = x.c + de GROUP BY x.r, x.c)"


@query(
    "habitat_features",
    f"""WITH {ROLLING}, {COVER('rolling')}, k AS (SELECT r, c, tree IS NOT NULL AND shrub IS NOT NULL AS ok, CASE WHEN tree IS NOT NULL AND shrub IS NOT NULL THEN tree ELSE 0 END AS t, CASE WHEN tree IS NOT NULL AND shrub IS NOT NULL THEN shrub ELSE 0 END AS b FROM cover),
    fl AS (SELECT *, ok AND greatest(t, b) >= 0.35 AS cv, ok AND t <= 0.2 AND b >= 0.05 AS op FROM k), nb(a, e) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
    dg AS (SELECT x.r, x.c, any_value(x.ok) AS ok, any_value(x.t) AS t, any_value(x.b) AS b, any_value(x.cv) AS cv, any_value(x.op) AS op, sum(CASE WHEN y.cv THEN 1 ELSE 0 END) AS dc, sum(CASE WHEN y.op THEN 1 ELSE 0 END) AS dop FROM fl x CROSS JOIN nb LEFT JOIN fl y ON y.r = x.r + a AND y.c = x.c + e GROUP BY x.r, x.c),
    pat AS (SELECT x.r, x.c, any_value(x.ok) AS ok, any_value(x.t) AS t, any_value(x.b) AS b, any_value(x.cv) AND (any_value(x.dc) >= 2 OR bool_or(coalesce(y.cv AND y.dc >= 2, false))) AS cov, any_value(x.op) AND (any_value(x.dop) >= 2 OR bool_or(coalesce(y.op AND y.dop >= 2, false))) AS opn FROM dg x CROSS JOIN nb LEFT JOIN dg y ON y.r = x.r + a AND y.c = x.c + e GROUP BY x.r, x.c),
    {_disk_sql('nr', 90, 'sum(CASE WHEN y.ok THEN 1 ELSE 0 END) AS n, sum(CASE WHEN y.cov THEN 1 ELSE 0 END) AS cc, sum(CASE WHEN y.opn THEN 1 ELSE 0 END) AS oc')}, {_disk_sql('fr', 270, 'sum(CASE WHEN y.ok THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y.cov THEN 1 ELSE 0 END) AS fc')},
    v AS (SELECT pat.r, pat.c, t, b, least(oc / greatest(n, 1) / 0.3, 1) * least(cc / greatest(n, 1) / 0.3, 1) AS mixed, least(fc / greatest(fn, 1) / 0.3, 1) AS cover, ok AND n / {len(terrain.disk(90, 30.0))} >= 0.8 - 1e-9 AND fn / {len(terrain.disk(270, 30.0))} >= 0.8 - 1e-9 AS known FROM pat JOIN nr USING (r, c) JOIN fr USING (r, c))
    SELECT r, c, round(mixed, 6) AS mixed, round(cover, 6) AS cover, known, round(0.1 + 0.45 * (b / (b + 0.15)) + 0.25 * mixed + 0.2 * cover, 9) AS h, round((1 - 0.9 * t) * (1 - 0.65 * b), 9) AS g FROM v""",
)
def habitat_features(spark, sf_dir):
    f = habitat.evaluate(habitat.features(grids.with_cover(_rolling(spark, sf_dir)), 30.0, 90, 270))
    return f.select("r", "c", F.round("mixed", 6).alias("mixed"), F.round("cover", 6).alias("cover"), "known", F.round("h", 9).alias("h"), F.round("g", 9).alias("g"))


PART_CELLS = """SELECT l_suppkey AS id, l_quantity >= 10 AS visible, l_discount >= 0.03 AS matching, l_partkey % 7 <> 0 AND l_suppkey % 4 <> 1 AS known, l_tax * 10 AS h, 1 - l_discount AS g FROM lineitem"""


@query(
    "habitat_metrics",
    f"""WITH c AS ({PART_CELLS}) SELECT id, round(CASE WHEN count(*) FILTER (visible AND matching AND known) > 0 THEN sum(CASE WHEN visible AND matching AND known THEN h * g ELSE 0 END) * 900 END, 4) AS effective, count(*) FILTER (visible) * 900.0::DOUBLE AS visible, count(*) FILTER (visible AND matching) * 900.0::DOUBLE AS matching,
    count(*) FILTER (visible AND matching AND known) * 900.0::DOUBLE AS scorable, count(*) FILTER (visible AND matching AND NOT known) * 900.0::DOUBLE AS habitat_unknown, count(*) FILTER (visible AND matching AND known AND h >= 0.45) * 900.0::DOUBLE AS high_habitat,
    count(*) FILTER (visible AND matching AND known AND h >= 0.45 AND g >= 0.93) * 900.0::DOUBLE AS priority, round(avg(g) FILTER (visible AND matching AND known), 8) AS mean_g FROM c GROUP BY id""",
)
def habitat_metrics(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as id", "l_quantity >= 10 as visible", "l_discount >= 0.03 as matching", "l_partkey % 7 <> 0 and l_suppkey % 4 <> 1 as known", "l_tax * 10 as h", "1 - l_discount as g")
    m = habitat.metrics(c, "id", 900.0, 0.45, 0.93)
    return m.select("id", F.round("effective", 4).alias("effective"), "visible", "matching", "scorable", "habitat_unknown", "high_habitat", "priority", F.round("mean_g", 8).alias("mean_g"))


#: Ways along the cells' sides, in blocks of ten by ten cells that don't touch.
LINK_SQL = f"""{CELLS}, l AS (SELECT r * {COLS} + c AS record, c * 100.0::DOUBLE AS ax, r * 100.0::DOUBLE AS ay, (c + dx) * 100.0::DOUBLE AS bx, (r + 1 - dx) * 100.0::DOUBLE AS by_, r, c FROM cells, range(2) t(dx)
    WHERE (r * 7 + c * 5 + dx) % 4 <> 0 AND (c + dx) // 10 = c // 10 AND (r + 1 - dx) // 10 = r // 10 AND (r + 1 - dx) < {DOWN})"""


def _links(spark, sf_dir):
    g = _cells(spark, sf_dir)
    l = g.withColumn("dx", F.explode(F.array(F.lit(0), F.lit(1)))).where("(r * 7 + c * 5 + dx) % 4 <> 0 and (c + dx) div 10 = c div 10 and (r + 1 - dx) div 10 = r div 10").where(F.col("r") + 1 - F.col("dx") < _rows(g))
    return l.selectExpr(f"r * {COLS} + c as record", "c * 100D as ax", "r * 100D as ay", "(c + dx) * 100D as bx", "(r + 1 - dx) * 100D as by", "r % 3 > 0 as motor")


@query(
    "network_shortest_path",
    f"""WITH RECURSIVE {LINK_SQL}, e AS (SELECT printf('%.2f,%.2f', ax, ay) AS u, printf('%.2f,%.2f', bx, by_) AS v, 100.0 AS w FROM l UNION ALL SELECT printf('%.2f,%.2f', bx, by_), printf('%.2f,%.2f', ax, ay), 100.0 FROM l),
    d(node, hops) AS (SELECT DISTINCT printf('%.2f,%.2f', ax, ay), 0 FROM l WHERE c % 10 = 1 AND r % 10 = 1 UNION SELECT e.v, hops + 1 FROM d JOIN e ON e.u = d.node WHERE hops < 100) SELECT node, min(hops) * 100.0::DOUBLE AS distance FROM d GROUP BY node""",
)
def network_shortest_path(spark, sf_dir):
    l = _links(spark, sf_dir)
    starts = l.where("ax % 1000 = 100 and ay % 1000 = 100").select(F.format_string("%.2f,%.2f", "ax", "ay").alias("node")).distinct()
    return network.shortest(network.edges_of(l), starts, patch=search.written_squares(5000.0)).select("node", F.round("distance", 6).alias("distance"))


@query(
    "network_repairs",
    f"""WITH p AS ({POINT_SQL}), e AS (SELECT vec_id AS record, x, y, (7000 + label)::VARCHAR AS rid, 'Ridge-' || label || ' Road' AS name FROM p), v AS (SELECT record, x + 1.5 AS x, y + 2 AS y, CASE WHEN record % 2 = 0 THEN rid[2:] ELSE '' END AS rid, CASE WHEN record % 3 = 0 THEN upper(name[1:7]) || ' TRAIL' ELSE 'other' END AS name FROM e)
    SELECT e.record AS r1, v.record, round(sqrt((v.x - e.x) * (v.x - e.x) + (v.y - e.y) * (v.y - e.y)), 4) AS gap FROM e JOIN v ON e.record <> v.record AND abs(v.x - e.x) <= 60 AND abs(v.y - e.y) <= 60
    WHERE sqrt((v.x - e.x) * (v.x - e.x) + (v.y - e.y) * (v.y - e.y)) <= 60 AND ((v.rid <> '' AND v.rid = e.rid[2:]) OR (v.name = upper(e.name[1:7]) || ' TRAIL'))""",
)
def network_repairs(spark, sf_dir):
    e = _points(spark, sf_dir).select(F.col("vec_id").alias("record"), "x", "y", (F.col("label") + 7000).cast("string").alias("rid"), F.concat(F.lit("Ridge-"), F.col("label").cast("string"), F.lit(" Road")).alias("name"))
    v = e.select(
        "record", (F.col("x") + 1.5).alias("x"), (F.col("y") + 2).alias("y"), F.when(F.col("record") % 2 == 0, F.substring("rid", 2, 9)).otherwise("").alias("rid"), F.when(F.col("record") % 3 == 0, F.concat(F.upper(F.substring("name", 1, 7)), F.lit(" TRAIL"))).otherwise("other").alias("name")
    )
    return network.repairs(e, v, 60.0).select("r1", "record", F.round("gap", 4).alias("gap"))


#: Cells of a pattern, in 64 bits: squares of rows soon leave 32.
MARKED = "(bigint(r) * r * 3 + c * 7 + bigint(r) * c * 2) % 5 < 3"


@query(
    "component_sizes",
    f"""WITH RECURSIVE {CELLS}, m AS (SELECT r * {COLS} + c AS node, r // 10 AS br, c // 10 AS bc, r, c FROM cells WHERE (r * r * 3 + c * 7 + r * c * 2) % 5 < 3),
    e AS (SELECT a.node AS u, b.node AS v FROM m a JOIN m b ON a.br = b.br AND a.bc = b.bc AND abs(a.r - b.r) + abs(a.c - b.c) = 1), w AS (SELECT node, node AS label FROM m UNION SELECT e.v, w.label FROM w JOIN e ON e.u = w.node), l AS (SELECT node, min(label) AS label FROM w GROUP BY node)
    SELECT label::BIGINT AS label, count(*) AS n FROM l GROUP BY label""",
)
def component_sizes(spark, sf_dir):
    """Cells that hang together inside blocks of ten by ten."""
    m = _cells(spark, sf_dir).select("r", "c", F.expr("r div 10").alias("br"), F.expr("c div 10").alias("bc")).where(MARKED).withColumn("node", (F.col("r") * COLS + F.col("c")).cast("long"))
    steps = F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((1, 0), (0, 1))))
    e = m.select("br", "bc", F.col("node").alias("u"), F.explode(steps).alias("x")).select("br", "bc", "u", "x.r", "x.c").join(m.withColumnRenamed("node", "v"), ["br", "bc", "r", "c"]).select("u", "v")
    return network.components(e, m).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "route_profile",
    f"""WITH {ROLLING}, s AS (SELECT s_suppkey AS id, k, k * 0.3::DOUBLE + s_suppkey * 3 AS pr, 5 + k * 1.3::DOUBLE AS pc FROM supplier, range(36) b(k)), f AS (SELECT *, floor(pr)::INT AS i, floor(pc)::INT AS j FROM s),
    z AS (SELECT f.id, f.k, CASE WHEN pr <= {DOWN} - 1 AND pc <= {ACROSS} - 1 THEN (1 - (pr - i)) * ((1 - (pc - j)) * a.z + (pc - j) * b.z) + (pr - i) * ((1 - (pc - j)) * c.z + (pc - j) * d.z) END AS z FROM f LEFT JOIN rolling a ON a.r = i AND a.c = j LEFT JOIN rolling b ON b.r = i AND b.c = least(j + 1, {ACROSS} - 1) LEFT JOIN rolling c ON c.r = least(i + 1, {DOWN} - 1) AND c.c = j LEFT JOIN rolling d ON d.r = least(i + 1, {DOWN} - 1) AND d.c = least(j + 1, {ACROSS} - 1)),
    w AS (SELECT *, z - lag(z) OVER (PARTITION BY id ORDER BY k) AS dz FROM z)
    SELECT id, round(CASE WHEN count(z) = count(*) THEN sum(CASE WHEN dz > 0 THEN dz ELSE 0 END) END, 5) AS gain, round(CASE WHEN count(z) = count(*) THEN sum(CASE WHEN dz < 0 THEN -dz ELSE 0 END) END, 5) AS loss, round(count(z) / count(*), 8) AS covered FROM w GROUP BY id""",
)
def route_profile(spark, sf_dir):
    g = _rolling(spark, sf_dir)
    rows = _rows(g)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(35))).alias("k"))
    s = s.withColumn("pr", F.col("k") * 0.3 + F.col("id") * 3).withColumn("pc", 5 + F.col("k") * 1.3)
    z = grids.sample_bilinear(g, s, rows, COLS).withColumn("z", F.when((F.col("pr") <= rows - 1) & (F.col("pc") <= COLS - 1), F.col("z")))
    return network.profile(z).select("id", F.round("gain", 5).alias("gain"), F.round("loss", 5).alias("loss"), F.round("covered", 8).alias("covered"))


RETURNS = "SELECT event_id AS seq, (event_id * 37 % 400) / 100.0::DOUBLE AS dx, (event_id * 91 % 300) / 100.0::DOUBLE AS dy, floor(value) % 7 AS z, 0.4 AS ground FROM events"


def _returns(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id as seq", "(event_id * 37 % 400) / 100D as dx", "(event_id * 91 % 300) / 100D as dy", "floor(value) % 7 as z", "0.4D as ground")


@query(
    "voxel_support",
    f"""WITH p AS (SELECT DISTINCT dx, dy, z FROM ({RETURNS})), c AS (SELECT floor(dx / 0.25)::BIGINT AS i, floor(dy / 0.25)::BIGINT AS j, floor(z / 0.25)::BIGINT AS k, count(*) AS n FROM p GROUP BY ALL)
    SELECT i, j, k, n FROM c WHERE n >= 4 OR (n >= 2 AND (SELECT count(*) FROM c s WHERE s.n >= 4 AND abs(s.i - c.i) <= 1 AND abs(s.j - c.j) <= 1 AND abs(s.k - c.k) <= 1) >= 2)""",
)
def voxel_support(spark, sf_dir):
    return points.voxels(_returns(spark, sf_dir), 0.25)


@query("lidar_columns", f"SELECT floor(dx / 0.5)::BIGINT AS i, floor(dy / 0.5)::BIGINT AS j, round(CASE WHEN max(z - ground) < 0.5 THEN 0 ELSE max(z - ground) END, 6) AS height, count(*) AS n FROM ({RETURNS}) GROUP BY ALL")
def lidar_columns(spark, sf_dir):
    return points.columns(_returns(spark, sf_dir), 0.5).withColumn("height", F.round("height", 6))


@query("ground_bins", f"SELECT floor(dx / 0.25)::BIGINT AS i, floor(dy / 0.25)::BIGINT AS j, min(seq) AS seq, arg_min(z, seq)::DOUBLE AS z FROM ({RETURNS}) GROUP BY ALL")
def ground_bins(spark, sf_dir):
    return points.first_in_bin(_returns(spark, sf_dir)).withColumn("z", F.col("z").cast("double"))


_SWITCH = [("full", [1] * 6)] + [(f"no_{f}", [int(g != f) for g in candidates.FEATURES]) for f in candidates.FEATURES] + [("bare", [0] * 6)]
_FACTORS = {"habitat": "(1 - l_discount)", "searchability": "(CASE WHEN l_quantity < 10 THEN 1.0 WHEN l_quantity < 30 THEN 0.6 ELSE 0.25 END)", "distance": "(1 - l_tax)", "perspective": "(l_linenumber / 7e0)", "light": "(0.5 + l_discount)", "inspection": "(l_quantity / 5e1)"}


@query(
    "scenario_matrix",
    f"WITH s(scenario, {', '.join('s_' + f for f in candidates.FEATURES)}) AS (VALUES {', '.join(str((n, *v)) for n, v in _SWITCH)}) SELECT scenario, l_suppkey AS id, round(sum({' * '.join(f'(CASE WHEN s_{f} = 1 THEN {e}::DOUBLE ELSE 1 END)' for f, e in _FACTORS.items())}) * {math.pi * 30!r}, 4) AS score FROM lineitem, s GROUP BY ALL",
)
def scenario_matrix(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), *(F.expr(f"cast({e} as double)").alias(f) for f, e in _FACTORS.items()))
    return candidates.component_scores(cells, candidates.scenarios(spark), math.pi * 30).select("scenario", "id", F.round("score", 4).alias("score"))


@query(
    "name_season_normalize",
    """WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 4 = 0 THEN '7' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') WHEN o_orderkey % 4 = 1 THEN ' fs ' || o_orderkey ELSE '81' || (o_orderkey % 90 + 10) END AS rid,
        o_orderpriority || ' Road TR' AS name, CASE o_orderkey % 5 WHEN 0 THEN '02/30-12/31' WHEN 1 THEN '07/01-12/31' WHEN 2 THEN '01/01-06/30' WHEN 3 THEN 'all year' ELSE '03/15-11/15' END AS season FROM orders),
    n AS (SELECT *, upper(trim(rid)) AS u, list_filter(string_split_regex(replace(upper(name), '-', ' '), '\\s+'), lambda w: w <> '' AND w NOT IN ('ROAD', 'RD', 'TRAIL', 'TR', 'CR', 'FS', 'NFSR', 'NFST')) AS w FROM o)
    SELECT id, CASE WHEN regexp_full_match(u, '[79][0-9]{3}') THEN u[2:] ELSE u END AS route, array_to_string(w, ' ') AS name,
        coalesce(try_strptime(year(d) || '/' || season[1:5], '%Y/%m/%d')::DATE <= d AND d + 8 <= try_strptime(year(d) || '/' || season[7:], '%Y/%m/%d')::DATE, false) AS covered FROM n""",
)
def name_season_normalize(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.to_date("o_orderdate").alias("d"), F.when(k % 4 == 0, F.concat(F.lit("7"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 4 == 1, F.concat(F.lit(" fs "), k.cast("string"))).otherwise(F.concat(F.lit("81"), (k % 90 + 10).cast("string"))).alias("rid"),
        F.concat("o_orderpriority", F.lit(" Road TR")).alias("name"), F.when(k % 5 == 0, "02/30-12/31").when(k % 5 == 1, "07/01-12/31").when(k % 5 == 2, "01/01-06/30").when(k % 5 == 3, "all year").otherwise("03/15-11/15").alias("season"),
    )
    return o.select("id", network.route_id(F.col("rid")).alias("route"), network.route_name(F.col("name")).alias("name"), network.season_covers(F.col("season"), F.col("d"), F.date_add("d", 8)).alias("covered"))


@query(
    "rolling_rate",
    """WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t, value FROM events), w AS (SELECT event_id, t, sum(value) OVER s AS total, (t - min(t) OVER s) / 1e6 AS span FROM e WINDOW s AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, round(total, 4) AS total, round(CASE WHEN span >= 3 THEN total / span END, 6) AS rate FROM w""",
)
def rolling_rate(spark, sf_dir):
    out = rates.rolling(table(spark, sf_dir, "events"), "event_type", 3600, 3)
    return out.select("event_id", F.round("total", 4).alias("total"), F.round("rate", 6).alias("rate"))


@query(
    "terrarium_tiles",
    f"""WITH {HILLS}, v AS (SELECT r, c, round_even((z + 32768) * 256, 0)::BIGINT AS v, r % 100 * 3.6::DOUBLE - 180 AS lon, c * 2.4::DOUBLE - 60 AS lat FROM hills)
    SELECT r, c, (v >> 16) & 255 AS red, (v >> 8) & 255 AS green, v & 255 AS blue, floor((lon + 180) / 360 * 1024)::INT AS tx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / {math.pi!r}) / 2 * 1024)::INT AS ty FROM v""",
)
def terrarium_tiles(spark, sf_dir):
    g = _hills(spark, sf_dir)
    lon, lat = F.col("r") % 100 * 3.6 - 180, F.col("c") * 2.4 - 60
    (red, green, blue), (tx, ty) = geo.terrarium(F.col("z")), geo.tile_of(lon, lat, 10)
    return g.select("r", "c", red.alias("red"), green.alias("green"), blue.alias("blue"), tx.alias("tx"), ty.alias("ty"))


@query("grid_average", f"WITH {HILLS} SELECT (r // 3)::INT AS r, (c // 3)::INT AS c, round(avg(z), 6) AS z, count(*) AS n FROM hills GROUP BY ALL")
def grid_average(spark, sf_dir):
    return grids.coarsen(_hills(spark, sf_dir), 3, ["z"]).withColumn("z", F.round("z", 6))


@query(
    "stratified_draw",
    f"""WITH {HILLS}, d AS (SELECT r, c, md5('54:' || r || ':' || c) AS h FROM hills) SELECT (r // 20)::INT AS sr, (c // 20)::INT AS sc, arg_min(r, h[1:12]) AS r, arg_min(c, h[1:12]) AS c FROM d GROUP BY ALL""",
)
def stratified_draw(spark, sf_dir):
    s = candidates.stratified(_cells(spark, sf_dir), 20, 54)
    return s.select(F.floor(F.col("r") / 20).cast("int").alias("sr"), F.floor(F.col("c") / 20).cast("int").alias("sc"), "r", "c")


@query(
    "spaced_candidates",
    f"""WITH RECURSIVE {CELLS}, o AS MATERIALIZED (SELECT r, c, row_number() OVER (ORDER BY md5('7:' || r || ':' || c)[1:12], r, c) AS n FROM cells),
    w(n, taken) AS (SELECT 0::BIGINT, CAST([] AS STRUCT(r INT, c INT)[]) UNION ALL SELECT o.n, CASE WHEN len(list_filter(taken, lambda x: (x.r - o.r) * (x.r - o.r) + (x.c - o.c) * (x.c - o.c) < 64)) = 0 THEN list_append(taken, {{'r': o.r, 'c': o.c}}) ELSE taken END FROM w JOIN o ON o.n = w.n + 1)
    SELECT x.r AS r, x.c AS c FROM (SELECT unnest(taken) AS x FROM w WHERE n = (SELECT max(n) FROM o))""",
)
def spaced_candidates(spark, sf_dir):
    """Cells no closer than eight cells, as if taken one by one in order of draw (checked so in the tests)."""
    g = _cells(spark, sf_dir).withColumn("draw", candidates.drawn(["r", "c"], 7))
    return candidates.spaced(g, 8.0).select("r", "c")


def searched_sql(side: int, priced: str) -> str:
    """Cells of areas of `side` rows with slopes inside each area, and the steps between them at 20 m: u to v, no corner cut; `priced` gives a step's cost and whether it is free, from cells a (u) and b (v), its length and its grade."""
    diff = lambda z, k, of: f"(coalesce(lead({z}) OVER (PARTITION BY {of} ORDER BY {k}), {z}) - coalesce(lag({z}) OVER (PARTITION BY {of} ORDER BY {k}), {z})) / ((CASE WHEN lead({z}) OVER (PARTITION BY {of} ORDER BY {k}) IS NULL OR lag({z}) OVER (PARTITION BY {of} ORDER BY {k}) IS NULL THEN 1 ELSE 2 END) * 20)"
    return f"""{ROLLING}, {COVER('rolling')}, g0 AS (SELECT r // {side} AS area, r % {side} AS r, c, z, tree, shrub, (r * 3 + c) % 11 <> 0 AS ok FROM cover), g1 AS (SELECT *, {diff('z', 'c', 'area, r')} AS gx, {diff('z', 'r', 'area, c')} AS gy FROM g0),
    g AS MATERIALIZED (SELECT area, r, c, z, coalesce(tree, 1) AS tree, coalesce(shrub, 1) AS shrub, ok, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (area * {side} + r) * {COLS} + c AS node FROM g1),
    st AS (SELECT i, j, 20 * sqrt(i * i + j * j) AS length FROM range(-1, 2) x(i), range(-1, 2) y(j) WHERE i <> 0 OR j <> 0), o AS (SELECT * FROM g WHERE ok),
    e0 AS (SELECT a.area, a.node AS u, b.node AS v, a.r, a.c, i, j, length, degrees(atan(abs(b.z - a.z) / length)) AS grade, a.slope AS slope_a, b.slope AS slope_b, a.tree AS tree_a, b.tree AS tree_b, a.shrub AS shrub_a, b.shrub AS shrub_b, b.z - a.z AS rise FROM o a CROSS JOIN st JOIN o b ON b.area = a.area AND b.r = a.r + i AND b.c = a.c + j),
    e1 AS (SELECT e0.* FROM e0 LEFT JOIN o k ON k.area = e0.area AND k.r = e0.r + i AND k.c = e0.c LEFT JOIN o l ON l.area = e0.area AND l.r = e0.r AND l.c = e0.c + j WHERE i = 0 OR j = 0 OR (k.node IS NOT NULL AND l.node IS NOT NULL {'AND k.slope <= 30 AND l.slope <= 30' if priced == 'plain' else ''}))"""


@query(
    "approach_costs",
    f"""WITH RECURSIVE {searched_sql(50, 'weighed')}, w(name, ws, wt, wb, wg) AS (VALUES ('recommended', 1.0, 1.0, 1.0, 1.0), ('shortest', 0.0, 0.0, 0.0, 0.0), ('brush', 1.0, 3.0, 3.0, 1.0)),
    e AS MATERIALIZED (SELECT name, area, u, v, length * (1 + ws * power(greatest(slope_a, slope_b, grade) / 15, 2) + wt * (tree_a + tree_b) / 2 + wb * (shrub_a + shrub_b) / 2) + 10 * wg * greatest(0, rise) AS cost FROM e1, w WHERE greatest(slope_a, slope_b, grade) <= 30),
    d(name, node, cost) USING KEY (name, node) AS (SELECT name, node, 0.0::DOUBLE FROM o, w WHERE r = 20 AND c = 20 UNION SELECT e.name, e.u, min(d.cost + e.cost)::DOUBLE FROM d JOIN e ON e.name = d.name AND e.v = d.node LEFT JOIN recurring.d k ON k.name = e.name AND k.node = e.u WHERE k.cost IS NULL OR d.cost + e.cost < k.cost GROUP BY e.name, e.u)
    SELECT w.name || '-' || g.area AS scenario, g.r || '-' || g.c AS start, round(d.cost, 5) AS cost FROM g JOIN w ON true JOIN (SELECT DISTINCT area FROM g WHERE r = 20 AND c = 20) t USING (area) LEFT JOIN d ON d.name = w.name AND d.node = g.node WHERE g.r % 13 = 5 AND g.c % 13 = 4""",
)
def approach_costs(spark, sf_dir):
    """Least-cost approaches for three objectives; heap searches inside grouped tasks, held against relaxation in the tests."""
    g = grids.with_cover(_rolling(spark, sf_dir)).withColumn("ok", (F.col("r") * 3 + F.col("c")) % 11 != 0)
    g = g.withColumn("area", F.expr("r div 50")).withColumn("r", F.col("r") % 50)  # an area for each fifty rows
    weights = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(w).alias(k) for k, w in zip(("ws", "wt", "wb", "wg"), ws))) for n, ws in (("recommended", (1.0, 1.0, 1.0, 1.0)), ("shortest", (0.0, 0.0, 0.0, 0.0)), ("brush", (1.0, 3.0, 3.0, 1.0)))))
    s = g.where("r = 20 and c = 20").select("area", F.explode(weights).alias("x")).select(F.concat_ws("-", "x.n", "area").alias("scenario"), "area", F.lit(20).alias("tr"), F.lit(20).alias("tc"), "x.ws", "x.wt", "x.wb", "x.wg")
    starts = g.where((F.col("r") % 13 == 5) & (F.col("c") % 13 == 4)).select("area", F.format_string("%d-%d", "r", "c").alias("start"), "r", "c")
    return network.approaches(s, g, starts, 20.0).select("scenario", "start", F.round("cost", 5).alias("cost"))


@query(
    "access_evidence",
    """WITH e AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'prohibited' WHEN 1 THEN 'unknown' WHEN 4 THEN NULL ELSE 'verified' END AS reachable, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'seen' END AS evidence, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal / 1000 END AS hike FROM supplier WHERE s_suppkey % 11 <> 0)
    SELECT s_suppkey AS id, true AS verified FROM supplier JOIN e ON s_suppkey = id WHERE reachable = 'verified' AND evidence <> '' AND hike <= 6""",
)
def access_evidence(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    e = s.where(k % 11 != 0).select(k.alias("id"), F.when(k % 5 == 0, "prohibited").when(k % 5 == 1, "unknown").when(k % 5 == 4, F.lit(None)).otherwise("verified").alias("reachable"), F.when(k % 3 == 0, "").otherwise("seen").alias("evidence"), F.when(k % 7 != 0, F.col("s_acctbal") / 1000).alias("hike_km"), F.lit(0.0).alias("gain_m"))
    return filters.access(s.select(k.alias("id")), e, False, 6.0, None)


@query(
    "ray_boxes",
    f"""WITH p AS ({POINT_SQL}), b AS (SELECT label AS area, x / 100 AS x, y / 100 AS y, 5.0 AS z, 4.0 AS side FROM p), s AS (SELECT vec_id AS id, label AS area, -20.0 AS x0, y / 100 AS y0, 5.0 AS z0, 20.0 AS x1, y / 100 + 3 AS y1, 6.0 AS z1 FROM p),
    t AS (SELECT id, (x - 2 - x0) / (x1 - x0) AS ax, (x + 2 - x0) / (x1 - x0) AS bx, (y - 2 - y0) / (y1 - y0) AS ay, (y + 2 - y0) / (y1 - y0) AS by_, (z - 2 - z0) / (z1 - z0) AS az, (z + 2 - z0) / (z1 - z0) AS bz FROM s JOIN b USING (area)), h AS (SELECT id, greatest(ax, ay, az) AS enter, least(bx, by_, bz) AS leave FROM t)
    SELECT id, count(*) AS hits, round(min(greatest(enter, 0)), 8) AS first_t, bool_or(enter <= 0) AS starts_inside, bool_or(leave >= 1) AS ends_inside FROM h WHERE enter <= leave AND leave >= 0 AND enter <= 1 GROUP BY id""",
)
def ray_boxes(spark, sf_dir):
    p = _points(spark, sf_dir)
    b = p.selectExpr("label as area", "x / 100 as x", "y / 100 as y", "5D as z", "4D as side")
    s = p.selectExpr("vec_id as id", "label as area", "-20D as x0", "y / 100 as y0", "5D as z0", "20D as x1", "y / 100 + 3 as y1", "6D as z1")
    return visibility.slab_hits(b, s, 8.0).withColumn("first_t", F.round("first_t", 8))


@query(
    "json_properties",
    """SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type""",
)
def json_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.count_distinct("k").alias("kinds"))


@query("wedge_rings", f"WITH p AS ({POINT_SQL}) SELECT vec_id, 17::INT AS n, round(x + 500 * sin(radians(30 * (label % 12) + 15)), 4) AS mid_x, round(y + 500 * cos(radians(30 * (label % 12) + 15)), 4) AS mid_y FROM p")
def wedge_rings(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("ring", geo.wedge(F.col("x"), F.col("y"), F.lit(0.0), F.lit(500.0), (F.col("label") % 12) * 30.0, 30.0, 9))
    return p.select("vec_id", (F.size("ring") - 2).cast("int").alias("n"), F.round(F.get("ring", F.lit(4))["x"], 4).alias("mid_x"), F.round(F.get("ring", F.lit(4))["y"], 4).alias("mid_y"))


@query(
    "cover_classes",
    f"""WITH {HILLS}, {COVER('hills')}, s AS (SELECT *, r // 28 * 5 + c // 28 AS id FROM cover) SELECT id::INT AS id, round(count(*) * 0.0001::DOUBLE, 6) AS raw, round(count(*) FILTER (tree < 0.1) * 0.0001::DOUBLE, 6) AS open, round(count(*) FILTER (tree >= 0.1 AND tree < 0.4) * 0.0001::DOUBLE, 6) AS partial,
    round(count(*) FILTER (tree >= 0.4) * 0.0001::DOUBLE, 6) AS dense, round(count(*) FILTER (tree IS NULL) * 0.0001::DOUBLE, 6) AS unknown, round(avg(shrub), 8) AS mean_shrub, round(avg((tree IS NULL OR shrub IS NULL)::INT), 8) AS unknown_share, true AS closes FROM s GROUP BY id""",
)
def cover_classes(spark, sf_dir):
    g = grids.with_cover(_hills(spark, sf_dir)).withColumn("id", (F.floor(F.col("r") / 28) * 5 + F.floor(F.col("c") / 28)).cast("int"))
    out = evaluation.cover_classes(g, "id", 1e-4)
    return out.select("id", *(F.round(k, 6).alias(k) for k in ("raw", "open", "partial", "dense", "unknown")), F.round("mean_shrub", 8).alias("mean_shrub"), F.round("unknown_share", 8).alias("unknown_share"), "closes")


@query(
    "directional_cover",
    f"""WITH p AS ({POINT_SQL}), q AS (SELECT label, sqrt(x * x + y * y) AS d, floor((degrees(atan2(x, y)) - 360 * floor(degrees(atan2(x, y)) / 360)) / 30) * 30 AS s, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE (vec_id % 100) / 100.0::DOUBLE END AS t FROM p),
    f AS (SELECT label, CASE WHEN d < 800 THEN 100.0 ELSE 800.0 END AS i, s::INT AS start, count(*) AS cells, avg(t) AS m, avg((t IS NULL)::INT) AS u FROM q WHERE d >= 100 AND d < 2000 GROUP BY ALL),
    e AS (SELECT label, i, s::INT AS start FROM (SELECT DISTINCT label FROM p), (VALUES (100.0), (800.0)) v(i), range(0, 360, 30) w(s))
    SELECT e.label, e.i::DOUBLE AS inner, e.start, coalesce(cells, 0) AS cells, round(m, 8) AS mean_tree, round(coalesce(u, 1), 8) AS unknown_share FROM e LEFT JOIN f ON e.label = f.label AND e.i = f.i AND e.start = f.start""".replace(" AS inner", ' AS "inner"'),
)
def directional_cover(spark, sf_dir):
    p = _points(spark, sf_dir).select("label", F.col("x").alias("dx"), F.col("y").alias("dy"), F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 100) / 100).alias("tree"))
    out = evaluation.directional(p, "label", [(100, 800), (800, 2000)])
    return out.withColumn("mean_tree", F.round("mean_tree", 8)).withColumn("unknown_share", F.round("unknown_share", 8))


@query(
    "support_masks",
    f"""WITH p AS ({POINT_SQL}), q AS (SELECT label, sqrt(x * x + y * y) AS d, vec_id FROM p), s AS (SELECT *, 'whole' AS support FROM q UNION ALL SELECT *, 'even' FROM q WHERE vec_id % 2 = 0 UNION ALL SELECT *, 'third' FROM q WHERE vec_id % 3 = 0)
    SELECT label, support, round(count(*) * 0.0001::DOUBLE, 6) AS visible, round(count(*) FILTER (d <= 1000) * 0.0001::DOUBLE, 6) AS near FROM s GROUP BY ALL""",
)
def support_masks(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("d", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))
    out = evaluation.by_support(p, "label", {"whole": F.lit(True), "even": F.col("vec_id") % 2 == 0, "third": F.col("vec_id") % 3 == 0}, 1e-4)
    return out.withColumn("visible", F.round("visible", 6)).withColumn("near", F.round("near", 6))


@query(
    "quadrant_baseline",
    f"""WITH p AS ({POINT_SQL}), m AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM p), q AS (SELECT vec_id, x >= mx AS east, y >= my AS north, k FROM p, m, range(20) t(k))
    SELECT k::INT AS replicate, east, north, arg_min(vec_id, md5('5402:' || k || ':' || vec_id)) AS id FROM q GROUP BY ALL""",
)
def quadrant_baseline(spark, sf_dir):
    return evaluation.quadrant_draws(_points(spark, sf_dir).withColumnRenamed("vec_id", "id"), 20, 5402)


ARMS = f"""SELECT 'revenue' AS arm, id, round(revenue, 2) AS score FROM ({SALES}) UNION ALL SELECT 'quantity', id, quantity FROM ({SALES}) UNION ALL SELECT 'returns', id, returned::DOUBLE FROM ({SALES})"""


def _arms(spark, sf_dir):
    s = _sales(spark, sf_dir)
    return s.select("id", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), v.cast("double").alias("score")) for a, v in (("revenue", F.round("revenue", 2)), ("quantity", F.col("quantity")), ("returns", F.col("returned")))))).alias("x")).select("x.arm", "id", "x.score")


@query(
    "cross_evaluation",
    f"""WITH a AS ({ARMS}), b AS (SELECT arm AS nominator, id FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS n FROM a) WHERE n <= 4)
    SELECT nominator, arm AS evaluator, round(avg(score), 4) AS mean FROM b JOIN a USING (id) GROUP BY ALL""",
)
def cross_evaluation(spark, sf_dir):
    return evaluation.cross_scores(_arms(spark, sf_dir), 4).withColumn("mean", F.round("mean", 4))


@query(
    "distinct_leaders",
    f"""WITH a AS ({ARMS}), x AS (SELECT id FROM a WHERE arm = 'revenue' ORDER BY score DESC, id LIMIT 1), y AS (SELECT id FROM a WHERE arm = 'quantity' AND id NOT IN (SELECT id FROM x) ORDER BY score DESC, id LIMIT 1),
    z AS (SELECT id FROM a WHERE arm = 'returns' AND id NOT IN (SELECT id FROM x UNION SELECT id FROM y) ORDER BY score DESC, id LIMIT 1) SELECT 0 AS place, 'revenue' AS arm, id FROM x UNION ALL SELECT 1, 'quantity', id FROM y UNION ALL SELECT 2, 'returns', id FROM z""",
)
def distinct_leaders(spark, sf_dir):
    return evaluation.distinct_leaders(_arms(spark, sf_dir), ["revenue", "quantity", "returns"])


@query(
    "nearby_alternatives",
    f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY x DESC, vec_id)::INT AS rank FROM ({POINT_SQL})), c AS (SELECT vec_id AS site, x AS sx, y AS sy FROM p WHERE vec_id % 50 = 0)
    SELECT site, string_agg(vec_id, ',' ORDER BY rank) AS alternatives FROM c JOIN p ON vec_id % 50 <> 0 AND (x - sx) * (x - sx) + (y - sy) * (y - sy) < 90000 GROUP BY site""",
)
def nearby_alternatives(spark, sf_dir):
    p = ranking.ranked(_points(spark, sf_dir).withColumnRenamed("vec_id", "id"), [F.desc("x"), F.col("id")])
    out = evaluation.alternatives_near(p, p.where("id % 50 = 0"), 300.0)
    return out.select("site", F.array_join(F.transform("alternatives", lambda v: v.cast("string")), ",").alias("alternatives"))


@query(
    "sampled_rays",
    "WITH d AS (SELECT l_suppkey AS id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('9:' || l_suppkey || ':' || l_orderkey || ':' || l_linenumber)) AS n FROM lineitem) SELECT id, l_orderkey, l_linenumber FROM d WHERE n <= 8",
)
def sampled_rays(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), "l_orderkey", "l_linenumber")
    return evaluation.sampled_per(cells, "id", ["l_orderkey", "l_linenumber"], 8, 9)


@query(
    "farthest_parents",
    f"""WITH p AS (SELECT vec_id AS id, x, y, x AS score FROM ({POINT_SQL})), a AS (SELECT id, x, y, row_number() OVER (ORDER BY score DESC, id)::INT AS place FROM p ORDER BY score DESC, id LIMIT 2),
    b AS (SELECT p.id, p.x, p.y, 3 AS place FROM p, a WHERE p.id NOT IN (SELECT id FROM a) GROUP BY p.id, p.x, p.y ORDER BY min((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y)) DESC, p.id LIMIT 1), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    c AS (SELECT p.id, p.x, p.y, 4 AS place FROM p, ab WHERE p.id NOT IN (SELECT id FROM ab) GROUP BY p.id, p.x, p.y ORDER BY min((p.x - ab.x) * (p.x - ab.x) + (p.y - ab.y) * (p.y - ab.y)) DESC, p.id LIMIT 1)
    SELECT place, id FROM ab UNION ALL SELECT place, id FROM c""",
)
def farthest_parents(spark, sf_dir):
    return evaluation.far_apart(_points(spark, sf_dir).withColumnRenamed("vec_id", "id").withColumn("score", F.col("x")), 2, 4)


@query(
    "largest_openings",
    f"""WITH RECURSIVE {CELLS}, m AS (SELECT r // 12 * 10 + c // 12 AS id, r * {COLS} + c AS node, r, c FROM cells WHERE (r * 7 + c * 5 + r * c) % 3 <> 0),
    e AS (SELECT a.node AS u, b.node AS v FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.id = b.id), w AS (SELECT node, node AS label FROM m UNION SELECT e.v, w.label FROM w JOIN e ON e.u = w.node), l AS (SELECT node, min(label)::BIGINT AS label FROM w GROUP BY node),
    j AS (SELECT m.*, label, avg(r) OVER k AS mr, avg(c) OVER k AS mc, count(*) OVER k AS n FROM m JOIN l USING (node) WINDOW k AS (PARTITION BY id, label)), t AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY n DESC, label)::INT AS place, row_number() OVER (PARTITION BY id, label ORDER BY round((r - mr) * (r - mr) + (c - mc) * (c - mc), 9), r, c) AS q FROM j)
    SELECT id, label, n, place, r, c FROM t WHERE place <= 2 AND q = 1""",
)
def largest_openings(spark, sf_dir):
    m = _cells(spark, sf_dir).select("r", "c").where((F.col("r") * 7 + F.col("c") * 5 + F.col("r") * F.col("c")) % 3 != 0).withColumn("node", (F.col("r") * COLS + F.col("c")).cast("long")).withColumn("id", F.expr("cast(r div 12 * 10 + c div 12 as int)"))
    steps = F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((1, 0), (0, 1))))
    e = m.select("id", F.col("node").alias("u"), F.explode(steps).alias("x")).select("id", "u", "x.r", "x.c").join(m.withColumnRenamed("node", "v"), ["id", "r", "c"]).select("u", "v")
    labels = network.components(e, m).join(m.select("node", "id"), "node")
    return evaluation.openings(m, labels, "id")


@query(
    "catalog_cover",
    """WITH q AS (SELECT s_suppkey AS id, 'p' || s_nationkey % 3 AS product, s_suppkey % 50 AS x0, s_suppkey % 40 AS y0, s_suppkey % 50 + 5 AS x1, s_suppkey % 40 + 4 AS y1 FROM supplier), c AS (SELECT p_partkey AS entry, 'p' || p_size % 3 AS product, p_partkey % 37 AS ex0, p_partkey % 29 AS ey0, p_partkey % 37 + p_size AS ex1, p_partkey % 29 + p_size AS ey1 FROM part)
    SELECT q.id, arg_min(c.entry, ((ex1 - ex0) * (ey1 - ey0), c.entry)) AS entry FROM q LEFT JOIN c ON q.product = c.product AND ex0 <= x0 AND ey0 <= y0 AND ex1 >= x1 AND ey1 >= y1 GROUP BY q.id""",
)
def catalog_cover(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "concat('p', s_nationkey % 3) as product", "s_suppkey % 50 as x0", "s_suppkey % 40 as y0", "s_suppkey % 50 + 5 as x1", "s_suppkey % 40 + 4 as y1")
    c = table(spark, sf_dir, "part").selectExpr("p_partkey as entry", "concat('p', p_size % 3) as product", "p_partkey % 37 as ex0", "p_partkey % 29 as ey0", "p_partkey % 37 + p_size as ex1", "p_partkey % 29 + p_size as ey1")
    return catalog.covering(q, c)


@query(
    "acquisition_choice",
    """WITH e AS (SELECT 'a' || l_suppkey % 9 AS acquisition, round(l_quantity) AS km2, l_linenumber = 1 AS cached, CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date, l_partkey AS bytes FROM lineitem)
    SELECT acquisition, sum(CASE WHEN cached THEN km2 ELSE 0 END) AS cached_km2, sum(km2) AS km2, max(date) FILTER (date <> 'n/a') AS date, sum(CASE WHEN cached THEN 0 ELSE bytes END)::BIGINT AS fetch FROM e GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC, 5, 1 LIMIT 1""",
)
def acquisition_choice(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), (F.col("l_suppkey") % 9).cast("string")).alias("acquisition"), F.round("l_quantity").alias("km2"), (F.col("l_linenumber") == 1).alias("cached"), F.when(F.col("l_orderkey") % 11 == 0, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), F.col("l_partkey").alias("bytes"))
    return catalog.choose_acquisition(e)


@query(
    "bytes_by_host",
    """WITH i AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, length(html) AS bytes, page_id % 4 = 0 AS cached FROM pages) SELECT host, sum(bytes)::BIGINT AS bytes, (ceil(sum(bytes) / 1e6 * 1.2 / 10) * 10)::BIGINT AS suggested_mb FROM i WHERE NOT cached GROUP BY host""",
)
def bytes_by_host(spark, sf_dir):
    return catalog.bytes_by_host(table(spark, sf_dir, "pages").select("url", F.length("html").alias("bytes"), (F.col("page_id") % 4 == 0).alias("cached")))


@query(
    "newest_imagery",
    "SELECT l_orderkey AS id, l_returnflag AS tag, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem l WHERE year(l_shipdate) = (SELECT max(year(m.l_shipdate)) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = l.l_returnflag) GROUP BY ALL",
)
def newest_imagery(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("tag"), F.year("l_shipdate").alias("year"))
    return catalog.newest_per(rows, ["id", "tag"], "year").groupBy("id", "tag", "year").agg(F.count("*").alias("n"))


SURFACES = ["AC - ASPHALT", "bst", "PCC - concrete", "Paved", "agg - crushed", "Gravel", "NAT", "native material", "EARTH - graded", "FSOIL", "unknown", None]
MOTORS = ["y", "Yes", "TRUE", "N", "no", "false", "maybe", None]


@query(
    "line_display",
    f"""WITH k AS (SELECT p_partkey AS id, p_size % 2 = 0 AS road, [{', '.join('NULL' if v is None else f"'{v}'" for v in SURFACES)}][p_size % 12 + 1] AS surface, [{', '.join('NULL' if v is None else f"'{v}'" for v in MOTORS)}][p_size % 8 + 1] AS motor FROM part), c AS (SELECT *, split_part(upper(surface), ' - ', 1) AS code FROM k)
    SELECT id, CASE WHEN road THEN CASE WHEN code IN ('AC', 'BST', 'PCC', 'ASPHALT', 'CONCRETE', 'PAVED') THEN 'paved' WHEN code IN ('AGG', 'GRAVEL', 'AGGREGATE') THEN 'gravel' WHEN code IN ('NAT', 'NATIVE MATERIAL', 'DIRT', 'EARTH') THEN 'natural' WHEN surface <> 'unknown' THEN 'other' ELSE 'unknown' END
        ELSE CASE WHEN upper(motor) IN ('Y', 'YES', 'TRUE') THEN 'motorized' WHEN upper(motor) IN ('N', 'NO', 'FALSE') THEN 'nonmotorized' ELSE 'unknown' END END AS display FROM c""",
)
def line_display(spark, sf_dir):
    k = F.col("p_size")
    pick = lambda values, n: F.get(F.array(*(F.lit(v) for v in values)), (k % n).cast("int"))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k % 2 == 0, "roads").otherwise("trails").alias("kind"), pick(SURFACES, 12).alias("surface"), pick(MOTORS, 8).alias("motor"))
    return catalog.line_display(lines)


@query(
    "departure_stations",
    f"""WITH {LINK_SQL}, s AS (SELECT ax, ay, bx, by_, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM l), i AS (SELECT *, unnest(range(0, ceil(len / 20)::INT + 1)) AS i FROM s), p AS (SELECT round(ax + least(i * 20, len) / len * (bx - ax), 6) AS x, round(ay + least(i * 20, len) / len * (by_ - ay), 6) AS y FROM i),
    n AS (SELECT ax, ay, bx, by_, greatest(0, least(1, ((2400 - ax) * (bx - ax) + (1350 - ay) * (by_ - ay)) / (len * len))) AS t FROM s), q AS (SELECT x, y FROM p UNION SELECT round(ax + t * (bx - ax), 6), round(ay + t * (by_ - ay), 6) FROM n)
    SELECT DISTINCT x, y FROM q WHERE (x - 2400) * (x - 2400) + (y - 1350) * (y - 1350) <= 5290000""",
)
def departure_stations(spark, sf_dir):
    return network.departures(_links(spark, sf_dir), (2400.0, 1350.0), 2300.0)


STEP_SQL = "SELECT l_orderkey AS id, l_quantity AS length, l_tax * 300 AS slope, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount * 5 END AS tree, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax * 4 END AS shrub, l_discount * 100 - 5 AS rise FROM lineitem"


@query(
    "path_summary",
    f"""WITH s AS ({STEP_SQL}) SELECT id, round(sum(length), 6) AS distance, round(sum(length * 1.5 * power(slope / 15, 2)), 6) AS slope_part, round(sum(length * coalesce(tree, 1)), 6) AS tree_part, round(sum(length * 2 * coalesce(shrub, 1)), 6) AS shrub_part, round(sum(10 * greatest(rise, 0)), 6) AS gain_part,
    round(sum(length * tree) FILTER (tree IS NOT NULL AND shrub IS NOT NULL) / sum(length) FILTER (tree IS NOT NULL AND shrub IS NOT NULL), 12) AS mean_tree, round(sum(CASE WHEN tree IS NULL OR shrub IS NULL THEN length ELSE 0 END) / sum(length), 12) AS unknown_share FROM s GROUP BY id""",
)
def path_summary(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", "l_quantity as length", "l_tax * 300 as slope", "if(l_partkey % 7 = 0, null, l_discount * 5) as tree", "if(l_partkey % 11 = 0, null, l_tax * 4) as shrub", "l_discount * 100 - 5 as rise", "1.5D as ws", "1D as wt", "2D as wb", "1D as wg")
    out = network.path_summary(s)
    return out.select("id", *(F.round(k, 6).alias(k) for k in ("distance", "slope_part", "tree_part", "shrub_part", "gain_part")), F.round("mean_tree", 12).alias("mean_tree"), F.round("unknown_share", 12).alias("unknown_share"))


@query("merged_objectives", "SELECT o_custkey AS path, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS objectives, min(o_totalprice) AS cost FROM orders GROUP BY 1")
def merged_objectives(spark, sf_dir):
    out = network.merged_labels(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("objective"), F.col("o_custkey").alias("path"), F.col("o_totalprice").alias("cost")))
    return out.select("path", F.array_join("objectives", "|").alias("objectives"), "cost")


@query(
    "median_colours",
    """WITH p AS (SELECT (o_orderkey // 50)::INT AS r, (o_orderkey % 50)::INT AS c, (o_custkey * 37 % 251)::INT AS red, (o_custkey * 91 % 241)::INT AS green, (o_custkey * 53 % 239)::INT AS blue, CASE WHEN o_orderkey % 7 < 5 THEN 255 ELSE 0 END AS alpha FROM orders), k AS (SELECT r * 50 + c AS id, r, c FROM p WHERE (r + c) % 3 = 0)
    SELECT k.id, coalesce(round_even(0.75 * median(red) + 18, 0), 72)::INT AS red, coalesce(round_even(0.75 * median(green) + 27, 0), 108)::INT AS green, coalesce(round_even(0.75 * median(blue) + 13.25, 0), 53)::INT AS blue FROM k LEFT JOIN p ON abs(p.r - k.r) <= 1 AND abs(p.c - k.c) <= 1 AND alpha > 0 GROUP BY k.id""",
)
def median_colours(spark, sf_dir):
    i = F.col("r") * COLS + F.col("c")
    cell = [F.expr(f"cast(o_orderkey div {COLS} as int)").alias("r"), F.expr(f"cast(o_orderkey % {COLS} as int)").alias("c")]
    p = table(spark, sf_dir, "orders").select(*cell, *(F.expr(f"cast(o_custkey * {a} % {b} as int)").alias(n) for n, a, b in (("red", 37, 251), ("green", 91, 241), ("blue", 53, 239))), F.expr("if(o_orderkey % 7 < 5, 255, 0)").alias("alpha"))
    return evaluation.median_colours(p.where((F.col("r") + F.col("c")) % 3 == 0).select(i.alias("id"), "r", "c"), p, (72, 108, 53))


@query(
    "vegetation_rays",
    f"""WITH {ROLLING}, g AS (SELECT *, CASE WHEN (r * 31 + c * 17) % 29 = 0 THEN NULL WHEN (r * 5 + c * 3) % 11 = 0 THEN 4.0 ELSE 0.0 END AS height FROM rolling), {SEAT_SQL},
    p AS (SELECT s.*, g.r, g.c, g.z AS z1, o.z AS z0, o.height AS h0, g.height AS h1, sqrt((g.r - r0) * (g.r - r0) + (g.c - c0) * (g.c - c0)) * {RRES} AS d FROM s JOIN g o ON o.r = r0 AND o.c = c0 JOIN g ON abs(g.r - r0) <= 8 AND abs(g.c - c0) <= 8),
    q AS (SELECT *, greatest(3, ceil(d / 5)::INT) AS steps FROM p WHERE d <= {RADIUS} AND d > 0), i AS (SELECT *, unnest(range(1, steps)) AS i FROM q), t AS (SELECT *, i / steps AS t, r0 + i / steps * (r - r0) AS pr, c0 + i / steps * (c - c0) AS pc FROM i),
    k AS (SELECT t.*, floor(pr)::INT AS fr, floor(pc)::INT AS fc, floor(pr + 0.5)::INT AS nr, floor(pc + 0.5)::INT AS nc FROM t),
    h AS (SELECT k.*, n.height, (1 - (pr - fr)) * ((1 - (pc - fc)) * a.z + (pc - fc) * b.z) + (pr - fr) * ((1 - (pc - fc)) * e.z + (pc - fc) * f.z) AS z, (z0 + 1.7) * (1 - t) + (z1 + 0.8 - {DROP!r} * d * d) * t + {DROP!r} * (t * d) * (t * d) AS line,
        NOT ((nr = r0 AND nc = c0) OR (nr = k.r AND nc = k.c)) AS mid FROM k JOIN g n ON n.r = nr AND n.c = nc JOIN g a ON a.r = fr AND a.c = fc JOIN g b ON b.r = fr AND b.c = least(fc + 1, {ACROSS} - 1) JOIN g e ON e.r = least(fr + 1, {DOWN} - 1) AND e.c = fc JOIN g f ON f.r = least(fr + 1, {DOWN} - 1) AND f.c = least(fc + 1, {ACROSS} - 1)),
    x AS (SELECT *, mid AND coalesce(height > 0 AND z + height > line, false) AS hit, t * d <= 30 AS near, (1 - t) * d <= 30 AND NOT t * d <= 30 AS fin FROM h)
    SELECT id, r, c, bool_or(hit AND near) AS observer, bool_or(hit AND NOT near AND NOT fin) AS intermediate, bool_or(hit AND fin) OR coalesce(any_value(h1) > 0.8, false) AS target, bool_or(mid AND height IS NULL) OR bool_or(h0 IS NULL) OR bool_or(h1 IS NULL) AS unknown, bool_or(mid AND z > line + 1e-6) AS terrain FROM x GROUP BY id, r, c""",
)
def vegetation_rays(spark, sf_dir):
    k = F.col("r")
    g = _rolling(spark, sf_dir).withColumn("height", F.when((k * 31 + F.col("c") * 17) % 29 == 0, None).when((k * 5 + F.col("c") * 3) % 11 == 0, 4.0).otherwise(0.0))
    pairs = visibility.targets_within(_seats(spark, sf_dir), g.select("r", "c"), RADIUS, RRES).drop("d")
    return visibility.vegetation_rays(pairs, g, _rows(g), COLS, RRES).drop("r0", "c0")


@query("attention_sweep")
def attention_sweep(spark, sf_dir):
    """Exact and even use of three budgets over polar patches; a fold that SQL can't state (patch_knapsack's test covers it)."""
    p = _points(spark, sf_dir).select("label", F.col("x").alias("dx"), F.col("y").alias("dy"), F.lit(1.0).alias("reward"))
    out = attention.sweep(attention.polar_patches(p, "label", 30, 500, 2000, 1e-4), "label", [10.0, 30.0, 60.0])
    return out.select("label", "budget", F.round("selective", 9).alias("selective"), F.round("uniform", 9).alias("uniform"))


def _reached(limit: float, n: int) -> str:
    """Cells that hang together with the first row over open cells and steps within the limit, by flood fill."""
    return f"""o{n} AS MATERIALIZED (SELECT r, c, z FROM sl WHERE ok AND slope <= {limit}), e{n} AS MATERIALIZED (SELECT a.r, a.c, b.r AS r2, b.c AS c2 FROM o{n} a, range(-1, 2) x(i), range(-1, 2) y(j), o{n} b WHERE (i <> 0 OR j <> 0) AND b.r = a.r + i AND b.c = a.c + j AND degrees(atan(abs(b.z - a.z) / (12 * sqrt(i * i + j * j)))) <= {limit}
        AND (i = 0 OR j = 0 OR (EXISTS (SELECT 1 FROM o{n} k WHERE k.r = a.r + i AND k.c = a.c) AND EXISTS (SELECT 1 FROM o{n} k WHERE k.r = a.r AND k.c = a.c + j)))), f{n}(r, c) AS (SELECT r, c FROM o{n} WHERE r = 0 UNION SELECT e.r2, e.c2 FROM f{n} JOIN e{n} e USING (r, c))"""


@query(
    "connection_screen",
    f"""WITH RECURSIVE {ROLLING}, steep AS (SELECT r, c, z * 1.8::DOUBLE AS z FROM rolling), {GRADIENT('steep', 'z', 12.0)}, sl AS MATERIALIZED (SELECT r, c, z, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (r * 3 + c * 7) % 5 <> 0 AS ok FROM graded), {_reached(25.0, 1)}, {_reached(35.0, 2)}
    SELECT r || '-' || c AS id, CASE WHEN f1.r IS NOT NULL OR f2.r IS NOT NULL THEN 'connected' WHEN NOT ok THEN 'outside the domain' WHEN slope > 35 THEN 'too steep' ELSE 'no connection' END AS status, CASE WHEN f1.r IS NOT NULL THEN 25.0 WHEN f2.r IS NOT NULL THEN 35.0 END::DOUBLE AS "limit"
    FROM sl LEFT JOIN f1 USING (r, c) LEFT JOIN f2 USING (r, c) WHERE r % 7 = 3 AND c % 6 = 2""",
)
def connection_screen(spark, sf_dir):
    """Seats that hang together with a departure at the first slope limit that allows it; held against a flood fill in the tests."""
    g = terrain.gradient(_rolling(spark, sf_dir).withColumn("z", F.col("z") * 1.8), "z", 12.0)
    g = g.select("r", "c", "z", terrain.slope_of(F.col("gx"), F.col("gy")).alias("slope"), ((F.col("r") * 3 + F.col("c") * 7) % 5 != 0).alias("ok"))
    seats = g.where("r % 7 = 3 and c % 6 = 2").select(F.concat_ws("-", "r", "c").alias("id"), "r", "c")
    return network.connections(g, seats, g.where("r = 0").select("r", "c"), 12.0, (25.0, 35.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewshed_rank(spark, sf_dir)


from . import decision_queries, path_queries, source_queries  # noqa: E402, F401  register their queries beside these
