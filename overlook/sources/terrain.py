"""Cell tables: closed-form terrain and cover, grid contracts, tiles and resampling.

A raster is a long table of cells (r, c, z, ...), an unknown value is NULL. Wide work on windows of cells
goes by tiles: arrays of TILE x TILE values keyed by (tr, tc), so that a consumer joins the tiles it
needs and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH = 6378137.0
TILE = 64


def cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """(r, c) of a grid, generated in parallel."""
    return spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))


def hills(spark: SparkSession, n: int, res: float = 10.0) -> DataFrame:
    """Smooth terrain with a bump, n x n cells (x = c res, y = r res)."""
    x, y = F.col("c") * res, F.col("r") * res
    z = 2500 + 220 * F.sin(x / 800) * F.cos(y / 1300) + 380 * F.exp(-(((x - 7000) / 350) ** 2)) + 0.012 * y
    return cells(spark, n, n).withColumn("z", z)


def rolling(spark: SparkSession, n: int) -> DataFrame:
    """Rolling terrain whose cell coordinates are the argument of the waves."""
    return cells(spark, n, n).withColumn("z", 2100 + 80 * F.sin(F.col("c") / 18) + 50 * F.cos(F.col("r") / 22) + 0.2 * F.col("r"))


def with_cover(grid: DataFrame) -> DataFrame:
    """Closed-form tree, shrub and herb fractions; every 37th cell's tree and every 41st cell's shrub are unknown."""
    k = F.col("r") * 131 + F.col("c") * 17
    tree = F.when(k % 37 == 0, None).otherwise(((F.col("r") * 7 + F.col("c") * 3) % 100) / 100.0)
    shrub = F.when(k % 41 == 0, None).otherwise(((F.col("r") * 5 + F.col("c") * 11) % 60) / 100.0)
    return grid.withColumn("tree", tree).withColumn("shrub", shrub).withColumn("herb", ((F.col("r") + F.col("c") * 2) % 50) / 100.0)


def centre(x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """(x, y) of a cell's centre in a north-up grid."""
    return x0 + (F.col("c") + 0.5) * res, y0 - (F.col("r") + 0.5) * res


def cell_of(x: Column, y: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """(row, column) that holds a point, by floor."""
    return F.floor((y0 - y) / res).cast("int"), F.floor((x - x0) / res).cast("int")


def contract(meta: DataFrame) -> DataFrame:
    """Grids that break the contract, one row for each fault: (id, fault). meta: id, bands, unit, rotation, dx, dy, rows, cols, unknown_cells."""
    faults = {
        "bands": F.col("bands") != 1,
        "unit": ~F.col("unit").eqNullSafe("m"),
        "rotated": F.col("rotation") != 0,
        "north_up": (F.col("dx") <= 0) | (F.col("dy") >= 0),
        "square": F.abs(F.col("dx") + F.col("dy")) > 1e-9,
        "size": F.col("rows") * F.col("cols") > 3_000_000,
        "no_data": F.col("unknown_cells") > 0,
    }
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in faults.items())), lambda f: f.isNotNull())
    return meta.select("id", F.explode(found).alias("fault"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries whose content is absent or differs: (path, expected, found). files: path, content."""
    have = files.select("path", F.sha2("content", 256).alias("found"))
    return manifest.select("path", F.col("sha256").alias("expected")).join(have, "path", "left").where("not expected <=> found")


def coarsen(grid: DataFrame, k: int, values: list[str]) -> DataFrame:
    """Means over k x k blocks, unknown cells left out."""
    blocks = grid.groupBy(F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c"))
    return blocks.agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))


def sample_bilinear(grid: DataFrame, points: DataFrame, rows: int, cols: int) -> DataFrame:
    """points (id, pr, pc: fractional row and column) with z by bilinear weights, edges extended: four keyed lookups.

    Sizes of exploded rows are taken for those of the rows before, so the lookups name their join: no side of it is sent to every task.
    """
    r0, c0 = F.floor("pr"), F.floor("pc")
    fr, fc = F.col("pr") - r0, F.col("pc") - c0
    corner = lambda dr, dc: F.struct(
        F.least(F.greatest(r0 + dr, F.lit(0)), F.lit(rows - 1)).cast("int").alias("r"),
        F.least(F.greatest(c0 + dc, F.lit(0)), F.lit(cols - 1)).cast("int").alias("c"),
        ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("w"),
    )
    asked = points.withColumn("__k", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1))))).select("*", "__k.r", "__k.c", "__k.w").drop("__k")
    keys = [c for c in points.columns]
    return asked.hint("merge").join(grid.select("r", "c", "z"), ["r", "c"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def sample_nearest(grid: DataFrame, points: DataFrame, x0: float, y0: float, res: float, outside: str = "drop") -> DataFrame:
    """points (id, x, y) with the value of the cell that holds them; points outside the grid are left out, or raise with outside="error"."""
    r, c = cell_of(F.col("x"), F.col("y"), x0, y0, res)
    asked = points.withColumn("r", r).withColumn("c", c)
    if outside != "error":
        return asked.join(grid, ["r", "c"])
    held = asked.join(grid.withColumn("__in", F.lit(True)), ["r", "c"], "left")
    return held.where(F.coalesce("__in", F.raise_error(F.concat(F.lit("outside the grid: "), F.col("id").cast("string"))).cast("boolean"))).drop("__in")


def cell_cut(x: Column, y: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """(row, column) by cutting towards zero: unlike `cell_of`, points up to a cell above or left of the grid fall into its first row or column."""
    return ((y0 - y) / res).cast("int"), ((x - x0) / res).cast("int")


def corner_triangles(grid: DataFrame, points: DataFrame, rows: int, cols: int) -> DataFrame:
    """points (id, pr, pc) with z on the two triangles of each square of cell centres, cut along the diagonal from its first corner; NULL outside, or where a corner of the triangle is unknown: nothing bridges it."""
    r, c = F.least(F.greatest(F.floor("pr"), F.lit(0)), F.lit(rows - 2)).cast("int"), F.least(F.greatest(F.floor("pc"), F.lit(0)), F.lit(cols - 2)).cast("int")
    p = points.withColumn("__r", r).withColumn("__c", c)
    at = F.array(*(F.struct((F.col("__r") + i).alias("r"), (F.col("__c") + j).alias("c"), F.lit(n).alias("n")) for i, j, n in ((0, 0, "a"), (0, 1, "b"), (1, 0, "d"), (1, 1, "e"))))
    seen = p.select("id", F.explode(at).alias("k")).select("id", "k.*").hint("merge").join(grid.select("r", "c", "z"), ["r", "c"])
    four = seen.groupBy("id").agg(*(F.max(F.when(F.col("n") == n, F.col("z"))).alias(f"__{n}") for n in "abde"))
    fr, fc = F.col("pr") - F.col("__r"), F.col("pc") - F.col("__c")
    inside = (F.col("pr") >= 0) & (F.col("pc") >= 0) & (F.col("pr") <= rows - 1) & (F.col("pc") <= cols - 1)
    above = F.col("__a") * (1 - fc) + F.col("__b") * (fc - fr) + F.col("__e") * fr
    below = F.col("__a") * (1 - fr) + F.col("__e") * fc + F.col("__d") * (fr - fc)
    return p.join(four.hint("merge"), "id", "left").withColumn("z", F.when(inside, F.when(fr <= fc, above).otherwise(below))).drop("__r", "__c", *(f"__{n}" for n in "abde"))


def tiles(grid: DataFrame, value: str = "z", size: int = TILE) -> DataFrame:
    """(tr, tc, p, v): each tile's positions (row * size + column in the tile) and values, as two arrays."""
    at = F.pmod("r", F.lit(size)) * size + F.pmod("c", F.lit(size))
    by = grid.groupBy(F.floor(F.col("r") / size).cast("int").alias("tr"), F.floor(F.col("c") / size).cast("int").alias("tc"))
    held = by.agg(F.collect_list(F.struct(at.cast("int").alias("p"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"))).alias("x"))
    return held.select("tr", "tc", F.col("x.p").alias("p"), F.col("x.v").alias("v"))


def load_verified(spark: SparkSession, files: DataFrame, manifest: DataFrame, layers: dict[str, str]) -> DataFrame:
    """The grid of Parquet layers {name: path} as one cell table (r, c, a column a layer), read only if every file of the manifest is there as it was sealed; raises with the first faults otherwise."""
    faults = verified(files, manifest).orderBy("path").limit(5).collect()
    if faults:
        raise ValueError("not as sealed: " + ", ".join(r["path"] for r in faults))
    grid = None
    for name, path in layers.items():
        layer = spark.read.parquet(path).select("r", "c", F.col("value").alias(name))
        grid = layer if grid is None else grid.join(layer, ["r", "c"], "full")
    return grid
