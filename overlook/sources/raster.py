"""Rasters as blocks of cells: a data source that checks the grid's contract and reads only the blocks that a filter needs.

A raster is a folder with meta.json (bands, unit, rotation, dx, dy, x0, y0, rows, cols, block, and the SHA-256 of each block) and one file of
little-endian doubles for each block of block x block cells. `register(spark)` makes it known; then

    spark.read.format("grid_blocks").load(path).where("r < 100")

has a partition for each block, and leaves out blocks that comparisons of r and c with constants rule out. Paths may name any store that Arrow
reads. Each fault of the contract raises, as does a block that differs from its seal or holds an unknown cell; `contract=false` reads such grids, unknown cells as NULL.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

MOST_CELLS = 3_000_000
FORMAT = "grid_blocks"
#: Pushes filters to Python sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str) -> bytes:
    store, place = _store(path)
    with store.open_input_stream(place) as f:
        return f.read()


def faults(meta: dict) -> list[str]:
    """What the contract forbids, by name: one band, metres, no rotation, north up, square cells, a bounded number of them."""
    found = {
        "bands": meta.get("bands") != 1,
        "unit": meta.get("unit") != "m",
        "rotated": meta.get("rotation") != 0,
        "north_up": not (meta.get("dx", 0) > 0 and meta.get("dy", 0) < 0),
        "square": abs(meta.get("dx", 0) + meta.get("dy", 1)) > 1e-8,
        "size": meta.get("rows", 0) * meta.get("cols", 0) > MOST_CELLS,
    }
    return [name for name, bad in found.items() if bad]


class Block(InputPartition):
    def __init__(self, br: int, bc: int):
        self.br, self.bc = br, bc


class _Reader(DataSourceReader):
    def __init__(self, path: str, strict: bool):
        self.path, self.strict = path.rstrip("/"), strict
        self.meta = json.loads(_read(f"{self.path}/meta.json"))
        bad = faults(self.meta) if strict else []
        if bad:
            raise ValueError(f"{path} breaks the grid contract: {', '.join(bad)}")
        self.span = {"r": [0, self.meta["rows"] - 1], "c": [0, self.meta["cols"] - 1]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons narrow the span of rows and columns; all of them are still checked on the cells by Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if name in self.span and isinstance(f.value, (int, float)):
                low, high = self.span[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, math.floor(f.value) if not isinstance(f, GreaterThan) else math.floor(f.value) + 1)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, math.ceil(f.value) if not isinstance(f, LessThan) else math.ceil(f.value) - 1)
                self.span[name] = [low, high]
            yield f

    def partitions(self) -> list[Block]:
        n = self.meta["block"]
        (r0, r1), (c0, c1) = self.span["r"], self.span["c"]
        return [Block(i, j) for i in range(r0 // n, r1 // n + 1) for j in range(c0 // n, c1 // n + 1)] if r0 <= r1 and c0 <= c1 else []

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block is left
            return
        n, (i, j) = self.meta["block"], (partition.br, partition.bc)
        raw = _read(f"{self.path}/{i}_{j}.f8")
        if hashlib.sha256(raw).hexdigest() != self.meta["sha256"][f"{i}_{j}"]:
            raise ValueError(f"block {i}, {j} of {self.path} differs from its seal")
        rows, cols = min(n, self.meta["rows"] - i * n), min(n, self.meta["cols"] - j * n)
        z = np.frombuffer(raw, "<f8").reshape(rows, cols)
        known = np.isfinite(z)
        if self.strict and not known.all():
            raise ValueError(f"block {i}, {j} of {self.path} holds unknown cells: sightlines over them can't be told")
        r, c = np.divmod(np.arange(rows * cols), cols)
        yield pa.RecordBatch.from_arrays([pa.array((r + i * n).astype(np.int32)), pa.array((c + j * n).astype(np.int32)), pa.array(z.ravel(), mask=~known.ravel())], names=["r", "c", "z"])


class GridBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "r int, c int, z double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], str(self.options.get("contract", "true")).lower() != "false")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridBlocks)
    spark.conf.set(PUSHDOWN, "true")


def _bytes(cells: pd.DataFrame, i: int, j: int, block: int, rows: int, cols: int) -> bytes:
    """Block i, j of a raster of rows x cols, from its cells."""
    a = np.full((min(block, rows - i * block), min(block, cols - j * block)), np.nan)
    a[cells.r - i * block, cells.c - j * block] = cells.z
    return a.astype("<f8").tobytes()


def write_areas(grid: DataFrame, path: str, block: int, x0: float, y0: float, res: float, unit: str = "m", most: int = MOST_CELLS) -> list[tuple[int, int, int, int]]:
    """grid (r, c, z) of any size as rasters of at most `most` cells, each as `write_blocks` writes it, in a folder of its own under the path: whole blocks, bands of full rows where they fit.

    Returns (first row, first column, rows, columns) of each; its folder is named by the first two. Seals stay with the tasks that write an area's frame.
    """
    rows, cols = grid.agg(F.max("r") + 1, F.max("c") + 1).first()
    if block * block > most:
        raise ValueError(f"a block of {block * block} cells is more than {most}")
    wide = cols if cols * block <= most else most // block // block * block
    high = most // wide // block * block
    base = path.rstrip("/")

    def extent(r0: int, c0: int) -> tuple[int, int]:
        return min(high, rows - r0), min(wide, cols - c0)

    def put(key, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0, i, j = map(int, key)
        raw = _bytes(cells, i, j, block, *extent(r0, c0))
        store, place = _store(f"{base}/{r0}_{c0}")
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/{i}_{j}.f8") as f:
            f.write(raw)
        return pd.DataFrame({"r0": [r0], "c0": [c0], "block": [f"{i}_{j}"], "sha256": [hashlib.sha256(raw).hexdigest()]})

    def seal(key, blocks: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = map(int, key)
        n, m = extent(r0, c0)
        seals = dict(zip(blocks.block, blocks.sha256))
        _whole(seals, n, m, block)
        store, place = _store(f"{base}/{r0}_{c0}")
        _frame(store, place, seals, x0 + c0 * res, y0 - r0 * res, res, n, m, block, unit)
        return pd.DataFrame({"r0": [r0], "c0": [c0], "rows": [n], "cols": [m]})

    first = lambda c, n: (F.floor(F.col(c) / n) * n).cast("int")
    g = grid.select("r", "c", F.col("z").cast("double").alias("z")).withColumn("r0", first("r", high)).withColumn("c0", first("c", wide)).withColumn("r", F.col("r") - F.col("r0")).withColumn("c", F.col("c") - F.col("c0"))
    g = g.withColumn("br", F.floor(F.col("r") / block).cast("int")).withColumn("bc", F.floor(F.col("c") / block).cast("int"))
    sealed = g.groupBy("r0", "c0", "br", "bc").applyInPandas(put, "r0 int, c0 int, block string, sha256 string").groupBy("r0", "c0").applyInPandas(seal, "r0 int, c0 int, rows int, cols int")
    areas = sorted(tuple(a) for a in sealed.collect())
    lost = {(r, c) for r in range(0, rows, high) for c in range(0, cols, wide)} - {a[:2] for a in areas}
    if lost:
        raise ValueError("no cells at all in areas " + ", ".join(f"{r}_{c}" for r, c in sorted(lost)[:5]))
    return areas


def read_areas(spark: SparkSession, path: str, areas: list[tuple[int, int, int, int]], r: tuple[int, int], c: tuple[int, int]) -> DataFrame:
    """(r, c, z) of `write_areas` from row r[0] to before r[1] and column c[0] to before c[1]: areas and blocks beside them are left out."""
    register(spark)
    out = spark.createDataFrame([], "r int, c int, z double")
    for r0, c0, rows, cols in areas:
        if r0 < r[1] and r[0] < r0 + rows and c0 < c[1] and c[0] < c0 + cols:
            here = spark.read.format(FORMAT).load(f"{path.rstrip('/')}/{r0}_{c0}").where((F.col("r") >= r[0] - r0) & (F.col("r") < r[1] - r0) & (F.col("c") >= c[0] - c0) & (F.col("c") < c[1] - c0))
            out = out.union(here.select((F.col("r") + r0).alias("r"), (F.col("c") + c0).alias("c"), "z"))
    return out


def _whole(seals: dict[str, str], rows: int, cols: int, block: int) -> None:
    """Raises if a block of the raster has no seal."""
    lost = [f"{i}_{j}" for i in range(-(-rows // block)) for j in range(-(-cols // block)) if f"{i}_{j}" not in seals]
    if lost:
        raise ValueError("no cells at all in blocks " + ", ".join(lost[:5]))


def _frame(store, place: str, seals: dict[str, str], x0: float, y0: float, res: float, rows: int, cols: int, block: int, unit: str) -> None:
    meta = {"bands": 1, "unit": unit, "rotation": 0, "dx": res, "dy": -res, "x0": x0, "y0": y0, "rows": rows, "cols": cols, "block": block, "sha256": seals}
    with store.open_output_stream(f"{place}/meta.json") as f:
        f.write(json.dumps(meta).encode())


def write_blocks(grid: DataFrame, path: str, block: int, x0: float, y0: float, res: float, unit: str = "m") -> None:
    """grid (r, c, z) as one raster folder: a task writes each block whole, under its final name, so that a task run twice writes the same; then the seals and the frame go to meta.json."""
    rows, cols = grid.agg(F.max("r") + 1, F.max("c") + 1).first()
    store, place = _store(path.rstrip("/"))
    store.create_dir(place, recursive=True)

    def put(key, cells: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        raw = _bytes(cells, i, j, block, rows, cols)
        store, place = _store(path.rstrip("/"))
        with store.open_output_stream(f"{place}/{i}_{j}.f8") as f:
            f.write(raw)
        return pd.DataFrame({"block": [f"{i}_{j}"], "sha256": [hashlib.sha256(raw).hexdigest()]})

    at = lambda c: F.floor(F.col(c) / block).cast("int")
    seals = {s.block: s.sha256 for s in grid.select("r", "c", F.col("z").cast("double").alias("z"), at("r").alias("br"), at("c").alias("bc")).groupBy("br", "bc").applyInPandas(put, "block string, sha256 string").collect()}
    _whole(seals, rows, cols, block)
    _frame(store, place, seals, x0, y0, res, rows, cols, block, unit)
