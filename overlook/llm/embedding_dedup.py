"""Embedding near-dedup by a subspace pigeonhole join.

Vectors are scaled to length one and rotated, then split into BLOCKS runs of dimensions. Cosine >= c means
a squared distance of at most 2 - 2c, so some block has at most its proportional share,
(2 - 2c) / BLOCKS: a range join in each block under that budget meets every pair. The rotation's axes are
the principal ones of a bounded sample (FIT_ROWS vectors about their labels' means), dealt to the blocks in
turn, so that the first dimensions of each block spread the most; any rotation gives the same result. The
join lays a grid as wide as the budget's radius over the block's first GRID dimensions; a vector goes to
its own cell and, as a visitor, to those among half of the cells around it that its radius reaches, so that
two neighbours meet in one cell once. The union of candidates is verified exactly: a pair is decided in
single precision only where that is further from the threshold than its error can be, and otherwise by the
cosine of the vectors as given in double precision (scaled by powers of two, so that no
square of a tiny or huge component is lost); each pair counts in the first block that holds it.
Only equal labels meet, for the label, of any type and compared by its text, is part of the cell.

Equal vectors of a label are one member with a count. Rotated vectors are computed once and travel as
bytes; cells of any size are cut into blocks of CELL_BYTES (pairs.py) and compared tile by tile, and a
task returns counts and a spanning forest, never pairs.

Edge cases: rows whose label is null, or whose vector is null, empty, zero, or holds null or non-finite
components, link with nothing; vectors of different lengths don't link with each other; repeated rows are rows (each links with the other);
components join vectors and not ids, so rows that repeat a vec_id share one only where links reach; a null vec_id
is compared and counted, its kept is null, and its component is null only where no row of the component has an id; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, mix, table
from .components import components
from .pairs import LINKS_DDL, Links, by_group, in_blocks

COSINE = 0.93
#: Runs of dimensions, and how many dimensions of each the grid covers.
BLOCKS, GRID = 4, 2
#: Vectors that the rotation is fitted on.
FIT_ROWS = 2048
#: Bytes of a cell's vectors that one side of a comparison holds, and members that a tile compares.
CELL_BYTES, TILE = 16 << 20, 1024
#: Relative and absolute allowance for vectors rounded to single precision.
SLACK, ROUNDED = 1e-4, 1e-5


def rotation(dims: int, sample: np.ndarray | None = None) -> np.ndarray:
    """Axes as columns: the sample's principal ones, dealt to the blocks in turn; random ones without a sample."""
    if sample is None or len(sample) < 2:
        q, r = np.linalg.qr(np.random.default_rng(2).normal(size=(dims, dims)))
        return q * np.sign(np.diag(r))
    _, axes = np.linalg.eigh(sample.T @ sample)
    ranked = iter(axes.T[::-1])
    out = np.zeros((dims, dims))
    blocks = runs(dims)
    for k in range(dims):
        for lo, hi in blocks:
            if lo + k < hi:
                out[:, lo + k] = next(ranked)
    return out


def runs(dims: int) -> list[tuple[int, int]]:
    """The blocks' dimensions; fewer blocks if there are fewer dimensions."""
    cuts = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def budget(cosine: float, blocks: int) -> float:
    return (2 - 2 * cosine) / blocks * (1 + SLACK) + ROUNDED


#: Steps to the cells that a vector may visit: of each pair of opposite neighbours, one.
def forward(grid: int) -> np.ndarray:
    return np.array([s for s in product((-1, 0, 1), repeat=grid) if s > (0,) * grid], np.int64).reshape(-1, grid)


def _cell_hash(block: int, cells: np.ndarray) -> np.ndarray:
    h = np.full(len(cells), block + 1, np.uint64)
    for k in range(cells.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, k].astype(np.uint64))
    return h.view(np.int64)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """rows times powers of two that bring their largest components near 1: the cosine's bits stay, and no square leaves the range of doubles."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def fit(reps: DataFrame) -> dict[int, np.ndarray]:
    """The rotation for the commonest length among at most FIT_ROWS vectors, the ones of the least hashes."""
    rows = [(r.label, r.embedding) for r in bounded_sample(reps.select("rep", "label", "embedding"), FIT_ROWS, "rep").collect()]
    if not rows:
        return {}
    sizes, counts = np.unique([len(v) for _, v in rows], return_counts=True)
    dims = int(sizes[counts.argmax()])
    x = _unit(np.array([v for _, v in rows if len(v) == dims], np.float64))
    _, owner = np.unique([label for label, v in rows if len(v) == dims], return_inverse=True)
    means = np.stack([np.bincount(owner, x[:, k]) for k in range(dims)], axis=1) / np.bincount(owner)[:, None]
    return {dims: rotation(dims, x - means[owner])}


def slots(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(cells, whether each is reached) of rotated vectors: for each block the home cell and then the forward ones."""
    dims = x.shape[1]
    blocks = runs(dims)
    most = budget(cosine, len(blocks))
    width = np.sqrt(most) * (1 + SLACK)
    cells, reached = [], []
    for b, (lo, hi) in enumerate(blocks):
        place = x[:, lo : lo + min(GRID, hi - lo)].astype(np.float64) / width
        home = np.floor(place).astype(np.int64)
        inside = place - home
        for step in (np.zeros(home.shape[1], np.int64), *forward(home.shape[1])):
            gap = np.where(step > 0, 1 - inside, np.where(step < 0, inside, 0))
            cells.append(_cell_hash(b + 97 * dims, home + step))
            reached.append((gap * gap).sum(1) <= 1 + SLACK)
    return np.stack(cells, axis=1), np.stack(reached, axis=1)


PLACED_DDL = "label string, rep long, vec_id long, copies long, raw binary, turned binary, cells array<long>"


def _placed(cosine: float, axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            values = column.flatten().to_numpy(zero_copy_only=False)
            first = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
            raws: list[bytes] = [b""] * batch.num_rows
            turned, out = list(raws), [None] * batch.num_rows
            for dims in np.unique(np.diff(first)):
                rows = np.flatnonzero(np.diff(first) == dims)
                raw = _scaled(values[first[rows][:, None] + np.arange(dims)])
                x = (_unit(raw) @ (axes[dims] if dims in axes else rotation(int(dims)))).astype(np.float32)
                cells, reached = slots(x, cosine)
                for i, r in enumerate(rows):
                    raws[r], turned[r] = raw[i].tobytes(), x[i].tobytes()
                    out[r] = np.where(reached[i], cells[i], None).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("rep"), batch.column("vec_id"), batch.column("copies"), pa.array(raws, pa.binary()), pa.array(turned, pa.binary()), pa.array(out, pa.list_(pa.int64()))],
                names=["label", "rep", "vec_id", "copies", "raw", "turned", "cells"],
            )

    return run


def _verify(cosine: float, tile: int):
    def handle(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, copies, own, slot = (group.column(c).to_numpy() for c in ("rep", "copies", "own", "slot"))
        turned, raws = group.column("turned").to_pylist(), group.column("raw").to_pylist()
        size = len(turned[0])
        same = np.array([len(v) == size for v in turned])  # a hash of cells could mix lengths
        ids, copies, own, slot = ids[same], copies[same], own[same], slot[same]
        dims = size // 4
        x = np.frombuffer(b"".join(v for v in turned if len(v) == size), np.float32).reshape(-1, dims)
        raw = np.frombuffer(b"".join(v for v in raws if len(v) == 2 * size), np.float64).reshape(-1, dims)
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        blocks = runs(dims)
        # slots are home and visited cells, block after block
        ends, width = [], []
        for lo, hi in blocks:
            width.append(1 + len(forward(min(GRID, hi - lo))))
            ends.append((ends[-1] if ends else 0) + width[-1])
        block = int(np.searchsorted(ends, slot[0], side="right"))
        home = slot == ends[block] - width[block]
        lo, hi = blocks[block]
        most, doubt = budget(cosine, len(blocks)), 1e-6 + 3e-7 * dims
        part = np.ascontiguousarray(x[:, lo:hi])
        norm = (part * part).sum(1)
        links = Links(ids, copies)

        def compare(left: np.ndarray, right: np.ndarray) -> None:
            d = part[left] @ part[right].T
            d *= -2
            d += norm[left][:, None]
            d += norm[right]
            i, j = np.nonzero(d <= most + ROUNDED)
            if bi == bj:  # two at home meet in both orders
                once = ~home[right[j]] | (left[i] < right[j])
                i, j = i[once], j[once]
            if not len(i):
                return
            if 16 * len(i) > d.size:
                cos = (x[left] @ x[right].T)[i, j]
            else:
                cos = (x[left[i]] * x[right[j]]).sum(1)
            take = cos >= cosine - doubt
            i, j, cos = left[i[take]], right[j[take]], cos[take]
            near = np.flatnonzero(cos < cosine + doubt)
            u, v = raw[i[near]], raw[j[near]]
            sure = np.ones(len(i), bool)
            sure[near] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= cosine
            i, j = i[sure], j[sure]
            for a in range(0, len(i), 1 << 16):
                p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                gap = (x[p] - x[q]) ** 2  # the same in every block's task, so that one alone counts the pair
                inside = np.stack([gap[:, s:e].sum(1) <= most for s, e in blocks[: block + 1]], axis=1)
                first = inside[:, block] & ~inside[:, :block].any(axis=1)
                links.add(p[first], q[first])

        at_home, all_i, all_j = np.flatnonzero((own == bi) & home), np.flatnonzero((own == bi) & ~home), np.flatnonzero(own == bj)
        sides = [(at_home, all_j)] if bi == bj else [(at_home, all_j), (np.flatnonzero((own == bj) & home), all_i)]
        for left, right in sides:
            for a in range(0, len(left), tile):
                for c in range(0, len(right), tile):
                    compare(left[a : a + tile], right[c : c + tile])
        yield from links.rows()

    return by_group(["label", "cell", "bi", "bj"], handle)


def near(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding, label)."""
    finite = F.expr("coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0), false)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # one zero
    same = [F.xxhash64("label", "embedding").alias("same"), F.xxhash64(F.lit(1), "embedding", "label").alias("same2")]
    marked = rows.select("*", (F.col("label").isNotNull() & finite).alias("fit"), *same)
    rep = F.xxhash64("same", "same2").alias("rep")
    good = marked.where("fit")
    reps = good.groupBy("same", "same2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = materialize(reps.select(rep, "label", "vec_id", "copies", "embedding"), "vectors")
    placed = reps.select("label", "rep", "vec_id", "copies", "embedding").mapInArrow(_placed(cosine, fit(reps)), PLACED_DDL)
    placed = materialize(placed, "cells")
    where = placed.select("label", F.octet_length("raw").alias("size"), F.explode("cells").alias("cell")).where("cell is not null")
    crowds = where.groupBy("label", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1")
    crowds = materialize(crowds.select("label", "cell", F.ceil(F.col("size") / F.lit(CELL_BYTES)).cast("int").alias("blocks")), "crowds")
    members = placed.select("label", "rep", "copies", "raw", "turned", F.posexplode("cells").alias("slot", "cell")).where("cell is not null")
    found = materialize(in_blocks(members, crowds, ["label", "cell"], "rep").mapInArrow(_verify(cosine, TILE), LINKS_DDL), "near")
    links = found.groupBy(F.col("member").alias("rep")).agg(F.sum("links").alias("links"))
    # components go by rep, one node for each distinct vector; ids are looked up for the components that result
    classes = components(found.where("member <> root").select(F.col("member").alias("a"), F.col("root").alias("b")).distinct()).toDF("rep", "node").distinct()
    least = classes.join(placed.select("rep", "vec_id"), "rep").groupBy("node").agg(F.min("vec_id").alias("component"))
    classes = classes.join(least, "node").select("rep", "component")
    final = placed.select("rep", "vec_id", "copies").join(links, "rep", "left").join(classes, "rep", "left")
    final = final.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked_rows = marked.select("vec_id", "fit", rep)
    out = linked_rows.where("fit").join(final, "rep").select("vec_id", "n_links", "component_id")
    out = out.union(linked_rows.where("not fit").select("vec_id", F.lit(0).cast("long"), F.when(~F.col("fit"), F.col("vec_id"))))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))
