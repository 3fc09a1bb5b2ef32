"""Vector compression: integer product codes, their codebooks searched by annular norm pruning.

Each component x becomes floor(SCALE * x); a vector is cut into PARTS equal consecutive parts. A part position's codebook
starts as that part of the ENTRIES vectors of least vec_id; ROUNDS times every part goes to its nearest entry and every
entry becomes the componentwise floor of its parts' mean. The last codebooks give the codes.

The nearest entry of a part p: entries lie sorted by norm. An entry nearer than the best distance d so far has a norm within
d of |p|, by the triangle inequality, so binary search gives the interval of entries that are still possible: the annulus. The entries
beside |p| give the first d; then the annulus alone is evaluated, and cut anew as d falls. Its ends are inclusive and a hair wider than d, so that no entry
at the same distance is missed; distances are exact integers, ties go to the lower index. Parts of like norm share these steps.

A round is one pass over the vectors: a task sends a row for each entry that it met (sums and count), and the codebooks, PARTS x ENTRIES
x width integers whatever the table holds, come to the driver and go out with the next pass. The last pass is written, so that
sums by label and rows come from one table.

Edge cases: vectors that are null, or hold null or non-finite components, are dropped. A vector's length must be that of most of the
codebooks' first vectors (ties: the longer), and its components below LIMIT / SCALE in size: other rows stay, with null code and
error. That length must be a multiple of PARTS, else ValueError. Equal vec_ids start codebooks in the order of their vectors, null vec_ids come
last; repeated rows count each time. With fewer than ENTRIES vectors, codebooks are smaller. An entry with no parts stays. label_error sums
known errors of equal labels, null labels together (null if a label has none). An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integer components are smaller than this, so that squared distances of parts of up to 64 components fit 64 bits.
LIMIT = 1 << 27
#: Parts of like norm that share an annulus, and entries on either side of their norms that give the first distances.
BLOCK, BESIDE = 128, 4


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (points, entries) of integer vectors: a product of doubles where none of its sums can leave 53 bits, else differences of 64-bit integers."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * max(1, points.shape[1]) < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None]).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for x, y in zip(points.T, entries.T):
        out += (x[:, None] - y[None]) ** 2
    return out


class Annuli:
    """Entries sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.index, self.entries = np.argsort(norms, kind="stable"), entries
        self.norms = norms[self.index]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance, distances evaluated) of each point; ties go to the lower index.

        Points go in blocks of like norm. A block looks at the entries beside its own norms, then at those further out, in steps that
        grow; a point leaves once what has been looked at covers its annulus, and no step goes beyond the annuli of those that are left.
        """
        norm = np.sqrt((points.astype(np.float64) ** 2).sum(1))
        index, dist, work = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max), 0
        order = np.argsort(norm, kind="stable")
        for first in range(0, len(points), BLOCK):
            rows = order[first : first + BLOCK]
            left, right = np.searchsorted(self.norms, norm[rows[[0, -1]]])
            seen, low, high, step = slice(left, left), 0, len(self.norms), BESIDE
            while len(rows):
                now = slice(max(low, left - step), min(high, right + step))
                now = slice(min(now.start, seen.start), max(now.stop, seen.stop))
                found = np.sort(np.concatenate([self.index[now.start : seen.start], self.index[seen.stop : now.stop]]))  # by index, as the first of equal distances wins
                if len(found):
                    d = distances(points[rows], self.entries[found])
                    at = d.argmin(1)
                    d, at = d[np.arange(len(rows)), at], found[at]
                    better = (d < dist[rows]) | ((d == dist[rows]) & (at < index[rows]))
                    dist[rows[better]], index[rows[better]] = d[better], at[better]
                    work += len(rows) * len(found)
                reach = np.sqrt(dist[rows].astype(np.float64))
                reach += 1e-12 * (reach + norm[rows]) + 1e-9
                lows = np.searchsorted(self.norms, norm[rows] - reach, side="left")
                highs = np.searchsorted(self.norms, norm[rows] + reach, side="right")
                open_ = (lows < now.start) | (highs > now.stop)
                rows, seen, step = rows[open_], now, step * 4
                low, high = lows[open_].min(initial=len(self.norms)), highs[open_].max(initial=0)
        return index, dist, work


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integer components of all vectors in turn, each vector's first one and their number, whether it is kept, whether none of them reaches LIMIT)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    values = np.floor(values * SCALE)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    none_of = lambda flags: (so_far := np.concatenate([[0], np.cumsum(flags)]))[end] == so_far[end - size]
    return values, end - size, size, there & none_of(~np.isfinite(values)), none_of(~(np.abs(values) < LIMIT))


def fitting(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are kept, of these the ones that can be coded, their vectors as integers)."""
    values, first, size, kept, small = integers(column)
    fit = kept & small & (size == length)
    return kept, fit[kept], values[first[fit][:, None] + np.arange(length)].astype(np.int64)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ENTRIES kept rows of each batch that can start a codebook."""
    for batch in batches:
        values, first, size, kept, small = integers(batch.column("embedding"))
        ids = batch.column("vec_id").to_pylist()
        rows = [(ids[i], values[first[i] : first[i] + size[i]].astype(np.int64).tolist()) for i in np.flatnonzero(kept & small)]
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:ENTRIES]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.list_(pa.int64()))], names=["vec_id", "v"])


def first_books(rows: DataFrame) -> np.ndarray:
    """(PARTS, entries, width): the parts of the ENTRIES kept vectors of least vec_id."""
    first = rows.select("vec_id", "embedding").mapInArrow(_first, "vec_id long, v array<long>").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    lengths = [len(r.v) for r in first]
    length = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    if length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")
    first = [r.v for r in first if len(r.v) == length]
    first = np.array(first, np.int64).reshape(len(first), PARTS, length // PARTS)
    return first.transpose(1, 0, 2)


def assigned(vectors: np.ndarray, annuli: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances), both (n, PARTS)."""
    parts = vectors.reshape(len(vectors), PARTS, vectors.shape[1] // PARTS)
    index, dist = np.zeros((2, len(vectors), PARTS), np.int64)
    for p, a in enumerate(annuli):
        index[:, p], dist[:, p], _ = a.nearest(np.ascontiguousarray(parts[:, p]))
    return index, dist


def _sums(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, (parts, k, width) = [Annuli(b) for b in books], books.shape
        total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            vectors = fitting(batch.column("embedding"), parts * width)[2]
            index = (assigned(vectors, annuli)[0] + np.arange(parts) * k).ravel()
            count += np.bincount(index, minlength=parts * k)
            np.add.at(total, index, vectors.reshape(len(vectors) * parts, width))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["entry", "n", "total"])

    return run


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    width = books.shape[2]
    sums = rows.select("embedding").mapInArrow(_sums(books), "entry int, n long, total array<long>")
    sums = sums.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).cast("array<long>").alias("total"))
    out = books.reshape(-1, width).copy()
    for r in sums.collect():  # PARTS x ENTRIES rows at most
        out[r.entry] = [t // r.n for t in r.total]
    return out.reshape(books.shape)


def codebooks(rows: DataFrame) -> np.ndarray:
    books = first_books(rows)
    for _ in range(ROUNDS if books.size else 0):
        books = improved(rows, books)
    return books


def _codes(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, (parts, _, width) = [Annuli(b) for b in books], books.shape
        for batch in batches:
            kept, fit, vectors = fitting(batch.column("embedding"), parts * width)
            index, dist = assigned(vectors, annuli)
            code, error = np.full(len(fit), None, object), np.full(len(fit), None, object)
            code[fit] = [bytes(i).hex() for i in index.astype(np.uint8)]
            error[fit] = dist.sum(1)
            held = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(held), batch.column("label").filter(held), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def compress(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of rows(vec_id, embedding, label), codebooks)."""
    label = dict(rows.dtypes)["label"]
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = codebooks(rows)
    if not books.shape[1]:  # nothing to start a codebook with: rows that are kept, such as too large ones, have no code
        books = np.zeros((PARTS, 1, 0), np.int64)
    return rows.mapInArrow(_codes(books), f"vec_id long, label {label}, code string, error long"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors summed over equal labels. Sums are made before the shuffle; the join back may split a frequent label."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_errors(materialize(coded, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out, every part against every entry."""
    near = """{a} AS (
        SELECT vec_id, part, v, (best).entry AS entry, (best).d AS d FROM (
            SELECT p.vec_id, p.part, any_value(p.v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'entry': c.entry}}) AS best
            FROM p JOIN {c} c USING (part) GROUP BY ALL))"""
    again = """{n} AS (
        SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM {c} c LEFT JOIN (
            SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
                SELECT part, entry, i, sum(v[i]) AS s, count(*) AS n FROM {a}, range(1, 17) r(i) GROUP BY part, entry, i)
            GROUP BY part, entry) m USING (part, entry))"""
    steps = [
        f"""q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT vec_id, part, v[part * 16 + 1 : part * 16 + 16] AS v FROM q, range({PARTS}) r(part))",
        f"c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for i in range(ROUNDS):
        steps += [near.format(a=f"a{i}", c=f"c{i}"), again.format(n=f"c{i + 1}", c=f"c{i}", a=f"a{i}")]
    steps += [
        near.format(a="a", c=f"c{ROUNDS}"),
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})",
        "o AS (SELECT vec_id, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY vec_id)",
    ]
    steps = [s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN q USING (vec_id), h"


ORACLE = _oracle()
