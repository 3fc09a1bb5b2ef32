"""N-gram Jaccard join by MinHash banding.

A document's set is that of its 5-word shingles (words as they stand; a document of one to four words is
one shingle). Rows with equal sets become one class member with a count. Each member's signature of
BANDS x ROWS minima is cut into bands, chosen by `choose` so that a pair at the threshold shares a band
with probability RECALL or more; members that share a band are compared on their full sets of 64-bit
shingle hashes, and link at Jaccard similarity >= threshold.

Order of work: a narrow table (set hash, size, bands) is computed in one pass; bands met once go, and of
bands with the same members only one stays; only documents that are left have their sets built and sent.
Large groups are compared block by block (pairs.py), each pair once, in the first band that both share,
and a task returns counts and a spanning forest, never pairs.

Edge cases: null, empty and all-blank texts have no shingles, link with nothing and keep their own class;
rows with equal sets link with each other; classes join sets and not ids, so rows that repeat a doc_id share a
class only where their texts are linked; a null doc_id is compared and counted like any other, counts as larger
than every id, and its class is null only where no row of the class has an id; empty tables give empty results;
extra columns are ignored by `join` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import R_WORD, Words, boxed, keyed, materialize, mix, row_key, shuffle_parts, span_hash, steps, table, unboxed
from .components import components
from .pairs import LINKS_DDL, Links, by_group, in_blocks

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Members of a group that one side of a comparison holds; smaller blocks spread a large group over more tasks, and send its members more often.
BLOCK = 256


def choose(threshold: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): as few bands as reach the recall for pairs at the threshold."""
    miss = 1 - threshold**rows
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss > 0 else 1, rows


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the distinct shingles of each document, in ascending order."""
    w = Words(data, offs)
    n = len(offs) - 1
    if not len(w.doc):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    whole = w.count[w.doc]
    at = np.flatnonzero((w.rank + size <= whole) | ((whole < size) & (w.rank == 0)))
    ends = np.minimum(at + size, w.first[1:][w.doc[at]])
    h, doc = span_hash(w.hashes(), at, ends, R_WORD), w.doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _signatures(size: int, bands: int, rows: int):
    rng = np.random.default_rng(8)
    flip = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    times = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sign = np.zeros((n, bands), np.uint64)
            for lo, hi, data, offs in steps(batch.column("text")):
                h, first = shingles(data, offs, size)
                have = np.flatnonzero(np.diff(first))
                if not len(have):
                    continue
                at = first[have]
                count[lo:hi] = np.diff(first)
                a[lo + have] = np.add.reduceat(mix(h), at)
                b[lo + have] = np.add.reduceat(mix(h ^ np.uint64(R_WORD)), at)
                for band in range(bands):
                    out = np.full(len(have), band + 1, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        out = mix(out * np.uint64(R_WORD) + np.minimum.reduceat((h ^ flip[k]) * times[k], at))
                    sign[lo + have, band] = out
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(count > 0, bands, 0))].astype(np.int32)), pa.array(sign[count > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(count), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=["key", "doc_id", "size", "set_a", "set_b", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for _, _, data, offs in steps(batch.column("text")):
                h, first = shingles(data, offs, size)
                raw = h.tobytes()
                out += [raw[8 * i : 8 * j] for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("bands"), pa.array(out, pa.binary())], names=["rep", "copies", "bands", "set"])

    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], as a matrix."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(values, return_inverse=True)
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(left), len(right)))
    if not len(column):
        return out
    names, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(256, (4 << 20) // max(1, len(sets)))
    for a in range(0, len(names), width):
        lo, hi = np.searchsorted(column, (a, a + width))
        m = np.zeros((len(sets), min(width, len(names) - a)), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m[left] @ m[right].T
    return out


def _verify(threshold: float):
    def handle(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
        band = group.column("band")[0].as_py()
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        if not len(left) or not len(right):
            return
        both = overlaps(sets, left, right)
        close = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9
        i, j = np.nonzero(close)
        i, j = left[i], right[j]
        if bi == bj:
            i, j = i[i < j], j[i < j]
        bands = np.array(group.column("bands").to_pylist(), np.int64)  # 0 where the band was left out
        earlier = ((bands[i, :band] == bands[j, :band]) & (bands[i, :band] != 0)).any(axis=1)
        links = Links(ids, copies)
        links.add(i[~earlier], j[~earlier])
        yield from links.rows()

    return by_group(["bucket", "bi", "bj"], handle)


def join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """(key, doc_id, set_id, class_id, n_links) of every row: smallest doc_id with the same set, smallest doc_id that links reach, number of other rows linked directly."""
    return _classed(docs, threshold, shingle, recall).drop("keeper")


def _classed(docs: DataFrame, threshold: float, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """The columns of `join`, and keeper: the key of the least (doc_id, key) of the row's class, null for rows without shingles."""
    spark = docs.sparkSession
    bands, rows = choose(threshold, recall)
    texts = keyed(docs)
    signed = materialize(texts.mapInArrow(_signatures(shingle, bands, rows), "key long, doc_id long, size long, set_a long, set_b long, bands array<long>"), "signatures")
    there = signed.where("size > 0")
    reps = there.groupBy("set_a", "set_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    reps = materialize(reps.select("set_a", "set_b", F.col("one.doc_id").alias("set_id"), F.col("one.key").alias("rep"), "copies", "bands"), "sets")
    in_bands = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    met = in_bands.groupBy("band", "bucket").agg(
        F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")
    )
    met = met.where("n > 1").groupBy("n", "lo", "hi", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("one"))
    met = materialize(met.select("one.band", "one.bucket", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")), "buckets")
    # each member's bands that are left, by place; 0 elsewhere
    mine = in_bands.join(met, ["band", "bucket"]).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("left"))
    places = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.try_element_at("left", b), F.lit(0).cast("long")))
    mine = mine.join(reps.select("rep", "copies"), "rep").select(F.col("rep").alias("key"), "rep", "copies", places.alias("bands"))
    # rows that share a key are equal: one of them is enough
    held = texts.select("key", "text").repartition(shuffle_parts(spark), "key").join(mine.hint("shuffle_hash"), "key").dropDuplicates(["key"])
    members = held.select("rep", "copies", "bands", "text").mapInArrow(_sets(shingle), "rep long, copies long, bands array<long>, set binary")
    members = members.select("*", F.posexplode("bands").alias("band", "bucket")).where("bucket <> 0")
    found = materialize(in_blocks(members, met, ["band", "bucket"], "rep").mapInArrow(_verify(threshold), LINKS_DDL), "pairs")
    links = found.groupBy("member").agg(F.sum("links").alias("links"))
    # components go by rep, one node for each distinct set; ids are looked up for the classes that result
    classes = components(found.where("member <> root").select(F.col("member").alias("a"), F.col("root").alias("b")).distinct()).toDF("rep", "component").distinct()
    least = classes.join(reps.select("rep", "set_id"), "rep").groupBy("component").agg(F.min(F.struct(F.col("set_id").isNull().alias("none"), "set_id", "rep")).alias("least"))
    classes = classes.join(least, "component").select("rep", "least")
    final = reps.select("set_a", "set_b", "set_id", "rep", "copies").join(links.withColumnRenamed("member", "rep"), "rep", "left").join(classes, "rep", "left")
    final = final.select(
        "set_a",
        "set_b",
        "set_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("least").isNull(), F.col("set_id")).otherwise(F.col("least.set_id")).alias("class_id"),
        F.coalesce("least.rep", "rep").alias("keeper"),
    )
    out = there.join(final, ["set_a", "set_b"]).select("key", "doc_id", "set_id", "class_id", "n_links", "keeper")
    alone = signed.where("size = 0").select("key", "doc_id", F.col("doc_id").alias("set_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("keeper"))
    return out.union(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that of the least (doc_id, key); rows without shingles stay. Of rows that share a key, and so are equal in id and text, any one stays."""
    spark = docs.sparkSession
    found = _classed(docs, threshold).where("keeper is not null").groupBy("key").agg(F.first("keeper").alias("keeper"), F.count("*").alias("n"))
    copies = materialize(found.where("key <> keeper or n > 1").select("key", (F.col("key") == F.col("keeper")).alias("stays"), "n"), "copies")
    # keys of many rows go apart, so that their rows don't meet in one task
    many = copies.where("n > 1").select("key", "stays")
    gone = copies.where("n = 1").select("key")
    marked = boxed(docs, row_key())
    single = marked.join(many, "key", "left_anti").repartition(shuffle_parts(spark), "key").join(gone.hint("shuffle_hash"), "key", "left_anti")
    firsts = marked.join(many.where("stays"), "key", "left_semi").dropDuplicates(["key"])
    return unboxed(single, docs).union(unboxed(firsts, docs))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("key")
