"""Masks as bitmaps: one row a mask and bucket of BITS cells, instead of one a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a bucket: what one of the engine's bitmaps holds.
BITS = 32768
#: Masks of a bucket that one comparison unpacks.
CHUNK = 256


def packed(masks: DataFrame) -> DataFrame:
    """(id, bucket, bits) of masks (id, cell): a bitmap of BITS cells, built before the shuffle; a repeated cell counts once."""
    at = F.pmod(F.col("cell").cast("long"), F.lit(BITS))
    return masks.groupBy("id", F.floor(F.col("cell") / BITS).alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))


def unpacked(bitmaps: DataFrame) -> DataFrame:
    """(id, cell) of bitmaps (id, bucket, bits)."""
    kind = dict(bitmaps.dtypes)["id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for i, b, bits in zip(rows.id, rows.bucket, rows.bits):
                at = np.flatnonzero(_flags([bits])[0])
                yield pd.DataFrame({"id": [i] * len(at), "cell": b * BITS + at})

    return bitmaps.select("id", "bucket", "bits").mapInPandas(run, f"id {kind}, cell long")


def _flags(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")


def sizes(bitmaps: DataFrame) -> DataFrame:
    """(id, n): cells of each mask."""
    return bitmaps.groupBy("id").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def union(bitmaps: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, bucket, bits) of the cells in any mask."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(bitmaps: DataFrame) -> DataFrame:
    """One row, as `coverage.counts`: a bucket's masks are folded into two bitmaps, cells seen and cells seen twice, blocks of masks at a time."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for rows in parts:
            for b, s, t in zip(rows.bucket, rows.seen, rows.twice):
                seen, twice = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
                if b in held:
                    a = held[b]
                    a[1] |= twice | (a[0] & seen)
                    a[0] |= seen
                else:
                    if len(held) >= CHUNK:
                        yield _folded(held)
                        held = {}
                    held[b] = [seen.copy(), twice.copy()]
        if held:
            yield _folded(held)

    none = F.lit(b"\0" * (BITS // 8))
    once = bitmaps.select("bucket", F.col("bits").alias("seen"), none.alias("twice")).mapInPandas(fold, FOLD_DDL)  # before the shuffle
    whole = once.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(fold, FOLD_DDL)
    per = whole.select(F.bitmap_count("seen").alias("n"), F.bitmap_count("twice").alias("k"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("union_cells"), F.coalesce(F.sum("k"), F.lit(0)).alias("shared_cells"), F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)).alias("unique_cells"))


FOLD_DDL = "bucket long, seen binary, twice binary"


def _folded(held: dict[int, list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({"bucket": list(held), "seen": [a.tobytes() for a, _ in held.values()], "twice": [b.tobytes() for _, b in held.values()]})


def overlaps(bitmaps: DataFrame, block: int = CHUNK) -> DataFrame:
    """(a, b, shared, jaccard, of_smaller), as `coverage.overlaps`: the masks of a bucket are dealt to blocks, and each pair of blocks is a task's work of its own that
    multiplies their bits, so that a bucket under many masks is neither in one task nor becomes a row for each pair and cell."""
    kind = dict(bitmaps.dtypes)["id"]
    many = bitmaps.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = bitmaps.join(many, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o"))

    def pairs(key, g: pd.DataFrame) -> pd.DataFrame:
        left, right = g[g.own == key[1]], g[g.own == key[2]]
        out = []
        for a in range(0, len(left), CHUNK):
            x = _flags(list(left.bits[a : a + CHUNK])).astype(np.float32)
            for b in range(0, len(right), CHUNK):
                shared = x @ _flags(list(right.bits[b : b + CHUNK])).astype(np.float32).T
                i, j = np.nonzero(shared)
                u, v = left.id.to_numpy()[a + i], right.id.to_numpy()[b + j]
                once = u < v if key[1] == key[2] else u != v
                u, v, n = u[once], v[once], shared[i, j][once].astype(np.int64)
                swap = u > v
                out.append(pd.DataFrame({"a": np.where(swap, v, u), "b": np.where(swap, u, v), "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []})

    found = rows.select("bucket", "i", "j", "own", "id", "bits").groupBy("bucket", "i", "j").applyInPandas(pairs, f"a {kind}, b {kind}, n long")
    shared = found.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    n = sizes(bitmaps)
    out = shared.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("of_smaller"))


def added(bitmaps: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, gain): cells of each mask that lie in none of `covered` (bucket, bits)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            none = b"\0" * (BITS // 8)
            bits, seen = (np.frombuffer(b"".join(x), np.uint8).reshape(len(rows), -1) for x in (rows.bits, [none if s is None else s for s in rows.seen]))
            yield pd.DataFrame({"id": rows.id, "gain": np.bitwise_count(bits & ~seen).sum(axis=1).astype(np.int64)})

    kind = dict(bitmaps.dtypes)["id"]
    held = bitmaps.join(covered.select("bucket", F.col("bits").alias("seen")), "bucket", "left").select("id", "bits", "seen")
    return held.mapInPandas(run, f"id {kind}, gain long").groupBy("id").agg(F.sum("gain").alias("gain"))
