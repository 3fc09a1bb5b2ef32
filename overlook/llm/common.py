"""Helpers shared by the text operators: tables, cut lineage, vectorised words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that one vectorised step looks at (a longer document makes a longer step).
STEP_BYTES = 2 << 20

R_BYTE = 0x9E3779B97F4A7C15 | 1
R_WORD = 0xD6E8FEB86659FD93 | 1
R_WORD2 = 0xA0761D6478BD642F | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all of Spark is this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="overlook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths written since the innermost `scratch` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, tag: str, written: list[str] | None = None) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, and a lost executor costs nothing.

    The table stays until the `scratch` around ends, or until whoever holds the list `written` discards it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/overlook/{tag}-{uuid.uuid4().hex}"
    written = _WRITTEN.get() if written is None else written
    if written is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def kept_apart():
    """The list of paths that are written inside; those that are still in it at the end go to the list around."""
    mine: list[str] = []
    around = _WRITTEN.get()
    token = _WRITTEN.set(mine)
    try:
        yield mine
    finally:
        _WRITTEN.reset(token)
        if around is not None:
            around += mine


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables that were written inside; what is still to be read must have been written by then, elsewhere."""
    with kept_apart() as written:
        try:
            yield
        finally:
            discard(spark, written)
            written.clear()


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def boxed(docs: DataFrame, *more: F.Column) -> DataFrame:
    """docs as one column `row`, beside further columns: no name inside meets one of ours."""
    return docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"), *more)


def unboxed(rows: DataFrame, docs: DataFrame, new: dict[str, F.Column] | None = None) -> DataFrame:
    """The columns of docs from `row`, with their types; those in `new` get other values."""
    new = new or {}
    return rows.select(*((new[c] if c in new else F.col("row")[c]).cast(t).alias(c) for c, t in docs.dtypes))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def new_text(kept: F.Column, docs: DataFrame) -> dict[str, F.Column]:
    """Values of text (and n_chars, if there) of boxed rows where `kept` is not null."""
    out = {"text": F.coalesce(kept, F.col("row")["text"])}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(kept.isNull(), F.col("row")["n_chars"]).otherwise(F.length(kept))
    return out


def row_key() -> F.Column:
    """Rows that repeat both doc_id and text share a key; a null text is empty."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key")


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) of every row."""
    return docs.select(row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def bounded_sample(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """The `size` rows whose hashed key is least. Rows are counted first and those of large hashes left out, so that the sort sees about 2 size rows of any table."""
    h = F.xxhash64(key)
    n = rows.count()
    if n > 2 * size:
        rows = rows.where(h < F.lit(int(2 * size / n * 2.0**64) - (1 << 63)))
    return rows.orderBy(h, key).limit(size)


def sums_before(rows: DataFrame, order: list[Column], weight: str, out: str, group: str | None = None) -> DataFrame:
    """rows with the sum of `weight` over the rows of the same group that come earlier in `order`, which must begin with the group.

    Rows are dealt by range and written; what meets in one task besides a range is one number a range and group.
    """
    of = [group] if group else []
    dealt = materialize(rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).withColumn("range_", F.spark_partition_id()), "ranges")
    inside = F.sum(weight).over(Window.partitionBy("range_", *of).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy("range_", *of).agg(F.sum(weight).alias("all_"))
    earlier = F.sum("all_").over(Window.partitionBy(*of).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("range_", *of, F.coalesce(earlier, F.lit(0)).alias("earlier_"))
    summed = dealt.withColumn("inside_", F.coalesce(inside, F.lit(0))).join(totals, ["range_", *of])
    return summed.select(*rows.columns, (F.col("inside_") + F.col("earlier_")).alias(out))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes."""
    data, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of values[start:end], by prefix sums of a polynomial modulo 2**64."""
    up, down = powers(base, len(values) + 1)
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=pre[1:])
    h = (pre[ends] - pre[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of a run of documents: byte spans, each word's document, each document's first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        solid = ~SPACE[data]
        begin, end = solid.copy(), solid.copy()
        if n:
            begin[1:] &= ~solid[:-1] | edge[1:-1]
            end[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        self.rank = np.arange(len(self.starts)) - self.first[:-1][self.doc]

    def hashes(self) -> np.ndarray:
        return span_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, R_BYTE)


def blobs(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """values cut at the given positions, as bytes."""
    raw, size = np.ascontiguousarray(values).tobytes(), values.dtype.itemsize
    return [raw[a * size : b * size] for a, b in zip(cuts[:-1], cuts[1:])]
