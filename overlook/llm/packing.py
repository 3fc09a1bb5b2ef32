"""Packing along a space-filling curve.

Each document becomes a feature-hashed bag of words (BUCKETS signed counts); a fixed random projection
brings it to DIMS dimensions, its cell on a Hilbert curve is the sort key. Rows are dealt to ranges
of the curve that hold equal numbers of bytes and sorted there by (key, hash of the text, doc_id), so that neighbours
on the curve, alike in content, become neighbours in sequences. The ranges are cut on the full key, from the bytes of every key summed
along the curve (`dealt`); only rows of one equal key, such as a large group of copies, are spread over the ranges that it covers, by (hash of the
text, doc_id). Keys are made once, by cheap array steps, and written beside the texts; a text is tokenized after the one shuffle, in
curve order.

Each partition is one stream of tokens, cut every `length` tokens. The rest of a stream, under `length`,
is cut at powers of two, which need no padding: no sequence has any.

Edge cases: a null or empty text is one token, the end id; documents longer than a sequence span several;
ties of the key go by the text's hash, then doc_id; rows that repeat a doc_id are packed as they come; a null doc_id
stays null; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, shuffle_parts, steps, sums_before, table

LENGTH = 2048
DIMS, BITS, BUCKETS = 4, 8, 1024
#: The leading bits of a key that name its stripe of the curve: bounds the table in which rows look up cuts, whatever the input.
STRIPE_BITS = 14
#: Documents whose bags of words are held at once.
ROWS = 2048
END_ID, SPECIAL, SPECIAL_ID = 1, "<|endoftext|>", 50256
TOKENIZER = "byte_bpe_50k"

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n, dims), each coordinate of `bits` bits: Gray code of the cells after undoing each level's turn."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = np.uint64(level - 1)
        for i in range(dims):
            high = (x[i] & np.uint64(level)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[dims - 1] & np.uint64(level)) != 0, np.uint64(level - 1), np.uint64(0))
        level >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def projection() -> np.ndarray:
    return np.random.default_rng(20).choice([-1.0, 1.0], size=(BUCKETS, DIMS))


def curve_keys(column: pa.Array, plane: np.ndarray) -> np.ndarray:
    keys = np.zeros(len(column), np.int64)
    for lo, hi, data, offs in steps(column):
        w = Words(data, offs)
        vectors = np.zeros((hi - lo, DIMS))
        h = w.hashes() if len(w.doc) else np.zeros(0, np.uint64)
        for a in range(0, hi - lo, ROWS):
            b = min(hi - lo, a + ROWS)
            mine = slice(w.first[a], w.first[b])
            slot = (w.doc[mine] - a) * BUCKETS + (h[mine] & np.uint64(BUCKETS - 1)).astype(np.int64)
            bags = np.bincount(slot, np.where(h[mine] >> np.uint64(63), 1.0, -1.0), (b - a) * BUCKETS).reshape(-1, BUCKETS)
            vectors[a:b] = bags @ plane / np.maximum(np.sqrt((bags * bags).sum(1)), 1e-9)[:, None]
        cells = np.clip(np.floor((vectors + 4) / 8 * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
        keys[lo:hi] = hilbert(cells, BITS)
    return keys


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plane = projection()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(curve_keys(batch.column("text"), plane)), batch.column("doc_id"), batch.column("text")], names=["curve", "doc_id", "text"])


class Tokens:
    """Ids of whole texts. The rank file holds the JSON file's vocabulary and gives its ids, several times faster; its special token, if a text spells it, is an id of its own there too."""

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        name = f"{TOKENIZER}.tiktoken"
        path = os.path.join(folder, name) if folder else public_tokenizers.path(name)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        parts = text.split(SPECIAL) if SPECIAL in text else [text]
        found: list[np.ndarray] = []
        for i, part in enumerate(parts):
            if i:
                found.append(np.array([SPECIAL_ID], np.uint32))
            found.append(self.encoding.encode_to_numpy(part, disallowed_special=()))
        return np.concatenate([*found, np.array([END_ID], np.uint32)]).astype("<u4")


def closing(rest: int) -> list[int]:
    """A stream's rest as powers of two, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(length: int, folder: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Tokens(folder)
        stream = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # documents that still lie in the open sequence: (doc_id, ids, first id not placed)
        waiting, number = 0, 0

        def place(take: int) -> list[tuple]:
            """Pieces of one sequence of `take` tokens, from the front of what is held."""
            nonlocal number, waiting
            rows, offset = [], 0
            while offset < take:
                doc_id, ids, start = held[0]
                n = min(len(ids) - start, take - offset)
                piece = ids[start : start + n]
                rows.append((doc_id, start, n, zlib.crc32(piece), len(ids), stream + number, offset, piece.tobytes() if with_ids else None))
                offset += n
                if start + n == len(ids):
                    held.pop(0)
                else:
                    held[0] = (doc_id, ids, start + n)
            waiting -= take
            number += 1
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text)
                held.append((doc_id, ids, 0))
                waiting += len(ids)
                while waiting >= length:
                    rows += place(length)
            if rows:
                yield batch_of(rows)
        rows = [row for size in closing(waiting) for row in place(size)]
        if rows:
            yield batch_of(rows)

    return run


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows(curve, size, copy, doc_id, text), which are read twice, in `parts` partitions that follow the curve and hold about equal bytes.

    Bytes are summed by full key and along the curve. Where the sum passes a multiple of the partitions' share, the key there is a cut:
    keys before it go to the partition before, keys behind it to the one behind; rows of that one key are spread over
    what it covers. There are fewer cuts than partitions; a row finds those of its stripe of the curve.
    """
    keys = rows.groupBy("curve").agg(F.sum("size").alias("size"))
    keys = materialize(sums_before(keys, [F.col("curve")], "size", "before"), "curve")
    whole = keys.agg(F.sum("size")).first()[0] or 1
    at = lambda place: F.least(F.floor(place / F.lit(float(whole)) * parts), F.lit(parts - 1)).cast("int")
    stripe = F.shiftright("curve", DIMS * BITS - STRIPE_BITS).cast("int")
    keys = keys.withColumn("low", at(F.col("before"))).withColumn("high", at(F.col("before") + F.col("size")))
    cut = F.when(F.col("high") > F.col("low"), F.struct("curve", "before", "size", "high"))
    # at most 2**STRIPE_BITS rows, and `parts` cuts in all of them
    stripes = keys.groupBy(stripe.alias("stripe")).agg(F.min("low").alias("low"), F.array_sort(F.collect_list(cut)).alias("cuts"))
    rows = rows.withColumn("stripe", stripe).join(F.broadcast(stripes), "stripe")
    within = F.pmod(F.xxhash64("copy", "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    mine = F.get(F.filter("cuts", lambda x: x["curve"] == F.col("curve")), F.lit(0))
    behind = F.aggregate("cuts", F.col("low"), lambda low, x: F.when(x["curve"] < F.col("curve"), x["high"]).otherwise(low))
    place = F.when(mine.isNull(), behind).otherwise(at(mine["before"] + within * mine["size"]))
    return rows.repartitionById(parts, place).drop("stripe", "low", "cuts")


def pack(docs: DataFrame, length: int = LENGTH, tokenizers: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece of a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if asked."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.mapInArrow(_keys, "curve long, doc_id long, text string").select("*", F.xxhash64("text").alias("copy"), (F.octet_length("text") + F.lit(1).cast("long")).alias("size"))
    rows = dealt(materialize(rows, "keys"), shuffle_parts(docs.sparkSession)).sortWithinPartitions("curve", "copy", "doc_id")
    return rows.select("doc_id", "text").mapInArrow(_pack(length, tokenizers, with_ids), PIECES_DDL)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
