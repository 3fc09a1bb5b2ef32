"""Mixing sources to target weights by Pareto order sampling.

Sources, in code point order with null last, weigh WEIGHTS in turn and share SHARE times all words; a target stops at MOST times its
source's words and the excess is shared anew by weight until none is above (`targets`).

A source of `size` words with a target t takes each of its documents floor(t / size) times for certain. What is left to reach t, the
`goal`, comes from a sample without replacement. Let f be the goal over the size: a document of at most `long` words (LONG times
the source's mean) is taken whole with probability f. A longer one is included with probability f * words / long, up to 1, and gives
`long` words, or f of its words if it is certain, so that each document's expected words are f of its own and one long document can't
swing the total. The documents rank by their random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), u from an
MD5 of seed and doc_id; the sample is the head of this order up to the goal, its size fixed in words: the last document
gives the words that are still missing. A source's words therefore meet its target to half a word.

All of it runs on narrow rows (doc_id, source, number of words), written once. The order is dealt by range of (source, rank), summed
inside the ranges, and each range adds what earlier ranges hold of its source: no task holds a source. A join by source may split a
frequent one. `render` fetches the texts of what was taken.

Edge cases: a null text has no words; documents without words take none; a null source is a source of its own; a source
without words has target 0; null doc_ids are drawn as one id; rows that tie in draw, doc_id and number of words are interchangeable,
and as many of them are taken as the order demands; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, row_key, steps, sums_before, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of more words than this many times their source's mean are long.
LONG = 4
SEED = "mix"
#: Hex digits of a hash that make a draw: 52 bits, exact in a double.
DIGITS = 13


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Words(data, offs).count for _, _, data, offs in steps(batch.column("text"))]
        size = pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("source"), size], names=["key", "doc_id", "source", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, size): the number of words of every row."""
    rows = docs.select(row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted, "key long, doc_id long, source string, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(place, source, source_size, docs, target) of sizes(source, size)."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("one", F.lit(1).cast("long"))
    found = sums_before(found, [F.col("source").asc_nulls_last()], "one", "place").drop("one")
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod("place", F.lit(len(weights))).cast("int")]
    found = materialize(found.withColumn("weight", weight), "sources")
    most = F.lit(float(MOST)) * F.col("source_size")
    rate, last = 0.0, None
    while rate != last:  # the rate only rises, and with it the set of sources that are at their most
        last, above = rate, most < F.lit(rate) * F.col("weight")
        r = found.agg(F.sum("source_size"), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        rate = (share * (r[0] or 0) - MOST * (r[1] or 0)) / r[2] if r[2] else rate
    return found.withColumn("target", F.least(F.lit(rate) * F.col("weight"), most)).drop("weight")


def draw(seed: str = SEED) -> Column:
    """A number between 0 and 1, the same for the same doc_id in any partitioning."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return (F.conv(F.substring(hashed, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 4 * DIGITS))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """(key, doc_id, source, size, source_size, target, taken): what the mix takes of every row."""
    rows = materialize(sized(docs), "sizes")
    plan = targets(rows, weights, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    plan = plan.withColumn("whole", whole).withColumn("goal", F.floor(rest + 0.5)).withColumn("f", F.try_divide(rest, F.col("source_size")))
    plan = plan.withColumn("long", F.expr(f"{LONG} * ((source_size + docs - 1) div docs)")).drop("docs").withColumnRenamed("source", "of")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    is_long = F.col("size") > F.col("long")
    p = F.when(is_long, F.least(F.lit(1.0), F.col("f") * F.col("size") / F.col("long"))).otherwise(F.col("f"))
    rows = rows.withColumn("p", p).withColumn("u", draw(seed))
    rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    piece = F.when(is_long, F.greatest("long", F.ceil(F.col("f") * F.col("size")))).otherwise(F.col("size"))
    rows = rows.select("key", "doc_id", "source", "size", "source_size", "target", "whole", "goal", "place", rank.alias("rank"), piece.alias("piece"), F.monotonically_increasing_id().alias("row"))
    # the row's number comes last: it only deals rows that are alike to several ranges
    rows = sums_before(rows, [F.col(c) for c in ("place", "rank", "doc_id", "size", "row")], "piece", "before", "place")
    extra = F.greatest(F.lit(0), F.least(F.col("piece"), F.col("goal") - F.col("before")))
    return rows.select("key", "doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))


def _copies() -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, taken = batch.column("doc_id").to_pylist(), batch.column("taken").to_pylist()
            for lo, hi, data, offs in steps(batch.column("text")):
                words = Words(data, offs)
                rows = []
                for i in range(hi - lo):
                    size, left = int(words.count[i]), taken[lo + i]
                    for copy in range(-(-left // size) if size else 0):
                        n = min(size, left - copy * size)
                        end = offs[i + 1] if n == size else words.ends[words.first[i] + n - 1]
                        rows.append((ids[lo + i], copy, data[offs[i] : end].tobytes().decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def render(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(doc_id, copy, text): a row for each copy that the mix takes, the last one cut after the words that it gives."""
    texts = docs.select(row_key(), F.col("text").cast("string").alias("text")).dropDuplicates(["key"])
    return mixed.where("taken > 0").select("key", "doc_id", "taken").join(texts, "key").mapInArrow(_copies(), "doc_id long, copy int, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, [{', '.join(f'{w}.0' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
    FROM d GROUP BY source
), o AS (  -- the first so many sources by size over weight may be at their most: the rate rises until the right ones are
    SELECT *, coalesce(sum(source_size) OVER below, 0) AS full_size, sum(weight) OVER above AS open_weight
    FROM s WINDOW below AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        above AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), r AS (
    SELECT max((CAST({SHARE} AS DOUBLE) * (SELECT sum(source_size) FROM s) - {MOST} * full_size) / open_weight) AS rate FROM o
), t AS (
    SELECT source, source_size, {LONG} * ((source_size + docs - 1) // docs) AS long, least(rate * weight, CAST({MOST} AS DOUBLE) * source_size) AS target FROM s, r
), w AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, target - whole * source_size AS rest,
        CAST(floor(rest + 0.5) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN rest / source_size END AS f FROM t
), p AS (
    SELECT d.doc_id, d.source, d.size, w.source_size, w.target, w.whole, w.goal,
        CASE WHEN size > long THEN greatest(long, CAST(ceil(f * size) AS BIGINT)) ELSE size END AS piece,
        CASE WHEN size > long THEN least(CAST(1 AS DOUBLE), f * size / long) ELSE f END AS p,
        (CAST('0x' || left(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), {DIGITS}) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({1 << 4 * DIGITS} AS DOUBLE) AS u
    FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
), k AS (
    SELECT *, CASE WHEN p >= 1 THEN CAST(0 AS DOUBLE) WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM p
), b AS (
    SELECT *, coalesce(sum(piece) OVER (PARTITION BY source ORDER BY rank NULLS FIRST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(piece, goal - before)) AS BIGINT) AS taken FROM b
"""
