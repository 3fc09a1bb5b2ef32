"""Document fingerprints by locally consistent parsing.

A text's bytes are symbols. At each level runs of one symbol become one symbol; deterministic coin
tossing (twice the place of the lowest bit in which a symbol differs from its left neighbour, plus that
bit) turns 64-bit symbols into six labels in four rounds, with neighbours still different; local minima of the
labels open phrases, and a phrase's name is a hash of its symbols. Names are the next level's symbols,
until one is left. Where a phrase opens depends on a few symbols around it alone, so equal substrings get
equal interior names at any offset.

A fingerprint is the root's name (16 hex digits: equal texts and, but for hash collisions, no others) and
SLOTS minima over the names of level DEPTH and up (4 hex digits each); the likeness of two is the share
of equal slots, an estimate of the Jaccard similarity of their names.

For the edited texts each row needs the next document's text. doc_ids are cut into ranges at quantiles; the rows of
an id that fills whole ranges, or of none, are cut further by text, at heads of texts of a bounded sample. The first
row of each range is also sent to the range before it, so that one shuffle by range suffices; one number a range
comes to the driver. Cuts balance work and change no row; equal texts that lie together are parsed once.

Edge cases: a null or empty text has the root 0 and empty slots, is like another empty text and unlike
others; rows that share a doc_id follow each other in order of text; a null doc_id comes last; a single
row is its own next document; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import R_WORD, mix, shuffle_parts, span_hash, table

SLOTS, DEPTH, ROUNDS = 64, 2, 4
NO_ID = -(1 << 63)
#: Place of rows without an id, below that of any; and the bound under which ids are places exactly.
NOWHERE, EXACT = -1e19, float(1 << 53)
#: Rows sampled for each further cut of a frequent id, and the characters of a text that such a cut holds.
SAMPLED, HEAD = 20, 256
#: Bytes of text parsed at once (a longer text is parsed alone).
STEP = 1 << 20


def _labels(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Coin tossing: neighbours differ before, and do after; heads of texts keep their lowest bit."""
    label = x
    for _ in range(ROUNDS):
        gap = label.copy()
        gap[1:] ^= label[:-1]
        gap[head] = 1
        place = np.bitwise_count((gap & -gap) - np.uint64(1)).astype(np.uint64)
        label = (place << np.uint64(1)) | ((label >> place) & np.uint64(1))
    return label


def _phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, first name of each text) one level up; first has the texts' starts in x and its length."""
    n = len(x)
    head = np.zeros(n, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    new = head.copy()
    new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    if len(starts) < n:  # runs of one symbol
        length = np.diff(np.r_[starts, n])
        x = np.where(length > 1, mix(x[starts] + length.astype(np.uint64) * np.uint64(R_WORD)), x[starts])
        head = head[starts]
        first = np.searchsorted(starts, first)
        n = len(x)
        clash = np.zeros(n, bool)  # names of unlike runs could be equal by chance
        clash[1:] = (x[1:] == x[:-1]) & ~head[1:]
        x = x + clash.astype(np.uint64)
    label = _labels(x, head)
    low = np.zeros(n, bool)
    low[1:] = label[1:] < label[:-1]
    low[:-1] &= (label[1:] > label[:-1]) | head[1:]
    opens = np.flatnonzero(low | head)
    names = span_hash(x, opens, np.r_[opens[1:], n], R_WORD)
    return names, np.searchsorted(opens, first)


def parse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(roots, slots) of texts; slots is a matrix of SLOTS 16-bit minima a text."""
    n = len(texts)
    roots, slots = np.zeros(n, np.uint64), np.zeros((n, SLOTS), np.uint16)
    sizes = np.array([len(t) for t in texts], np.int64)
    live = np.flatnonzero(sizes)
    if not len(live):
        return roots, slots
    x = mix(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1))
    first = np.r_[0, np.cumsum(sizes[live])]
    times = np.random.default_rng(9).integers(0, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
    least = np.full((SLOTS, n), np.iinfo(np.uint64).max, np.uint64)
    level = 0
    while len(live):
        x, first = _phrases(x, first)
        level += 1
        count = np.diff(first)
        done = count == 1
        use = np.full(len(live), level >= DEPTH) | done  # short texts end before DEPTH
        if use.any():
            pick = np.repeat(use, count)
            y, at = x[pick], np.r_[0, np.cumsum(count[use])[:-1]]
            rows = live[use]
            for s in range(SLOTS):
                least[s, rows] = np.minimum(least[s, rows], np.minimum.reduceat(y * times[s], at))
        roots[live[done]] = x[first[:-1][done]]
        if done.any():
            x = x[np.repeat(~done, count)]
            first = np.r_[0, np.cumsum(count[~done])]
            live = live[~done]
    some = sizes > 0
    slots[some] = (mix(least[:, some].T.ravel()) >> np.uint64(48)).astype(np.uint16).reshape(-1, SLOTS)
    roots[some] = np.maximum(roots[some], 1)
    return roots, slots


def likeness(root_a, slots_a, root_b, slots_b) -> np.ndarray:
    same = (slots_a == slots_b).mean(axis=1)
    same = np.where((root_a == 0) != (root_b == 0), 0.0, same)
    return np.where(root_a == root_b, 1.0, same)


def printed(roots: np.ndarray, slots: np.ndarray) -> list[str]:
    return [r.tobytes().hex() + s.tobytes().hex() for r, s in zip(roots.astype(">u8"), slots.astype(">u2"))]


def _parsed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """parse of the distinct texts, in steps of bounded size."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros((0, SLOTS), np.uint16)
    place: dict[bytes, int] = {}
    back = np.array([place.setdefault(t, len(place)) for t in texts])
    every = list(place)
    roots, slots, lo, size = [], [], 0, 0
    for i, t in enumerate(every):
        size += len(t)
        if size >= STEP or i == len(every) - 1:
            r, s = parse(every[lo : i + 1])
            roots.append(r)
            slots.append(s)
            lo, size = i + 1, 0
    return np.concatenate(roots)[back], np.concatenate(slots)[back]


OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range; in each, its documents in descending order and then the head of the next range."""

    def handle(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows[i + 1] is next to rows[i] where it belongs to the same range; the last row is only a neighbour."""
        at = [i for i in range(len(rows) - 1) if rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not at:
            return None
        texts = [r[3] for r in rows]
        edited = []
        for i in at:
            k = len(texts[i]) // 3
            edited.append((texts[i][: len(texts[i]) - k] + texts[i + 1][:k]).encode())
        roots, slots = _parsed([t.encode() for t in texts])
        e_roots, e_slots = _parsed(edited)
        at = np.array(at)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(printed(roots[at], slots[at])),
                pa.array(printed(e_roots, e_slots)),
                pa.array(likeness(roots[at], slots[at], e_roots, e_slots)),
                pa.array(likeness(roots[at], slots[at], roots[at + 1], slots[at + 1])),
            ],
            names=[f.split()[0] for f in OUT_DDL.split(", ")],
        )

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "doc_id", "text"))):
            held.append(row)
            size += len(row[3])
            if size >= 4 * STEP:
                out = handle(held)
                if out is not None:
                    yield out
                held, size = [row], len(row[3])
    if len(held) > 1:
        out = handle(held)
        if out is not None:
            yield out


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows the least text of each range."""
    found: dict[int, tuple] = {}
    for batch in batches:
        for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
            if part not in found or text < found[part][1]:
                found[part] = (doc_id, text)
    if found:
        rows = [(part, *row) for part, row in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string()))], names=["part", "doc_id", "text"])


def _cuts(rows: DataFrame, parts: int) -> tuple[list[float], dict[float, list[str]]]:
    """Where ranges of place begin, and for the place of a frequent id, which is a range of its own, the texts at which it is cut further."""
    cuts = rows.select(F.percentile_approx("place", [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("cuts")).first()["cuts"] or []
    times: dict[float, int] = {}
    for c in cuts:
        times[c] = times.get(c, 0) + 1
    often = {c: n for c, n in times.items() if n > 1 and (c == NOWHERE or abs(c) < EXACT)}
    inner: dict[float, list[str]] = {}
    if often:
        size = SAMPLED * sum(often.values())
        mine = rows.where(F.col("place").isin(list(often)))
        n = mine.count()
        h = F.xxhash64("text")  # by text, so that copies of one text can't fill the sample
        picked = mine.where(h < F.lit(int(size / n * 2.0**64) - (1 << 63))) if n > size else mine
        heads = picked.select("place", F.substring("text", 1, HEAD).alias("head")).distinct().limit(4 * size).collect()
        for c, m in often.items():
            have = sorted(r["head"] for r in heads if r["place"] == c)
            inner[c] = sorted({have[i * len(have) // (m + 1)] for i in range(1, m + 1)}) if have else []
    starts = set(times) | {float(np.nextafter(c, np.inf)) for c in often}
    return sorted(c for c in starts if c > NOWHERE or c in often), inner


def dealt(docs: DataFrame) -> DataFrame | None:
    """(part, own, doc_id, text): every row in its range, in the order of the result, and after a range's rows the first row of the next range, whose `own` is false; None if there are no rows."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    number = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(number, F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(number.cast("double"), F.lit(NOWHERE)).alias("place"))
    starts, inner = _cuts(rows, parts)
    # ranges in descending order of place, those of a frequent id in ascending order of text
    splits = [float("-inf"), *starts, float("inf")]
    width = [len(inner.get(c, [])) + 1 for c in splits[:-1]]
    base = [sum(width[i + 1 :]) for i in range(len(width))]
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(rows)
        part = F.get(F.array(*map(F.lit, base)), F.col("range").cast("int"))
        for c, texts in inner.items():
            if texts:
                part = part + F.when(F.col("place") == c, F.size(F.filter(F.array(*map(F.lit, texts)), lambda t: t <= F.col("text")))).otherwise(0)
        placed = placed.withColumn("part", part.cast("int"))
    else:
        placed = rows.withColumn("part", F.lit(0))
    heads = {r["part"]: r["head"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}  # one number for each range
    order = sorted(heads)
    if not order:
        return None
    before = {b: a for a, b in zip([order[-1], *order], order)}
    # by place in the list of ranges: a lookup costs the same however many there are
    at = range(order[-1] + 1)
    head = F.array(*(F.lit(heads.get(i)).cast("long") for i in at))
    to = F.array(*(F.lit(before.get(i)).cast("int") for i in at))
    # equal rows may head a range in any number: each task sends its least one
    first = placed.where(F.col("doc_id") == F.get(head, F.col("part"))).select("part", "doc_id", "text").mapInArrow(_least, "part int, doc_id long, text string")
    sent = first.select(F.get(to, F.col("part")).alias("part"), F.lit(False).alias("own"), "doc_id", "text")
    return placed.select("part", F.lit(True).alias("own"), "doc_id", "text").union(sent).repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part", F.desc("own"), F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = dealt(docs)
    if rows is None:
        return docs.sparkSession.createDataFrame([], OUT_DDL)
    out = rows.mapInArrow(_compare, OUT_DDL)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
