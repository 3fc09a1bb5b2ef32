"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document. A word goes if some window over it has a word
sequence that also starts earlier: in a smaller doc_id, or earlier in the same document.

Hashing every window of every document would shuffle a row for each word. Instead only anchors are
hashed: runs of window - v + 1 words that start at a position whose remainder modulo v lies in a
difference cover of v. Any two occurrences of one window share an anchor at the same shift (for every
difference d there are a, b in the cover with a - b = d), so a window can only repeat if one of its
anchors does. Anchors that occur once go; around those that stay the match is extended to whole
windows, whose 128-bit hashes name the earliest occurrence.

Skew: each task first combines what it holds (a repeated anchor or window leaves a task once, however
often it occurs there), so that a passage in a third of all documents reaches the reducer as one entry a
task. Entries travel as packed arrays by hash range.

Edge cases: a null text has no words; documents under `window` words keep all of theirs; rows with equal
doc_id and equal text are one document (neither is earlier than the other); a null doc_id counts as the
smallest; empty tables give empty results; extra columns are ignored by `dedup_words` and kept by
`drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import R_WORD, R_WORD2, Words, blobs, boxed, keyed, mix, new_text, row_key, shuffle_parts, span_hash, steps, table, unboxed

#: Perfect difference covers: every difference modulo the key arises from two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
WINDOW = 20
#: Entries that a task gathers before it combines and sends them.
FLUSH = 2_000_000


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least a third of the window (one word at least)."""
    fits = [v for v in COVERS if window - v + 1 >= max(1, window // 3)]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _lead(hashes: np.ndarray, at: np.ndarray, length: int, parts: int) -> np.ndarray:
    """The hash range of each run of `length` words: that of its least 4-gram, which neighbouring runs mostly share."""
    gram = min(4, length)
    n = len(hashes)
    least = span_hash(hashes, np.arange(n), np.minimum(np.arange(n) + gram, n), R_WORD)
    have, need = 1, length - gram + 1
    while have < need:
        step = min(have, need - have)
        least[:-step] = np.minimum(least[:-step], least[step:])
        have += step
    return _part(mix(least[at]), parts)


def _joined(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in columns]


ANCHORS = pa.schema([("part", pa.int32()), ("seen", pa.bool_()), ("h", pa.binary()), ("key", pa.binary()), ("pos", pa.binary())])


def _anchors(window: int, parts: int):
    v, cover = cover_for(window)
    size = window - v + 1
    wanted = np.isin(np.arange(v), cover)

    def flush(h, key, pos, place) -> pa.RecordBatch:
        """One entry for each anchor to its hash range; anchors met twice here are already known to stay."""
        order = np.argsort(h, kind="stable")
        h, key, pos, place = h[order], key[order], pos[order], place[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1 if len(h) else new
        out = {n: [] for n in ANCHORS.names}
        for seen, take in ((False, new), (True, many)):
            hh, kk, pp = h[take], key[take], pos[take]
            part = (kk % parts) if seen else place[take]
            if not seen:  # the sign bit of pos tells that the anchor needs no answer here
                pp = np.where(many[take], -1 - pp, pp)
            by = np.lexsort((pp, kk, part)) if seen else np.lexsort((kk, part))
            hh, kk, pp, part = hh[by], kk[by], pp[by], part[by]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = np.flatnonzero(np.diff(cuts))
            cuts = np.r_[cuts[rows], len(part)]
            out["part"] += rows.tolist()
            out["seen"] += [seen] * len(rows)
            out["h"] += [b""] * len(rows) if seen else blobs(hh, cuts)
            out["key"] += blobs(kk, cuts)
            out["pos"] += blobs(pp.astype(np.int32), cuts)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in ANCHORS], schema=ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        n = 0
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in steps(batch.column("text")):
                w = Words(data, offs)
                long = (w.count >= window)[w.doc] if len(w.doc) else np.zeros(0, bool)
                at = np.flatnonzero(long & wanted[w.rank % v] & (w.rank + size <= w.count[w.doc])) if len(w.doc) else np.zeros(0, np.int64)
                if not len(at):
                    continue
                hashes = w.hashes()
                for k, col in enumerate((span_hash(hashes, at, at + size, R_WORD), keys[lo:hi][w.doc[at]], w.rank[at].astype(np.int64), _lead(hashes, at, size, parts))):
                    held[k].append(col)
                n += len(at)
                if n >= FLUSH:
                    yield flush(*_joined(held))
                    held, n = [[], [], [], []], 0
        if n:
            yield flush(*_joined(held))

    return run


SURVIVORS = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("pos", pa.binary())])
SURVIVORS_DDL = "part int, key binary, pos binary"


def _to_documents(parts: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(key, pos) pairs as one row for each range of documents."""
    if not pairs:
        return
    key, pos = np.concatenate([k for k, _ in pairs]), np.concatenate([p for _, p in pairs])
    part = key % parts
    order = np.lexsort((pos, key, part))
    key, pos, part = key[order], pos[order], part[order]
    rows = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    cuts = np.r_[rows, len(part)]
    yield pa.RecordBatch.from_arrays([pa.array(part[rows].astype(np.int32)), pa.array(blobs(key, cuts), pa.binary()), pa.array(blobs(pos.astype(np.int32), cuts), pa.binary())], schema=SURVIVORS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of this task's ranges: its key and positions."""
    keys, poss = [], []
    for batch in batches:
        keys += [np.frombuffer(k, np.int64) for k in batch.column("key").to_pylist()]
        poss += [np.frombuffer(p, np.int32) for p in batch.column("pos").to_pylist()]
    if keys:
        key, pos = np.concatenate(keys), np.concatenate(poss)
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(blobs(pos, np.r_[first, len(key)]), pa.binary())], names=["key", "found"])


def _repeated(parts: int):
    """The anchors of this task's hash ranges that came more than once, and those known before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, keys, poss, out = [], [], [], []
        for batch in batches:
            for seen, h, key, pos in zip(*(batch.column(c).to_pylist() for c in ("seen", "h", "key", "pos"))):
                k, p = np.frombuffer(key, np.int64), np.frombuffer(pos, np.int32)
                if seen:
                    out.append((k, p))
                else:
                    hs.append(np.frombuffer(h, np.uint64))
                    keys.append(k)
                    poss.append(p)
        if hs:
            h = np.concatenate(hs)
            order = np.argsort(h, kind="stable")
            h = h[order]
            same = h[1:] == h[:-1]
            many = np.r_[False, same] | np.r_[same, False]
            key, pos = np.concatenate(keys)[order][many], np.concatenate(poss)[order][many]
            out.append((key[pos >= 0], pos[pos >= 0]))
        yield from _to_documents(parts, out)

    return run


WINDOWS = pa.schema([("part", pa.int32()), ("seen", pa.bool_()), ("h", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary()), ("key", pa.binary()), ("pos", pa.binary())])


def _first(h, h2, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash and place, whether each entry in that order is at its window's earliest place)."""
    order = np.lexsort((pos, doc, h2, h))
    h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (doc == doc[start]) & (pos == pos[start])


def _windows(window: int, parts: int):
    v, _ = cover_for(window)

    def flush(h, h2, doc, key, pos, place) -> pa.RecordBatch:
        order, first = _first(h, h2, doc, pos)
        out = {n: [] for n in WINDOWS.names}
        for seen, take in ((False, order[first]), (True, order[~first])):
            to = (key % parts) if seen else place
            by = take[np.lexsort((pos[take], key[take], to[take]))]
            part = to[by]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = np.flatnonzero(np.diff(cuts))
            cuts = np.r_[cuts[rows], len(part)]
            out["part"] += rows.tolist()
            out["seen"] += [seen] * len(rows)
            for name, values in (("h", h), ("h2", h2), ("doc", doc)):
                out[name] += [b""] * len(rows) if seen else blobs(values[by], cuts)
            out["key"] += blobs(key[by], cuts)
            out["pos"] += blobs(pos[by].astype(np.int32), cuts)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in WINDOWS], schema=WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(6)]
        n = 0
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            found = batch.column("found")
            for lo, hi, data, offs in steps(batch.column("text")):
                w = Words(data, offs)
                mark = np.zeros(len(w.starts) + 1, np.int64)
                for row in range(lo, hi):
                    base, count = w.first[row - lo], w.count[row - lo]
                    a = np.frombuffer(found[row].as_py(), np.int32).astype(np.int64)
                    a = a[a < count]  # another row's, if two keys ever collide
                    np.add.at(mark, base + np.maximum(a - v + 1, 0), 1)
                    np.add.at(mark, base + a + 1, -1)
                at = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & (w.rank + window <= w.count[w.doc])) if len(w.doc) else np.zeros(0, np.int64)
                if not len(at):
                    continue
                hashes = w.hashes()
                for k, col in enumerate((span_hash(hashes, at, at + window, R_WORD), span_hash(hashes, at, at + window, R_WORD2), docs[lo:hi][w.doc[at]], keys[lo:hi][w.doc[at]], w.rank[at], _lead(hashes, at, window, parts))):
                    held[k].append(col)
                n += len(at)
                if n >= FLUSH:
                    yield flush(*_joined(held))
                    held, n = [[] for _ in range(6)], 0
        if n:
            yield flush(*_joined(held))

    return run


def _later(parts: int):
    """The windows of this task's hash ranges that start earlier elsewhere, and those known before."""
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in kinds]
        out = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seen", "h", "h2", "doc", "key", "pos"))):
                if row[0]:
                    out.append((np.frombuffer(row[4], np.int64), np.frombuffer(row[5], np.int32)))
                else:
                    for c, kind, value in zip(cols, kinds, row[1:]):
                        c.append(np.frombuffer(value, kind))
        if cols[0]:
            h, h2, doc, key, pos = _joined(cols)
            order, first = _first(h, h2, doc, pos)
            late = order[~first]
            out.append((key[late], pos[late]))
        yield from _to_documents(parts, out)

    return run


RESULT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found").to_pylist()
            out = {n: [] for n in RESULT.names if n not in ("key", "doc_id")}
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.encode().split()
                n = len(words)
                gone = 0
                if found[i]:
                    starts = np.frombuffer(found[i], np.int32)
                    starts = starts[starts + window <= n]
                    mark = np.zeros(n + 1, np.int64)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + window, -1)
                    keep = np.cumsum(mark)[:-1] == 0
                    gone = n - int(keep.sum())
                    words = [words[j] for j in np.flatnonzero(keep)]
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(gone)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"].append((kept.decode() if gone else text) if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *(pa.array(out[f.name], f.type) for f in list(RESULT)[2:])], schema=RESULT)

    return run


def _back(rows: DataFrame, reduce, parts: int) -> DataFrame:
    """(key, found) for each document that the reducers of rows answer."""
    answers = rows.repartitionById(parts, F.col("part")).mapInArrow(reduce(parts), SURVIVORS_DDL)
    return answers.repartitionById(parts, F.col("part")).mapInArrow(_merged, "key long, found binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(key, doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of docs.

    The text moves once, hashed by key, and both later joins reuse that exchange.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rows = keyed(docs)
    held = rows.repartition(parts, "key")
    anchors = rows.select("key", "text").mapInArrow(_anchors(window, parts), "part int, seen boolean, h binary, key binary, pos binary")
    near = held.join(_back(anchors, _repeated, parts).hint("shuffle_hash"), "key")
    windows = near.select("key", "doc_id", "text", "found").mapInArrow(_windows(window, parts), "part int, seen boolean, h binary, h2 binary, doc binary, key binary, pos binary")
    return held.join(_back(windows, _later, parts).hint("shuffle_hash"), "key", "left").select("key", "doc_id", "text", "found").mapInArrow(
        _cut(window, with_text), "key long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return repeated_spans(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every repeated window's words taken out of text (n_chars follows, if there); other texts, and all other columns whatever their names, stay as they are."""
    spark = docs.sparkSession
    cut = repeated_spans(docs, window, with_text=True).where("n_removed > 0").dropDuplicates(["key"]).select("key", F.col("kept_text").alias("kept"))
    out = boxed(docs, row_key()).repartition(shuffle_parts(spark), "key").join(cut.hint("shuffle_hash"), "key", "left")
    return unboxed(out, docs, new_text(F.col("kept"), docs))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"))
