"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of WINDOW bytes, all of them read. In each, one gated recurrent unit of HIDDEN
states runs forward and one backward; every position gets log probabilities of the languages from both
states, and a document's are their sum, tempered by SHARE for the dependence of neighbours.

Training is numpy backpropagation through time with Adam on a bounded sample of the training folds
(FIT_ROWS texts in equal shares by language, those whose hashed doc_id is least; languages also get equal
parts of every batch). lang, source and doc_id take no part in a prediction.

Edge cases: null texts and those without a letter are `und` with score 0; null langs aren't learned; a
single language is always predicted with score 1, and without any every text is `und`; ties go to the
language that sorts first; a null doc_id is predicted, never learned from, and counts as held out; rows are
independent; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import steps, table
from .toxicity import training_fold

FIT_ROWS, STEPS, BATCH = 2000, 300, 128
WINDOW, HIDDEN = 64, 8
SHARE = 0.05
#: Windows that one vectorised pass holds.
LANES = 2048
PAD = 256


def start(langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters; the first axis is the direction, gates are update, reset, candidate."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    return {
        "x": rng.normal(0, 0.3, (2, 257, 3 * h)).astype(np.float32),
        "h": rng.normal(0, 0.3, (2, h, 3 * h)).astype(np.float32),
        "b": np.zeros((2, 1, 3 * h), np.float32),
        "v": rng.normal(0, 0.3, (2, h, langs)).astype(np.float32),
        "c": np.zeros(langs, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def forward(p: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False):
    """States (2, time, lanes, hidden) of byte codes (time, lanes); the padding's update gate holds the state. keep: gates too, for training."""
    time, lanes = codes.shape
    h = HIDDEN
    x = p["x"]
    x[:, PAD] = 0
    x[:, PAD, :h] = 60
    states = np.zeros((2, time, lanes, h), x.dtype)
    now = np.zeros((2, lanes, h), x.dtype)
    gates = []
    for t in range(time):
        a = np.stack([x[0][codes[t]], x[1][codes[time - 1 - t]]])
        u = np.matmul(now, p["h"])
        u += p["b"]
        zr = _sigmoid(a[..., : 2 * h] + u[..., : 2 * h])
        n = u[..., 2 * h :] * zr[..., h:]
        n += a[..., 2 * h :]
        np.tanh(n, out=n)
        if keep:
            gates.append((now, zr, n, u[..., 2 * h :]))
        now = n + zr[..., :h] * (now - n)
        states[0, t], states[1, time - 1 - t] = now
    return states, gates


def log_probabilities(p: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """(time, lanes, languages)."""
    out = np.matmul(states[0], p["v"][0]) + np.matmul(states[1], p["v"][1]) + p["c"]
    out -= out.max(axis=-1, keepdims=True)
    out -= np.log(np.exp(out).sum(axis=-1, keepdims=True))
    return out


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions that aren't padding, and its gradient by backpropagation through time."""
    time, lanes = codes.shape
    h = HIDDEN
    states, gates = forward(p, codes, keep=True)
    logs = log_probabilities(p, states)
    on = codes != PAD
    total = max(1, on.sum())
    loss = -(np.take_along_axis(logs, y[None, :, None], 2)[..., 0] * on).sum() / total
    d = np.exp(logs)
    np.put_along_axis(d, np.broadcast_to(y[None, :, None], (time, lanes, 1)), np.take_along_axis(d, y[None, :, None], 2) - 1, 2)
    d *= (on / total)[..., None].astype(d.dtype)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["c"] = d.sum(axis=(0, 1))
    for k in (0, 1):
        g["v"][k] = states[k].reshape(-1, h).T @ d.reshape(-1, d.shape[-1])
    above = np.stack([d @ p["v"][0].T, (d @ p["v"][1].T)[::-1]])  # by step of each direction
    back = np.zeros((2, lanes, h), d.dtype)
    into = np.zeros((2, time, lanes, 3 * h), d.dtype)
    for t in range(time - 1, -1, -1):
        now, zr, n, un = gates[t]
        z, r = zr[..., :h], zr[..., h:]
        dh = above[:, t] + back
        dn = dh * (1 - z) * (1 - n * n)
        da = np.concatenate([dh * (now - n) * z * (1 - z), dn * un * r * (1 - r), dn], axis=-1)
        du = da.copy()
        du[..., 2 * h :] *= r
        into[:, t] = da
        g["h"] += np.matmul(now.transpose(0, 2, 1), du)
        g["b"] += du.sum(axis=1, keepdims=True)
        back = dh * z + np.matmul(du, p["h"].transpose(0, 2, 1))
    for k, order in ((0, codes), (1, codes[::-1])):
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        kinds, first = np.unique(flat[by], return_index=True)
        g["x"][k][kinds] = np.add.reduceat(into[k].reshape(-1, 3 * h)[by], first, axis=0)
        g["x"][k][PAD] = 0
    return float(loss), g


def train(texts: list[bytes], langs: list[str], rounds: int = STEPS, seed: int = 7) -> tuple[list[str], dict[str, np.ndarray] | None]:
    names = sorted(set(langs))
    if len(names) < 2:
        return names, None
    p = start(len(names), seed)
    rng = np.random.default_rng(seed)
    by = [[t for t, lang in zip(texts, langs) if lang == n] for n in names]
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        codes, y = np.full((WINDOW, BATCH), PAD, np.int64), np.arange(BATCH) % len(names)
        for i, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            lo = int(rng.integers(max(1, len(t) - WINDOW + 1)))
            part = np.frombuffer(t[lo : lo + WINDOW], np.uint8)
            codes[: len(part), i] = part
        _, g = gradients(p, codes, y)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, v in g.items():
            v = v * np.float32(min(1.0, 5 / (norm + 1e-9)))
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            p[k] = (p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return names, p


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by (time, lane), each lane's text) of all bytes."""
    sizes = np.diff(offs)
    lanes = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), lanes)
    base = np.r_[0, np.cumsum(lanes)[:-1]]
    rank = np.arange(len(data)) - np.repeat(offs[:-1], sizes)
    codes = np.full((int(lanes.sum()), WINDOW), PAD, np.int16)
    codes[np.repeat(base, sizes) + rank // WINDOW, rank % WINDOW] = data
    return np.ascontiguousarray(codes.T), owner


def pooled(p: dict[str, np.ndarray], data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Language probabilities of texts."""
    codes, owner = windows(data, offs)
    langs = len(p["c"])
    sums = np.zeros((len(offs) - 1, langs))
    for lo in range(0, codes.shape[1], LANES):
        part = codes[:, lo : lo + LANES]
        logs = log_probabilities(p, forward(p, part)[0])
        logs[part == PAD] = 0
        np.add.at(sums, owner[lo : lo + LANES], logs.sum(axis=0))
    sums = SHARE * (sums - sums.max(axis=1, keepdims=True))
    e = np.exp(sums)
    return e / e.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """A model of at most `rows` texts, an equal share of each language (one at least), or all it has.

    Ids and languages alone are counted and drawn, four times the share in case texts have no letter; one more pass fetches the texts of what was drawn.
    """
    known = training_fold(F.col("doc_id")) & F.col("lang").isNotNull()
    ids = docs.where(known).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    # the `rows` commonest languages; more could not be learned from so many texts
    counts = F.broadcast(ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows))
    share = max(1, rows // max(1, counts.count()))
    # a language's least hashes, from about twice as many rows as are drawn, whatever its number
    h = F.xxhash64("doc_id")
    near = ids.withColumn("h", h).join(counts, "lang").where((F.col("n") <= 8 * share) | (F.col("h") < (F.lit(8.0 * share) / F.col("n") * 2.0**64 - 2.0**63).cast("long")))
    first = lambda k: F.row_number().over(Window.partitionBy("lang").orderBy("h", *k))
    picked = near.withColumn("place", first(["doc_id"])).where(F.col("place") <= 4 * share).select("doc_id", "lang").distinct()  # at most 4 rows
    texts = docs.where(known & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    drawn = texts.join(F.broadcast(picked), ["doc_id", "lang"]).withColumn("h", h)
    chosen = drawn.withColumn("place", first(["doc_id", "text"])).where(F.col("place") <= share).select("doc_id", "lang", "text").collect()
    chosen.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text.encode() for r in chosen], [r.lang for r in chosen])


def _predict(names: list[str], p: dict[str, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column("has").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(len(has), np.int64), np.ones(len(has))
            if p is not None:
                for lo, hi, data, offs in steps(batch.column("text"), 1 << 20):
                    q = pooled(p, data, offs)
                    best[lo:hi], score[lo:hi] = q.argmax(axis=1), q.max(axis=1)
            has &= len(names) > 0
            langs = [names[k] if ok else "und" for k, ok in zip(best, has)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(has, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model=None, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    names, p = model or learn(docs, rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("has"))
    return seen.mapInArrow(_predict(names, p), "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
