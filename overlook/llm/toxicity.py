"""Toxicity by a linear-chain conditional random field over words.

Learning reads a bounded sample of labelled rows (FIT_ROWS, a parameter; the rows whose hashed doc_id is
least, a quarter of them toxic at most) of the training folds. Labels are of documents, so words get
theirs from them: a word feature (the word, or a prefix of 4 to 6 letters) is an offender if it occurs in
OFTEN toxic documents or more and its rate there is OFFENDS times its rate elsewhere; words of toxic
documents with such a feature are tagged. The field has two states, hashed word features (the word,
prefixes of 3 to 6, suffix of 3) and transition weights, and is fitted by gradient steps on
forward-backward expectations in numpy. A sequence is a run of SPAN words.

Scoring tags every word of every whole text: marginals from forward-backward; words with a
marginal of one half or more give the offending offsets (code points), and a logistic layer over log1p of
their marginals' sum and the logit of the largest marginal gives the document's score. Labels, lang, source and doc_id take no part.

Edge cases: null and empty texts score as texts without offenders; labels that are null are skipped, of
repeated ones the largest counts; without both classes every score is the share of toxic labels (0
without labels); a null doc_id is scored, has no label and counts as held out; rows are independent;
empty tables give empty results; extra columns are ignored by `score` and kept by `keep_clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, keyed, table

FIT_ROWS, THRESHOLD = 2500, 0.7
SPAN, BUCKETS = 64, 1 << 18
OFTEN, OFFENDS = 4, 20.0
#: Slots of the offenders' counts.
SLOTS = 1 << 22
CACHE = 200_000
WORD = re.compile(r"\S+")
EDGES = "\"'.,;:!?()[]{}<>$%&*#|-_~^`+=/\\"


def core(word: str) -> str:
    return word.strip(EDGES).lower()


def lexical(word: str) -> list[str]:
    """Features that can offend."""
    w = core(word)
    return [f"w{w}", *(f"p{w[:k]}" for k in (4, 5, 6) if len(w) > k)] if w else []


def buckets(word: str) -> list[int]:
    w = core(word)
    if not w:
        return []
    names = [f"w{w}", *(f"p{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), f"s{w[-3:]}"]
    return [crc32(n.encode()) & (BUCKETS - 1) for n in names]


def training_fold(doc_id) -> F.Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1. Rows without an id are never learned from, and so count as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1, F.lit(False))


class Chain:
    """Two-state chain: start scores, transitions and a score of state 1 for each word."""

    def __init__(self, start: np.ndarray, moves: np.ndarray):
        self.start, self.moves = start, moves

    def passes(self, unary: np.ndarray, mask: np.ndarray):
        """(forward, backward, log partition) of sequences (n, time); each message has a column per state."""
        n, time = unary.shape
        t = self.moves
        f = np.zeros((time, 2, n))
        f[0, 0], f[0, 1] = self.start[0], self.start[1] + unary[:, 0]
        for i in range(1, time):
            on = mask[:, i]
            f[i, 0] = np.where(on, np.logaddexp(f[i - 1, 0] + t[0, 0], f[i - 1, 1] + t[1, 0]), f[i - 1, 0])
            f[i, 1] = np.where(on, np.logaddexp(f[i - 1, 0] + t[0, 1], f[i - 1, 1] + t[1, 1]) + unary[:, i], f[i - 1, 1])
        b = np.zeros((time, 2, n))
        for i in range(time - 2, -1, -1):
            on = mask[:, i + 1]
            one = unary[:, i + 1] + b[i + 1, 1]
            b[i, 0] = np.where(on, np.logaddexp(t[0, 0] + b[i + 1, 0], t[0, 1] + one), 0)
            b[i, 1] = np.where(on, np.logaddexp(t[1, 0] + b[i + 1, 0], t[1, 1] + one), 0)
        return f, b, np.logaddexp(f[-1, 0], f[-1, 1])

    def marginals(self, unary: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b, z = self.passes(unary, mask)
        return np.where(mask, np.exp(np.minimum(0, f[:, 1] + b[:, 1] - z)).T, 0)


def in_spans(counts: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of every word when documents of so many words are cut to runs of SPAN, and the number of runs."""
    counts = np.asarray(counts, np.int64)
    runs = -(-counts // SPAN)
    base = np.r_[0, np.cumsum(runs)[:-1]]
    rank = np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    return np.repeat(base, counts) + rank // SPAN, rank % SPAN, int(runs.sum())


def fit_chain(texts: list[np.ndarray], tags: list[np.ndarray], table: np.ndarray, steps: int = 300, batch: int = 256, seed: int = 6) -> tuple[np.ndarray, Chain]:
    """Weights of buckets and the chain, from tagged words; runs with no tag are kept one in three. texts are places in table, which has each word's buckets (-1: none)."""
    rng = np.random.default_rng(seed)
    row, col, n = in_spans([len(t) for t in texts])
    y = np.zeros((n, SPAN), bool)
    y[row, col] = np.concatenate(tags)
    keep = y.any(axis=1) | (rng.random(n) < 1 / 3)
    mask = np.zeros((n, SPAN), bool)
    mask[row, col] = True
    at = np.cumsum(keep) - 1
    use = np.flatnonzero(keep[row])
    found = table[np.concatenate(texts)[use]]
    owner = np.broadcast_to((at[row[use]] * SPAN + col[use])[:, None], found.shape)[found >= 0]
    flat = found[found >= 0]
    y, mask = y[keep], mask[keep]
    n = len(y)
    w = np.zeros(BUCKETS)
    chain = Chain(np.array([0.0, -3.0]), np.array([[0.0, -3.0], [0.0, -1.0]]))
    square = np.full(BUCKETS, 1e-2)
    square_t = np.full(8, 1e-1)
    ends = np.searchsorted(owner // SPAN, np.arange(n + 1))
    for _ in range(-(-steps * batch // n)):
        shuffled = rng.permutation(n)
        for lo in range(0, n, batch):
            pick = shuffled[lo : lo + batch]
            size = ends[pick + 1] - ends[pick]
            mine = np.repeat(ends[pick] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            cell = np.repeat(np.arange(len(pick)), size) * SPAN + owner[mine] % SPAN
            unary = np.bincount(cell, w[flat[mine]], len(pick) * SPAN).reshape(len(pick), SPAN)
            f, b, z = chain.passes(unary, mask[pick])
            p = np.where(mask[pick], np.exp(np.minimum(0, f[:, 1] + b[:, 1] - z)).T, 0)
            gap = np.where(mask[pick], y[pick] - p, 0)
            g = np.bincount(flat[mine], gap.ravel()[cell], BUCKETS) / len(pick) - 1e-5 * w
            square += g * g
            w += 0.5 * g / np.sqrt(square)
            step = np.zeros(8)
            both = mask[pick][:, 1:]
            for a in (0, 1):
                for c in (0, 1):
                    lead = f[:-1, a] + chain.moves[a, c] + (unary[:, 1:].T if c else 0) + b[1:, c] - z
                    seen = (y[pick][:, :-1] == bool(a)) & (y[pick][:, 1:] == bool(c)) & both
                    step[2 * a + c] = (seen.sum() - np.exp(np.minimum(0, lead)).T[both].sum()) / len(pick)
            step[4] = (~y[pick][:, 0] & mask[pick][:, 0]).sum() / len(pick) - (1 - p[:, 0]).sum() / len(pick)
            step[5] = y[pick][:, 0].sum() / len(pick) - p[:, 0].sum() / len(pick)
            square_t += step * step
            move = 0.1 * step / np.sqrt(square_t)
            chain = Chain(chain.start + move[4:6], chain.moves + move[:4].reshape(2, 2))
    return w, chain


class Model:
    def __init__(self, weights: np.ndarray | None, chain: Chain | None, layer: np.ndarray, base: float):
        self.weights, self.chain, self.layer, self.base = weights, chain, layer, base
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def unary(self, words: list[str]) -> list[float]:
        known, out = self._known, []
        if len(known) > CACHE:
            known.clear()
        for w in words:
            u = known.get(w)
            if u is None:
                u = known[w] = float(sum(self.weights[k] for k in buckets(w)))
            out.append(u)
        return out

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(each word's marginal of being toxic, each text's first word)."""
        return self.tagged([np.array(self.unary(t)) for t in texts])

    def tagged(self, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        counts = [len(t) for t in scores]
        first = np.r_[0, np.cumsum(counts)].astype(np.int64)
        row, col, n = in_spans(counts)
        out = np.zeros(first[-1])
        u = np.concatenate([np.zeros(0), *scores])
        for lo in range(0, n, 1 << 14):
            a, b = np.searchsorted(row, (lo, lo + (1 << 14)))
            if a == b:
                continue
            size = int(row[b - 1]) - lo + 1
            unary, mask = np.zeros((size, SPAN)), np.zeros((size, SPAN), bool)
            unary[row[a:b] - lo, col[a:b]], mask[row[a:b] - lo, col[a:b]] = u[a:b], True
            out[a:b] = self.chain.marginals(unary, mask)[row[a:b] - lo, col[a:b]]
        return out, first

    @staticmethod
    def pooled(p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row for each text: log1p of the sum of its offending words' marginals, and the bounded logit of the largest marginal."""
        total = np.r_[0, np.cumsum(np.where(p >= 0.5, p, 0))]
        add = total[first[1:]] - total[first[:-1]]
        some = np.flatnonzero(np.diff(first))
        top = np.full(len(add), 1e-4)
        if len(some):
            top[some] = np.maximum.reduceat(p, first[:-1][some])
        top = np.clip(top, 1e-4, 1 - 1e-4)
        return np.stack([np.log1p(np.maximum(add, 0)), np.log(top / (1 - top)) / 10, np.ones(len(add))], axis=1)

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.weights is None:
            return np.full(len(texts), self.base), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
        p, first = self.marginals(texts)
        return 1 / (1 + np.exp(-np.clip(self.pooled(p, first) @ self.layer, -30, 30))), p, first


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w), -2, 2)
    return w


def fit(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, int)
    base = float(y.mean()) if len(y) else 0.0
    if len(np.unique(y)) < 2:
        return Model(None, None, np.zeros(3), base)
    # texts become places in the vocabulary, words become rows of hashed features
    place: dict[str, int] = {}
    coded = [np.fromiter((place.setdefault(w, len(place)) for w in t.split()), np.int32) for t in texts]
    lexicon, features = np.full((len(place), 4), -1, np.int32), np.full((len(place), 6), -1, np.int32)
    for i, w in enumerate(place):
        names, found = lexical(w), buckets(w)
        lexicon[i, : len(names)] = [crc32(n.encode()) & (SLOTS - 1) for n in names]
        features[i, : len(found)] = found
    del place
    seen = np.zeros((2, SLOTS), np.int32)
    for t, label in zip(coded, y):
        slots = np.unique(lexicon[np.unique(t)])
        seen[label, slots[slots >= 0]] += 1
    total = np.bincount(y, minlength=2)
    worst = (seen[1] >= OFTEN) & (seen[1] / total[1] >= OFFENDS * (seen[0] + 0.5) / total[0])
    bad = (worst[lexicon] & (lexicon >= 0)).any(axis=1)
    if not bad.any():
        return Model(None, None, np.zeros(3), base)
    tags = [bad[t] if label == 1 else np.zeros(len(t), bool) for t, label in zip(coded, y)]
    weights, chain = fit_chain(coded, tags, features)
    model = Model(weights, chain, np.zeros(3), base)
    unary = np.where(features >= 0, weights[features], 0).sum(axis=1)
    p, first = model.tagged([unary[t] for t in coded])
    model.layer = logistic(model.pooled(p, first), y.astype(float))
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of a bounded sample of the labelled rows in the training folds; at most `rows` texts come to the driver."""
    marked = labels.where(training_fold(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, other = bounded_sample(marked.where("toxic = 1"), rows // 4), bounded_sample(marked.where("toxic = 0"), rows - rows // 4)
    picked = F.broadcast(toxic.union(other))  # at most `rows` pairs of numbers
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(picked, "doc_id").orderBy("doc_id", "text").limit(2 * rows).collect()
    found.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in found], [int(r.toxic) for r in found])


SCORED_DDL = "key long, doc_id long, score double, spans string"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for lo in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.column("text").slice(lo, 512).to_pylist()]
                s, p, first = model.scores([t.split() for t in texts])
                scores.append(s)
                hit = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(first, hit, side="right") - 1
                found = [""] * len(texts)
                for i in np.unique(owner):
                    where = [m.span() for m in WORD.finditer(texts[i])]
                    found[i] = ",".join("%d:%d" % where[k - first[i]] for k in hit[owner == i])
                spans += found
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else []), pa.array(spans, pa.string())], names=["key", "doc_id", "score", "spans"])

    return run


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(key, doc_id, score, spans) of every row; spans are start:end of offending words."""
    return keyed(docs).select("key", "doc_id", "text").mapInArrow(_score(learn(docs, labels, rows)), SCORED_DDL)


def _tagged(model: Model, columns: list[str], mark: str):
    names = [*columns, mark]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = columns.index("text")
        for batch in batches:
            out = [np.zeros(0)]
            for lo in range(0, batch.num_rows, 512):
                out.append(model.scores([(t or "").split() for t in batch.column(place).slice(lo, 512).to_pylist()])[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=names)

    return run


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns stay, whatever their names. One pass, no shuffle."""
    mark = "score"
    while mark in (c.lower() for c in docs.columns):
        mark += "_"
    schema = StructType([*docs.schema.fields, StructField(mark, DoubleType())])
    return docs.mapInArrow(_tagged(learn(docs, labels, rows), docs.columns, mark), schema).where(F.col(mark) < threshold).drop(mark)


def query(spark, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
