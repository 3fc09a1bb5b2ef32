"""Ranked lexical search over shards of documents that recursive graph bisection has put in order.

Documents and their terms are a bipartite graph. Bisection halves the documents and swaps those whose move lowers the
cost of the halves' postings most (a term in a of n documents costs a * log2(n / (a + 1))), then goes on inside each half
(`bisected`). The upper LEVELS halvings are learned from a bounded sample of FIT_ROWS documents: every document goes down
this tree by its terms' preference for either half (`_tree`). Rows are dealt along the leaves, spread by hash inside a leaf, so that
no leaf or group of copies is one task; each task bisects blocks of BLOCK documents of a leaf down to shards of SHARD documents.

The index has a row for each shard: its terms with their document counts, the greatest impact of each term in it, and the
postings. A query's bound for a shard is the sum of its terms' weights times these impacts. Queries go in batches of
ITEMS. First each item visits the SEEDS shards of greatest bound, whose results give its score to beat; then the shards whose bound
reaches it, equal bounds included, as an equal score with a smaller doc_id still counts. Within a task shards go by falling bound, and
an item stops where the bound falls below its tenth score so far. Only what is visited is sent to Python; the answer is
that of scoring everything.

Terms are named by 64-bit hashes. Scores follow the contract in 64-bit integers; sums are exact.

Edge cases: null or empty texts, and texts without terms, are not indexed and count neither in N nor in L; an item without terms has no
results; items that repeat item_id and text count once, equal item_ids with other texts are ranked each for itself; rows that repeat a doc_id are
documents of their own; null doc_ids come after others of the same score; an empty table on either side gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import R_BYTE, blobs, bounded_sample, materialize, shuffle_parts, span_hash, steps, table

TOP = 10
FIT_ROWS, LEVELS, BUCKETS = 4096, 6, 1 << 13
BLOCK, BLOCK_POSTINGS, SHARD, ROUNDS = 4096, 1 << 21, 128, 4
#: Items whose terms are sent to all tasks at once, and shards that each of them visits first.
ITEMS, SEEDS = 1024, 8

#: Bytes of terms: digits, letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[0x41:0x5B] += np.uint64(0x20)


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each term of a run of documents, in order."""
    inside = np.concatenate([[False], TERM[data], [False]])
    begin, end = inside[1:-1].copy(), inside[1:-1].copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begin &= ~inside[:-2] | edge[:-1]
    end &= ~inside[2:] | edge[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(offs, starts, side="right") - 1
    return doc, span_hash(LOWER[data] + np.uint64(1), starts, ends, R_BYTE) if len(starts) else np.zeros(0, np.uint64)


def counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences), sorted."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])[: len(doc)])
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


def _ranks(groups: np.ndarray, count: int) -> np.ndarray:
    """Place of each element inside its group, for groups in order."""
    return np.arange(len(groups)) - np.searchsorted(groups, np.arange(count))[groups]


def halved(doc: np.ndarray, term: np.ndarray, node: np.ndarray, nodes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The half, 0 or 1, of each document inside its node, after swaps of the pairs that gain most. Documents start in the order they have."""
    docs = len(node)
    order = np.argsort(node, kind="stable")
    size = np.bincount(node, minlength=nodes)
    half = np.zeros(docs, np.int64)
    half[order] = _ranks(node[order], nodes) >= (size[node[order]] + 1) // 2
    pairs, pair = np.unique(node[doc] * (int(term.max(initial=0)) + 1) + term, return_inverse=True)
    of = np.zeros(len(pairs), np.int64)
    of[pair] = node[doc]  # each pair's node
    log = np.log2(np.arange(docs + 3) + 1.0)  # log[k] is log2(k + 1)
    members = np.bincount(node * 2 + half, minlength=2 * nodes).reshape(-1, 2)  # swaps keep them
    log_a, log_b = (np.log2(np.maximum(members[:, i], 1))[of] for i in (0, 1))
    for _ in range(rounds):
        seen = np.bincount(pair * 2 + half[doc], minlength=2 * len(pairs)).reshape(-1, 2)
        a, b = seen[:, 0], seen[:, 1]
        now = a * (log_a - log[a]) + b * (log_b - log[b])
        to_b = now - (a - 1) * (log_a - log[np.maximum(a - 1, 0)]) - (b + 1) * (log_b - log[b + 1])
        to_a = now - (a + 1) * (log_a - log[a + 1]) - (b - 1) * (log_b - log[np.maximum(b - 1, 0)])
        gain = np.bincount(doc, np.where(half[doc] == 0, to_b[pair], to_a[pair]), docs)
        side = node * 2 + half
        order = np.lexsort((-gain, side))
        rank = _ranks(side[order], 2 * nodes)
        best = np.full((2 * nodes, int(members.max(initial=0))), -np.inf)
        best[side[order], rank] = gain[order]
        swaps = (best[0::2] + best[1::2] > 1e-9).sum(1)  # the best of both sides, then the second best: sums fall
        moved = order[rank < swaps[node[order]]]
        if not len(moved):
            break
        half[moved] ^= 1
    return half


def bisected(doc: np.ndarray, term: np.ndarray, docs: int, shard: int = SHARD) -> np.ndarray:
    """The documents 0..docs-1 in an order in which alike ones are near: halved until `shard` or fewer lie together."""
    kept = np.bincount(term, minlength=1)[term] > 1  # a term of one document favours no order
    doc, term = doc[kept], term[kept]
    node, nodes = np.zeros(docs, np.int64), 1
    while math.ceil(docs / nodes) > shard:
        node = node * 2 + halved(doc, term, node, nodes)
        nodes *= 2
    return np.argsort(node, kind="stable")


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: for each inner node of the tree its buckets' preference for the second half and the median of its documents' preferences."""
    docs, terms, base = [], [], 0
    for batch in batches:
        for lo, hi, data, offs in steps(batch.column("text")):
            d, t = terms_of(data, offs)
            d, t, _ = counted(d, (t & np.uint64(BUCKETS - 1)).astype(np.int64))
            docs.append(d + base)
            terms.append(t)
            base += hi - lo
    doc, term = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (docs, terms))
    distinct = np.maximum(np.bincount(doc, minlength=base), 1)
    node = np.zeros(base, np.int64)
    likes, middles = [], []
    for level in range(LEVELS if base else 0):
        nodes = 1 << level
        side = node * 2 + halved(doc, term, node, nodes)
        seen = np.bincount(side[doc] * BUCKETS + term, minlength=2 * nodes * BUCKETS).reshape(nodes, 2, BUCKETS)
        share = np.log2((seen + 0.5) / (np.bincount(side, minlength=2 * nodes).reshape(nodes, 2, 1) + 1.0))
        like = (share[:, 1] - share[:, 0]).astype(np.float32)
        mean = np.bincount(doc, like[node[doc], term], base) / distinct
        middles += [np.median(mean[node == k]) if (node == k).any() else 0.0 for k in range(nodes)]
        likes.append(like)
        node = side
    likes = np.concatenate(likes).tobytes() if likes else b""
    yield pa.RecordBatch.from_arrays([pa.array([likes], pa.binary()), pa.array([np.array(middles).tobytes()], pa.binary())], names=["likes", "middles"])


def fitted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tree of the upper levels, from a bounded sample that one task bisects."""
    sample = bounded_sample(docs.select("doc_id", "text"), FIT_ROWS).select("text")
    found = sample.coalesce(1).mapInArrow(_tree, "likes binary, middles binary").collect()
    likes, middles = (found[0].likes, found[0].middles) if found else (b"", b"")
    return np.frombuffer(likes, np.float32).reshape(-1, BUCKETS), np.frombuffer(middles)


def _tokenised(likes: np.ndarray, middles: np.ndarray) -> Callable:
    names = ["leaf", "doc_id", "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offs in steps(batch.column("text")):
                doc, term = terms_of(data, offs)
                n = np.bincount(doc, minlength=hi - lo)
                doc, term, tf = counted(doc, term)
                bucket = (term & np.uint64(BUCKETS - 1)).astype(np.int64)
                distinct = np.bincount(doc, minlength=hi - lo)
                node = np.zeros(hi - lo, np.int64)
                for level in range(LEVELS if len(middles) else 0):
                    at = node + (1 << level) - 1
                    mean = np.bincount(doc, likes[at[doc], bucket], hi - lo) / np.maximum(distinct, 1)
                    node = node * 2 + (mean > middles[at])
                cuts, held = np.append(0, np.cumsum(distinct)), pa.array(n > 0)
                columns = [pa.array(node, pa.int32()), ids.slice(lo, hi - lo), pa.array(n), pa.array(blobs(term, cuts), pa.binary()), pa.array(blobs(tf.astype(np.uint32), cuts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(held)

    return run


@dataclass
class Totals:
    """N and L: documents with a term, and their terms with repeats."""

    docs: int
    terms: int

    def length(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        return 10 + 90 * n * self.docs // self.terms

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def _shards(totals: Totals) -> Callable:
    schema = pa.schema([("shard", pa.int64()), ("terms", pa.binary()), ("ends", pa.binary()), ("best", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ms", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())])

    def block(first: int, ids: list, ns: list, terms: list, tfs: list) -> pa.RecordBatch:
        term, names = np.unique(np.concatenate(terms), return_inverse=True)[::-1]
        doc, tf = np.repeat(np.arange(len(ids)), [len(t) for t in terms]), np.concatenate(tfs).astype(np.int64)
        order = bisected(doc, term, len(ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = totals.length(np.array(ns, np.int64))
        shard, at = np.divmod(place[doc], SHARD)
        by = np.lexsort((at, term, shard))
        shard, at, term, tf, impact = shard[by], at[by], term[by], tf[by], Totals.impact(tf, m[doc])[by]
        rows = []
        for k in range(-(-len(ids) // SHARD)):
            mine = slice(*np.searchsorted(shard, [k, k + 1]))
            lists = np.flatnonzero(np.append(True, np.diff(term[mine]) != 0))
            here = order[k * SHARD : (k + 1) * SHARD]
            ends = np.append(lists[1:], mine.stop - mine.start)
            rows.append((first + k, names[term[mine][lists]].tobytes(), ends.astype(np.uint32).tobytes(), np.maximum.reduceat(impact[mine], lists).astype(np.uint32).tobytes(), [ids[i] for i in here], m[here].tobytes(), at[mine].astype(np.uint16).tobytes(), tf[mine].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held, size, leaf = ([], [], [], []), 0, None
        for batch in batches:
            for of, i, n, t, f in zip(*(batch.column(c).to_pylist() for c in ("leaf", "doc_id", "n", "terms", "tfs"))):
                if held[0] and (of != leaf or len(held[0]) == BLOCK or size + len(t) // 8 > BLOCK_POSTINGS):
                    yield (out := block(number, *held))
                    number += out.num_rows
                    held, size = ([], [], [], []), 0
                leaf, size = of, size + len(t) // 8
                for x, v in zip(held, (i, n, np.frombuffer(t, np.uint64), np.frombuffer(f, np.uint32))):
                    x.append(v)
        if held[0]:
            yield block(number, *held)

    return run


SHARDS_DDL = "shard long, terms binary, ends binary, best binary, doc_ids array<long>, ms binary, docs binary, tfs binary"


def indexed(docs: DataFrame) -> tuple[DataFrame, Totals]:
    """(index of shards, totals) of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(_tokenised(*fitted(rows)), "leaf int, doc_id long, n long, terms binary, tfs binary"), "terms")
    leaves = sorted(tuple(r) for r in rows.groupBy("leaf").agg(F.count("*"), F.sum("n"), F.sum(F.octet_length("terms"))).collect())  # 2**LEVELS rows at most
    totals = Totals(sum(r[1] for r in leaves), sum(r[2] for r in leaves))
    if not leaves:
        return rows.sparkSession.createDataFrame([], SHARDS_DDL), totals
    # leaves lie one behind the other by bytes; a row goes to a hashed place inside its leaf
    parts, sizes = shuffle_parts(docs.sparkSession), [0] * (1 << LEVELS)
    for leaf, *_, size in leaves:
        sizes[leaf] = size
    before, whole = list(itertools.accumulate(sizes, initial=0)), sum(sizes)
    at = lambda values: F.array(*(F.lit(float(v)) for v in values))[F.col("leaf")]
    within = F.pmod(F.xxhash64("doc_id", "terms"), F.lit(1 << 20)) / float(1 << 20)
    place = F.floor((at(before) + within * at(sizes)) / float(whole) * parts)
    dealt = rows.repartitionById(parts, F.least(place, F.lit(parts - 1)).cast("int")).sortWithinPartitions("leaf")
    return materialize(dealt.mapInArrow(_shards(totals), SHARDS_DDL), "shards"), totals


@dataclass
class Queries:
    """A batch of items: their distinct terms in order, and for each (item, term) pair, by item, the two places."""

    ids: list
    terms: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def met(self, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(term of ours, place in the shard) of the terms that a shard holds."""
        there = np.frombuffer(terms, np.uint64)
        at = np.minimum(np.searchsorted(there, self.terms), len(there) - 1)
        mine = np.flatnonzero(there[at] == self.terms)
        return mine, at[mine]

    def bounds(self, mine: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Each item's bound in a shard that holds the terms `mine` with these impacts."""
        worth = np.zeros(len(self.terms))
        worth[mine] = self.weight[mine] * best
        return np.bincount(self.item, worth[self.term], len(self.ids)).astype(np.int64)


def _batch(rows: list) -> Queries:
    data, offs = (x := pa.array([r.text or "" for r in rows], pa.string())), None
    for lo, _, data, offs in steps(x, 1 << 62):
        item, term, _ = counted(*terms_of(data, offs))
        terms, term = np.unique(term, return_inverse=True)
    return Queries([r.item_id for r in rows], terms, item, term, np.zeros(len(terms), np.int64))


def _frequencies(q: Queries) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist()):
                mine, at = q.met(terms)
                df[mine] += np.diff(np.frombuffer(ends, np.uint32).astype(np.int64), prepend=0)[at]
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], names=["term", "df"])

    return run


def _best_shards(q: Queries) -> Callable:
    """(item, shard, bound): the SEEDS shards of greatest bound of each item, among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((3, 0), np.int64)
        for batch in batches:
            found = [kept]
            for shard, terms, best in zip(*(batch.column(c).to_pylist() for c in ("shard", "terms", "best"))):
                mine, at = q.met(terms)
                bound = q.bounds(mine, np.frombuffer(best, np.uint32)[at])
                item = np.flatnonzero(bound)
                found.append(np.stack([item, np.full(len(item), shard), bound[item]]))
            kept = np.concatenate(found, axis=1)
            kept = kept[:, np.lexsort((kept[1], -kept[2], kept[0]))]
            kept = kept[:, _ranks(kept[0], len(q.ids)) < SEEDS]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["item", "shard", "bound"])

    return run


def _open_pairs(q: Queries, beat: np.ndarray, visited: dict[int, np.ndarray]) -> Callable:
    """(shard, items, bounds): what is still to be visited, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, terms, best in zip(*(batch.column(c).to_pylist() for c in ("shard", "terms", "best"))):
                mine, at = q.met(terms)
                bound = q.bounds(mine, np.frombuffer(best, np.uint32)[at])
                bound[visited.get(shard, [])] = 0
                item = np.flatnonzero(bound >= beat)
                if len(item):
                    rows.append((shard, item.astype(np.int32).tobytes(), bound[item].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["of", "items", "bounds"])

    return run


def _visited(q: Queries, beat: np.ndarray) -> Callable:
    """(item, doc_id, score): the TOP documents of each item among the shards that a task visits."""

    def best_of(x: np.ndarray) -> np.ndarray:
        """Rows (item, no id, id, score) of which each item keeps its TOP best."""
        x = x[:, np.lexsort((x[2], x[1], -x[3], x[0]))]
        return x[:, _ranks(x[0], len(q.ids)) < TOP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, least = np.zeros((4, 0), np.int64), beat.copy()
        for batch in batches:
            bounds = [np.frombuffer(b, np.int64) for b in batch.column("bounds").to_pylist()]
            for i in sorted(range(len(bounds)), key=lambda i: -int(bounds[i].max())):
                row = {c: batch.column(c)[i].as_py() for c in ("terms", "ends", "doc_ids", "ms", "docs", "tfs", "items")}
                items = np.frombuffer(row["items"], np.int32).astype(np.int64)
                items = items[bounds[i] >= least[items]]
                if not len(items):
                    continue
                found = best_of(np.concatenate([kept, scored(q, row, items, least)], axis=1))
                rank = _ranks(found[0], len(q.ids))
                full = found[:, rank == TOP - 1]
                least[full[0]] = np.maximum(least[full[0]], full[3])
                kept = found
        ids = pa.array(kept[2], mask=kept[1] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), ids, pa.array(kept[3])], names=["item", "doc_id", "score"])

    return run


def scored(q: Queries, row: dict, items: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(item, no id, id, score) of a shard's documents that reach an item's least score."""
    ms = np.frombuffer(row["ms"], np.int64)
    mine, at = q.met(row["terms"])
    ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
    size = np.diff(ends, prepend=0)[at]
    post = np.arange(size.sum()) + np.repeat(ends[at] - np.cumsum(size), size)
    doc, tf = np.frombuffer(row["docs"], np.uint16)[post], np.frombuffer(row["tfs"], np.uint32)[post].astype(np.int64)
    worth = np.zeros((len(mine) + 1, len(ms)))  # sums stay below 2**53; the last row is that of terms the shard has not
    worth[np.repeat(np.arange(len(mine)), size), doc] = np.repeat(q.weight[mine], size) * Totals.impact(tf, ms[doc])
    place = np.full(len(q.terms), len(mine))
    place[mine] = np.arange(len(mine))
    wanted = np.zeros(len(q.ids), bool)
    wanted[items] = True
    pair = np.flatnonzero(wanted[q.item] & (place[q.term] < len(mine)))
    first = np.flatnonzero(np.diff(q.item[pair], prepend=-1))
    score = np.add.reduceat(worth[place[q.term[pair]]], first).astype(np.int64)
    item = q.item[pair[first]]
    hit, doc = np.nonzero((score >= least[item][:, None]) & (score > 0))
    ids = row["doc_ids"]
    return np.stack([item[hit], np.array([ids[d] is None for d in doc], np.int64), np.array([ids[d] or 0 for d in doc], np.int64), score[hit, doc]]).reshape(4, -1)


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {TOP}")


VISITED_DDL = "item long, doc_id long, score long"
RESULT_DDL = "item_id long, rank int, doc_id long, score long"


def _search(index: DataFrame, totals: Totals, q: Queries) -> DataFrame:
    """(item_id, rank, doc_id, score) of one batch of items."""
    spark = index.sparkSession
    df = dict(map(tuple, index.select("terms", "ends").mapInArrow(_frequencies(q), "term long, df long").groupBy("term").agg(F.sum("df")).collect()))  # one row a term of the batch
    q.weight = np.array([totals.weight(df.get(i, 0)) for i in range(len(q.terms))], np.int64)
    names = index.select("shard", "terms", "best")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "shard")
    seeds = names.mapInArrow(_best_shards(q), "item long, shard long, bound long").withColumn("r", F.row_number().over(order)).where(f"r <= {SEEDS}").collect()
    visited: dict[int, list] = {}
    for r in seeds:  # ITEMS x SEEDS rows at most
        visited.setdefault(r.shard, []).append((r.item, r.bound))
    first = [(s, np.array([i for i, _ in x], np.int32).tobytes(), np.array([b for _, b in x], np.int64).tobytes()) for s, x in visited.items()]
    first = spark.createDataFrame(first, "of long, items binary, bounds binary")
    one = np.ones(len(q.ids), np.int64)
    tops = materialize(_ranked(index.join(F.broadcast(first), F.col("shard") == F.col("of")).mapInArrow(_visited(q, one), VISITED_DDL)), "tops")
    beat = one.copy()
    for r in tops.where(f"rank = {TOP}").collect():
        beat[r.item] = r.score
    done = {s: np.array([i for i, _ in x]) for s, x in visited.items()}
    rest = names.mapInArrow(_open_pairs(q, beat, done), "of long, items binary, bounds binary")
    rest = index.join(rest, F.col("shard") == F.col("of")).mapInArrow(_visited(q, beat), VISITED_DDL)
    ids = F.array(*(F.lit(i).cast("long") for i in q.ids))
    return _ranked(tops.drop("rank").union(rest)).select(ids[F.col("item").cast("int")].alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of docs(doc_id, text) for each of items(item_id, text)."""
    index, totals = indexed(docs)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    out = []
    for rows in itertools.batched(items.toLocalIterator(), ITEMS):
        q = _batch(list(rows))
        if len(q.terms) and totals.docs:
            out.append(materialize(_search(index, totals, q), "ranks"))
    return reduce(DataFrame.union, out) if out else docs.sparkSession.createDataFrame([], RESULT_DDL)


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (
    SELECT doc_id, {_TERMS.format("text")} AS terms FROM documents
), t AS (
    SELECT doc_id, count(*) OVER () AS docs, CAST(sum(len(terms)) OVER () AS BIGINT) AS total, len(terms) AS n, terms FROM d WHERE len(terms) > 0
), p AS (
    SELECT doc_id, any_value(docs) AS docs, 100 - 90 + (90 * any_value(n) * any_value(docs)) // any_value(total) AS m, term, count(*) AS tf
    FROM (SELECT *, unnest(terms) AS term FROM t) GROUP BY doc_id, term
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(docs) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w FROM p GROUP BY term
), q AS (
    SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark
), s AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
