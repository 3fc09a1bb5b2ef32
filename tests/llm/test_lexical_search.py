import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from overlook.llm import lexical_search as op

from .helpers import awkward, clashing

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def brute(docs, items):
    """Every document scored for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for i, b, n in bags:
            m = 100 - 90 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:10], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, schema="doc_id long, text string"):
    got = op.search(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_whole_table_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.sql(op.ORACLE).select("item_id, rank, doc_id, score").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in op.query(spark, sf_dir).collect())


def test_small_shards_and_batches_equal_brute_force(spark, monkeypatch):
    """Many shards, several batches of items, many ties."""
    monkeypatch.setattr(op, "ITEMS", 7)
    rng = random.Random(3)
    words = [f"{'T' if i % 3 else 't'}opic{i // 9}w{i}" for i in range(400)]
    docs = []
    for i in range(1500):
        topic = rng.randrange(40) * 10
        docs.append((i, " ".join(rng.choice(words[topic : topic + 10] if rng.random() < 0.8 else words) for _ in range(rng.randrange(1, 60)))))
    docs += [(2000 + i, "ties are ranked by id, Ties ARE") for i in range(300)] + [(7, "ties again"), (None, "ties are without an id"), (None, "ties"), (3000, None), (3001, "-- !!")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice(words[10 * i : 10 * i + 10] + words) for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    items += [(30, "TIES are"), (31, "unknownterm"), (32, ""), (33, None), (3, "another text of item 3 topic0w1"), items[5], (None, "ties topic0w2"), (34, "ids")]
    assert found(spark, docs, items) == brute(docs, items)


def test_terms_are_those_of_the_pattern():
    texts = ["", "A-b_C9", "naïve CAFÉ é", "×÷ a\x00b", "𝄞x Y", "`a@b[c{d/e:f", "ÀA\x80\x9f", "  "]
    import pyarrow as pa

    for lo, hi, data, offs in op.steps(pa.array(texts)):
        doc, h = op.terms_of(data, offs)
    names = {}
    want = [(i, t) for i, x in enumerate(texts) for t in terms(x)]
    assert [d for d, _ in want] == doc.tolist()
    for (_, t), x in zip(want, h.tolist()):
        assert names.setdefault(t, x) == x
    assert len(set(names.values())) == len(names)


def cost(order, doc, term, size):
    """Bits of the gaps between the documents of each term's list."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.lexsort((place[doc], term))
    gaps = np.diff(place[doc][by])[np.diff(term[by]) == 0]
    return np.log2(gaps + 1.0).sum()


def test_bisection_brings_topics_together():
    rng = np.random.default_rng(5)
    docs, topic = 1024, rng.integers(0, 16, 1024)
    doc = np.repeat(np.arange(docs), 30)
    term = np.where(rng.random(len(doc)) < 0.7, topic[doc] * 50 + rng.integers(0, 50, len(doc)), rng.integers(0, 800, len(doc)))
    doc, term, _ = op.counted(doc, term)
    order = op.bisected(doc, term, docs, 64)
    assert sorted(order) == list(range(docs))
    assert cost(order, doc, term, docs) < 0.85 * cost(np.arange(docs), doc, term, docs)
    same = np.mean([len(set(topic[order[k : k + 64]])) for k in range(0, docs, 64)])
    assert same < 8  # 16 without an order


def test_swaps_lower_the_cost_of_halves():
    kind = np.array([0, 0, 0, 1, 0, 1, 1, 1])
    doc, term = np.repeat(np.arange(8), 2), (kind[:, None] * 2 + np.arange(2)).ravel()
    assert op.halved(doc, term, np.zeros(8, np.int64), 1).tolist() in (kind.tolist(), (1 - kind).tolist())
    two = np.concatenate([np.zeros(8, np.int64), np.ones(8, np.int64)])
    both = op.halved(np.concatenate([doc, doc + 8]), np.concatenate([term, term]), two, 2)
    assert both[:8].tolist() == both[8:].tolist() == kind.tolist()


def test_bounds_let_shards_be_skipped(spark):
    """A rare term's item visits few shards; the answer is still whole."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"g{i % 30}x{rng.randrange(40)}" for _ in range(20))) for i in range(6000)]
    index, totals = op.indexed(spark.createDataFrame(docs, "doc_id long, text string"))
    shards = index.count()
    q = op._batch(spark.createDataFrame([(1, "g7x1 g7x2 g7x3")], "item_id long, text string").collect())
    df = dict(map(tuple, index.select("terms", "ends").mapInArrow(op._frequencies(q), "term long, df long").groupBy("term").sum("df").collect()))
    q.weight = np.array([totals.weight(df[i]) for i in range(3)])
    open_ = index.select("shard", "terms", "best").mapInArrow(op._open_pairs(q, np.array([1]), {}), "of long, items binary, bounds binary").count()
    assert shards >= 40 and open_ < shards / 2
    assert found(spark, docs, [(1, "g7x1 g7x2 g7x3")]) == brute(docs, [(1, "g7x1 g7x2 g7x3")])


def test_awkward_rows(spark):
    df, _ = clashing(awkward(spark))
    docs = [(r.doc_id, r.text) for r in df.collect()]
    items = [(1, "one word3 tie naïve"), (2, "word1 WORD2")]
    got = op.search(df, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.search(none, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert found(spark, [(1, "a b")], [(1, None)]) == []
    assert op.search(df, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert op.search(df, spark.createDataFrame(items, "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]
