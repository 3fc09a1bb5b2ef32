import random

import pytest

from overlook.llm import ngram_join as op
from overlook.llm.components import components

from .helpers import awkward, clashing, docs_frame, untouched


def shingle_set(t, size=5):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {i: i for i in range(len(sets))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(sets)
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (low[find(i)], links[i]) for i, (d, _) in enumerate(sets)}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 7])
def test_matches_brute_force(spark, block, monkeypatch):
    """Small blocks make many pairs of blocks; pairs close to the threshold may be missed at the stated recall, so none lie there."""
    monkeypatch.setattr(op, "BLOCK", block)
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(500)]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(12)]
    texts = [edited(rng, b, rng.choice([0, 1, 2, 15, 30])) for b in bases for _ in range(rng.choice([1, 3, 40]))]
    texts += ["a b c", "a b c", "c b a", "x", ""]
    rows = list(enumerate(texts))
    assert result(op.join(docs_frame(spark, texts))) == brute(rows)


def test_whole_table_recall(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got, want = result(op.query(spark, sf_dir)), brute(rows)
    assert sum(got[d] == want[d] for d in want) >= 0.99 * len(want)
    assert all(got[d][1] <= want[d][1] for d in want)


def test_band_choice():
    for threshold in (0.6, 0.8, 0.9):
        bands, rows = op.choose(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(2, 60)]
    df = spark.createDataFrame(chain + hub + [(7, 7), (500, 499), (499, 500)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 60)) and got[500] == got[499] == 499
    assert components(df.limit(0)).collect() == []


def test_awkward_rows(spark):
    df = awkward(spark)
    out = op.join(df).collect()
    assert len(out) == 10
    by = {r.doc_id: (r.class_id, r.n_links) for r in out}
    assert by[5] == (5, 1) and by[6] == (5, 1) and by[1] == (1, 0) and by[2] == (2, 0) and by[None] == (None, 0)
    kept = op.keep_one(df.withColumn("rep", df.text).withColumn("key", df.text))
    assert kept.columns == [*df.columns, "rep", "key"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 8]
    assert op.join(df.limit(0)).collect() == []


def test_keep_one_leaves_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs, names = clashing(docs_frame(spark, [text, text, "other", None]))
    out = op.keep_one(docs)
    assert untouched(out, docs, names) and sorted(r.doc_id for r in out.collect()) == [0, 2, 3]


def test_pair_recall(spark, sf_dir):
    """Links found among all that full sets give, over the whole next table."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()]
    got = result(op.query(spark, sf_dir.replace("sf0.001", "sf0.01")))
    want = brute(texts)
    there = sum(n for _, n in want.values())
    assert there > 100 and sum(got[d][1] for d in want) >= 0.99 * there and all(got[d][1] <= want[d][1] for d in want)


def test_repeated_and_null_ids(spark):
    """Classes join sets, not ids: unlike texts of one id stay apart, and rows without an id are held together by their texts alone."""
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(200)) for _ in range(4)]
    near = [edited(rng, b, 2) for b in base]
    rows = [(3, base[0]), (7, near[0]), (7, base[1]), (None, base[2]), (None, near[2]), (None, base[3]), (9, near[3]), (None, base[3]), (None, ""), (None, "")]
    df = docs_frame(spark, [t for _, t in rows], [d for d, _ in rows])
    got = {(r.doc_id, r.class_id, r.n_links) for r in op.join(df).collect()}
    assert got == {(3, 3, 1), (7, 3, 1), (7, 7, 0), (None, None, 1), (None, 9, 2), (9, 9, 2), (None, None, 0)}
    kept = sorted(((r.doc_id or 0, r.text) for r in op.keep_one(df).collect()), key=str)
    rest = [x for x in kept if x not in ((0, base[2]), (0, near[2]))]
    assert len(kept) == len(rest) + 1 and rest == sorted([(0, ""), (0, ""), (3, base[0]), (7, base[1]), (9, near[3])], key=str)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_keep_one_of_other_id_types(spark, kind):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(200))
    df = docs_frame(spark, [text, edited(rng, text, 2), "a b c", "a b c", "a b c d"], [1, 2, 3, 3, 4])
    kept = op.keep_one(df.withColumn("doc_id", df.doc_id.cast(kind)))
    assert sorted(int(r.doc_id) for r in kept.collect()) == [1, 3, 4] and kept.schema["doc_id"].dataType.simpleString() == kind
