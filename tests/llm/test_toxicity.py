import random
from itertools import product
from zlib import crc32

import numpy as np

from overlook.llm import toxicity as op

from .helpers import awkward, clashing, docs_frame, untouched


def test_passes_match_enumeration():
    rng = np.random.default_rng(1)
    chain = op.Chain(rng.normal(size=2), rng.normal(size=(2, 2)))
    unary = rng.normal(size=(3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    got = chain.marginals(unary, mask)
    for k, n in enumerate(mask.sum(1)):
        total, one = 0.0, np.zeros(n)
        for states in product((0, 1), repeat=int(n)):
            s = chain.start[states[0]] + sum(unary[k, i] for i in range(n) if states[i]) + sum(chain.moves[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(s)
            one += np.exp(s) * np.array(states)
        assert np.allclose(got[k, :n], one / total)


def test_held_out_accuracy_on_the_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = op.query(spark, sf_dir).collect()
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [(labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)
    assert sum(b for a, b in held if a == 0) <= 2


def toy(spark, n=400):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ban", "cor", "del", "fin", "gur") for b in ("ta", "so", "mi", "re", "ul", "eno")]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 150))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = "Grumb" + rng.choice(("el", "olio", "ata", "ing", "ex")) + rng.choice(("", ",", "."))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    return docs_frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic long"), labels


def test_spans_and_filter(spark):
    docs, labels, truth = toy(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = op.score(docs, labels).collect()
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id][1]) for r in out) >= 0.98 * len(out)
    for r in out:
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert texts[r.doc_id][a:b].startswith("Grumb")
    kept = op.keep_clean(docs.withColumn("score", docs.text), labels)
    assert kept.columns == [*docs.columns, "score"] and 290 <= kept.count() <= 310


def test_keep_clean_leaves_columns_of_any_name_and_null_ids_are_held_out(spark, tmp_path):
    docs, labels, _ = toy(spark, 80)
    more, names = clashing(docs)
    assert untouched(op.keep_clean(more, labels), more, names)
    docs_frame(spark, ["one two", "three"], [None, 1]).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r.held_out for r in op.query(spark, str(tmp_path)).collect()}
    assert out == {None: True, 1: crc32(b"1") % 3 == 1}


def test_awkward_rows(spark):
    docs, labels, _ = toy(spark, 80)
    df = awkward(spark)
    assert op.score(df, labels).count() == 10
    assert {r.score for r in op.score(df, labels.limit(0)).collect()} == {0.0}
    odd = spark.createDataFrame([(1, None), (1, 1), (1, 0), (None, 1), (2, 7)], "doc_id long, toxic long")
    assert op.score(df, odd).count() == 10
    assert op.score(docs.limit(0), labels).collect() == [] and op.keep_clean(df, labels.limit(0)).count() == 10
