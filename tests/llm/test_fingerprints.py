import hashlib
import random

import numpy as np

from overlook.llm import fingerprints as op

from .helpers import awkward, docs_frame


def want(rows):
    """(doc_id, n_chars, edited text's hash) by sorting everything."""
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else op.NO_ID), r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (d, _) in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(rows)]
        k = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op.query(spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=key) == sorted(want(rows), key=key)
    prints = {}
    for r in out:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    long = [r for r in out if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.35 and sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
    alone, _ = zip(*[(op.printed(*op.parse([dict(rows)[r.doc_id].encode()]))[0], 0) for r in out[:50]])
    assert list(alone) == [r.fingerprint for r in out[:50]]


def test_names_are_offset_free():
    rng = random.Random(4)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(4000))
    x, first = op.mix(np.frombuffer(body, np.uint8).astype(np.uint64)), np.array([0, len(body)])
    y = op.mix(np.frombuffer(b"some other head " + body, np.uint8).astype(np.uint64))
    other = np.array([0, len(y)])
    for _ in range(3):
        x, first = op._phrases(x, first)
        y, other = op._phrases(y, other)
        assert len(np.intersect1d(x, y)) > 0.9 * len(np.unique(x))


def test_phrases_are_short_and_cover():
    rng = np.random.default_rng(3)
    x = op.mix(rng.integers(0, 50, 100_000).astype(np.uint64))
    names, first = op._phrases(x, np.array([0, 40_000, 40_000, 100_000]))
    assert first[0] == 0 and first[1] == first[2] and first[-1] == len(names)
    assert 100_000 / 12 < len(names) < 100_000 / 2


def test_likeness_follows_overlap():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    roots, slots = op.parse([t.encode() for t in (text, text, " ".join(words[:-40]), " ".join(words[200:]), " ".join(reversed(words)), "")])
    near = [float(op.likeness(roots[:1], slots[:1], roots[i : i + 1], slots[i : i + 1])[0]) for i in range(6)]
    assert near[0] == near[1] == 1 and near[2] > 0.75 and 0.25 < near[3] < 0.75 and near[4] < near[3] and near[5] == 0


def test_likeness_estimates_the_jaccard_similarity_of_names(spark, sf_dir):
    """The slots' share against the exact similarity of the sets of names that they are minima of."""

    def names(text):
        x, first = op.mix(np.frombuffer(text.encode(), np.uint8).astype(np.uint64) + np.uint64(1)), np.array([0, len(text.encode())])
        found, level = set(), 0
        while True:
            x, first = op._phrases(x, first)
            level += 1
            if level >= op.DEPTH or len(x) == 1:
                found |= set(x.tolist())
            if len(x) == 1:
                return found

    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text), reverse=True)
    out = {r.doc_id: r for r in op.query(spark, sf_dir).collect()}
    gaps = []
    for (d, t), (_, after) in zip(rows, rows[1:]):
        k = len(t) // 3
        a, e, n = names(t), names(t[: len(t) - k] + after[:k]), names(after)
        gaps += [out[d].near_edited - len(a & e) / len(a | e), out[d].near_next - len(a & n) / len(a | n)]
    assert len(gaps) > 300 and abs(np.mean(gaps)) < 0.01 and np.sqrt(np.mean(np.square(gaps))) < 0.07 and max(map(abs, gaps)) < 0.3


def test_awkward_rows(spark):
    df = awkward(spark)
    out = op.fingerprints(df.withColumn("part", df.text).withColumn("own", df.text)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=key) == sorted(want([(r.doc_id, r.text) for r in df.collect()]), key=key)
    assert op.fingerprints(df.limit(0)).collect() == []
    one = op.fingerprints(docs_frame(spark, ["abcdef"])).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    assert {r.near_next for r in op.fingerprints(docs_frame(spark, ["", None, ""])).collect()} == {1.0}


def test_frequent_ids_are_cut_by_text(spark):
    """A third of the rows of one id, another third of none: neighbours as in a global sort, and no range holds a group."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = [(7, t) for t in texts[:200]] + [(None, t) for t in texts[200:400]] + [(i, t) for i, t in enumerate(texts[400:])] + [(7, "same")] * 60
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        out = op.fingerprints(df).collect()
        sizes = {r["part"]: r["n"] for r in op.dealt(df).where("own").groupBy("part").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=key) == sorted(want(rows), key=key)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 150
