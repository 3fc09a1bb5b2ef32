import random
import re
from collections import Counter

import duckdb

from overlook.llm import source_mixing as op

from .helpers import DOCS, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id size source_size target taken".split()


def water_fill(sizes):
    """Targets by going round until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, full = op.SHARE * sum(sizes.values()), set()
    while True:
        rate = left / sum(weight[s] for s in order if s not in full)
        above = [s for s in order if s not in full and rate * weight[s] > 2 * sizes[s]]
        if not above:
            return {s: 2.0 * sizes[s] if s in full else rate * weight[s] for s in order}
        full |= set(above)
        left -= sum(2 * sizes[s] for s in above)


def frame(spark, rows):
    """rows (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def check(docs, out):
    """docs (doc_id, text, source): sizes, targets and words of each source; no document beyond its bound."""
    size = Counter()
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
    want = water_fill(size)
    assert Counter((i, len(WORD.findall(t or "")), s) for i, t, s in docs) == Counter((r.doc_id, r.size, r.source) for r in out)
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6, s


def corpus(seed, n=900):
    rng = random.Random(seed)
    names = ["b", "a", "é", "z", "𝄞", "～", None]  # UTF-16 order differs from code point order for the last two
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(int(rng.paretovariate(0.8)))), rng.choice(names) if i % 3 else "hot") for i in range(n)]
    return rows + [(n, "long " * 20_000, "a"), (n + 1, None, "b"), (n + 2, " \n", "empty source"), (None, "x y z", "b"), (5, "other text", "a")] + rows[:60]


def test_words_meet_targets(spark):
    rows = corpus(1)
    check(rows, op.mix(frame(spark, rows)).collect())


def test_whole_table_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(op.ORACLE).select(", ".join(COLUMNS)).fetchall())
    assert want == sorted(tuple(r[c] for c in COLUMNS) for r in op.query(spark, sf_dir).collect())


def test_reruns_agree_in_any_partitioning(spark):
    rows = corpus(2, 300)
    runs = []
    for parts in (1, 7):
        random.Random(parts).shuffle(rows)
        runs.append(Counter(tuple(r) for r in op.mix(frame(spark, rows).repartition(parts)).collect()))
    assert runs[0] == runs[1]


def test_expected_words_are_equal_shares(spark):
    """Over many seeds long and short documents alike give the share of their words that the source is to give."""
    rows = [(i, "w " * (40 if i % 10 else 400), "ab"[i % 2]) for i in range(60)]
    given, whole, seeds = Counter(), Counter(), 8
    for seed in range(seeds):
        for r in op.mix(frame(spark, rows), seed=f"s{seed}").collect():
            given[r.source, r.size] += r.taken
            whole[r.source, r.size] += r.size * r.target / r.source_size
    assert all(abs(given[k] - whole[k]) <= 0.12 * whole[k] for k in whole)


def test_texts_are_what_was_taken(spark):
    rows = corpus(3, 200)
    docs = frame(spark, rows)
    mixed = op.mix(docs)
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += r.taken
    got, texts = Counter(), {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in op.render(docs, mixed).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert any(t.startswith(r.text) for t in texts[r.doc_id])
    assert +want == +got


def test_awkward_rows(spark):
    df = awkward(spark)
    for name in "key size p u f rank place row range_ before".split():
        df = df.withColumn(name, df.text)
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    check(docs, op.mix(df).collect())
    assert op.mix(df.limit(0)).collect() == []
    assert [r.taken for r in op.mix(frame(spark, [(1, None, None)])).collect()] == [0]
