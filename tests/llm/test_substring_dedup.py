import hashlib
import random

from overlook.llm import substring_dedup as op

from .helpers import awkward, clashing, docs_frame, untouched


def brute(rows, window):
    split = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_matches_brute_force_on_planted_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 33, 60)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
            words += rng.choice(passages)
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += ["loop loop loop " * 30, texts[3], texts[3]]
    rows = list(enumerate(texts))
    for window in (20, 5, 3):
        assert result(op.dedup_words(docs_frame(spark, texts), window)) == brute(rows, window)


def test_whole_table_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(op.query(spark, sf_dir)) == brute(rows, 20)


def test_covers_meet_every_difference():
    for v, cover in op.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_awkward_rows(spark):
    df = awkward(spark)
    out = op.dedup_words(df).collect()
    assert len(out) == 10
    assert {r.doc_id: r.n_removed for r in out}[6] == 30_000
    assert {r.doc_id for r in out} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert op.dedup_words(df.limit(0)).collect() == []
    kept = op.drop_repeats(df.withColumn("key", df.text).withColumn("found", df.text))
    assert kept.columns == [*df.columns, "key", "found"] and kept.count() == 10


def test_drop_repeats_leaves_columns_of_any_name(spark):
    again = " ".join(f"p{i}" for i in range(30))
    docs, names = clashing(docs_frame(spark, [again, again + " tail", None]))
    out = op.drop_repeats(docs)
    assert untouched(out, docs, names) and sorted(r.text or "" for r in out.collect()) == ["", again, "tail"]


def test_drop_repeats_leaves_clean_texts_alone(spark):
    clean = "Some  text,\nwith its own   spacing."
    again = " ".join(f"p{i}" for i in range(30))
    out = {r.doc_id: r for r in op.drop_repeats(docs_frame(spark, [clean, again, again + " tail"])).collect()}
    assert out[0].text == clean and out[1].text == again
    assert out[2].text == "tail" and out[2].n_chars == 4
