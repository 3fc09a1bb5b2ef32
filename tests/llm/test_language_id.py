from zlib import crc32

import numpy as np

from overlook.llm import language_id as op

from .helpers import awkward, docs_frame


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    p = {k: v.astype(np.float64) for k, v in op.start(3).items()}
    codes = rng.integers(0, 256, (6, 4))
    codes[4:, 1] = op.PAD
    y = np.array([0, 1, 2, 1])
    _, g = op.gradients(p, codes, y)
    for k in p:
        for _ in range(8):
            at = tuple(rng.integers(n) for n in p[k].shape)
            if k == "x":
                at = (at[0], int(codes[rng.integers(4), rng.integers(4)]), at[2])
                if at[1] == op.PAD:
                    continue
            keep, step = p[k][at], 1e-5
            p[k][at] = keep + step
            up, _ = op.gradients(p, codes, y)
            p[k][at] = keep - step
            down, _ = op.gradients(p, codes, y)
            p[k][at] = keep
            assert abs((up - down) / (2 * step) - g[k][at]) < 1e-6, (k, at)


def test_windows_hold_every_byte_once():
    texts = [b"", b"a" * 64, b"b" * 65, b"c"]
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    codes, owner = op.windows(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert owner.tolist() == [1, 2, 2, 3]
    assert [(codes[:, i][codes[:, i] != op.PAD]).tobytes() for i in range(4)] == [np.frombuffer(t, np.uint8).astype(np.int16).tobytes() for t in (b"a" * 64, b"b" * 64, b"b", b"c")]


def test_held_out_accuracy_on_the_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op.query(spark, sf_dir).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.96


def test_awkward_rows(spark):
    texts = ["the house is there and the man", "das haus ist dort und der mann"] * 20 + ["", None, "123 456", "..."]
    docs = spark.createDataFrame([(i, t, ("en", "de")[i % 2] if i < 40 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in op.identify(docs).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in range(40, 44))
    assert all(out[i].lang_pred == ("en", "de")[i % 2] for i in range(40))
    rare = spark.createDataFrame([(i, "the house is there and the man", "en") for i in range(300)] + [(1000 + i, "das haus ist dort und der mann", "de") for i in range(6)] + [(2000 + i, "", "fr") for i in range(5)] + [(None, "el hombre", "es")], "doc_id long, text string, lang string")
    names, _ = op.learn(rare, 40)
    assert names == ["de", "en"]
    df = awkward(spark)
    assert op.identify(df.withColumn("has", df.text).withColumn("score", df.text)).count() == 10
    assert {r.lang_pred for r in op.identify(df).collect()} == {"en", "und"}
    assert {r.lang_pred for r in op.identify(df, ([], None)).collect()} == {"und"}
    assert op.identify(df.limit(0)).collect() == []
    assert docs_frame(spark, []).columns == df.columns
