"""The pipeline, stage by stage, against brute force on its own input."""

import corpus_pipeline
from overlook.llm import toxicity

from . import test_ngram_join, test_packing, test_secret_scan, test_substring_dedup


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        kept = docs.collect()
        docs = spark.createDataFrame(kept, docs.schema)
        texts = {d: r.text for d, r in before.items()}
        if name == "packing":
            test_packing.check(list(texts.items()), kept)
            return
        assert docs.columns == columns and {r.doc_id for r in kept} <= set(before)
        if name == "toxicity":
            model = toxicity.learn(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = {d for d, t in texts.items() if model.scores([t.split()])[0][0] < toxicity.THRESHOLD}
            assert {r.doc_id for r in kept} == want and len(want) > 0.8 * len(before)
        elif name == "near_duplicates":
            want = {d for d, (low, _) in test_ngram_join.brute(list(texts.items())).items() if d == low}
            assert {r.doc_id for r in kept} >= want and len(kept) <= len(want) + 1
        elif name == "repeated_passages":
            want = test_substring_dedup.brute(list(texts.items()), 20)
            for r in kept:
                words, gone, _ = want[r.doc_id]
                assert len(r.text.encode().split()) == words - gone and (gone or r.text == texts[r.doc_id]) and r.n_chars == len(r.text)
        elif name == "secrets":
            for r in kept:
                assert test_secret_scan.base(r.text)[1:3] == (0, 0) and r.n_chars == len(r.text)
        rows.append(len(kept))
    raise AssertionError(rows)


def test_run_registered(spark, sf_dir):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {k.split("_")[0] for k in found} >= {"op1", "op2", "op4", "op6", "op8", "op10", "pipeline"}
    assert found["pipeline"](spark, sf_dir).where("start = 0").count() > 50
