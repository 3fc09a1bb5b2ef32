import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from overlook.llm import piece_codec as op

from .helpers import awkward, docs_frame


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def want(library, text):
    ids = [*library.encode(text or "", num_threads=1), 2]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))


def test_whole_table_equals_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.query(spark, sf_dir).collect()}
    assert got == {r.doc_id: want(library, r.text) for r in docs}


def test_odd_texts_equal_the_library(library):
    c = op.codec()
    rng = random.Random(9)
    alphabet = "abtheinr  ▁\n\té☃𝄞0123aaaa.,\x00　ﬁ́<>s"
    texts = ["", " ", "  ", "▁", "▁ ▁", "a" * 100, " " * 50, " " * 33 + "the", "\n\n", "<s></s><unk><0x41>", "the the", "​", "١٢٣"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    for t in texts:
        ids = [*library.encode(t), 2]
        assert c.encode(t) == ids, repr(t)
        assert c.decode(ids) == library.decode(ids) == c.both(t)[2], repr(t)


def test_decode_takes_any_ids_as_the_library_does(library):
    c = op.codec()
    rng = random.Random(3)
    mark = c.ids["▁"]
    strange = [[3 + 0xC3, 3 + 0x28], [3 + 0xE2, 3 + 0x98], [0], [1, 2], [mark, mark], [], [0, 0], [1, mark, 0], [3 + 0x20, mark], [3 + 0xE2, 1, 3 + 0x98, 3 + 0x83], [2, mark, 300]]
    strange += [[rng.choice((0, 1, 2, mark, 300, 3 + rng.randrange(256), 3 + rng.randrange(128, 256), rng.randrange(len(c.pieces)))) for _ in range(rng.randrange(1, 30))] for _ in range(5000)]
    for ids in strange:
        assert c.decode(ids) == library.decode(ids), ids


def test_round_trip_and_awkward_rows(spark, library):
    df = awkward(spark)
    out = op.digests(df.withColumn("ids", df.text)).collect()
    assert sorted(((r.doc_id is None, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)) == sorted((r.doc_id is None, *want(library, r.text)) for r in df.collect())
    back = {r.doc_id: r.text for r in op.decode(op.encode(df)).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in df.collect() if r.doc_id != 8)
    assert op.digests(df.limit(0)).collect() == []
    assert op.encode(docs_frame(spark, [None])).collect()[0].ids == [2]


def test_pairs_along_trees_equal_merging():
    c = op.codec()
    rng = random.Random(2)
    tokens = [i for i in range(259, len(c.pieces)) if c.merged(c.pieces[i]) == [c.pieces[i]]]
    for _ in range(30_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.5:  # likely clashes: two tokens that share letters
            b = c.ids.get(c.pieces[a][-1:] + c.pieces[b][-2:], b)
        if c.merged(c.pieces[b]) != [c.pieces[b]]:
            continue
        assert c.compatible(a, b) == (c.merged(c.pieces[a] + c.pieces[b]) == [c.pieces[a], c.pieces[b]]), (c.pieces[a], c.pieces[b])
    assert sum(c.spines(t) is not None for t in tokens) > 0.95 * len(tokens)
