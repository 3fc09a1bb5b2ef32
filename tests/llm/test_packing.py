import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from overlook.llm import packing as op

from .helpers import awkward, docs_frame


def check(docs, out, length=2048):
    """Every id lies in one piece, sequences have no gaps and are full or at a power of two."""
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    seen = {d: 0 for d in ids}
    for r in sorted(out, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(piece) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {d: len(i) for d, i in ids.items()}
    sequences = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= length and n & (n - 1) == 0 for n in sequences.values())


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(docs, op.query(spark, sf_dir).collect())


def test_ids_equal_the_tokenizers_library(spark, sf_dir):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = op.Tokens()
    rng = random.Random(1)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()]
    alphabet = "abcdetheinr  \n\n\t\r'sé☃𝄞0123.,-_<|>\x00\u00a0\u200d　"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(3000)]
    for t in texts:
        assert encode(t).tolist() == [*tk.encode(t, add_special_tokens=False).ids, 1], t


def test_hilbert_steps_are_neighbours():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = op.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_copies_lie_side_by_side(spark):
    texts = [f"alpha beta gamma topic{i % 7} " * 40 for i in range(70)]
    out = op.pack(docs_frame(spark, texts), 1 << 20).orderBy("sequence_id", "offset").collect()
    order = [r.doc_id % 7 for r in out if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 12


def test_ranges_hold_equal_bytes_and_follow_the_curve(spark):
    """A third of all bytes are copies of one text, and a few texts are a hundred times as long as the rest."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2000 if i % 50 == 0 else 20)) for i in range(600)]
    texts += ["same text again and again " * 4] * 300 + ["", None]
    check_ranges(spark, docs_frame(spark, texts).selectExpr("doc_id", "coalesce(text, '') AS text").mapInArrow(op._keys, "curve long, doc_id long, text string"), len(texts))


def check_ranges(spark, rows, n, most=1.5):
    """Ranges of about equal bytes in the order of the full key; only rows of one equal key may lie in several."""
    rows = rows.withColumn("copy", F.xxhash64("text")).withColumn("size", F.octet_length("text") + F.lit(1).cast("long"))
    out = op.dealt(rows, 8).select("curve", "doc_id", "size", F.spark_partition_id().alias("part")).collect()
    assert sorted(r.doc_id for r in out) == list(range(n))
    sizes = [sum(r.size for r in out if r.part == p) for p in range(8)]
    assert max(sizes) <= most * sum(sizes) / 8
    ends = [(min(r.curve for r in x), max(r.curve for r in x)) for p in range(8) if (x := [r for r in out if r.part == p])]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_one_stripe_of_half_the_bytes_is_cut_by_the_full_key(spark):
    """Half of all bytes lie in one stripe of the curve, under many keys: their ranges follow the key, not a hash."""
    rng = random.Random(2)
    stripe = 5 << (op.DIMS * op.BITS - op.STRIPE_BITS)
    rows = [(stripe + rng.randrange(1 << 18) if i % 2 else rng.randrange(1 << 32), i, "x" * rng.randrange(1, 90)) for i in range(4000)]
    check_ranges(spark, spark.createDataFrame(rows, "curve long, doc_id long, text string"), len(rows), 1.1)
    same = [(7 if i % 3 == 0 else rng.randrange(1 << 32), i, "x" * 50) for i in range(4000)]
    check_ranges(spark, spark.createDataFrame(same, "curve long, doc_id long, text string"), len(same), 1.2)


def test_awkward_rows(spark):
    texts = [None, "", "<|endoftext|> spelled <|endoftext|>", "word " * 9000, "naïve ☃ 𝄞", "\x00"]
    out = op.pack(docs_frame(spark, texts, [None, 1, 2, 3, 4, 5]), 512).collect()
    check(list(zip([None, 1, 2, 3, 4, 5], texts)), out, 512)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in out)
    df = awkward(spark)
    assert op.pack(df.withColumn("curve", df.text).withColumn("ids", df.text)).where("start = 0").count() == 10
    assert op.pack(df.limit(0)).count() == 0
