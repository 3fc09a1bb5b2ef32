import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from overlook.llm import common, packing, pairs
from overlook.llm.ngram_join import overlaps

TEXTS = st.lists(st.text(alphabet="ab é\n\t\x0b☃　𝄞", max_size=30), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_split(texts):
    data, offs = common.utf8(pa.array(texts, pa.string()))
    w = common.Words(data, offs)
    got = [[] for _ in texts]
    for a, b, d, r in zip(w.starts, w.ends, w.doc, w.rank):
        assert r == len(got[d])
        got[d].append(data[a:b].tobytes())
    assert got == [t.encode().split() for t in texts]
    h = w.hashes()
    words = [x for g in got for x in g]
    assert len(set(words)) == len(set(h.tolist())) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_steps_cover_every_row_once(texts, most):
    column = pa.array(texts, pa.string())
    seen = []
    for lo, hi, data, offs in common.steps(column, most):
        assert lo == len(seen) and len(offs) == hi - lo + 1
        seen += [data[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:])]
    assert seen == texts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=12))
def test_overlaps_are_intersections(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    every = np.arange(len(sets))
    got = overlaps(arrays, every, every)
    assert all(got[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


@given(st.integers(0, 2047))
def test_closing_parts_are_powers_of_two(rest):
    parts = packing.closing(rest)
    assert sum(parts) == rest and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)


def test_linked_counts_copies_and_names_roots():
    links = pairs.Links(np.array([10, 11, 12, 13]), np.array([1, 5, 2, 7]))
    links.add(np.array([1]), np.array([2]))
    links.add(np.array([0]), np.array([1]))
    out = list(links.rows())[0].to_pydict()
    assert out == {"member": [10, 11, 12], "links": [5, 3, 5], "root": [10, 10, 10]}


def test_bounded_sample_is_the_least_hashes(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).toDF("doc_id")
    want = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    assert sorted(r.doc_id for r in common.bounded_sample(df, 300).collect()) == sorted(want)
    assert common.bounded_sample(df.limit(0), 5).count() == 0
