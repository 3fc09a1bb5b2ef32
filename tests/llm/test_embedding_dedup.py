import numpy as np
import pytest

from overlook.llm import embedding_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(rows[i][1], np.float32).astype(np.float64) for i in good}
    links, low = [0] * len(rows), {i: i for i in range(len(rows))}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for n, i in enumerate(good):
        for j in good[:n]:
            if rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= cosine:
                links[i] += 1
                links[j] += 1
                low[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block, tile, dims", [(16 << 20, 1024, 64), (4096, 3, 64), (16 << 20, 2, 5)])
def test_matches_brute_force(spark, monkeypatch, block, tile, dims):
    monkeypatch.setattr(op, "CELL_BYTES", block)
    monkeypatch.setattr(op, "TILE", tile)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        base = rng.normal(size=dims)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.normal(size=dims) * rng.choice([0, 0.1, 0.25, 0.4])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(g % 3)))
    assert result(op.near(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(op.query(spark, sf_dir)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 1), (11, [1.0, 2.0, 0.0], 1), (12, [-1.0, -2.0], 1), (13, [-0.0, 1.0], 2), (14, [0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(op.near(df)) == brute(rows)
    twice = op.near(df.where("vec_id = 8").union(df.where("vec_id = 8"))).collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in twice] == [(8, 1, 8)] * 2
    assert op.near(df.withColumn("rep", df.label).withColumn("cells", df.label)).count() == len(rows)
    assert op.near(df.limit(0)).collect() == []
    none = op.near(spark.createDataFrame([(None, [1.0, 0.0], 1)], SCHEMA)).collect()
    assert none[0].vec_id is None and none[0].n_links == 0


def test_repeated_and_null_ids(spark):
    """Components join vectors, not ids: null ids and repeated ones don't bring unlike vectors together."""
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [c + 0.1 for c in v]
    rows = [(3, x, 1), (None, near(x), 1), (9, y, 1), (None, near(y), 1), (None, z, 1), (None, near(z), 1), (3, z, 2), (4, near(z), 2), (4, x, 2)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in op.near(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(3, 1, 3, True), (None, 1, 3, None), (9, 1, 9, True), (None, 1, 9, None), (None, 1, None, None), (None, 1, None, None), (3, 1, 3, True), (4, 1, 3, False), (4, 0, 4, True)], key=str)


def test_tiny_and_huge_components(spark):
    """Norms that under- or overflow lose no link, and spoil no other row's."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 5))
    rows = [(1, [1e-200, 2e-200, 0.0, 0.0, 0.0], 1), (2, [2e-200, 4e-200, 0.0, 0.0, 0.0], 1), (3, [1e200, 2e200, 0.0, 0.0, 0.0], 1), (4, [1.0, 2.0, 0.0, 0.0, 0.0], 1), (5, [1e-310, 2e-310, 0.0, 0.0, 0.0], 1), (6, [-1e300, 1e300, 0.0, 0.0, 0.0], 1)]
    for i in range(60):
        v = (base[i % 6] + rng.normal(size=5) * 0.15) * 10.0 ** float(rng.integers(-290, 290))
        rows.append((10 + i, v.tolist(), 1))
    unit = {}
    for i, v, _ in rows:
        v = np.ldexp(np.array(v), -int(np.frexp(np.abs(v).max())[1]))
        unit[i] = v / np.sqrt(v @ v)
    want = {i: sum(j != i and unit[i] @ unit[j] >= 0.93 for j in unit) for i in unit}
    got = op.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == want
    assert {r.component_id for r in got if r.vec_id <= 5} == {1}
    only = op.near(spark.createDataFrame([r for r in rows if r[0] in (3, 6)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.n_links for r in only} == {0}


def test_labels_compare_as_given(spark):
    v = [1.0, 2.0]
    links = lambda labels, kind: [r.n_links for r in op.near(spark.createDataFrame([(i, v, x) for i, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")).orderBy("vec_id").collect()]
    assert links([1.2, 1.7, 1.2, None], "double") == [1, 0, 1, 0]
    assert links(["a", "b", "b", None, ""], "string") == [0, 1, 1, 0, 0]
    assert links([1 << 62, (1 << 62) + 1, 1 << 62], "long") == [1, 0, 1]
