import hashlib
import math

import duckdb
import numpy as np
import pytest

from overlook.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract, part by part and entry by entry."""
    kept = [(i, [math.floor(op.SCALE * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    parts = lambda v: [v[p * width : (p + 1) * width] for p in range(4)]
    books = [[parts(v)[p] for _, v, _ in kept[:256]] for p in range(4)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(4):
        new = []
        for p in range(4):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(parts(v)[p], p)[1], []).append(parts(v)[p])
            new.append([[sum(x) // len(mine[i]) for x in zip(*mine[i])] if i in mine else e for i, e in enumerate(books[p])])
        books = new
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(x, p) for p, x in enumerate(parts(v))]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, bytes(e for _, e in found).hex(), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[label]) for i, code, error, label in out), key=str), sha


def run(spark, rows, schema=SCHEMA):
    coded, books = op.compress(spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in op.with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect()), key=str), op.digest(books)


def test_whole_table_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    want = con.sql(op.ORACLE).select(columns).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in op.query(spark, sf_dir).select(*columns.split(", ")).collect())


def test_awkward_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=8) * 10.0 ** rng.integers(-3, 2)).tolist(), int(i) % 3) for i in rng.permutation(600)]
    rows += rows[:40] + [(700 + i, [0.5, -0.5] * 4, None) for i in range(200)]  # repeated rows, many equal vectors
    rows += [(None, rows[0][1], 1), (5, rows[1][1], None), (-1, [0.0] * 8, 2)]
    rows += [(900, None, 0), (-9, [None] * 8, 0), (-8, [float("nan")] * 8, 0), (-7, [float("inf")] + [0.0] * 7, 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:9]) == brute(rows[:9])  # fewer vectors than entries


def test_searches_equal_full_search_and_evaluate_the_annulus_alone():
    rng = np.random.default_rng(1)
    entries = rng.integers(-9, 9, (256, 4)) * rng.integers(1, 60, (256, 1))
    entries[100:140] = entries[60:100]  # equal entries: the lower index wins
    points = np.concatenate([rng.integers(-400, 400, (4000, 4)), entries, entries + 1, np.zeros((2, 4), int)])
    dist = ((points[:, None] - entries[None]) ** 2).sum(2)
    at, best, work = op.Annuli(entries).nearest(points)
    assert (at == dist.argmin(1)).all() and (best == dist.min(1)).all()
    assert work < 0.6 * dist.size
    big = entries * (op.LIMIT // 1100)
    at, best, _ = op.Annuli(big).nearest(big[::-1].copy())
    assert (best == 0).all() and (big[at] == big[::-1]).all()


def test_rows_that_have_no_code(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0], 1) for i in range(6)] + [(6, [1.0, 2.0], 1), (7, [1e30, 0.0, 0.0, 0.0], 2), (8, [], 1)]
    got = {r[0]: r for r in run(spark, rows)[0]}
    assert [got[i][1] is None and got[i][2] is None for i in range(9)] == [False] * 6 + [True] * 3
    assert got[0][3] == 0 and got[7][3] is None
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [1.0, 2.0, 3.0], 1)])
    assert run(spark, [])[0] == []
    assert [r[1] for r in run(spark, [(1, [1e30] * 4, 1)])[0]] == [None]


def test_labels_of_any_type_and_clashing_columns(spark):
    rows = [(i, [float(i % 5)] * 4, "ab"[i % 2], "x", 1) for i in range(20)]
    coded, _ = op.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, code string, of int"))
    out = op.with_label_errors(coded).collect()
    assert len(out) == 20 and {r.label for r in out} == {"a", "b"}
