"""Pools against the rule played out draw by draw."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.plans import pools


def draw(key, seed):
    return int(hashlib.md5(":".join(map(str, [seed, *key])).encode()).hexdigest()[:12], 16) / (1 << 48)


def one_by_one(cells, names, count, spacing, seed, manual=()):
    """cells: {(r, c): set of pools}."""
    points = []

    def add(r, c, provenance):
        near = next((p for p in points if (p[0] - r) ** 2 + (p[1] - c) ** 2 < spacing**2), None)
        if near:
            near[2].add(provenance)
            return False
        if len(points) >= count:
            return False
        points.append((r, c, {provenance}))
        return True

    for name, r, c in manual:
        add(r, c, f"manual:{name}")
    side = max(2, int(math.sqrt(count * 0.4)))
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    for rr in np.array_split(np.arange(rows[0], rows[-1] + 1), side):
        for cc in np.array_split(np.arange(cols[0], cols[-1] + 1), side):
            inside = [p for p in cells if p[0] in set(rr.tolist()) and p[1] in set(cc.tolist())]
            if inside:
                add(*min(inside, key=lambda p: (draw(p, seed), p)), pools.STRATIFIED)
    order = {k: sorted((p for p, h in cells.items() if n == pools.BACKGROUND or n in h), key=lambda p: (draw((k, *p), seed), p)) for k, n in enumerate(names)}
    cursor = dict.fromkeys(order, 0)
    while len(points) < count:
        progressed = False
        for k, pool in order.items():
            for _ in range(pools.TRIES):
                if cursor[k] >= len(pool):
                    break
                cursor[k], progressed = cursor[k] + 1, True
                if add(*pool[cursor[k] - 1], names[k]):
                    break
        if not progressed:
            break
    return [(f"C{n + 1:04d}", r, c, sorted(p | {x for x in cells[r, c] if x in names and x != pools.BACKGROUND})) for n, (r, c, p) in enumerate(points)]


def grid(spark, cells, names):
    rows = [(r, c, *(n in h for n in names if n != pools.BACKGROUND)) for (r, c), h in cells.items()]
    return spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"{n} boolean" for n in names if n != pools.BACKGROUND))


def made(seed, size=26):
    rng = np.random.default_rng(seed)
    names = ["bench", "shoulder", "ridge", pools.BACKGROUND]
    cells = {}
    for r in range(3, size):
        for c in range(size):
            if rng.random() < 0.8:
                cells[r, c] = {n for n, share in zip(names, (0.3, 0.05, 0.01)) if rng.random() < share}
    return names, cells


@pytest.mark.parametrize("seed, count, spacing, batch, tries", [(1, 30, 3.0, 512, 100), (2, 33, 3.5, 4, 100), (3, 20, 4.2, 3, 5)])
def test_pools_equal_going_one_by_one(spark, monkeypatch, seed, count, spacing, batch, tries):
    monkeypatch.setattr(pools, "BATCH", batch)
    monkeypatch.setattr(pools, "TRIES", tries)
    names, cells = made(seed)
    some = sorted(cells)[17]
    manual = [("one", *some), ("beside", *some), ("two", *sorted(cells)[-1])]
    want = one_by_one(cells, names, count, spacing, seed, manual)
    assert len(want) == count
    for parts in (1, 5):
        got = pools.pooled(grid(spark, cells, names).repartition(parts), names, count, spacing, seed, manual).orderBy("id").collect()
        assert [(r.id, r.r, r.c, r.provenance) for r in got] == want


def test_a_pool_that_cannot_be_filled_raises(spark):
    names, cells = made(4, 12)
    full = one_by_one(cells, names, 400, 3.0, 4)
    with pytest.raises(ValueError, match=f"only {len(full)} of 400"):
        pools.pooled(grid(spark, cells, names), names, 400, 3.0, 4)
    with pytest.raises(ValueError, match="outside the domain: lost"):
        pools.pooled(grid(spark, cells, names), names, 5, 3.0, 4, [("lost", 99, 0)])


def sent_to_all(plan):
    """Rows of each broadcast of a plan that has run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return sent_to_all(plan.executedPlan())
    if name.endswith("QueryStage"):
        return sent_to_all(plan.plan())
    below = [x for i in range(plan.children().size()) for x in sent_to_all(plan.children().apply(i))]
    return below + ([plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else [])


def test_cells_are_not_sent_to_every_task(spark):
    """Cells are few bytes as a file; the plan took them for small, and the driver built them whole."""
    names, cells = made(5, 60)
    assert len(cells) > 2000
    out = pools.pooled(grid(spark, cells, names), names, 20, 5.0, 5)
    got = [(r.id, r.r, r.c, r.provenance) for r in out.orderBy("id").collect()]
    assert got == one_by_one(cells, names, 20, 5.0, 5)
    out.collect()
    assert max(sent_to_all(out._jdf.queryExecution().executedPlan()), default=0) <= 20 * 9


def test_strata_are_runs_of_equal_length(spark):
    n = 11
    df = spark.range(n).select(F.col("id").cast("int").alias("r"), F.lit(0).alias("c"))
    got = [r.s for r in df.select("r", pools._stratum(F.col("r"), 0, n - 1, 3).alias("s")).orderBy("r").collect()]
    assert got == [k for k, part in enumerate(np.array_split(np.arange(n), 3)) for _ in part]
