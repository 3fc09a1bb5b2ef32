"""Pairs within groups of any size, compared inside tasks: a large group is cut into blocks, and each pair
of blocks is a task's work of its own, so that no task holds more than two blocks and no pair becomes a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts

def in_blocks(members: DataFrame, groups: DataFrame, keys: list[str], member: str) -> DataFrame:
    """members with own, bi, bj: a row for each pair of blocks (bi <= bj) that holds block `own` of its group, dealt and sorted by group and pair.

    groups has the keys and blocks, how many the group is cut into; groups of one have been left out.
    """
    rows = members.join(groups, keys)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.col(member)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("bi", F.least("own", "__o")).withColumn("bj", F.greatest("own", "__o")).drop("__o", "blocks")
    # a group's pairs of blocks are numbered and dealt in turn, from a place that the group's hash gives: no two of them meet before every task has one
    parts = shuffle_parts(members.sparkSession)
    number = (F.col("bj").cast("long") * (F.col("bj") + 1) / 2).cast("long") + F.col("bi")
    place = F.pmod(F.pmod(F.xxhash64(*keys), F.lit(parts)) + number, F.lit(parts)).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions(*keys, "bi", "bj")


def by_group(names: list[str], handle: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow: calls handle with the rows of each run of equal values in `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                mark = tuple(c[a] for c in columns)
                if mark != last and held:
                    yield from handle(pa.Table.from_batches(held))
                    held = []
                last = mark
                held.append(batch.slice(a, b - a))
        if held:
            yield from handle(pa.Table.from_batches(held))

    return run


LINKS = pa.schema([("member", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
LINKS_DDL = "member long, links long, root long"


class Links:
    """Links between members of one group, folded as they come: each member's count of linked rows, and a root that connects what the links connect."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies = ids, copies
        self.count, self.root = np.zeros(len(ids)), np.arange(len(ids))

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs of positions; no pair comes twice."""
        if not len(left):
            return
        n = len(self.ids)
        self.count += np.bincount(left, self.copies[right], n) + np.bincount(right, self.copies[left], n)
        a, b = self.root[left], self.root[right]
        apart = a != b
        if not apart.any():
            return
        both = np.unique(np.stack([a[apart], b[apart]]), axis=1) if apart.sum() < n else np.stack([a[apart], b[apart]])
        label = np.arange(n)
        while True:
            low = np.minimum(label[both[0]], label[both[1]])
            new = label.copy()
            np.minimum.at(new, both[0], low)
            np.minimum.at(new, both[1], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        self.root = label[self.root]

    def rows(self) -> Iterator[pa.RecordBatch]:
        take = np.flatnonzero(self.count > 0)
        if len(take):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[take]), pa.array(self.count[take].astype(np.int64)), pa.array(self.ids[self.root[take]])], schema=LINKS)
