"""Counts of all n-grams of a corpus, gathered in shards by hash range.

Every task packs its sorted distinct grams, one row for each shard; a shard's
rows meet in one task that writes what it learns to the shared folder.  Rows are
few and large, so the JVM handles blobs and never single grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.arrays import pack_planes, pack_sorted, unpack_planes, unpack_sorted
from rulespan.llm.text import run_lengths, shard_runs

BLOB_FIELDS = [("shard", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())]
BLOB_DDL = "shard int, grams binary, counts binary"
FLUSH = 3 << 20


class Gather:
    """Collects grams of a task; rows() gives them by shard once there are many."""

    def __init__(self, shards: int, flush: int = FLUSH):
        self.shards, self.flush, self.held, self.n = shards, flush, [], 0

    def add(self, grams: np.ndarray) -> None:
        self.held.append(grams)
        self.n += len(grams)

    def rows(self, last: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
        if not self.n or (self.n < self.flush and not last):
            return
        keys, counts = run_lengths(np.sort(np.concatenate(self.held)))
        self.held, self.n = [], 0
        for shard, part in shard_runs(keys, self.shards):
            yield shard, pack_sorted(keys[part]), pack_planes(counts[part].astype(np.uint32))


def blob_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    cols = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, BLOB_FIELDS)], names=[n for n, _ in BLOB_FIELDS])


def merged(grams: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of a shard, sorted, and their counts."""
    k, c = np.concatenate([unpack_sorted(x) for x in grams]), np.concatenate([unpack_planes(x, np.uint32) for x in counts])
    if c.max(initial=0) > 1 << 12:
        order = np.argsort(k)
        k, c = k[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[at], np.add.reduceat(c.astype(np.int64), at)
    k = np.repeat(k, c)
    k.sort()
    return run_lengths(k)


def by_shard(blobs: DataFrame, shards: int, write: Callable, ddl: str) -> DataFrame:
    """write(shard, sorted grams, counts) -> dict of one row of integers. A partition is a shard."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            shard = rows[0].column("shard")[0].as_py()
            columns = [[x for b in rows for x in b.column(c).to_pylist()] for c in ("grams", "counts")]
            del rows
            found = merged(*columns)
            del columns
            yield pa.RecordBatch.from_pylist([write(shard, *found)])

    return blobs.repartitionById(shards, F.col("shard")).mapInArrow(run, ddl)
