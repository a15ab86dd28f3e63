"""Comparing the members of buckets, in blocks of bounded size.

A bucket with more rows than ``BLOCK`` is dealt into blocks by a hash of its
members, and each pair of blocks becomes a group of its own; so no group (and
no task's memory) grows with a hot bucket, and the work on it spreads over
tasks. Kernels see two numpy-able halves and return few rows: counts and a
spanning forest of the links, never all pairs of a bucket.

Defined results: a row whose bucket is null, and a bucket of one row, meet
nothing; rows given twice are rows of their own; an empty table gives no group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a block, on average over a bucket.
BLOCK = 1024


def deal(members: DataFrame, bucket: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """Rows of ``members`` once for each pair of blocks they belong to: columns ``_left``, ``_right``, ``_half``.

    Buckets that hold a single row are dropped: they have nothing to compare.
    """
    sizes = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    dealt = (members.join(sizes, bucket).withColumn("_blocks", blocks)
             .withColumn("_own", F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    return dealt.select("*", F.least("_own", "_other").alias("_left"), F.greatest("_own", "_other").alias("_right"),
                        (F.col("_own") > F.col("_other")).cast("int").alias("_half")).drop("_n", "_blocks", "_own", "_other")


Kernel = Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def by_group(dealt: DataFrame, keys: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """Run ``kernel(rows, starts)`` on whole groups of ``keys``.

    Rows come sorted by group, many groups at a time: ``starts`` holds where each
    group begins (and the end). One Python call per batch instead of one per group.
    """
    arranged = dealt.repartition(*keys).sortWithinPartitions(*keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            starts = _starts(rows, n)
            if len(starts) == 1:
                held = rows.to_batches()
                continue
            last = int(starts[-1])   # the last group may go on in the next batch
            yield from kernel(rows.slice(0, last), np.append(starts[:-1], last))
            held = rows.slice(last).to_batches()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from kernel(rows, np.append(_starts(rows, n), rows.num_rows))

    return arranged.mapInArrow(run, schema)


def _starts(rows: pa.Table, n: int) -> np.ndarray:
    change = np.zeros(rows.num_rows, dtype=bool)
    change[0] = True
    for k in range(n):
        col = rows.column(k).to_numpy()
        change[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(change)
