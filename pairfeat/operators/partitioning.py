"""Partitioning of a corpus.

Pair features are projections and stay where the scan put them; scan splits are
sized by ``spark.sql.files.maxPartitionBytes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_if_narrow(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a corpus on ``key`` only when it arrives in fewer
    partitions than the cluster has cores (one large file, say). A corpus
    read from many files is already spread, and re-shuffling its raw text
    would cost more than it saves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
