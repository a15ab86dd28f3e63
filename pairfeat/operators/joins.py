"""Lookup joins of a large fact side against a keyed table of known size.

Broadcast only when the keyed table's size (rows, known from its fit, times the
bytes of a row) is under a limit. Above it, a shuffle join on (key, salt): the fact rows of the hottest
keys - a bounded set read from the keyed table's own frequency column - are
spread over ``salt_buckets`` partitions, and those keys' rows are repeated once
per salt. Any single key, however common, is then split ``salt_buckets`` ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 << 20   # per executor copy
TERM_BYTES = 64                  # a row of a term, a tag and a few numbers
HOT_KEYS = 10_000                # bounded broadcast of the hot-key list itself
SALT_BUCKETS = 64


def broadcastable(table_rows: int, row_bytes: int = TERM_BYTES) -> bool:
    return table_rows * row_bytes <= BROADCAST_MAX_BYTES


def lookup_join(facts: DataFrame, table: DataFrame, key: str, table_rows: int, how: str = "inner",
                weight: str | None = None, spread: Column | None = None,
                row_bytes: int = TERM_BYTES, hot_keys: int | None = None,
                salt_buckets: int | None = None) -> DataFrame:
    """Join ``facts`` to ``table`` on ``key``.

    ``weight`` ranks keys by how many fact rows they are expected to carry;
    ``spread`` is a deterministic per-row value used to salt hot keys (a hash of
    row coordinates, so a retried task salts the same way).
    """
    if broadcastable(table_rows, row_bytes):
        return facts.join(F.broadcast(table), key, how)
    if weight is None or spread is None:
        return facts.join(table, key, how)   # AQE skew-join splitting still applies
    hot_keys = HOT_KEYS if hot_keys is None else hot_keys
    salt_buckets = SALT_BUCKETS if salt_buckets is None else salt_buckets
    # By key as well: both sides must see the same keys where weights are tied.
    hot = table.orderBy(F.desc(weight), key).limit(hot_keys).select(key, F.lit(True).alias("_hot"))
    f = (facts.join(F.broadcast(hot), key, "left")
         .withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(salt_buckets))).otherwise(F.lit(0)))
         .drop("_hot"))
    t = (table.join(F.broadcast(hot), key, "left")
         .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt_buckets - 1)))
                                        .otherwise(F.array(F.lit(0)))))
         .drop("_hot"))
    return f.join(t, [key, "_salt"], how).drop("_salt")
