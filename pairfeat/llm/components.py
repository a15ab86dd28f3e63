"""Connected components by alternating stars, for links of any number.

Each round joins links with the smallest neighbour of their ends; minima are
aggregated before they are shuffled, so a node with very many links costs one
row per task. Every round is written to the shared checkpoint folder, which
cuts the lineage and survives lost executors.

Defined results: links of a node with itself and links with a null end say
nothing; links given twice or both ways count once; no links, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfeat.session import scratch_dir


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the node's smallest neighbour (or to the node itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, point to the smallest of them. Links run from large to small."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return (links.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a > b").distinct())


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``links`` (a, b: long) -> ``node, component``: the smallest node it is linked with, for nodes that have a link."""
    spark = links.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "components")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = written(_small_star(_large_star(now)))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Settled: each node points straight to the smallest of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
