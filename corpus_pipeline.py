"""From raw documents to packed training sequences.

Five stages, each one operator of ``pairfeat.llm`` over all rows that the stage
before it kept. The first four return the columns of ``documents``; the last
returns the packed pieces. ``run`` writes each stage's rows to the shared
checkpoint folder and reads them again, so a lost executor costs at most the
stage at work.

Rows with null ids, null or empty texts, repeated ids and extra columns go
through as the operators define (see their docstrings): the quality rules
reject texts of under ten words, null ones among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.llm import mixing, packing, pii, quality, simhash
from pairfeat.session import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.filter_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars``, where present, follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target: documents once for every time they are drawn whole, and the last part of a source's share."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("simhash", simhash_dedup),
    ("pii", personal_data),
    ("mixing", source_mix),
    ("packing", packed),
]

#: The last stages depend on a tokenizer and on XXH64, which SQL does not have; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
