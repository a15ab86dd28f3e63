"""Pair and corpus sources (S1, S2) and the pair tables derived from test data.

Pair files are tab-separated ``qid, ql, qr, label`` with no header, every field
a string. Rows whose ``ql`` or ``qr`` is missing cannot be featurised; they are
split off into a rejects frame instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairfeat.operators.partitioning import spread_if_narrow
from pairfeat.sources.tables import read_table

PAIR_SCHEMA = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("ql", T.StringType()),
    T.StructField("qr", T.StringType()),
    T.StructField("label", T.StringType()),
])

PAIR_COLUMNS = [f.name for f in PAIR_SCHEMA.fields]


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Scan TSV pair files. Quoted fields use ``"`` with ``""`` as escape."""
    return (spark.read
            .schema(PAIR_SCHEMA)
            .option("sep", "\t")
            .option("header", "false")
            .option("quote", '"')
            .option("escape", '"')
            .option("mode", "PERMISSIVE")
            .csv(path))


def split_rejects(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with both texts present, and the rest (NULL ``ql`` or ``qr``)."""
    ok = F.col("ql").isNotNull() & F.col("qr").isNotNull()
    return pairs.filter(ok), pairs.filter(~ok)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Write a pair frame back as headerless TSV, quoting where needed."""
    (pairs.select(*PAIR_COLUMNS).write.mode("overwrite")
     .option("sep", "\t").option("header", "false")
     .option("quote", '"').option("escape", '"')
     .csv(path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document per line, column ``value``."""
    return spark.read.text(path)


def write_corpus(texts: DataFrame, path: str, col: str = "text") -> None:
    texts.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


# --------------------------------------------------------------------------
# Pair tables derived from the driver's tables (FIXTURES.md section 2).
# Each one is row-local or an equi-join on a unique key, so no key can hold a
# large share of the rows.
# --------------------------------------------------------------------------

def _sentences(docs: DataFrame) -> DataFrame:
    """Per document, the array of its non-empty pieces between newlines and '. ',
    in document order. Built inside the row: no window, no shuffle."""
    pieces = F.flatten(F.transform(F.split("text", "\n"),
                                   lambda line: F.split(line, r"\. ")))
    return docs.select(
        "doc_id",
        F.filter(pieces, lambda t: F.length(t) > 0).alias("sents"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; spread first where they come in fewer partitions than there are cores
    (one small file, say), since what follows costs CPU per row. A large table is never moved."""
    return spread_if_narrow(read_table(spark, sf_dir, "documents"), "doc_id")


def _neighbours(sents: Column) -> Column:
    """[(k, s[k], s[k+1])] for k = 1..n-1."""
    n = F.size(sents)
    return F.when(n < 2, F.array().cast("array<struct<k:int,a:string,b:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1),
                    lambda k: F.struct(k.alias("k"), F.element_at(sents, k).alias("a"),
                                       F.element_at(sents, k + 1).alias("b"))))


def sent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sentences of each document, label '0'."""
    s = _sentences(_documents(spark, sf_dir))
    return (s.select("doc_id", F.inline(_neighbours(F.col("sents"))))
            .select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("qid"),
                    F.col("a").alias("ql"), F.col("b").alias("qr"),
                    F.lit("0").alias("label")))


def rotated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence against itself with the first word moved last, label '1'."""
    s = _sentences(_documents(spark, sf_dir))
    one = s.select("doc_id", F.posexplode("sents").alias("pos", "t"))
    w = F.split("t", " ")
    return (one.filter(F.size(w) > 1)
            .select(F.concat(F.col("doc_id").cast("string"), F.lit("-"),
                             (F.col("pos") + 1).cast("string"), F.lit("r")).alias("qid"),
                    F.col("t").alias("ql"),
                    F.array_join(F.concat(F.slice(w, 2, F.size(w)), F.slice(w, 1, 1)), " ").alias("qr"),
                    F.lit("1").alias("label")))


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_pairs (label 0) union rotated_pairs (label 1)."""
    return sent_pairs(spark, sf_dir).unionByName(rotated_pairs(spark, sf_dir))


def turn_pairs(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Each turn and the turn that follows it (long texts), label NULL.

    Equi-join on the unique (conv_id, turn) key: a conversation with many turns
    still yields one match per row, so no partition collects a hot key.
    ``how="left"`` keeps a conversation's last turn, with no text on the right.
    """
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a = c.select("conv_id", (F.col("turn") + 1).alias("nxt"),
                                                 F.col("turn").alias("t0"), F.col("text").alias("ql"))
    b = c.select("conv_id", F.col("turn").alias("nxt"), F.col("text").alias("qr"))
    return (a.join(b, ["conv_id", "nxt"], how)
            .select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("t0").cast("string")).alias("qid"),
                    "ql", "qr", F.lit(None).cast("string").alias("label")))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ASCII pairs: each part name against the next part key's name.
    Label '1' when the second word (the noun) agrees."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a = p.select((F.col("p_partkey") + 1).alias("k"), F.col("p_partkey").alias("ka"), F.col("p_name").alias("ql"))
    b = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("qr"))
    noun = lambda c: F.split_part(c, F.lit(" "), F.lit(2))
    return (a.join(b, "k")
            .select(F.concat_ws("-", F.col("ka").cast("string"), F.col("k").cast("string")).alias("qid"),
                    "ql", "qr", (noun(F.col("ql")) == noun(F.col("qr"))).cast("int").cast("string").alias("label")))


def corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitting corpus: one document per row, column ``text`` (and ``doc_id``)."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("text").isNotNull())
