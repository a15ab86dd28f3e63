"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts. A
whole text (its letter runs, lower-cased) is compressed with every dictionary;
the smallest result names the language. Where the two smallest are closer than
``MARGIN`` the text is rejected: ``accepted`` is false and ``lang`` null, while
``lang_pred`` still names the best. Equal sizes go to the language with more
training rows, then to the alphabet.

Training takes at most ``TEXTS`` distinct texts a language, the first by a hash
of the text, and ``CHARS`` characters of each from a place that the hash names, of
the ``LANGUAGES`` languages with most rows (ties: alphabet). These bounds are on
the dictionaries alone; every text is compressed whole. As the chosen hashes are
so bounded, they are broadcast, and only the chosen pieces are shuffled.

Defined results: null text or one without a letter is ``und`` with score 0; so is
every text where no row is labelled; equal texts get equal results; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXTS = 512
CHARS = 1024
LANGUAGES = 256
LEVEL = 9
#: Parts of the hashes' range by which training texts are chosen.
SHARES = 1 << 20
#: Least share by which the second smallest must exceed the smallest.
MARGIN = 0.02
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased letter runs, blank-joined; empty where the text has no letter."""
    runs = _LETTERS.findall(text.lower())
    return f" {' '.join(runs)} " if any(c.isalpha() for r in runs for c in r) else ""


def held_out(id_col: str) -> Column:
    """Rows that no dictionary may learn from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS,
          chars: int = CHARS, languages: int = LANGUAGES) -> list[tuple[str, bytes]]:
    """(language, dictionary), most frequent language first. At most ``texts * chars`` characters a language reach the driver."""
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL AND lang <> '" + UNKNOWN + "'").withColumn("h", F.xxhash64("text"))
    # Hashes first, without the texts; copies of a text have one hash and count once.
    hashes = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    totals = hashes.groupBy("lang").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).orderBy(
        F.desc("rows"), "lang").limit(languages)
    counts = {r["lang"]: r["rows"] for r in totals.collect()}
    # About four times the wanted number, by a share of the hash's range; then exactly the first of those.
    near = hashes.join(F.broadcast(totals), "lang").filter(F.pmod("h", F.lit(SHARES)) < F.lit(4.0 * texts * SHARES) / F.col("distinct"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(SHARES)), "h")
    first = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= texts)
    at = F.pmod("h", F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    chosen = rows.join(F.broadcast(first.select("lang", "h")), ["lang", "h"], "left_semi").select(
        "lang", "h", F.substring("text", at, F.lit(chars)).alias("piece")).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    content: dict[str, list[str]] = {}
    for r in chosen:
        content.setdefault(r["lang"], []).append(letters(r["piece"]))
    return [(lang, "".join(content[lang]).encode()) for lang in sorted(content, key=lambda x: (-counts[x], x))]


#: A worker process prepares a set of dictionaries once, whatever number of tasks it runs.
_COMPRESSORS: dict[str, list] = {}


def _compressors(key: str, dictionaries: list[tuple[str, bytes]]) -> list:
    import zstandard
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        made = []
        for lang, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                        write_checksum=False, write_dict_id=False)))
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def classify(text: str | None, compressors: list) -> tuple[str, float, bool]:
    """(language, score from 0 to 1, accepted)."""
    content = letters(text or "").encode("utf-8", "surrogatepass")
    if not content or not compressors:
        return UNKNOWN, 0.0, False
    sizes = [len(c.compress(content)) for _, c in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    score = 1 / sum(2.0 ** ((sizes[best] - s) / 4) for s in sizes)
    others = sizes[:best] + sizes[best + 1:]
    return compressors[best][0], score, not others or min(others) >= sizes[best] * (1 + MARGIN)


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score, accepted and lang (null where rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    key = hashlib.sha256(b"".join(lang.encode() + content for lang, content in dictionaries)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(key, shared.value)
        for rows in batches:
            got = [classify(t.as_py(), compressors) for t in rows.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=[*keep, "lang_pred", "score", "accepted"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = ", ".join([f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep])
    return chosen.mapInArrow(run, f"{schema}, lang_pred string, score double, accepted boolean").withColumn(
        "lang", F.when(F.col("accepted"), F.col("lang_pred")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    dictionaries = train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return predict(docs, dictionaries, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "accepted")


QUERIES = {"op4_langid": op4_langid}
