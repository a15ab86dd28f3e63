"""Spelling variant grouping by a bit-sliced position index.

The vocabulary is counted in Spark: letter runs, some of them with one code
point left out by a hash of document and run, and words that occur often enough.

Two words of ``L`` and ``L`` or ``L + 1`` code points that differ by one edit
agree on their first ``L // 2`` code points or on their last ``L - L // 2``. So
each word goes to four buckets: by its head and by its tail, with the shorter
and with the longer words. Blocks of buckets are compared at once: for every
position and letter a bitset tells which words of the block have that letter
there, and for all words as queries the recurrences move along the positions,

* zero errors: the words that agree so far,
* one error: by a replaced letter (same position), by a letter that only the
  other word has (one position on) or that it lacks (one position back),

64 words of the block with each operation. A pair belongs to the head bucket if
its heads agree and else to the tail bucket, so it is found once. Bits stand in
the order of falling counts, so a word's form is its lowest bit; a block returns
one row per word, not pairs. Buckets of any size are compared in blocks.

Roots follow forms by doubling; each step multiplies the count by ``RATIO`` at
least, so rounds grow with the logarithm of the logarithm of the largest count.

Defined results: null or empty texts have no words; a null id counts as the
empty string before the colon; rows given twice count twice; ties between forms
go to the smallest word; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.llm.blocks import by_group, deal
from pairfeat.session import scratch_dir

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: Every so many runs (by hash) lose a code point.
DROP_EVERY = 31
#: Words that are compared at once.
BLOCK = 2048


def _lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``word, n``: the distinct results of at least that length and count."""
    text = F.col(f"`{text_col}`").cast("string")
    # Shorter runs cannot give a word. Possessive: a long run is matched without recursion.
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", _lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select("run", h.alias("h")).select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, longest + 1) code points, 0 beyond a word's end, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), int(sizes.max()) + 1), np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out, sizes


def _bits(rows: np.ndarray) -> np.ndarray:
    """Boolean rows as bitsets of 64-bit words, the first column the lowest bit."""
    wide = -(-rows.shape[1] // 64) * 64
    padded = np.zeros((rows.shape[0], wide), bool)
    padded[:, :rows.shape[1]] = rows
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Index:
    """For every position and letter, the words of a block that have it there. Positions are made when they are reached."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes = sizes
        self.letters, letter = np.unique(codes, return_inverse=True)
        self.letter = letter.reshape(codes.shape)

    def at(self, p: int) -> np.ndarray:
        """(letters, bitset words) of a position."""
        if not 0 <= p < self.letter.shape[1]:
            return np.zeros((len(self.letters), -(-len(self.sizes) // 64)), np.uint64)
        return _bits(self.letter[:, p][None, :] == np.arange(len(self.letters))[:, None])

    def near(self, queries: np.ndarray, size: int, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, bitset words): words one edit away from queries of this size, and words that agree on their heads."""
        q = self.letter[queries]
        before, here, after = self.at(-1), self.at(0), self.at(1)
        exact = ~before[q[:, 0]]   # zero errors: at first all words
        swapped, longer, shorter = (np.zeros_like(exact) for _ in range(3))   # one error, by kind
        agree = exact.copy()
        for p in range(size):
            letter = q[:, p]
            swapped = (swapped & here[letter]) | (exact & ~here[letter])
            longer = (longer | exact) & after[letter]
            shorter = (shorter & before[letter]) | exact
            exact &= here[letter]
            agree[head == p + 1] = exact[head == p + 1]
            before, here, after = here, after, self.at(p + 2)
        longer |= exact   # the other word goes on by one letter
        lengths = [_bits((self.sizes == n)[None, :]) for n in (size - 1, size, size + 1)]
        return (shorter & lengths[0]) | (swapped & lengths[1]) | (longer & lengths[2]), agree


def _kernel(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each word of a block: how many near words the block holds, and the one with the largest count."""
    short = rows.column("short").to_numpy()[starts[:-1]]
    at = 0
    while at < len(starts) - 1:
        # As many whole groups as a block takes, one at least; groups come by length, and long words stand apart from short ones.
        end = min(np.searchsorted(starts, starts[at] + BLOCK, "right") - 1, np.searchsorted(short, 2 * short[at], "right"))
        end = max(at + 1, int(end))
        block = rows.slice(starts[at], starts[end] - starts[at])
        sizes = np.diff(starts[at:end + 1])
        yield from _compared(block, np.repeat(np.arange(end - at), sizes))
        at = end


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _compared(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = rows.column("word").to_pylist()
    n = rows.column("n").to_numpy()
    # The bits of a block stand by falling count, then by word; UTF-8 and code points sort alike.
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    words = [words[i] for i in order]
    n, group = n[order], group[order]
    short, tail, left, right, half = (rows.column(k).to_numpy()[order] for k in ("short", "tail", "_left", "_right", "_half"))
    codes, sizes = _codes(words)
    index = Index(codes, sizes)
    groups = _bits(group[None, :] == np.arange(group.max() + 1)[:, None])
    halves = _bits(np.stack((half == 0, half == 1)))
    shorts = _bits((sizes == short)[None, :])
    for size in np.unique(sizes):
        queries = np.flatnonzero(sizes == size)
        found, agree = index.near(queries, int(size), short[queries] // 2)
        found &= groups[group[queries]]
        # Longer words meet each other where they are the shorter ones.
        found = np.where((short[queries] < size)[:, None], found & shorts, found)
        found = np.where(tail[queries][:, None] == 1, found & ~agree, found)
        apart = left[queries] != right[queries]
        found = np.where(apart[:, None], found & halves[1 - half[queries]], found)
        count = np.bitwise_count(found).sum(1, dtype=np.int64)
        has = np.flatnonzero(count)
        if len(has):
            found = found[has]
            block = (found != 0).argmax(1)
            low = found[np.arange(len(has)), block]
            best = block * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in queries[has]], pa.string()), pa.array(count[has]),
                 pa.array([words[i] for i in best], pa.string()), pa.array(n[best])], schema=_FOUND)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n`` of the words of ``words`` (word, n) that have a near word: how many, and the most frequent."""
    size = F.length("word")

    def bucket(short: Column, tail: int) -> Column:
        key = F.substring(F.col("word"), F.lit(1), F.floor(short / 2).cast("int")) if not tail else F.substring(
            F.col("word"), (size - (short - F.floor(short / 2)) + 1).cast("int"), size)
        return F.struct(short.cast("int").alias("short"), F.lit(tail).alias("tail"), F.xxhash64(key).alias("bucket"))

    members = words.select("word", "n", F.explode(F.array(
        bucket(size, 0), bucket(size, 1), bucket(size - 1, 0), bucket(size - 1, 1))).alias("b")).select("b.*", "word", "n")
    dealt = deal(members, ["short", "tail", "bucket"], "word").select(
        "short", "tail", "bucket", "_left", "_right", "_half", "word", "n")
    found = by_group(dealt, ["short", "tail", "bucket", "_left", "_right"], _kernel, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) -> ``word, root``: the last word that forms lead to. Forms must not lead in circles."""
    spark = forms.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "roots")
        df.write.parquet(path)
        return spark.read.parquet(path)

    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.filter("moved").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.select("word", "root").join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``words`` (word, n; words are distinct)."""
    spark = words.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    words = written(words.select("word", "n"), "words")
    is_form = F.col("near_n") >= ratio * F.col("n")
    judged = written(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "variants")
    last = roots(judged.filter("form IS NOT NULL").select("word", "form"))
    return judged.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_variants(vocabulary(docs))


QUERIES = {"op13_spelling": op13_spelling}

#: DuckDB has no crc32: the fold below is its definition, bit by bit over a table of 256 remainders. Letters are of one or two UTF-8 bytes.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {"op13_spelling": f"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM (SELECT unnest(range(256)) i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST_LENGTH},}}')), '{_UPPER}', '{_LOWER}') w FROM documents),
b AS (SELECT doc_id, w, count(*) k, coalesce(doc_id::VARCHAR, '') || ':' || w s FROM r GROUP BY doc_id, w),
y AS (SELECT w, k, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)]
      ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) bytes FROM b),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, bytes::BIGINT[]),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) h FROM y, t),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT n FROM (SELECT CASE WHEN h % {DROP_EVERY} = 0
      THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END word, k FROM h)
      WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) rest
      FROM (SELECT word, unnest(range(1, length(word) + 1)) i FROM v)),
p AS MATERIALIZED (SELECT DISTINCT a, b FROM (
      SELECT x.word a, z.word b FROM d x JOIN d z ON x.rest = z.rest AND x.i = z.i AND x.word <> z.word
      UNION ALL SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest
      UNION ALL SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest)),
g AS (SELECT a word, count(*) n_near, arg_min(b, (-n, b)) near, max(n) near_n FROM p JOIN v ON v.word = b GROUP BY a),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0)::BIGINT n_near, CASE WHEN near_n >= {RATIO} * n THEN near END form,
      CASE WHEN near_n >= {RATIO} * n THEN near_n END form_n FROM v LEFT JOIN g ON g.word = v.word),
s AS (SELECT word, word here, 0 step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.here WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n::BIGINT form_n, root
FROM f JOIN (SELECT word, arg_max(here, step) root FROM s GROUP BY word) x ON x.word = f.word
"""}
