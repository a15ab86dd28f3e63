"""Corpus-fitted and hashed bag-of-words vectors and pair distances (2.7).

* Vocabulary fit (G1, G2, G5): per document the distinct analysed terms, then
  ``groupBy(term).count()`` - one shuffle, with map-side combining, so a term
  present in every document costs one row per partition.
* Count / TF-IDF vectors and distances (G1, G2, G7-G10): the fitted vocabulary is
  a term table (``operators.trie``) that tasks look up in place, so both are
  projections: no token is exchanged, whatever the vocabulary's size, and a
  pair's values do not depend on its ``qid``.
* Hashed vectors (G3, G4) hold no state: buckets and signs come from the signed
  MurmurHash3 of each distinct item of a batch (``operators.murmur``).

One Arrow kernel reads both sides' terms of a batch, in integers: every vector
is a list of (couple of sides, entry, value) that sorts and segmented sums turn
into distances. There is no loop over rows or terms.

Distances follow the paired metrics: euclidean and manhattan on the vectors as
transformed (counts raw, TF-IDF and hashed L2-normalised); cosine distance is
half the squared euclidean distance of the L2-normalised vectors, which is
``1 - cos`` normally, 0.5 when exactly one side is all zero and 0 when both are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairfeat.functions import text
from pairfeat.functions.core import empty_array, once
from pairfeat.operators.lexical import token_exprs
from pairfeat.operators.murmur import murmur3_32
from pairfeat.operators.partitioning import spread_if_narrow
from pairfeat.operators.trie import TermTable, write_terms

# The six vectorisers. The hashed ones keep their names; their
# widths are 2**20 for the "_18" and 2**24 for the "_20" variants.
HASHERS = {"hash1_18": (1, 2 ** 20), "hash1_20": (1, 2 ** 24),
           "hash2_18": (2, 2 ** 20), "hash2_20": (2, 2 ** 24)}
VOCAB_VECTORS = ("tfidf1", "count1")
# The emitted matrix, euclidean for tfidf1, count1, hash1_18, hash1_20; cosine and
# manhattan for all six.
PED = ["tfidf1", "count1", "hash1_18", "hash1_20"]
PCD = ["tfidf1", "count1", "hash1_18", "hash1_20", "hash2_18", "hash2_20"]
PMD = list(PCD)
DIST_NAMES = ([f"{v}_PED" for v in PED] + [f"{v}_PCD" for v in PCD] + [f"{v}_PMD" for v in PMD])


@dataclass
class Vocabulary:
    """Fitted vocabulary: ``table`` (term, df, idf) and corpus size."""
    table: DataFrame
    n_docs: int
    n_terms: int
    _terms: TermTable | None = field(default=None, repr=False)

    def terms(self) -> TermTable:
        """The vocabulary as a term table with ``idf``; written when first asked for."""
        if self._terms is None:
            self._terms = write_terms(self.table, self.n_terms, ("idf",))
        return self._terms

    def save(self, path: str) -> None:
        """K1: persist as parquet; corpus stats ride along as one-row table."""
        self.table.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.table.sparkSession
        spark.createDataFrame([(self.n_docs, self.n_terms)], "n_docs long, n_terms long") \
             .write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Vocabulary":
        """Load a persisted vocabulary."""
        stats = spark.read.parquet(f"{path}/stats").first()
        return Vocabulary(spark.read.parquet(f"{path}/terms"), int(stats["n_docs"]), int(stats["n_terms"]))


def idf(df: Column, n_docs: Column) -> Column:
    """Smoothed inverse document frequency: ln((1 + n) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def document_frequencies(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over documents: distinct terms per document, then a count.
    The analyser runs where the documents are; a corpus that arrives in fewer
    partitions than cores is spread first (``spread_if_narrow``)."""
    if "doc_id" in corpus.columns:
        corpus = spread_if_narrow(corpus, "doc_id")
    terms = corpus.select(F.explode(F.array_distinct(text.analyzed(F.col(text_col)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fit_vocabulary(corpus: DataFrame, text_col: str = "text", persist_to: str | None = None) -> Vocabulary:
    """G5 (count and TF-IDF share one fit). The hashers hold no state.

    The table is written out when ``persist_to`` is given (lineage cut, K1) and
    read back, so later joins read a file, not the corpus plan.
    """
    n_docs = corpus.filter(F.col(text_col).isNotNull()).count()
    table = document_frequencies(corpus.filter(F.col(text_col).isNotNull()), text_col) \
        .select("term", F.col("df").cast("long").alias("df"),
                idf(F.col("df"), F.lit(float(n_docs))).alias("idf"))
    spark = corpus.sparkSession
    if persist_to is not None:
        table.write.mode("overwrite").parquet(f"{persist_to}/terms")
        table = spark.read.parquet(f"{persist_to}/terms")
    n_terms = table.count()
    vocab = Vocabulary(table, n_docs, n_terms)
    if persist_to is not None:
        spark.createDataFrame([(n_docs, n_terms)], "n_docs long, n_terms long") \
             .write.mode("overwrite").parquet(f"{persist_to}/stats")
    return vocab


# --------------------------------------------------------------------------
# Terms a vectoriser sees for one side
# --------------------------------------------------------------------------

def vector_terms(tok: Column) -> Column:
    """Terms joined by a space, then the vectoriser's analyser (P4 + G1)."""
    return text.analyzed(text.term_text(tok))


# --------------------------------------------------------------------------
# Count and TF-IDF vectors (row-local)
# --------------------------------------------------------------------------

def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The strings of an array<array<string>> column (a fixed number of arrays a row) and, for each, the number of its array."""
    inner = lists.flatten()
    return inner.flatten(), np.repeat(np.arange(len(inner)), np.diff(inner.offsets.to_numpy()))


def _unit(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """L2-normalised by group; all-zero groups stay."""
    norm = np.sqrt(np.bincount(group, weights=values * values, minlength=n))[group]
    return np.divide(values, norm, out=np.zeros(len(values)), where=norm > 0)


def _sides(cell: np.ndarray, entry: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(couple, entry, left count, right count) of the entries, under ``most``, of arrays left, right, left, right, ..."""
    key = (cell // 2 * most + entry) * 2 + cell % 2
    key.sort()
    side, key = key & 1, key >> 1
    new = np.flatnonzero(np.diff(key, prepend=-1))
    both = np.diff(new, append=len(key))
    y = np.add.reduceat(side, new) if len(new) else side
    return key[new] // most, key[new] % most, (both - y).astype(np.float64), y.astype(np.float64)


def _distances(couple: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, unit: bool = False) -> dict[str, np.ndarray]:
    """PED, PCD and PMD of each couple, of the vectors or of the unit vectors. PCD is half the squared distance of the
    unit vectors."""
    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(couple, weights=values, minlength=n)

    u, v = _unit(x, couple, n), _unit(y, couple, n)
    apart = total((u - v) ** 2)
    if unit:
        return {"PED": np.sqrt(apart), "PCD": 0.5 * apart, "PMD": total(np.abs(u - v))}
    return {"PED": np.sqrt(total((x - y) ** 2)), "PCD": 0.5 * apart, "PMD": total(np.abs(x - y))}


def _vocab_entries(counts: tuple[np.ndarray, ...], terms: pa.Array, n: int, table: TermTable) -> dict[str, dict[str, np.ndarray]]:
    """``counts``: (couple, number of the term, left count, right count)."""
    vocabulary = table.open()
    ids = vocabulary.find(terms)
    known = ids[counts[1]] >= 0
    couple, entry, x, y = (c[known] for c in counts)
    idf = vocabulary.values["idf"][ids[entry]] if len(entry) else np.zeros(0)
    return {"tfidf1": _distances(couple, x * idf, y * idf, n, unit=True), "count1": _distances(couple, x, y, n)}


def _neighbours(coded: pa.DictionaryArray, cell: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct neighbours in an array, joined by a blank; the number and the array of each."""
    code = coded.indices.to_numpy().astype(np.int64)
    pair = np.flatnonzero(cell[1:] == cell[:-1])
    kinds = max(len(coded.dictionary), 1)
    keys, at = np.unique(code[pair] * kinds + code[pair + 1], return_inverse=True)
    first, second = (coded.dictionary.take(pa.array(k)) for k in (keys // kinds, keys % kinds))
    return pc.binary_join_element_wise(first, second, " "), at, cell[pair]


def _hashes(flat: pa.Array, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all items; hashes of neighbours in an array, and their arrays."""
    coded = flat.dictionary_encode()
    joined, at, pair_cell = _neighbours(coded, cell)
    code = coded.indices.to_numpy()
    return murmur3_32(coded.dictionary)[code].astype(np.int64), cell, murmur3_32(joined)[at].astype(np.int64), pair_cell


def _hashed_entries(hashes: tuple[np.ndarray, ...], order: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(array, bucket, sign) of the items of a hashed vectoriser."""
    h, cell = (np.concatenate(hashes[k::2][:order]) for k in (0, 1))
    return cell, np.abs(h) % width, np.where(h >= 0, 1.0, -1.0)


def _hashed_distances(counts: tuple[np.ndarray, ...], h: np.ndarray, widths: dict[str, int], n: int) -> dict[str, dict[str, np.ndarray]]:
    """Distances of hashed vectors for each name and width; ``h`` is the hash of each item that ``counts`` numbers.

    A sign turns both sides of an entry alike, so distances are those of the counts wherever a couple's items have
    buckets of their own. Couples in which two items share a bucket are done once more, by bucket."""
    couple, item, x, y = counts
    plain = _distances(couple, x, y, n, unit=True)
    out = {}
    for name, width in widths.items():
        bucket = np.abs(h) % width
        order = np.argsort(bucket, kind="stable")
        same = np.diff(bucket[order]) == 0
        shared = np.zeros(len(h), bool)      # buckets that two items of the batch have; few of them meet in a couple
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        at = np.flatnonzero(shared[item])
        key = np.sort(couple[at] * width + bucket[item[at]])
        met = np.unique(key[1:][np.diff(key) == 0] // width)
        out[name] = plain
        if len(met):
            at = np.flatnonzero(np.isin(couple, met))
            sign = np.where(h[item[at]] >= 0, 1.0, -1.0)
            keys, to = np.unique(couple[at] * width + bucket[item[at]], return_inverse=True)
            left, right = (np.bincount(to, weights=side[at] * sign, minlength=len(keys)) for side in (x, y))
            again = _distances(np.searchsorted(met, keys // width), left, right, len(met), unit=True)
            out[name] = {m: d.copy() for m, d in plain.items()}
            for m, d in again.items():
                out[name][m][met] = d
    return out


def _pair_distances(lists: pa.ListArray, names: tuple[str, ...], table: TermTable | None) -> dict[str, np.ndarray]:
    """For arrays (left, right, left, right, ...) a row: the distances of each left-right couple, in order."""
    flat, cell = _flat(lists)
    n = len(lists.flatten()) // 2
    coded = flat.dictionary_encode()
    by = pc.sort_indices(coded.dictionary)      # numbered in order: sums do not depend on what else is in the batch
    terms = coded.dictionary.take(by)
    coded = pa.DictionaryArray.from_arrays(pa.array(np.argsort(by.to_numpy())[coded.indices.to_numpy()]), terms)
    counts = _sides(cell, coded.indices.to_numpy().astype(np.int64), max(len(terms), 1))
    found = _vocab_entries(counts, terms, n, table) if any(v in VOCAB_VECTORS for v in names) else {}
    for order in (1, 2):
        widths = {name: HASHERS[name][1] for name in names if name in HASHERS and HASHERS[name][0] == order}
        if widths:
            h = murmur3_32(terms)
            if order == 2:
                joined, at, pair_cell = _neighbours(coded, cell)
                pairs = _sides(pair_cell, at, max(len(joined), 1))
                h = np.concatenate((h, murmur3_32(joined)))
                counts = tuple(np.concatenate((a, b)) for a, b in zip(counts, (pairs[0], pairs[1] + len(terms), *pairs[2:])))
            found.update(_hashed_distances(counts, h.astype(np.int64), widths, n))
    return {f"{name}_{m}": d for name in names for m, d in found[name].items()}


def _distance_kernel(vocab: Vocabulary, kinds: tuple[str, ...]):
    """Arrow function: array(left, right, ...) of term arrays -> struct of distances for each kind."""
    table = vocab.terms()
    kind_type = T.StructType([T.StructField(n, T.DoubleType()) for n in DIST_NAMES])

    @F.arrow_udf(T.StructType([T.StructField(kd, kind_type) for kd in kinds]))
    def distances(lists: pa.Array) -> pa.Array:
        found = _pair_distances(lists, (*VOCAB_VECTORS, *HASHERS), table)
        return pa.StructArray.from_arrays(
            [pa.StructArray.from_arrays([pa.array(found[n][k::len(kinds)]) for n in DIST_NAMES], DIST_NAMES) for k in range(len(kinds))],
            list(kinds))

    return once(distances)


def side_terms(pairs: DataFrame, kinds=("all", "notion")) -> list[Column]:
    """The vectorisers' terms of each kind's left and right side, none for a missing text. They are a kernel's
    arguments: rows that wait for it do not carry them."""
    def terms(kind: str, tok: Column, given: str, source: str) -> Column:
        if given not in pairs.columns:      # no tokens are built to be joined again
            return text.analyzed_terms(F.col(source)) if kind == "all" else text.analyzed(F.array_join(text.notional_terms(F.col(source)), " "))
        return vector_terms(tok if kind == "all" else text.notional(tok))

    return [F.coalesce(terms(kd, tok, given, source), empty_array())
            for kd in kinds for tok, given, source in zip(token_exprs(pairs), ("tok_l", "tok_r"), ("ql", "qr"))]


def vector_features(pairs: DataFrame, vocab: Vocabulary, kinds=("all", "notion"), keep=("qid",)) -> DataFrame:
    """``keep`` and all 16 distances for each kind (32 with ``notion``), one row per pair. A projection."""
    lists = F.array(*side_terms(pairs, kinds))
    k = pairs.select(*keep, _distance_kernel(vocab, tuple(kinds))(lists).alias("_dist"))
    return k.select(*keep, *[F.col("_dist")[kd][name].alias(f"{'' if kd == 'all' else 'notion_'}{name}")
                             for kd in kinds for name in DIST_NAMES])


def _term_sides(pairs: DataFrame) -> DataFrame:
    """(qid, side, ts): the terms of each side."""
    return pairs.select("qid", F.inline(F.array(*[F.struct(F.lit(sd).alias("side"), ts.alias("ts"))
                                                  for sd, ts in zip(("l", "r"), side_terms(pairs, ("all",)))])))


def _row_lists(row: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.ListArray:
    """Entries, sorted by row, as an array of structs for each of ``n`` rows."""
    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def hashed_vectors_long(pairs: DataFrame, order: int) -> DataFrame:
    """(qid, side, vectorizer, bucket, value): the nonzero hashed entries that the features compare."""
    names = [n for n, (o, _) in HASHERS.items() if o == order]
    entry = T.StructType([T.StructField("vectorizer", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("value", T.DoubleType())])

    @F.arrow_udf(T.ArrayType(entry))
    def entries(lists: pa.Array) -> pa.Array:
        hashes = _hashes(lists.flatten(), _rows_of(lists))
        rows, which, buckets, values = [], [], [], []
        for k, name in enumerate(names):
            width = HASHERS[name][1]
            row, bucket, sign = _hashed_entries(hashes, order, width)
            keys, at = np.unique(row * width + bucket, return_inverse=True)
            row, value = keys // width, np.bincount(at, weights=sign, minlength=len(keys))
            rows.append(row[value != 0])
            which.append(np.full(len(rows[-1]), k))
            buckets.append(keys[value != 0] % width)
            values.append(_unit(value, row, len(lists))[value != 0])
        row = np.concatenate(rows)
        by = np.argsort(row, kind="stable")
        which, buckets, values = (np.concatenate(x)[by] for x in (which, buckets, values))
        return _row_lists(row[by], len(lists), {"vectorizer": pa.array(names).take(pa.array(which)), "bucket": pa.array(buckets), "value": pa.array(values)})

    return _term_sides(pairs).select("qid", "side", once(entries)(F.col("ts")).alias("e")).select("qid", "side", F.inline("e"))


def vocab_vectors_long(pairs: DataFrame, vocab: Vocabulary, tfidf: bool) -> DataFrame:
    """(qid, side, term, weight): count vectors, or L2-normalised TF-IDF vectors. A projection."""
    table = vocab.terms()
    entry = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    @F.arrow_udf(T.ArrayType(entry))
    def entries(lists: pa.Array) -> pa.Array:
        row = _rows_of(lists)
        vocabulary = table.open()
        distinct, (code, ids) = vocabulary.find_all(lists.flatten())
        of_code = np.full(len(distinct) + 1, -1)
        of_code[code] = ids
        known = ids >= 0
        most = len(distinct) + 1
        keys, count = np.unique(row[known] * most + code[known], return_counts=True)
        row, code, weight = keys // most, keys % most, count.astype(np.float64)
        if tfidf and len(keys):
            weight = _unit(weight * vocabulary.values["idf"][of_code[code]], row, len(lists))
        return _row_lists(row, len(lists), {"term": distinct.take(pa.array(code)), "weight": pa.array(weight)})

    return _term_sides(pairs).select("qid", "side", once(entries)(F.col("ts")).alias("e")).select("qid", "side", F.inline("e"))
