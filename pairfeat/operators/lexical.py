"""Lexical pair features (2.3-2.6, F1-F3) as one narrow projection.

One Arrow kernel (``operators.pairkernel``) reads the texts, and the terms of both
sides with one blank between (or the caller's tokens), and returns the requested
columns. Terms are its arguments, cut where it needs them: rows that wait for a
Python worker are held by Spark, on disk if memory is short, and carry texts alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairfeat.functions import text
from pairfeat.functions.core import once
from pairfeat.operators.pairkernel import Tokens, lexical_columns

# Names of families and columns.
LENGTH_NAMES = ["len_l", "len_r", "len_union", "len_intersect", "len_diff",
                "len_l_diff_r", "len_r_diff_l", "len_l_diff_r_ratio", "len_r_diff_l_ratio"]
LENGTH_EXTRA = ["len_diff_l_ratio", "len_diff_r_ratio"]
SEQ_METRICS = ["longest_common_subsequence", "longest_common_substring", "longest_common_prefix",
               "longest_common_suffix", "levenshtein_distance", "damerau_levenshtein_distance"]
SEQ_NAMES = ([f"{m}_v" for m in SEQ_METRICS] + [f"{m}_l_ratio" for m in SEQ_METRICS]
             + [f"{m}_r_ratio" for m in SEQ_METRICS])
NGRAM_KINDS = ["jaccard", "dice", "overlap"]

CHAR, WORD, TAG = "char", "basic_word", "postag"
CHAR_NGRAMS, WORD_NGRAMS, TAG_NGRAMS = (1, 2, 3, 4), (1, 2), (1, 2)
PERIPH_PREFIX = {"all": "periph_basic_word", "adj": "periph_adj_basic_word",
                 "adv": "periph_adv_basic_word", "verb": "periph_verb_basic_word",
                 "noun": "periph_noun_basic_word"}


def length_names(prefix: str, extra: bool = False) -> list[str]:
    return [f"{prefix}_{n}" for n in LENGTH_NAMES + (LENGTH_EXTRA if extra else [])]


def ngram_names(prefix: str, ns) -> list[str]:
    return [f"{prefix}_{n}gram_{k}" for n in ns for k in NGRAM_KINDS]


def seq_names(prefix: str) -> list[str]:
    return [f"{prefix}_{n}" for n in SEQ_NAMES]


LEXICAL_NAMES = (length_names(CHAR) + ngram_names(CHAR, CHAR_NGRAMS) + seq_names(CHAR)
                 + length_names(WORD) + ngram_names(WORD, WORD_NGRAMS) + seq_names(WORD)
                 + length_names(TAG) + ngram_names(TAG, TAG_NGRAMS))
PERIPH_NAMES = [n for k in text.PERIPH_KINDS for n in length_names(PERIPH_PREFIX[k])]


# --------------------------------------------------------------------------
# DataFrame jobs
# --------------------------------------------------------------------------

def with_tokens(pairs: DataFrame, left: str = "ql", right: str = "qr") -> DataFrame:
    """Add ``tok_l``/``tok_r`` (P5) unless the caller supplied them."""
    out = pairs
    if "tok_l" not in pairs.columns:
        out = out.withColumn("tok_l", text.tokens(F.col(left)))
    if "tok_r" not in pairs.columns:
        out = out.withColumn("tok_r", text.tokens(F.col(right)))
    return out


def supplied_tokens(pairs: DataFrame) -> list[str]:
    """The token columns that the caller supplied."""
    return [c for c in ("tok_l", "tok_r") if c in pairs.columns]


def token_exprs(pairs: DataFrame, left: str = "ql", right: str = "qr") -> tuple[Column, Column]:
    """Tokens of both sides for a kernel's arguments: supplied ones, or cut there from the text, so that no row carries them."""
    return tuple(F.col(t) if t in pairs.columns else text.tokens(F.col(c)) for t, c in (("tok_l", left), ("tok_r", right)))


FAMILIES = ("char_len", "char_ngram", "char_seq", "word_len", "word_ngram", "word_seq",
            "postag_len", "postag_ngram", "periph_len")
LEXICAL = FAMILIES[:-1]
_LEVEL = {"char": CHAR, "word": WORD, "postag": TAG}
_NGRAMS = {"char_ngram": CHAR_NGRAMS, "word_ngram": WORD_NGRAMS, "postag_ngram": TAG_NGRAMS}


def _family_names(family: str, extra: bool) -> list[str]:
    level, _, what = family.partition("_")
    if level == "periph":
        return [n for k in text.PERIPH_KINDS for n in length_names(PERIPH_PREFIX[k], extra)]
    if what == "len":
        return length_names(_LEVEL[level], extra)
    return ngram_names(_LEVEL[level], _NGRAMS[family]) if what == "ngram" else seq_names(_LEVEL[level])


def _is_count(name: str) -> bool:
    return not (name.endswith("_ratio") or name.rpartition("_")[2] in NGRAM_KINDS)


def lexical_features(pairs: DataFrame, families=LEXICAL, keep=("qid",), left: str = "ql",
                     right: str = "qr", extra_ratios: bool = False) -> DataFrame:
    """the requested lexical families as flat columns next to ``keep``.

    Default families give the 87 lexical columns; add ``"periph_len"`` for the
    45 peripheral columns (132 together). A projection: rows stay where the
    scan put them, whatever their ``qid``.
    """
    keep, wanted = list(keep), tuple(f for f in FAMILIES if f in families)
    names = [n for f in wanted for n in _family_names(f, extra_ratios)]
    result = T.StructType([T.StructField(n, T.IntegerType() if _is_count(n) else T.DoubleType()) for n in names])
    with_words = any(not f.startswith("char") for f in wanted)

    def columns(a: pa.Array, b: pa.Array, tokens: Tokens | None) -> pa.Array:
        return pa.StructArray.from_arrays(lexical_columns(a, b, tokens, wanted, extra_ratios, _NGRAMS), names)

    if with_words:
        @F.arrow_udf(result)
        def kernel(a: pa.Array, b: pa.Array, l: pa.Array, r: pa.Array) -> pa.Array:
            return columns(a, b, Tokens(l, r))
    else:
        @F.arrow_udf(result)
        def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
            return columns(a, b, None)

    k0 = pairs.select(*keep, F.col(left).alias("_a"), F.col(right).alias("_b"), *supplied_tokens(pairs))
    args = [F.col("_a"), F.col("_b")]
    if with_words:
        args += (token_exprs(k0, "_a", "_b") if supplied_tokens(k0) else [text.spaced_terms(c) for c in args])
    return k0.select(*keep, once(kernel)(*args).alias("_k")).select(*keep, "_k.*")
