"""Token tags from a lexicon table (P5, lexicon form).

Terms are cut by the tokenizer rule, looked up in a ``(term, postag)`` table,
and terms the table lacks keep the rule's tag. The lexicon is a term table
(``operators.trie``) that tasks look up in place: a projection, no token is
exchanged, whatever the lexicon's size. What is looked up is the number of a
term's tags (one tag, or several where the lexicon repeats a term: a token for
each) in the list of all that occur.

Two lexicons are joined instead: one with more kinds of tags than that list may
hold, and one that comes with a frequency column (``operators.joins``: broadcast
when its row count allows, else a shuffle join, salted on the most frequent
terms). Tokens are then put back in order per (row key, side); a group is one
text's own tokens, never more than the row already held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfeat.functions import text
from pairfeat.functions.core import empty_array, once
from pairfeat.operators.joins import lookup_join
from pairfeat.operators.pairkernel import rule_tags
from pairfeat.operators.rowkey import ROW, with_row_key
from pairfeat.operators.trie import write_terms

TOKEN_STRUCT = "struct<term:string,postag:string>"
MAX_KINDS = 10_000      # different tags, or lists of tags, of a lexicon that is looked up in place


def _tagged(lists: pa.ListArray, table, kinds: list[list[str]]) -> pa.ListArray:
    """Arrays of terms (some arrays a row) as arrays of tokens."""
    inner = lists.flatten()
    ends = inner.offsets.to_numpy() - inner.offsets[0].as_py()
    coded = inner.flatten().dictionary_encode()
    lexicon = table.open()
    ids = lexicon.find(coded.dictionary)
    known = ids >= 0
    rules = rule_tags(coded.dictionary).dictionary_encode()
    kind = rules.indices.to_numpy().astype(np.int64) + len(kinds)
    if known.any():
        kind[known] = lexicon.values["kind"][ids[known]]
    tags = kinds + [[t] for t in rules.dictionary.to_pylist()]
    sizes = np.array([len(t) for t in tags], np.int64)
    code = coded.indices.to_numpy().astype(np.int64)
    first, size = (np.cumsum(sizes) - sizes)[kind][code], sizes[kind][code]
    if (size != 1).any():
        after = np.append(0, np.cumsum(size))
        ends, code = after[ends].astype(np.int32), np.repeat(code, size)
        first = np.repeat(first - after[:-1], size) + np.arange(after[-1])
    flat = pa.array([t for x in tags for t in x], pa.string())
    tokens = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)), flat.take(pa.array(first))], ["term", "postag"])
    each = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array(each), pa.ListArray.from_arrays(pa.array(ends), tokens))


def _looked_up(pairs: DataFrame, lexicon: DataFrame, lexicon_rows: int, left: str, right: str) -> DataFrame | None:
    """``pairs`` with tokens whose tags are looked up in place; nothing for a lexicon with too many kinds of tags."""
    tags = F.array_sort(F.collect_list(F.coalesce("postag", text.suffix_tag(F.col("term")))))
    terms = lexicon.filter(F.col("term").isNotNull()).groupBy("term").agg(tags.alias("tags"))
    kinds = [r["tags"] for r in terms.select("tags").distinct().limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS:
        return None
    numbers = lexicon.sparkSession.createDataFrame(list(enumerate(kinds)), "kind int, tags array<string>")
    table = write_terms(terms.join(F.broadcast(numbers), "tags"), lexicon_rows, ("kind",))

    @F.arrow_udf(f"array<array<{TOKEN_STRUCT}>>")
    def tagged(lists: pa.Array) -> pa.Array:
        return _tagged(lists, table, kinds)

    def cut(side: str) -> Column:
        return F.coalesce(text.terms_of(F.col(side)), empty_array())

    return (pairs.withColumn("_tok", once(tagged)(F.array(cut(left), cut(right))))
            .withColumns({"tok_l": F.col("_tok")[0], "tok_r": F.col("_tok")[1]}).drop("_tok"))


def tokens_from_lexicon(pairs: DataFrame, lexicon: DataFrame, lexicon_rows: int, left: str = "ql",
                        right: str = "qr", weight: str | None = None) -> DataFrame:
    """``pairs`` plus ``tok_l``/``tok_r`` tagged through ``lexicon(term, postag[, weight])``. With ``weight`` by a join."""
    if weight is None:
        found = _looked_up(pairs, lexicon, lexicon_rows, left, right)
        if found is not None:
            return found
    p = with_row_key(pairs)
    rows = (p.select(ROW, F.inline(F.array(
        F.struct(F.lit("l").alias("side"), text.terms_of(F.col(left)).alias("ts")),
        F.struct(F.lit("r").alias("side"), text.terms_of(F.col(right)).alias("ts")))))
        .select(ROW, "side", F.posexplode("ts").alias("pos", "term")))
    cols = ["term", "postag"] + ([weight] if weight else [])
    lex = lexicon.select(*cols).withColumnRenamed("postag", "lex_tag")
    joined = lookup_join(rows, lex, "term", lexicon_rows, how="left", weight=weight,
                         spread=F.xxhash64(ROW, "side", "pos"))
    tok = F.struct(F.col("term"), F.coalesce(F.col("lex_tag"), text.suffix_tag(F.col("term"))).alias("postag"))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(
        F.col("side") == s, F.struct("pos", tok.alias("tok"))))), lambda x: x["tok"]).alias(f"tok_{s}")
    grouped = joined.groupBy(ROW).agg(side("l"), side("r"))
    empty = F.array().cast(f"array<{TOKEN_STRUCT}>")
    return (p.join(grouped, ROW, "left")
            .withColumn("tok_l", F.coalesce("tok_l", empty))
            .withColumn("tok_r", F.coalesce("tok_r", empty)).drop(ROW))
