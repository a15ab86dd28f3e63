"""n-grams over array columns (N1). Overlaps and multiset sizes are counted by ``operators.grams``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairfeat.functions.core import empty_array, let

GRAM_SEP = "\u0001"  # joins the items of a word or tag n-gram; never inside a term or tag
PAD_START, PAD_END = "<s>", "</s>"  # fixed values: padding symbols of ngrams(padding=True)


def ngrams(seq: Column, n: int, sep: str = GRAM_SEP, padding: bool = False) -> Column:
    """Sliding n-grams as strings; fewer than n items give none."""
    if padding and n > 1:
        seq = F.concat(F.array_repeat(F.lit(PAD_START), n - 1), seq, F.array_repeat(F.lit(PAD_END), n - 1))
    if n == 1:
        return seq
    return let(seq, lambda a: F.when(F.size(a) < n, empty_array()).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(a) - n + 1),
                    lambda i: F.array_join(F.slice(a, i, n), sep))))
