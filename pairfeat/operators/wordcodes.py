"""Word sequences as strings, one code point for each word.

Every sequence metric compares an item of one side with an item of the other,
so any coding under which equal words of a pair have equal code points leaves
all six metrics unchanged, and the character operators apply. Words are numbered
over a whole Arrow batch at once; a batch with more distinct words than there
are code points is numbered pair by pair, where only words that both sides
have need a number of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairfeat.functions.core import once

# The private-use and supplementary code points.
_PUA_BASE, _PUA_SIZE, _SUPP_BASE = 0xE000, 0x1900, 0x10000
MAX_CODES = _PUA_SIZE + (0x10FFFF - _SUPP_BASE + 1)
RESULT = T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())])


def _text(codes: np.ndarray) -> str:
    points = np.where(codes < _PUA_SIZE, codes + _PUA_BASE, codes - _PUA_SIZE + _SUPP_BASE).astype("<u4")
    return points.tobytes().decode("utf-32-le")


def _pair(a, b) -> tuple[str, str]:
    both = sorted(set(a) & set(b))
    if len(both) + 2 > MAX_CODES:
        raise ValueError(f"a pair shares more than {MAX_CODES - 2} distinct words")
    number = {w: k + 2 for k, w in enumerate(both)}
    return (_text(np.array([number.get(w, 0) for w in a], np.int64)), _text(np.array([number.get(w, 1) for w in b], np.int64)))


def encode(left: list, right: list) -> tuple[list, list]:
    """Both sides of every pair as strings; None where a side is None."""
    sides = [w for pair in zip(left, right) for w in pair]
    sizes = [0 if s is None else len(s) for s in sides]
    words = np.array([w for s in sides if s is not None for w in s], dtype=object)
    codes, distinct = pd.factorize(words)
    if len(distinct) <= MAX_CODES:
        whole = _text(codes)      # one code point a word: cut where the words were
        ends = np.cumsum(sizes).tolist()
        out = [None if s is None else whole[e - n:e] for s, n, e in zip(sides, sizes, ends)]
    else:
        out = [x for a, b in zip(left, right) for x in ((None, None) if a is None or b is None else _pair(a, b))]
    return out[::2], out[1::2]


@F.pandas_udf(RESULT)
def _encode(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    l, r = encode(left.tolist(), right.tolist())
    return pd.DataFrame({"l": l, "r": r}, dtype=object)


def words_as_strings(wl: Column, wr: Column) -> Column:
    """struct(l, r) of strings that encode two word sequences item for item."""
    return once(_encode)(wl, wr)
