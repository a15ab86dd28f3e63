"""Machine-translation feature family (2.8): BLEU, GLEU, RIBES on characters
and on words, both directions, 12 columns (16 with standard GLEU).

One Arrow kernel counts the n-grams of a batch (``operators.grams``) for BLEU
and both GLEUs, and aligns hypothesis items to the reference by the shortest
contexts that occur once on both sides for RIBES (``operators.suffixes``). Scores
that follow from counts are column expressions. GLEU as called on words compares
terms, read as characters, with one-character words; few terms have one of these,
and those are counted term by term.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairfeat.functions import mt, text
from pairfeat.functions.core import once
from pairfeat.operators.grams import gram_counts, localised
from pairfeat.operators.lexical import supplied_tokens, token_exprs
from pairfeat.operators.pairkernel import Tokens
from pairfeat.operators.suffixes import Index, Pairs, pairs_of

# Column names.
MT_NAMES = ["bleu_score_l", "bleu_score_r", "gleu_score_l", "gleu_score_r", "ribes_score_l", "ribes_score_r"]
MT_EXTRA = ["gleu_std_l", "gleu_std_r"]
RIBES_ALPHA, RIBES_BETA = 0.25, 0.10  # fixed values: RIBES exponents


# --------------------------------------------------------------------------
# RIBES: items are aligned by contexts that occur just once on either side.
# --------------------------------------------------------------------------

def _only_shared(p: Pairs) -> tuple[Pairs, list[np.ndarray], list[np.ndarray]]:
    """Items that one side alone has become one number of that side (2 left, 3 right): they are never aligned, and no
    context that could be reaches across them. Also, for every item of each side, the place of its counterpart where it
    stands once on both sides (else -1), and whether both sides have it."""
    rows = [np.repeat(np.arange(len(p)), n) for n in p.sizes]
    most = int(max((x.max(initial=0) for x in p.items))) + 1
    keys, at = np.unique(np.concatenate([r * most + x for r, x in zip(rows, p.items)]), return_inverse=True)
    at = [at[:len(rows[0])], at[len(rows[0]):]]
    count = [np.bincount(x, minlength=len(keys)) for x in at]
    both = (count[0] > 0) & (count[1] > 0)
    once = (count[0] == 1) & (count[1] == 1)
    items, lone = [], []
    for s in (0, 1):
        starts = np.cumsum(p.sizes[1 - s]) - p.sizes[1 - s]
        where = np.zeros(len(keys), np.int64)
        where[at[1 - s]] = np.arange(len(at[1 - s])) - starts[rows[1 - s]]
        lone.append(np.where(once[at[s]], where[at[s]], -1))
        items.append(np.where(both[at[s]], p.items[s] + 2, 2 + s))
    return Pairs(tuple(items), p.sizes), lone, [both[x] for x in at]


def _contexts(p: Pairs) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every item of each side: the least length of a run from it on that occurs once on both sides (0: none), and its place there."""
    index = Index(p)
    least, place = index.lone_contexts()
    out = []
    for s in (0, 1):
        at = (index.side == s) & ~index.mark
        out.append((least[at], place[at] - index.start[index.row[at], 1 - s]))
    return out


def ribes_of(p: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """RIBES of every pair, with the left side as reference, and with the right side; 0 for an empty hypothesis.

    The definition widens the context of an item to both sides together, first to the right, and stops short of the far end."""
    coded, lone, both = _only_shared(p)
    ahead, behind = _contexts(coded), _contexts(coded.reversed())
    out = []
    for s in (1, 0):   # the side that is the hypothesis
        n, m = p.sizes[s], p.sizes[1 - s]
        row = np.repeat(np.arange(len(p)), n)
        first = np.cumsum(n) - n
        i = np.arange(len(row)) - first[row]
        back = first[row] + n[row] - 1 - i                      # the item in the reversed side
        limit = np.maximum(i, n[row] - i + 1)
        right = np.where(ahead[s][0] > 0, ahead[s][0] - 1, limit)
        left = np.where(behind[s][0][back] > 0, np.minimum(behind[s][0][back] - 1, limit), limit)
        by_context = np.where((right < limit) & (right <= left), ahead[s][1],
                              np.where(left < limit, m[row] - 1 - behind[s][1][back], -1))
        place = np.where(lone[s] >= 0, lone[s], by_context)
        found = both[s] & (place >= 0)
        out.append(_scores(row[found], place[found], m, n))
    return out[0], out[1]


def _scores(row: np.ndarray, place: np.ndarray, n_ref: np.ndarray, n_hyp: np.ndarray) -> np.ndarray:
    """Scores from the aligned places of every row, in order: pairs inside maximal runs of +1 steps over all pairs, the
    share of aligned items and the brevity penalty."""
    count = np.bincount(row, minlength=len(n_hyp))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(row)))
    inside = np.zeros(len(n_hyp), np.int64)
    np.add.at(inside, row[first], run * (run - 1) // 2)
    hyp = np.maximum(n_hyp, 1)
    tau = inside / np.maximum(count * (count - 1) // 2, 1)
    penalty = np.minimum(1.0, np.exp(np.minimum(1.0 - n_ref / hyp, 0.0)))
    return np.where(n_hyp > 0, tau * (count / hyp) ** RIBES_ALPHA * penalty ** RIBES_BETA, 0.0)


def ribes_batch(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """RIBES of two columns of strings (characters) or of arrays of strings."""
    return _ribes(pairs_of(left, right))


def _ribes(p: Pairs) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(p)), np.zeros(len(p))
    for at, part in p.chunks():
        out[0][at], out[1][at] = ribes_of(part)
    return out


# --------------------------------------------------------------------------
# GLEU as called on words
# --------------------------------------------------------------------------

def _grams(n_items: int) -> int:
    """Number of 1..4-grams of so many items."""
    return sum(max(n_items - n + 1, 0) for n in mt.ORDERS)


def _spelt(words: list[str | None]) -> Counter:
    """What the 1..4-grams of one-character words spell."""
    out: Counter = Counter()
    run = ""
    for w in words:
        run = run + w if w is not None and len(w) == 1 else ""
        for n in mt.ORDERS:
            if len(run) >= n:
                out[run[-n:]] += 1
    return out


def gleu_words(reference: list[str | None], hypothesis: list[str | None]) -> float:
    """T2 on words: each reference term, read as characters, is a reference for the hypothesis; the best term wins."""
    spelt = _spelt(hypothesis)
    if not spelt:
        return 0.0
    total, best = _grams(len(hypothesis)), 0.0
    singles = [g for g in spelt if len(g) == 1]
    for t in set(reference):
        if t is None or not any(c in t for c in singles):
            continue
        found = Counter(t[i:i + n] for n in mt.ORDERS for i in range(len(t) - n + 1))
        best = max(best, sum(min(k, spelt[g]) for g, k in found.items() if g in spelt) / max(total, _grams(len(t))))
    return best


def _gleu_words(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """GLEU as called of every pair, with the left side as reference, and with the right side."""
    terms = [*tokens.terms.to_pylist(), None]
    single = np.array([t is not None and len(t) == 1 for t in terms], bool)[tokens.code]
    sizes = tokens.words.sizes
    ends = [np.append(0, np.cumsum(n)) for n in sizes]
    n_left = int(ends[0][-1])
    codes = tokens.code[:n_left].tolist(), tokens.code[n_left:].tolist()
    out = np.zeros(len(sizes[0])), np.zeros(len(sizes[0]))
    for hyp, flags in ((1, single[n_left:]), (0, single[:n_left])):
        some = np.diff(np.append(0, np.cumsum(flags))[ends[hyp]]) > 0
        for row in np.flatnonzero(some & (sizes[1 - hyp] > 0)).tolist():
            reference, hypothesis = ([terms[c] for c in codes[s][ends[s][row]:ends[s][row + 1]]] for s in (1 - hyp, hyp))
            out[1 - hyp][row] = gleu_words(reference, hypothesis)
    return out


_STATS = T.StructType([T.StructField(f"n{n}", T.StructType([T.StructField(k, T.LongType()) for k in ("a", "b", "i")]))
                       for n in mt.ORDERS])
_SIDES = T.StructType([T.StructField("l", T.DoubleType()), T.StructField("r", T.DoubleType())])


def _stats(p: Pairs, none: pa.Array) -> pa.Array:
    """n-gram counts and clipped matches of every pair; null where a side is."""
    out = {n: {k: np.zeros(len(p), np.int64) for k in ("a", "b", "i")} for n in mt.ORDERS}
    for at, part in p.chunks():
        for n, counts in gram_counts(part, mt.ORDERS, sets=False).items():
            for k, values in out[n].items():
                values[at] = counts[k]
    orders = [pa.StructArray.from_arrays([pa.array(x) for x in out[n].values()], list(out[n])) for n in mt.ORDERS]
    return pa.StructArray.from_arrays(orders, [f"n{n}" for n in mt.ORDERS], mask=none)


def _kernel(level: str, with_ribes: bool):
    """Arrow function of both sides' texts, or of their terms (``pairkernel.Tokens``): struct of the n-gram counts, for words
    of GLEU as called, and with ``with_ribes`` of RIBES."""
    kinds = {"st": _STATS} | ({"gl": _SIDES} if level != "char" else {}) | ({"rb": _SIDES} if with_ribes else {})

    @F.arrow_udf(T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    def scores(left: pa.Array, right: pa.Array) -> pa.Array:
        if level == "char":
            p, known = pairs_of(left, right), tuple(c.is_valid().to_numpy(zero_copy_only=False) for c in (left, right))
        else:
            tokens = Tokens(left, right)
            p, known = localised(tokens.words), tokens.known
        none = pa.array(~(known[0] & known[1]))
        out = [_stats(p, none)]
        if "gl" in kinds:
            out.append(pa.StructArray.from_arrays([pa.array(x) for x in _gleu_words(tokens)], ["l", "r"]))
        if with_ribes:
            out.append(pa.StructArray.from_arrays([pa.array(x) for x in _ribes(p)], ["l", "r"], mask=none))
        return pa.StructArray.from_arrays(out, list(kinds))

    return once(scores)


# --------------------------------------------------------------------------
# Family
# --------------------------------------------------------------------------

def mt_features(pairs: DataFrame, keep=("qid",), standard_gleu: bool = False, levels=("char", "basic_word"),
                with_ribes: bool = True) -> DataFrame:
    """T1-T3 for characters (``char_``) and words (``basic_word_``)."""
    keep = list(keep)
    s0 = pairs.select(*keep, F.col("ql").alias("_a"), F.col("qr").alias("_b"), *supplied_tokens(pairs))
    texts = F.col("_a"), F.col("_b")
    words = token_exprs(s0, "_a", "_b") if supplied_tokens(s0) else tuple(text.spaced_terms(c) for c in texts)
    s1 = s0.select(*keep, *[_kernel(lv, with_ribes)(*(texts if lv == "char" else words)).alias(f"_mt_{lv}") for lv in levels])
    out = []
    for lv in levels:
        found = F.col(f"_mt_{lv}")
        st = found["st"]
        if lv == "char":
            gl, gr = mt.gleu_as_called_chars(st, "b"), mt.gleu_as_called_chars(st, "a")
        else:
            gl, gr = found["gl"]["l"], found["gl"]["r"]
        out += [mt.bleu(st, "b", "a").alias(f"{lv}_bleu_score_l"), mt.bleu(st, "a", "b").alias(f"{lv}_bleu_score_r"),
                gl.alias(f"{lv}_gleu_score_l"), gr.alias(f"{lv}_gleu_score_r")]
        if with_ribes:
            out += [found["rb"]["l"].alias(f"{lv}_ribes_score_l"), found["rb"]["r"].alias(f"{lv}_ribes_score_r")]
        if standard_gleu:
            g = mt.gleu_std(st)
            out += [g.alias(f"{lv}_gleu_std_l"), g.alias(f"{lv}_gleu_std_r")]
    return s1.select(*keep, *out)
