"""Machine-translation scores as column expressions (2.8, T1, T2, T2b).

Suffix ``_l``: the left text is the reference and the right text the
hypothesis; ``_r``: the reverse. Clipped n-gram matches are symmetric in the
two sides, so the four multiset intersections serve BLEU in both directions and
standard GLEU: ``st`` is struct(n1..n4: struct(a, b, i)), n-grams per side and
matches (``operators.mt``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairfeat.functions.core import ratio

ORDERS = (1, 2, 3, 4)
WEIGHT = 0.25  # fixed value: uniform BLEU-4 weights


def bleu(st: Column, hyp: str, ref: str) -> Column:
    """BLEU-4 with geometric-sequence smoothing (method 3).

    p_n = matches / max(1, hypothesis n-grams); 0 when there is no unigram
    match; the k-th zero p_n (k = 1, 2, ..) becomes 1 / (2^k * denominator);
    brevity penalty 1 if the hypothesis is longer, else exp(1 - ref/hyp).
    """
    ref_len, hyp_len = st["n1"][ref], st["n1"][hyp]
    den = {n: F.greatest(st[f"n{n}"][hyp], F.lit(1)) for n in ORDERS}
    num = {n: st[f"n{n}"]["i"] for n in ORDERS}
    logs = []
    zeros_before = F.lit(0)
    for n in ORDERS:
        zero = num[n] == 0
        k = zeros_before + 1
        smoothed = F.lit(1.0) / (F.pow(F.lit(2.0), k) * den[n])
        p = F.when(zero, smoothed).otherwise(num[n].cast("double") / den[n])
        logs.append(F.log(p))
        zeros_before = zeros_before + zero.cast("int")
    bp = (F.when(hyp_len > ref_len, F.lit(1.0))
          .when(hyp_len == 0, F.lit(0.0))
          .otherwise(F.exp(F.lit(1.0) - ref_len.cast("double") / hyp_len)))
    total = WEIGHT * logs[0]
    for x in logs[1:]:
        total = total + WEIGHT * x
    geo = F.exp(total)
    return F.when(num[1] == 0, F.lit(0.0)).otherwise(bp * geo)


def gleu_std(st: Column) -> Column:
    """One reference; matches / max(hyp n-grams, ref n-grams), n = 1..4."""
    tp = sum(st[f"n{n}"]["i"] for n in ORDERS)
    na = sum(st[f"n{n}"]["a"] for n in ORDERS)
    nb = sum(st[f"n{n}"]["b"] for n in ORDERS)
    return ratio(tp, F.greatest(na, nb))


def _all_grams(n_items: Column) -> Column:
    """Number of 1..4-grams of a sequence of ``n_items`` items."""
    return sum(F.greatest(n_items - (n - 1), F.lit(0)) for n in ORDERS)


def gleu_as_called_chars(st: Column, hyp: str) -> Column:
    """T2 on characters: every character of the reference is its own one-item
    reference, so the best score is 1 / (hypothesis 1..4-grams) when any
    character is shared and 0 otherwise. On words it is ``operators.mt.gleu_words``."""
    shared = F.coalesce(st["n1"]["i"] > 0, F.lit(False))
    return F.when(shared, F.lit(1.0) / F.greatest(_all_grams(st["n1"][hyp]), F.lit(1))).otherwise(F.lit(0.0))
