"""The batch kernels of the pair features against plain Python, and the plans around them."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairfeat.functions import text
from pairfeat.operators import bitlanes, grams, lexical as lex, mt as mtf, suffixes
from test_sequences import brute, dp_edit, dp_lcs

SCHEMA = "qid string, ql string, qr string, label string"


def _texts(rng, n, most, items="aab cé漢\U0001F600"):
    return [("".join(rng.choice(items) for _ in range(rng.randrange(most))), "".join(rng.choice(items) for _ in range(rng.randrange(most)))) for _ in range(n)]


def _pairs(pairs):
    return suffixes.pairs_of(*(pa.array(side) for side in zip(*pairs)))


def _counts(a, b, n):
    l, r = (Counter(x[i:i + n] for i in range(len(x) - n + 1)) for x in (a, b))
    return {"a": sum(l.values()), "b": sum(r.values()), "i": sum((l & r).values()), "da": len(l), "db": len(r), "di": len(l.keys() & r.keys())}


@pytest.mark.parametrize("bits", [64, 20, 3])
def test_ngram_counts_of_all_orders(monkeypatch, bits):
    """By one sort, with items numbered anew within their pairs, and by a sort for each order."""
    pairs = _texts(random.Random(2), 150, 25) + [("", ""), ("a", ""), ("ab" * 300, "ba" * 200), ("aaaa", "aaa")]
    monkeypatch.setattr(grams, "WORD_BITS", bits)
    got = grams.gram_counts(_pairs(pairs), (1, 2, 4))
    for n in (1, 2, 4):
        for k, (a, b) in enumerate(pairs):
            assert {key: int(v[k]) for key, v in got[n].items()} == _counts(a, b, n), (n, a, b)


@pytest.mark.parametrize("items", [256, 0])
def test_edit_metrics_as_columns_and_as_lanes(monkeypatch, items):
    rng = random.Random(4)
    pairs = _texts(rng, 150, 30, "abc") + _texts(rng, 20, 150, "ab") + [("a" * 64, "a" * 65), ("ab" * 64, "ba" * 64), ("", "ab"), ("", ""), ("a" * 130, "b" + "a" * 140)]
    monkeypatch.setattr(bitlanes, "COLUMN_ITEMS", items)
    monkeypatch.setattr(bitlanes, "COLUMNS", 64)
    got = zip(*[x.tolist() for x in bitlanes.edit_metrics(_pairs(pairs))])
    assert list(got) == [(dp_lcs(a, b), dp_edit(a, b, True), dp_edit(a, b, False)) for a, b in pairs]


def test_suffix_order_by_packed_words():
    """Suffixes that packed words tell apart, and those that doubling goes on with."""
    pairs = _texts(random.Random(5), 60, 20, "ab") + [("abcdefghijklmnopqrstuvwxyz" * 4, "abcdefghijklmnopqrstuvwxyz" * 3), ("a" * 90, "a" * 70), ("", "")]
    p = _pairs(pairs)
    index = suffixes.Index(p)
    assert index.longest_common().tolist() == [brute(a, b)[1] for a, b in pairs]
    for k, (i, j) in enumerate(zip(index.order[1:], index.order[:-1]), 1):
        same = 0
        while index.row[i] == index.row[j] and index.items[i + same] == index.items[j + same]:
            same += 1
        assert index.lcp[k] == same


def test_features_are_no_array_functions(spark):
    """A plan without lambdas; each family query has one kernel."""
    df = spark.createDataFrame([("1", "a b", "b c", "0")], SCHEMA)
    for out in (lex.lexical_features(df, families=lex.FAMILIES), lex.lexical_features(df, families=("char_ngram",)), mtf.mt_features(df, levels=("basic_word",), standard_gleu=True)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1


def test_supplied_tokens_give_the_same_features(spark):
    rows = [("1", " the-nation, doing a thing.", "doing the ably nation a b a", "0"), ("2", "", "x", "0"), ("3", "漢字 é", "é 漢字 _", "0"), ("4", "!?", "  ", "0")]
    df = spark.createDataFrame(rows, SCHEMA)
    given = df.select("*", text.tokens(F.col("ql")).alias("tok_l"), text.tokens(F.col("qr")).alias("tok_r"))
    for features in (lambda p: lex.lexical_features(p, families=lex.FAMILIES), mtf.mt_features):
        assert sorted(features(df).collect()) == sorted(features(given).collect())


def test_missing_sides(spark):
    long = "a " * 300
    rows = [("1", None, "ab c", "0"), ("2", "ab c", None, "0"), ("3", None, None, "0"), ("4", long, None, "0"), ("5", None, long, "0")]
    got = {r["qid"]: r for r in lex.lexical_features(spark.createDataFrame(rows, SCHEMA), families=lex.FAMILIES).collect()}
    for level in ("char", "basic_word", "postag", "periph_basic_word"):
        n = {"char": 4}.get(level, 2)
        some = [[got[q][f"{level}_{c}"] for c in ("len_l", "len_r", "len_union", "len_intersect", "len_diff", "len_l_diff_r", "len_r_diff_l", "len_l_diff_r_ratio")] for q in "12345"]
        m = {"char": 600}.get(level, 300)
        assert some == [[None, n, None, None, None, None, None, 0.0], [n, None, None, None, None, None, None, 0.0], [None] * 7 + [0.0],
                        [m, None, None, 0, None, m, None, 0.0], [None, m, None, 0, None, None, m, 0.0]]
    assert all(got[q][f"{p}_longest_common_prefix_v"] is None and got[q][f"{p}_levenshtein_distance_r_ratio"] == 0.0 and got[q][f"{p}_1gram_dice"] == 0.0
               for q in "12345" for p in ("char", "basic_word"))
    scores = {r["qid"]: r for r in mtf.mt_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(scores[q][f"{p}_gleu_score_l"] == 0.0 and scores[q][f"{p}_bleu_score_l"] is None and scores[q][f"{p}_ribes_score_r"] is None
               for q in "12345" for p in ("char", "basic_word"))


def _gleu(reference, hypothesis):
    def all_grams(x):
        return Counter(tuple(x[i:i + n]) for n in (1, 2, 3, 4) for i in range(len(x) - n + 1))
    h = all_grams(hypothesis)
    return max((sum((all_grams(t) & h).values()) / max(sum(all_grams(t).values()), sum(h.values()), 1) for t in reference), default=0.0)


def test_gleu_words_by_definition():
    rng = random.Random(9)
    for _ in range(300):
        ref, hyp = ([rng.choice(["a", "b", "ab", "abab", "ba", "é", "x"]) for _ in range(rng.randrange(9))] for _ in range(2))
        assert abs(mtf.gleu_words(ref, hyp) - _gleu(ref, hyp)) < 1e-15
    assert np.array_equal(mtf.gleu_words([None, "ab"], ["a", None, "b"]), _gleu(["ab"], ["a", "\0\0", "b"]))


def test_sentence_vectors_read_texts(spark):
    """Terms reach the sentence vectors as texts, without token structs, and give what supplied tokens give."""
    from pairfeat.operators import sentvec as sv
    lexicon = sv.build_lexicon(spark.createDataFrame([("ab", [1.0, 0.5]), ("é", [0.0, 2.0])], "term string, vec array<double>"),
                               spark.createDataFrame([("ab", 3), ("é", 1)], "term string, freq long"))
    df = spark.createDataFrame([("1", " ab, é!ab x", "é", "0"), ("2", None, "ab", "0"), ("3", "", "?", "0")], SCHEMA)
    given = df.select("*", text.tokens(F.col("ql")).alias("tok_l"), text.tokens(F.col("qr")).alias("tok_r"))
    direction = np.array([0.6, 0.8])
    out = sv.with_sif(df, lexicon, direction)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(out.select("qid", *sv.SIF_NAMES).collect()) == sorted(sv.with_sif(given, lexicon, direction).select("qid", *sv.SIF_NAMES).collect())
