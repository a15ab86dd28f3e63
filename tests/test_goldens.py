
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairfeat.operators import lexical as lex
from pairfeat.operators import mt as mtf
from pairfeat.operators import vectors as vec

CJK_L, CJK_R = "用精子库精子需要多少能怀孕", "用精子库的精子需要多少钱"

SEQ = [  # left, right, lcs, sub, pre, suf, lev, osa
    ("abced", "abe", 3, 2, 2, 0, 2, 2),
    ("abcede", "abe", 3, 2, 2, 1, 3, 3),
    ("abcede", "abecde", 5, 2, 2, 2, 2, 1),
    ("ca", "abc", 1, 1, 0, 0, 3, 3),
    ("", "abc", 0, 0, 0, 0, 3, 3),
    ("", "", 0, 0, 0, 0, 0, 0),
    (CJK_L, CJK_R, 10, 6, 4, 0, 4, 4),
]
LENGTHS = [  # len_l, len_r, union, intersect, diff, l-r, r-l
    ("abced", "abe", (5, 3, 5, 3, 2, 2, 0)),
    ("abcede", "abe", (6, 3, 6, 3, 3, 3, 0)),
    ("abcede", "abecde", (6, 6, 6, 6, 0, 0, 0)),
    ("ca", "abc", (2, 3, 3, 2, 1, 0, 1)),
    ("", "abc", (0, 3, 3, 0, 3, 0, 3)),
    ("", "", (0, 0, 0, 0, 0, 0, 0)),
    (CJK_L, CJK_R, (13, 12, 15, 10, 1, 3, 2)),
]
NGRAMS = [  # per n: inter / union / left set / right set
    ("abced", "abe", [(3, 5, 5, 3), (1, 5, 4, 2), (0, 4, 3, 1), (0, 2, 2, 0)]),
    ("abcede", "abecde", [(5, 5, 5, 5), (2, 8, 5, 5), (0, 8, 4, 4), (0, 6, 3, 3)]),
    ("ca", "abc", [(2, 3, 2, 3), (0, 3, 1, 2), (0, 1, 0, 1), (0, 0, 0, 0)]),
    (CJK_L, CJK_R, [(8, 13, 11, 10), (7, 14, 11, 10), (6, 15, 11, 10), (4, 15, 10, 9)]),
]
METRICS = lex.SEQ_METRICS
LEN_COLS = ["len_l", "len_r", "len_union", "len_intersect", "len_diff", "len_l_diff_r", "len_r_diff_l"]


def _rows(spark, pairs):
    df = spark.createDataFrame([(str(i), a, b, "0") for i, (a, b) in enumerate(pairs)],
                               "qid string, ql string, qr string, label string")
    out = lex.lexical_features(df, families=("char_len", "char_ngram", "char_seq"))
    return {r["qid"]: r.asDict() for r in out.collect()}


def test_char_sequence_goldens(spark):
    got = _rows(spark, [(a, b) for a, b, *_ in SEQ])
    for i, (a, b, *want) in enumerate(SEQ):
        assert [got[str(i)][f"char_{m}_v"] for m in METRICS] == want, (a, b)


def test_char_length_goldens(spark):
    got = _rows(spark, [(a, b) for a, b, _ in LENGTHS])
    for i, (a, b, want) in enumerate(LENGTHS):
        assert tuple(got[str(i)][f"char_{c}"] for c in LEN_COLS) == want, (a, b)
        r = got[str(i)]
        assert r["char_len_l_diff_r_ratio"] == (want[5] / want[1] if want[1] else 0.0)
        assert r["char_len_r_diff_l_ratio"] == (want[6] / want[0] if want[0] else 0.0)


def test_char_ngram_goldens(spark):
    got = _rows(spark, [(a, b) for a, b, _ in NGRAMS])
    for i, (a, b, cells) in enumerate(NGRAMS):
        for n, (inter, union, sl, sr) in enumerate(cells, start=1):
            r = got[str(i)]
            assert r[f"char_{n}gram_jaccard"] == pytest.approx(inter / union if union else 0.0)
            assert r[f"char_{n}gram_dice"] == pytest.approx(2 * inter / (sl + sr) if sl + sr else 0.0)
            assert r[f"char_{n}gram_overlap"] == pytest.approx(inter / min(sl, sr) if sl and sr else 0.0)


def test_word_goldens(spark):
    df = spark.createDataFrame([("w", "a b c c d", "b c d", "0")], "qid string, ql string, qr string, label string")
    r = lex.lexical_features(df, families=("word_len", "word_ngram", "word_seq")).first().asDict()
    assert [r[f"basic_word_{m}_v"] for m in METRICS] == [3, 2, 0, 2, 2, 2]
    assert [r[f"basic_word_{c}"] for c in LEN_COLS] == [5, 3, 5, 3, 2, 2, 0]
    assert r["basic_word_1gram_jaccard"] == pytest.approx(3 / 4)
    assert r["basic_word_2gram_jaccard"] == pytest.approx(2 / 4)


def test_ngrams_of_abcd(spark):
    from pairfeat.functions import sets, text
    r = spark.range(1).select(sets.ngrams(text.chars(F.lit("abcd")), 3, "").alias("g")).first()
    assert r["g"] == ["abc", "bcd"]


def test_mt_goldens(spark):
    df = spark.createDataFrame([("m", "a b c c d", "b c d", "0")], "qid string, ql string, qr string, label string")
    r = mtf.mt_features(df, levels=("basic_word",), standard_gleu=True).first().asDict()
    assert r["basic_word_bleu_score_l"] == pytest.approx(0.305280, abs=1e-6)
    assert r["basic_word_bleu_score_r"] == pytest.approx(0.281171, abs=1e-6)
    assert r["basic_word_gleu_score_l"] == pytest.approx(1 / 6)
    assert r["basic_word_gleu_score_r"] == pytest.approx(1 / 14)
    assert r["basic_word_gleu_std_l"] == pytest.approx(5 / 14)
    assert r["basic_word_gleu_std_r"] == pytest.approx(5 / 14)
    assert r["basic_word_ribes_score_l"] == pytest.approx(0.311836, abs=1e-6)
    assert r["basic_word_ribes_score_r"] == pytest.approx(0.315247, abs=1e-6)


def test_count_distance_goldens(spark):
    corpus = spark.createDataFrame([("aa bb cc",)], "text string")
    vocab = vec.fit_vocabulary(corpus)
    pairs = spark.createDataFrame([("1", "aa bb bb", "aa cc", "0"), ("2", "", "aa", "0"), ("3", "", "", "0")],
                                  "qid string, ql string, qr string, label string")
    got = {r["qid"]: r for r in vec.vector_features(pairs, vocab, kinds=("all",)).collect()}
    assert got["1"]["count1_PED"] == pytest.approx(2.23606797749979)
    assert got["1"]["count1_PMD"] == pytest.approx(3.0)
    assert got["1"]["count1_PCD"] == pytest.approx(0.683772233983162)
    assert (got["2"]["count1_PED"], got["2"]["count1_PMD"], got["2"]["count1_PCD"]) == pytest.approx((1.0, 1.0, 0.5))
    assert (got["3"]["count1_PED"], got["3"]["count1_PMD"], got["3"]["count1_PCD"]) == pytest.approx((0.0, 0.0, 0.0))
    # hashed vectors are unit length: identical sides give 0, one empty side gives 0.5
    assert got["2"]["hash1_18_PCD"] == pytest.approx(0.5)
    assert got["3"]["hash2_20_PCD"] == pytest.approx(0.0)
