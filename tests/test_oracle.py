"""Differential check: registered queries against their DuckDB twins (sf0.001)."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL

QUICK = ["sent_pairs", "rotated_pairs", "name_pairs", "turn_pairs", "scan_pairs", "scan_corpus",
         "tokenize_tag", "term_text", "notional_tokens", "periph_tokens", "ngrams", "ngrams_padded",
         "char_len", "word_len", "postag_len", "periph_len", "char_ngram", "word_ngram", "postag_ngram",
         "char_seq_names", "word_seq", "levenshtein_word", "osa_word", "fit_vocab", "count_vectors",
         "tfidf_vectors", "hash_vectors", "vector_distances", "mt_gleu_char", "mt_bleu_word",
         "sif_weighted_mean", "train_test_split", "micro_f1", "classification_report", "json_lines"]


@pytest.mark.parametrize("name", QUICK)
def test_matches_duckdb(spark, name):
    from oracle_check import compare
    res = compare(spark, SF_SMALL, [name], verbose=False)
    assert res[name] == "OK", res[name]
