"""All pair features of the catalogue in one projection.

Lexical families with their peripheral variants (132 columns), vector distances
of all tokens and of content words (32) and machine-translation scores (12):
176 columns for every pair, which is scanned once and never moved. Each family
cuts its tokens where it needs them: between families a row holds its texts and
values, no arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairfeat.operators import lexical as lex
from pairfeat.operators import mt
from pairfeat.operators import vectors as vec

VECTOR_NAMES = [f"{p}{n}" for p in ("", "notion_") for n in vec.DIST_NAMES]
MT_NAMES = [f"{level}_{n}" for level in ("char", "basic_word") for n in mt.MT_NAMES]


def all_features(pairs: DataFrame, vocab: vec.Vocabulary, keep=("qid",)) -> DataFrame:
    """``keep`` and the 176 columns, lexical ones first."""
    texts = ["ql", "qr", *lex.supplied_tokens(pairs)]
    with_vectors = vec.vector_features(pairs, vocab, keep=[*keep, *texts])
    with_scores = mt.mt_features(with_vectors, keep=[*keep, *texts, *VECTOR_NAMES])
    out = lex.lexical_features(with_scores, families=lex.FAMILIES, keep=[*keep, *VECTOR_NAMES, *MT_NAMES])
    lexical = [c for c in out.columns if c not in (*keep, *VECTOR_NAMES, *MT_NAMES)]
    return out.select(*keep, *lexical, *VECTOR_NAMES, *MT_NAMES)
