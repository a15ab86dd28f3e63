"""License scans by a positional rare-token index.

1. Document frequencies of the templates' words are counted over the whole
   corpus (at most one row per template word comes back: a bound set by
   ``TEMPLATES``, not by the data).
2. Each template is indexed by the highest-IDF words of its mandatory phrase:
   postings (word, template, place in the template).
3. A file's occurrences of indexed words vote for offsets (place in the file
   minus place in the template); offsets on which all of a template's rare words
   agree are verified by comparing the mandatory phrase word for word, and
   scored by the share of the template's words that stand where they should.

A phrase that stands in a file has its rare words at the right places, so the
index loses no place. Steps 2 and 3 are expressions over one row.

Defined results: null or empty text has no word and no label, score 0 and null
places; repeated rows give equal results; an empty table gives an empty one;
other columns pass through ``scan`` unless they carry one of its names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.llm.native import whole


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrase: tuple[str, ...]
    base: bool = False

    @property
    def at(self) -> int:
        """Where the mandatory phrase stands in the template."""
        n = len(self.phrase)
        return next(k for k in range(len(self.words) - n + 1) if self.words[k:k + n] == self.phrase)


def _t(label: str, words: str, phrase: str | None = None, base: bool = False) -> Template:
    return Template(label, tuple(words.split()), tuple((phrase or words).split()), base)


# The base phrases, then templates of license notices with their mandatory phrases.
TEMPLATES = [
    _t("gpl", "gnu general public license", base=True),
    _t("apache", "apache license", base=True),
    _t("cc-by", "cc by", base=True),
    _t("mit", "mit license", base=True),
    _t("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _t("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    _t("lgpl", "gnu lesser general public license"),
    _t("agpl", "gnu affero general public license"),
    _t("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _t("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _t("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _t("cc0", "creative commons cc0 1 0 universal", "commons cc0"),
    _t("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software "
       "and associated documentation files", "permission is hereby granted free of charge"),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
       "redistribution and use in source and binary forms"),
    _t("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
       "is hereby granted", "permission to use copy modify"),
    _t("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    _t("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

#: Rare words of a mandatory phrase that index its template.
RARE = 2

#: Runs between words; A-Z are word characters here because words are lower-cased after the cut.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text; those of ASCII alone are lower-cased (only they can equal a template's word)."""
    cut = F.array_remove(F.split(text, BETWEEN, -1), "")
    return F.transform(cut, lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(w))


def idf(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, float]:
    """IDF of every word of a mandatory phrase over all rows of ``docs``."""
    vocabulary = sorted({w for t in templates for w in t.phrase})
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = F.array_intersect(words(whole(F.col(text_col))), known)
    # "" stands for the row itself, so one pass counts rows and words.
    counted = (docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word"))
               .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect())
    n = {r["word"]: r["n"] for r in counted}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def index(templates: list[Template], weights: dict[str, float]) -> list[list[tuple[str, int]]]:
    """For each template its rarest (word, place in the template); ties go to the alphabet."""
    out = []
    for t in templates:
        first = {w: t.at + k for k, w in reversed(list(enumerate(t.phrase)))}
        rare = sorted(first, key=lambda w: (-weights[w], w))[:RARE]
        out.append([(w, first[w]) for w in rare])
    return out


def _votes(word: str, at: int) -> Column:
    return F.transform(F.filter("_hit", lambda x: x["w"] == word), lambda x: x["i"] - at)


def _agreed(posting: list[tuple[str, int]]) -> Column:
    """Offsets of a template for which each of its rare words votes."""
    out = _votes(*posting[0])
    for word, at in posting[1:]:
        out = F.array_intersect(out, _votes(word, at))
    return F.array_distinct(out)


def _verified(k: int, t: Template) -> Column:
    """Places at which the mandatory phrase of template ``k`` stands, with the share of the template found around it."""
    phrase = F.array(*[F.lit(w) for w in t.phrase])
    template = F.array(*[F.lit(w) for w in t.words])
    stands = lambda o: (o + t.at >= 0) & (F.slice("_w", F.greatest(o + t.at + 1, F.lit(1)), len(t.phrase)) == phrase)
    return F.transform(F.filter(f"_v{k}", stands), lambda o: F.struct(
        F.lit(k).alias("template"), (o + t.at).alias("start"),
        (F.size(F.filter(template, lambda w, j: F.get(F.col("_w"), o + j) == w)) / F.lit(len(t.words))).alias("share")))


def scan(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """Add n_words and ``places``: array of (template, start, share), start being the mandatory phrase's first word."""
    postings = index(templates, idf(docs, templates, text_col))
    indexed = sorted({w for p in postings for w, _ in p})
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "places")])
    staged = kept.withColumn("_w", words(whole(F.col(text_col))))
    staged = staged.withColumn("_hit", F.when(
        F.arrays_overlap("_w", F.array(*[F.lit(w) for w in indexed])),
        F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(indexed))))
    staged = staged.withColumns({f"_v{k}": _agreed(posting) for k, posting in enumerate(postings)})
    found = [_verified(k, t) for k, t in enumerate(templates)]
    empty = F.array().cast("array<struct<template:int,start:int,share:double>>")
    staged = staged.withColumns({
        "n_words": F.size("_w").cast("long"),
        "places": F.when(F.col("_hit").isNotNull(), F.concat(*found)).otherwise(empty)})
    return staged.drop("_w", "_hit", *[f"_v{k}" for k in range(len(templates))])


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_base = sum(t.base for t in TEMPLATES)
    names = F.array(*[F.lit(t.label) for t in TEMPLATES])
    base = F.filter("places", lambda p: p["template"] < n_base)
    label = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: F.get(names, p["template"])))), ",")
    return scan(docs).drop("text").withColumn("_b", base).select(
        "doc_id", "n_words", F.size("_b").cast("long").alias("n_base"),
        F.array_min(F.transform("_b", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_b", lambda p: p["start"])).cast("long").alias("last_word"),
        label(F.col("_b")).alias("base_labels"), label(F.col("places")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)), 4).alias("score"))


def _sql() -> str:
    n_base = sum(t.base for t in TEMPLATES)
    parts = [rf"""
SELECT rid, {k} template, '{t.label}' lab, i - 1 s,
       len(list_filter(range(1, {len(t.words) + 1}), lambda j: i - {t.at} + j - 1 >= 1 AND ws[i - {t.at} + j - 1] = {list(t.words)!r}[j])) / {len(t.words)}.0 share
FROM (SELECT rid, ws, unnest(range(1, len(ws) - {len(t.phrase) - 2})) i FROM w WHERE list_contains(ws, '{t.phrase[0]}'))
WHERE ws[i:i+{len(t.phrase) - 1}] = {list(t.phrase)!r}""" for k, t in enumerate(TEMPLATES)]
    union = "\nUNION ALL".join(parts)
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () rid, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
p AS ({union}),
g AS (SELECT rid, count(*) FILTER (template < {n_base}) n_base, min(s) FILTER (template < {n_base}) first_word,
        max(s) FILTER (template < {n_base}) last_word, string_agg(DISTINCT lab, ',' ORDER BY lab) FILTER (template < {n_base}) base_labels,
        string_agg(DISTINCT lab, ',' ORDER BY lab) labels, round(max(share), 4)::DOUBLE score FROM p GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_base, 0)::BIGINT n_base, first_word::BIGINT first_word, last_word::BIGINT last_word,
       coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::DOUBLE score
FROM w LEFT JOIN g USING (rid)
"""


SQL = {"op6_licenses": _sql()}
QUERIES = {"op6_licenses": op6_licenses}
