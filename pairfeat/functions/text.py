"""Turning texts into sequences: code points, terms, tags.

The reference's segmenter and tagger are a closed native library that is not
available, so tokens are an input column shaped ``array<struct<term, postag>>``.
``tokens`` builds that column with a rule any engine can express; callers with
their own segmenter pass their own column instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairfeat.functions.core import empty_array, let

TOKEN_TYPE = "array<struct<term:string,postag:string>>"

# Fixed values (test-fixture tokenizer and tagger, FIXTURES.md section 3):
#   term pattern: maximal runs of letters, digits and underscore; case kept.
#   tag: the first matching suffix rule, in this order:
#        "tion" -> "n", "th" -> "nz", "ing" -> "v", "ble" -> "a", "ly" -> "d", otherwise "x".
TERM_PATTERN = r"[\p{L}\p{N}_]+"
SUFFIX_TAGS = [("tion", "n"), ("th", "nz"), ("ing", "v"), ("ble", "a"), ("ly", "d")]
DEFAULT_TAG = "x"

# Fixed values (vectoriser analyser): lower-case, then maximal runs of two or
# more word characters, so one-character terms are dropped.
ANALYZER_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Fixed values (content-word classes of the tag set): adjective "a",
# adverb "d", verb "v", and every tag starting with "n" is a noun.
ADJ, ADV, VERB, NOUN_PREFIX = "a", "d", "v", "n"


def chars(s: Column) -> Column:
    """The code points of a string as an array of one-character strings."""
    return F.when(s == "", empty_array()).otherwise(F.split(s, ""))


def terms_of(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(TERM_PATTERN), 0)


def spaced_terms(s: Column) -> Column:
    """The terms of a raw text with one space between, as ``term_text(tokens(s))`` but for spaces at the ends."""
    return F.regexp_replace(s, r"[^\p{L}\p{N}_]+", " ")


def notional_terms(s: Column) -> Column:
    """The terms of ``notional(tokens(s))``: every suffix rule names a content word."""
    word = r"[\p{L}\p{N}_]"
    suffixes = "|".join(suffix for suffix, _ in SUFFIX_TAGS)
    return F.regexp_extract_all(s, F.lit(rf"(?<!{word}){word}*(?:{suffixes})(?!{word})"), 0)


def suffix_tag(term: Column) -> Column:
    out = None
    for suffix, tag in SUFFIX_TAGS:
        cond = term.endswith(suffix)
        out = F.when(cond, F.lit(tag)) if out is None else out.when(cond, F.lit(tag))
    return out.otherwise(F.lit(DEFAULT_TAG))


def tokens(s: Column) -> Column:
    """P5: ``array<struct<term, postag>>`` from a raw text."""
    return F.transform(terms_of(s), lambda t: F.struct(t.alias("term"), suffix_tag(t).alias("postag")))


def term_seq(tok: Column) -> Column:
    """P2."""
    return F.transform(tok, lambda t: t["term"])


def tag_seq(tok: Column) -> Column:
    """P3."""
    return F.transform(tok, lambda t: t["postag"])


def term_text(tok: Column) -> Column:
    """Terms joined by one space."""
    return F.array_join(term_seq(tok), " ")


def _is_noun(tag: Column) -> Column:
    return F.coalesce(tag.startswith(NOUN_PREFIX), F.lit(False))


def _is(tag: Column, value: str) -> Column:
    return F.coalesce(tag == value, F.lit(False))


def notional(tok: Column) -> Column:
    """Keep adjectives, adverbs, verbs and nouns. A NULL or empty tag is no class."""
    return F.filter(tok, lambda t: _is(t["postag"], ADJ) | _is(t["postag"], ADV)
                    | _is(t["postag"], VERB) | _is_noun(t["postag"]))


PERIPH_KINDS = ("all", "adj", "adv", "verb", "noun")


def periph(tok: Column, other_text: Column) -> Column:
    """Tokens whose term is not a substring of the other side's raw text."""
    return F.filter(tok, lambda t: ~F.coalesce(F.contains(other_text, t["term"]), F.lit(False)))


def periph_kind(ptok: Column, kind: str) -> Column:
    if kind == "all":
        return ptok
    if kind == "noun":
        return F.filter(ptok, lambda t: _is_noun(t["postag"]))
    tag = {"adj": ADJ, "adv": ADV, "verb": VERB}[kind]
    return F.filter(ptok, lambda t: _is(t["postag"], tag))


def analyzed(s: Column) -> Column:
    """Vectoriser analyser: lower-case, then runs of 2+ word characters."""
    return F.regexp_extract_all(F.lower(s), F.lit(ANALYZER_PATTERN), 0)


def analyzed_terms(s: Column) -> Column:
    """``analyzed(spaced_terms(s))``. Only a capital sigma is lower-cased by what stands around it; other texts are read once."""
    return F.when(F.contains(s, F.lit("\u03a3")), analyzed(spaced_terms(s))).otherwise(analyzed(s))
