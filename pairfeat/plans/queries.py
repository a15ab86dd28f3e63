"""

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables (or
pair tables Spark derives from them) and, where SQL can state it, has a DuckDB
twin in ``SQL`` with the same column names. Feature columns are rounded to six
places only where the value comes from floating-point sums, so both engines
agree on every digit kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.functions import sets, text
from pairfeat.operators import catalogue, lattice
from pairfeat.operators import lexical as lex
from pairfeat.operators import mt as mtf
from pairfeat.operators import sentvec as sv
from pairfeat.operators import tagging
from pairfeat.operators import vectors as vec
from pairfeat.plans import model
from pairfeat.plans import oracles as O
from pairfeat.session import scratch_dir
from pairfeat.sources import lexicon as lexsrc
from pairfeat.sources import word2vec as w2v
from pairfeat.streaming import score
from pairfeat.sources import pairs as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _select_sql(table: str, cols: list[str], base: str | None = None, extra_ctes: tuple = ()) -> str:
    ctes = list(extra_ctes)
    src_rel = table
    if base is not None:
        ctes.insert(0, base)
        src_rel = "lex"
    return O.with_pairs(table, *ctes) + f"SELECT qid, {', '.join(cols)} FROM {src_rel}"


# --------------------------------------------------------------------------
# Sources and sinks (2.1)
# --------------------------------------------------------------------------

@register("scan_pairs", O.with_pairs("sent_pairs") + "SELECT qid, ql, qr, label FROM sent_pairs")
def q_scan_pairs(spark, sf_dir):
    """Write the sentence pairs as TSV, scan them back."""
    path = scratch_dir(spark, "pairs-tsv")
    src.write_pairs(src.sent_pairs(spark, sf_dir), path)
    return src.read_pairs(spark, path)


@register("scan_corpus", "SELECT unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL")
def q_scan_corpus(spark, sf_dir):
    """Write the document texts as lines, scan them back (one row per line)."""
    path = scratch_dir(spark, "corpus-txt")
    src.write_corpus(src.corpus_texts(spark, sf_dir), path)
    return src.read_corpus(spark, path)


@register("scan_rejects", """
SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS qid, a.text AS ql, b.text AS qr, CAST(NULL AS VARCHAR) AS label
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.text IS NULL OR b.text IS NULL""")
def q_scan_rejects(spark, sf_dir):
    """Rows the featurisers cannot take (each conversation's last turn has no reply) go to the rejects frame."""
    return src.split_rejects(src.turn_pairs(spark, sf_dir, how="left"))[1]


for _t in ("sent_pairs", "rotated_pairs", "turn_pairs", "name_pairs"):
    register(_t, O.with_pairs(_t) + f"SELECT qid, ql, qr, label FROM {_t}")(
        (lambda fn: lambda spark, sf_dir: fn(spark, sf_dir))(getattr(src, _t)))


# --------------------------------------------------------------------------
# Token shaping (2.2)
# --------------------------------------------------------------------------

def _sides(pairs: DataFrame) -> DataFrame:
    """One row per (qid, side) with the side's text and the other side's text."""
    return pairs.select("qid", F.inline(F.array(
        F.struct(F.lit("l").alias("side"), F.col("ql").alias("t"), F.col("qr").alias("o")),
        F.struct(F.lit("r").alias("side"), F.col("qr").alias("t"), F.col("ql").alias("o")))))


_SIDES_SQL = ("sides AS (SELECT qid, 'l' AS side, ql AS t, qr AS o FROM sent_pairs "
              "UNION ALL SELECT qid, 'r', qr, ql FROM sent_pairs)")


@register("tokenize_tag", O.with_pairs("sent_pairs", _SIDES_SQL) + f"""
SELECT qid, side, CAST(generate_subscripts({O.terms('t')}, 1) AS INTEGER) AS pos,
       unnest({O.terms('t')}) AS term, unnest({O.tags('t')}) AS postag FROM sides""")
def q_tokenize_tag(spark, sf_dir):
    """P5: tokens with tags, one row per token."""
    s = _sides(src.sent_pairs(spark, sf_dir))
    return (s.select("qid", "side", F.posexplode(text.tokens(F.col("t"))).alias("p", "tok"))
            .select("qid", "side", (F.col("p") + 1).cast("int").alias("pos"), "tok.term", "tok.postag"))


@register("term_text", O.with_pairs("sent_pairs", _SIDES_SQL) +
          f"SELECT qid, side, array_to_string({O.terms('t')}, ' ') AS term_text FROM sides")
def q_term_text(spark, sf_dir):
    """P2 + P4: terms of each side joined by one space."""
    s = _sides(src.sent_pairs(spark, sf_dir))
    return s.select("qid", "side", text.term_text(text.tokens(F.col("t"))).alias("term_text"))


@register("notional_tokens", O.with_pairs("sent_pairs", _SIDES_SQL) + f"""
SELECT qid, side, array_to_string([z[1] for z in list_zip({O.terms('t')}, {O.tags('t')})
       if z[2] IN ('a', 'd', 'v') OR starts_with(z[2], 'n')], ' ') AS notional_text FROM sides""")
def q_notional_tokens(spark, sf_dir):
    """Content words (adjective, adverb, verb, noun) of each side."""
    s = _sides(src.sent_pairs(spark, sf_dir))
    return s.select("qid", "side", text.term_text(text.notional(text.tokens(F.col("t")))).alias("notional_text"))


@register("periph_tokens", O.with_pairs("sent_pairs") + "SELECT qid, " + ", ".join(
    f"array_to_string({O.periph_terms(side, kind)}, ' ') AS periph_{kind}_{side}"
    for side in ("l", "r") for kind in text.PERIPH_KINDS) + " FROM sent_pairs")
def q_periph_tokens(spark, sf_dir):
    """Per side, terms not inside the other raw text, then by tag class."""
    p = lex.with_tokens(src.sent_pairs(spark, sf_dir))
    pl, pr = text.periph(F.col("tok_l"), F.col("qr")), text.periph(F.col("tok_r"), F.col("ql"))
    return p.select("qid", *[text.term_text(text.periph_kind(pt, kind)).alias(f"periph_{kind}_{side}")
                             for side, pt in (("l", pl), ("r", pr)) for kind in text.PERIPH_KINDS])


@register("ngrams", O.with_pairs("sent_pairs", _SIDES_SQL, "w AS (SELECT qid, side, " + O.terms("t") + " AS a FROM sides)",
                                 "g AS (SELECT qid, side, 2 AS n, " + O.ngrams("a", 2, "' '") + " AS gs FROM w "
                                 "UNION ALL SELECT qid, side, 3, " + O.ngrams("a", 3, "' '") + " FROM w)") +
          "SELECT qid, side, CAST(n AS INTEGER) AS n, CAST(generate_subscripts(gs, 1) AS INTEGER) AS pos, "
          "unnest(gs) AS gram FROM g")
def q_ngrams(spark, sf_dir):
    """Word 2- and 3-grams of both texts, one row per n-gram."""
    w = _sides(src.sent_pairs(spark, sf_dir)).select("qid", "side", text.terms_of(F.col("t")).alias("a"))
    g = w.select("qid", "side", F.inline(F.array(*[
        F.struct(F.lit(n).alias("n"), sets.ngrams(F.col("a"), n, " ").alias("gs")) for n in (2, 3)])))
    return g.select("qid", "side", F.col("n").cast("int").alias("n"), F.posexplode("gs").alias("p", "gram")) \
            .select("qid", "side", "n", (F.col("p") + 1).cast("int").alias("pos"), "gram")


_PAD = "list_concat(['<s>', '<s>'], {a}, ['</s>', '</s>'])"


@register("ngrams_padded", O.with_pairs("sent_pairs", _SIDES_SQL, "w AS (SELECT qid, side, " + _PAD.format(a=O.terms("t")) +
                                        " AS a FROM sides)",
                                        "g AS (SELECT qid, side, " + O.ngrams("a", 3, "' '") + " AS gs FROM w)") +
          "SELECT qid, side, CAST(generate_subscripts(gs, 1) AS INTEGER) AS pos, unnest(gs) AS gram FROM g")
def q_ngrams_padded(spark, sf_dir):
    """N1 with padding: word 3-grams of both texts with two start and end symbols."""
    w = _sides(src.sent_pairs(spark, sf_dir)).select("qid", "side", sets.ngrams(text.terms_of(F.col("t")), 3, " ",
                                                                                 padding=True).alias("gs"))
    return w.select("qid", "side", F.posexplode("gs").alias("p", "gram")) \
            .select("qid", "side", (F.col("p") + 1).cast("int").alias("pos"), "gram")


# --------------------------------------------------------------------------
# Lexical families (2.3-2.6)
# --------------------------------------------------------------------------

def _lex_query(families, table="sent_pairs"):
    def q(spark, sf_dir):
        return lex.lexical_features(getattr(src, table)(spark, sf_dir), families=families)
    return q


_LEX = O.lex_base("sent_pairs")

register("char_len", _select_sql("sent_pairs", O.length_cols("cl", "cr", "char"), _LEX))(_lex_query(("char_len",)))
register("word_len", _select_sql("sent_pairs", O.length_cols("wl", "wr", "basic_word"), _LEX))(
    _lex_query(("word_len",)))
register("postag_len", _select_sql("sent_pairs", O.length_cols("gl", "gr", "postag"), _LEX))(
    _lex_query(("postag_len",)))
register("periph_len", _select_sql("sent_pairs", [
    c for kind in text.PERIPH_KINDS
    for c in O.length_cols(O.periph_terms("l", kind), O.periph_terms("r", kind), O.PERIPH[kind])]))(
    _lex_query(("periph_len",)))
register("char_ngram", _select_sql("sent_pairs", O.ngram_cols("cl", "cr", "char", (1, 2, 3, 4), "''"), _LEX))(
    _lex_query(("char_ngram",)))
register("word_ngram", _select_sql("sent_pairs", O.ngram_cols("wl", "wr", "basic_word", (1, 2)), _LEX))(
    _lex_query(("word_ngram",)))
register("postag_ngram", _select_sql("sent_pairs", O.ngram_cols("gl", "gr", "postag", (1, 2)), _LEX))(
    _lex_query(("postag_ngram",)))


def _seq_sql(table: str, a: str, b: str, prefix: str) -> str:
    inner, outer = O.seq_cols_staged(a, b, prefix)
    return (O.with_pairs(table, O.lex_base(table),
                         f"m AS (SELECT qid, {', '.join(inner)} FROM lex)") +
            f"SELECT qid, {', '.join(outer)} FROM m")


# DuckDB's dynamic programme is cubic in memory traffic, too slow for sentences of hundreds
# of characters: char_seq on them is held against a plain one in tests/test_sequences.py,
# prefix and suffix against SQL on the whole table, and all six metrics against SQL on
# name_pairs (the whole part table).
register("char_seq")(_lex_query(("char_seq",)))
register("word_seq", _seq_sql("sent_pairs", "wl", "wr", "basic_word"))(_lex_query(("word_seq",)))

# One query per metric, so a failure names its metric.
_METRIC_QUERIES = {
    "lcs_subsequence": ("longest_common_subsequence", O.dp_lcs),
    "lcs_substring": ("longest_common_substring", O.dp_substring),
    "common_prefix": ("longest_common_prefix", O.prefix),
    "common_suffix": ("longest_common_suffix", O.suffix),
    "levenshtein_char": ("levenshtein_distance", O.dp_levenshtein),
    "osa_char": ("damerau_levenshtein_distance", O.dp_osa),
}


def _metric_query(metric: str, prefix: str, family: str, table: str):
    def q(spark, sf_dir):
        f = lex.lexical_features(getattr(src, table)(spark, sf_dir), families=(family,))
        return f.select("qid", f"{prefix}_{metric}_v")
    return q


for _name, (_metric, _fn) in _METRIC_QUERIES.items():
    _table = "sent_pairs" if _name in ("common_prefix", "common_suffix") else "name_pairs"
    register(_name, _select_sql(_table, [f"CAST({_fn('cl', 'cr')} AS INTEGER) AS char_{_metric}_v"], O.lex_base(_table)))(
        _metric_query(_metric, "char", "char_seq", _table))

register("levenshtein_word", _select_sql("sent_pairs", [
    f"CAST({O.dp_levenshtein('wl', 'wr')} AS INTEGER) AS basic_word_levenshtein_distance_v"], _LEX))(
    _metric_query("levenshtein_distance", "basic_word", "word_seq", "sent_pairs"))
register("osa_word", _select_sql("sent_pairs", [
    f"CAST({O.dp_osa('wl', 'wr')} AS INTEGER) AS basic_word_damerau_levenshtein_distance_v"], _LEX))(
    _metric_query("damerau_levenshtein_distance", "basic_word", "word_seq", "sent_pairs"))

# Short ASCII names and long conversation turns exercise the two ends of the length range.
register("char_seq_names", _seq_sql("name_pairs", "cl", "cr", "char"))(_lex_query(("char_seq",), "name_pairs"))
# The DuckDB DP is quadratic in memory traffic on 2,000-character turns, so
# this one is checked against a brute-force DP in tests/test_sequences.py.
register("char_seq_turns")(_lex_query(("char_seq",), "turn_pairs"))
register("word_seq_turns", _seq_sql("turn_pairs", "wl", "wr", "basic_word"))(
    _lex_query(("word_seq",), "turn_pairs"))
register("char_len_turns", _select_sql("turn_pairs", O.length_cols("cl", "cr", "char"), O.lex_base("turn_pairs")))(
    _lex_query(("char_len",), "turn_pairs"))


def _lexical_sql(table: str, with_periph: bool) -> str:
    inner_c, outer_c = O.seq_cols_staged("cl", "cr", "char")
    inner_w, outer_w = O.seq_cols_staged("wl", "wr", "basic_word")
    base_cols = (O.length_cols("cl", "cr", "char") + O.ngram_cols("cl", "cr", "char", (1, 2, 3, 4), "''")
                 + O.length_cols("wl", "wr", "basic_word") + O.ngram_cols("wl", "wr", "basic_word", (1, 2))
                 + O.length_cols("gl", "gr", "postag") + O.ngram_cols("gl", "gr", "postag", (1, 2)))
    names = [c.rsplit(" AS ", 1)[1] for c in base_cols]
    periph = []
    if with_periph:
        periph = [c for kind in text.PERIPH_KINDS for c in
                  O.length_cols(O.periph_terms("l", kind), O.periph_terms("r", kind), O.PERIPH[kind])]
    names += [c.rsplit(" AS ", 1)[1] for c in periph]
    m = f"m AS (SELECT qid, {', '.join(base_cols + periph + inner_c + inner_w)} FROM lex)"
    return O.with_pairs(table, O.lex_base(table), m) + f"SELECT qid, {', '.join(names + outer_c + outer_w)} FROM m"


register("features_lexical")(_lex_query(lex.LEXICAL))
register("features_lexical_periph")(_lex_query(lex.FAMILIES))
register("features_lexical_names", _lexical_sql("name_pairs", False))(_lex_query(lex.LEXICAL, "name_pairs"))
register("features_lexical_periph_names", _lexical_sql("name_pairs", True))(_lex_query(lex.FAMILIES, "name_pairs"))
register("char_ngram_turns", _select_sql("turn_pairs", O.ngram_cols("cl", "cr", "char", (1, 2, 3, 4), "''"), O.lex_base("turn_pairs")))(
    _lex_query(("char_ngram",), "turn_pairs"))


def _extra_query(spark, sf_dir):
    """The two optional length ratios of the character family."""
    f = lex.lexical_features(src.sent_pairs(spark, sf_dir), families=("char_len",), extra_ratios=True)
    return f.select("qid", *lex.length_names(lex.CHAR, True)[-2:])


register("char_len_extra", O.with_pairs("sent_pairs") + "SELECT qid, " + ", ".join(
    f"{O.ratio('abs(length(ql) - length(qr))', f'length({c})')} AS char_{n}" for c, n in zip(("ql", "qr"), lex.LENGTH_EXTRA))
    + " FROM sent_pairs")(_extra_query)


def _repeated(pairs: DataFrame) -> DataFrame:
    """The same pairs with their document's number as id, which repeats."""
    return pairs.withColumn("qid", F.substring_index("qid", "-", 1))


_REPEATED = "rep AS (SELECT split_part(qid, '-', 1) AS qid, ql, qr, label FROM sent_pairs)"


# --------------------------------------------------------------------------
# Vectors and distances (2.7)
# --------------------------------------------------------------------------

def _r6(c):
    return (F.round(c, 6) + F.lit(0.0))


def fitted_vocabulary(spark, sf_dir):
    """G5 over ``documents``, persisted under the checkpoint folder (K1) and reloaded."""
    path = scratch_dir(spark, "vocab")
    vec.fit_vocabulary(src.corpus_texts(spark, sf_dir), persist_to=path)
    return vec.Vocabulary.load(spark, path)


@register("fit_vocab", O.with_pairs("sent_pairs", *O.VOCAB_CTES) +
          f"SELECT term, df, {O.r6('idf')} AS idf FROM vidf")
def q_fit_vocab(spark, sf_dir):
    """G1/G2/G5 fit: document frequency and smoothed idf per term (K1 write, S4 read)."""
    v = fitted_vocabulary(spark, sf_dir)
    return v.table.select("term", "df", _r6(F.col("idf")).alias("idf"))


@register("vocab_stats", O.with_pairs("sent_pairs", *O.VOCAB_CTES) +
          "SELECT (SELECT n FROM nd) AS n_docs, (SELECT count(*) FROM vocab) AS n_terms")
def q_vocab_stats(spark, sf_dir):
    """Corpus statistics stored with the vocabulary."""
    path = scratch_dir(spark, "vocab")
    vec.fit_vocabulary(src.corpus_texts(spark, sf_dir), persist_to=path)
    return spark.read.parquet(f"{path}/stats")


_VEC_ALL = O.vector_ctes("sent_pairs", ("all",))
_VEC_BOTH = O.vector_ctes("sent_pairs", ("all", "notion"))


@register("count_vectors", O.with_pairs("sent_pairs", *_VEC_ALL) +
          "SELECT qid, side, term, CAST(tf AS DOUBLE) AS weight FROM tv JOIN vidf USING (term) WHERE kind = 'all'")
def q_count_vectors(spark, sf_dir):
    """G1 transform: raw term counts per side over the fitted vocabulary."""
    return vec.vocab_vectors_long(src.sent_pairs(spark, sf_dir), fitted_vocabulary(spark, sf_dir), tfidf=False)


@register("tfidf_vectors", O.with_pairs("sent_pairs", *_VEC_ALL,
                                        "tw AS (SELECT qid, side, term, tf * idf AS w FROM tv JOIN vidf USING (term)"
                                        " WHERE kind = 'all')") +
          f"SELECT qid, side, term, {O.r6('w / sqrt(sum(w * w) OVER (PARTITION BY qid, side))')} AS weight FROM tw")
def q_tfidf_vectors(spark, sf_dir):
    """G2 transform: tf * idf, L2-normalised per side."""
    v = vec.vocab_vectors_long(src.sent_pairs(spark, sf_dir), fitted_vocabulary(spark, sf_dir), tfidf=True)
    return v.withColumn("weight", _r6(F.col("weight")))


def _hash_long_sql(order: int) -> str:
    names = [n for n, (o, _) in O.HASHERS.items() if o == order]
    inlist = ", ".join(f"'{n}'" for n in names)
    return (O.with_pairs("sent_pairs", *_VEC_ALL) +
            f"SELECT qid, side, vec AS vectorizer, bucket, {O.r6('vn')} AS value FROM hn "
            f"WHERE kind = 'all' AND vec IN ({inlist}) AND vn <> 0")


@register("hash_vectors", _hash_long_sql(1))
def q_hash_vectors(spark, sf_dir):
    """Signed md5 buckets of unigrams, widths 2**20 and 2**24, L2-normalised."""
    h = vec.hashed_vectors_long(src.sent_pairs(spark, sf_dir), 1)
    return h.withColumn("value", _r6(F.col("value")))


@register("hash2_vectors", _hash_long_sql(2))
def q_hash2_vectors(spark, sf_dir):
    """As G3 over unigrams and bigrams."""
    h = vec.hashed_vectors_long(src.sent_pairs(spark, sf_dir), 2)
    return h.withColumn("value", _r6(F.col("value")))


def _vector_query(kinds, names, prefix_notion: bool = False):
    def q(spark, sf_dir):
        f = vec.vector_features(src.sent_pairs(spark, sf_dir), fitted_vocabulary(spark, sf_dir), kinds)
        cols = [f"notion_{n}" for n in names] if prefix_notion else list(names)
        if kinds == ("all", "notion") and not prefix_notion:
            cols = list(names) + [f"notion_{n}" for n in names]
        return f.select("qid", *[_r6(F.col(c)).alias(c) for c in cols])
    return q


register("vector_distances", O.with_pairs("sent_pairs", *_VEC_ALL) +
         O.vector_select("sent_pairs", {"all": vec.DIST_NAMES}))(_vector_query(("all",), vec.DIST_NAMES))
register("vector_distances_notion", O.with_pairs("sent_pairs", *O.vector_ctes("sent_pairs", ("notion",))) +
         O.vector_select("sent_pairs", {"notion": vec.DIST_NAMES}))(
    _vector_query(("notion",), vec.DIST_NAMES, prefix_notion=True))
register("features_vector", O.with_pairs("sent_pairs", *_VEC_BOTH) +
         O.vector_select("sent_pairs", {"all": vec.DIST_NAMES, "notion": vec.DIST_NAMES}))(
    _vector_query(("all", "notion"), vec.DIST_NAMES))


@register("features_vector_repeated", O.with_pairs("sent_pairs", *_VEC_ALL, "feats AS (" + O.vector_select("sent_pairs", {"all": vec.DIST_NAMES})
          + ")") + f"SELECT split_part(qid, '-', 1) AS qid, {', '.join(vec.DIST_NAMES)} FROM feats")
def q_features_vector_repeated(spark, sf_dir):
    """F4 over pairs whose ids repeat: one row per pair, each with its own values."""
    f = vec.vector_features(_repeated(src.sent_pairs(spark, sf_dir)), fitted_vocabulary(spark, sf_dir), ("all",))
    return f.select("qid", *[_r6(F.col(c)).alias(c) for c in vec.DIST_NAMES])


for _metric, _key in (("PED", "dist_euclid"), ("PCD", "dist_cosine"), ("PMD", "dist_manhattan")):
    _names = [n for n in vec.DIST_NAMES if n.endswith(_metric)]
    register(_key, O.with_pairs("sent_pairs", *_VEC_ALL) + O.vector_select("sent_pairs", {"all": _names}))(
        _vector_query(("all",), _names))


# --------------------------------------------------------------------------
# Machine-translation scores (2.8)
# --------------------------------------------------------------------------

def _mt_query(cols, levels, standard_gleu=False, with_ribes=False, table="sent_pairs", rounded=True):
    def q(spark, sf_dir):
        f = mtf.mt_features(getattr(src, table)(spark, sf_dir), levels=levels, standard_gleu=standard_gleu,
                            with_ribes=with_ribes)
        return f.select("qid", *[(_r6(F.col(c)) if rounded else F.col(c)).alias(c) for c in cols])
    return q


def _mt_sql(exprs: dict[str, str]) -> str:
    return (O.with_pairs("sent_pairs", O.mt_base("sent_pairs")) + "SELECT qid, " +
            ", ".join(f"{O.r6(e)} AS {k}" for k, e in exprs.items()) + " FROM mtb")


register("mt_bleu_char", _mt_sql({"char_bleu_score_l": O.bleu_sql("cl", "cr", "''"),
                                  "char_bleu_score_r": O.bleu_sql("cr", "cl", "''")}))(
    _mt_query(["char_bleu_score_l", "char_bleu_score_r"], ("char",)))
register("mt_bleu_word", _mt_sql({"basic_word_bleu_score_l": O.bleu_sql("wl", "wr", "chr(1)"),
                                  "basic_word_bleu_score_r": O.bleu_sql("wr", "wl", "chr(1)")}))(
    _mt_query(["basic_word_bleu_score_l", "basic_word_bleu_score_r"], ("basic_word",)))
register("mt_gleu_char", _mt_sql({"char_gleu_score_l": O.gleu_chars_sql("cl", "cr"),
                                  "char_gleu_score_r": O.gleu_chars_sql("cr", "cl")}))(
    _mt_query(["char_gleu_score_l", "char_gleu_score_r"], ("char",)))
register("mt_gleu_word", _mt_sql({"basic_word_gleu_score_l": O.gleu_words_sql("wl", "wr"),
                                  "basic_word_gleu_score_r": O.gleu_words_sql("wr", "wl")}))(
    _mt_query(["basic_word_gleu_score_l", "basic_word_gleu_score_r"], ("basic_word",)))
register("mt_gleu_std", _mt_sql({"char_gleu_std_l": O.gleu_std_sql("cl", "cr", "''"),
                                 "char_gleu_std_r": O.gleu_std_sql("cl", "cr", "''"),
                                 "basic_word_gleu_std_l": O.gleu_std_sql("wl", "wr", "chr(1)"),
                                 "basic_word_gleu_std_r": O.gleu_std_sql("wl", "wr", "chr(1)")}))(
    _mt_query(["char_gleu_std_l", "char_gleu_std_r", "basic_word_gleu_std_l", "basic_word_gleu_std_r"],
              ("char", "basic_word"), standard_gleu=True))
# RIBES: alignment search, no SQL twin; checked against goldens and a plain
# reading of the definition in tests/test_mt.py.
register("mt_ribes_char")(_mt_query(["char_ribes_score_l", "char_ribes_score_r"], ("char",), with_ribes=True))
register("mt_ribes_word")(_mt_query(["basic_word_ribes_score_l", "basic_word_ribes_score_r"], ("basic_word",),
                                    with_ribes=True))
register("features_mt")(_mt_query([f"{lv}_{n}" for lv in ("char", "basic_word") for n in mtf.MT_NAMES],
                                  ("char", "basic_word"), with_ribes=True))


# --------------------------------------------------------------------------
# Sentence vectors
# --------------------------------------------------------------------------

def fixture_lexicon(spark, sf_dir) -> sv.Lexicon:
    """Word frequencies over ``documents`` and FIXTURES.md word vectors,
    each written once under the checkpoint folder."""
    base = scratch_dir(spark, "lexicon")
    lexsrc.word_freq(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/freq")
    wf = spark.read.parquet(f"{base}/freq")
    wv = wf.select("term", lexsrc.fixture_vector(F.col("term")).alias("vec"))
    return sv.build_lexicon(wv, wf, persist_to=f"{base}/lexicon")


@register("scan_word_vectors", f"""
WITH t AS (SELECT DISTINCT unnest({O.terms('text')}) AS term FROM documents WHERE text IS NOT NULL)
SELECT term, i::INTEGER AS dim, {O.r6("('0x' || substr(md5(term), i, 1))::INTEGER / 7.5 - 1.0")} AS value
FROM t, (SELECT unnest(range(1, {lexsrc.FIXTURE_DIMS + 1})) AS i)""")
def q_scan_word_vectors(spark, sf_dir):
    """Word vectors written in the word2vec binary format and read back by ranges of bytes."""
    path = scratch_dir(spark, "word2vec")
    w2v.write_word2vec(lexsrc.word_vectors(spark, sf_dir), path)
    v = w2v.read_word2vec(spark, path, range_bytes=1 << 16)
    return v.select("term", F.posexplode("vec").alias("p", "x")).select(
        "term", (F.col("p") + 1).cast("int").alias("dim"), _r6(F.col("x").cast("double")).alias("value"))


@register("sif_weighted_mean", O.SIF_MEAN_SQL)
def q_sif_weighted_mean(spark, sf_dir):
    """I1 step 2: SIF-weighted mean word vector per side, one row per dimension."""
    v = sv.sentence_vectors(src.sent_pairs(spark, sf_dir), fixture_lexicon(spark, sf_dir))
    return v.select("qid", "side", F.posexplode("vec").alias("p", "x")) \
            .select("qid", "side", (F.col("p") + 1).cast("int").alias("dim"), _r6(F.col("x")).alias("value"))


@register("sif_distances")
def q_sif_distances(spark, sf_dir):
    """Distances between the two sides' SIF vectors after removing the
    first singular direction of all sentence vectors (no SQL twin: an
    eigenvector; checked against numpy in tests/test_pipeline.py)."""
    f = sv.sif_features(src.sent_pairs(spark, sf_dir), fixture_lexicon(spark, sf_dir))
    return f.select("qid", *[_r6(F.col(c)).alias(c) for c in sv.SIF_NAMES])


# --------------------------------------------------------------------------
# Model (A1-A6, K3, K4, F5)
# --------------------------------------------------------------------------

@register("train_test_split", O.with_pairs("training_pairs", O.split_ranked("training_pairs")) +
          "SELECT qid, label, is_test FROM split")
def q_train_test_split(spark, sf_dir):
    """A1: reproducible hold-out of exactly ceil(0.1 n) pairs (identical pairs stay together), seed 42."""
    return model.with_split_flag(src.training_pairs(spark, sf_dir)).select("qid", "label", "is_test")


def _rule_predictions(spark, sf_dir):
    """Stand-in predictions for the evaluation jobs: '1' when the two sides
    have the same number of characters (from the char length family)."""
    p = src.training_pairs(spark, sf_dir)
    f = lex.lexical_features(p, families=("char_len",), keep=("qid", "label"))
    return f.select("qid", "label", F.when(F.col("char_len_diff") == 0, "1").otherwise("0").alias("pred"))


@register("micro_f1", O.with_pairs("training_pairs", O.RULE_PRED) +
          f"SELECT {O.r6('avg(CAST(label = pred AS DOUBLE))')} AS micro_f1 FROM rp")
def q_micro_f1(spark, sf_dir):
    """A4 over a prediction table."""
    return model.micro_f1(_rule_predictions(spark, sf_dir)).select(_r6(F.col("micro_f1")).alias("micro_f1"))


@register("classification_report", O.with_pairs("training_pairs", O.RULE_PRED, O.report_sql()) + O.REPORT_SELECT)
def q_classification_report(spark, sf_dir):
    """A5: per-class precision, recall, F1, support, and the weighted average row."""
    r = model.classification_report(_rule_predictions(spark, sf_dir), ["0", "1"])
    return r.select("class", *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def _trained(spark, sf_dir):
    return model.train(src.training_pairs(spark, sf_dir), fitted_vocabulary(spark, sf_dir), fixture_lexicon(spark, sf_dir),
                       save_to=scratch_dir(spark, "svm-model"))


@register("train")
def q_train(spark, sf_dir):
    """Split, features, LinearSVC fit, persist and reload (K3), test predictions."""
    return _trained(spark, sf_dir).test_predictions


@register("train_report")
def q_train_report(spark, sf_dir):
    """A4 + A5 on the trained model's own test predictions."""
    r = _trained(spark, sf_dir)
    return r.report.withColumn("micro_f1", F.lit(float(r.micro_f1)))


@register("coefficients")
def q_coefficients(spark, sf_dir):
    """K4: feature name and weight of the trained classifier."""
    return model.coefficients(spark, _trained(spark, sf_dir))


@register("features_model")
def q_features_model(spark, sf_dir):
    """lexical + bag-of-words distances + sentence vectors, one row per pair."""
    pairs = src.training_pairs(spark, sf_dir)
    return model.model_features(pairs, fitted_vocabulary(spark, sf_dir), fixture_lexicon(spark, sf_dir))


@register("features_model_repeated")
def q_features_model_repeated(spark, sf_dir):
    """F5 over pairs whose ids repeat: as many rows out as in (tests compare the values)."""
    pairs = _repeated(src.training_pairs(spark, sf_dir))
    return model.model_features(pairs, fitted_vocabulary(spark, sf_dir), fixture_lexicon(spark, sf_dir))


# --------------------------------------------------------------------------
# Line scoring: JSON sink and stream
# --------------------------------------------------------------------------

_COUNT_COLS = ["char_len_l", "char_len_r", "char_len_union", "char_len_intersect", "char_len_diff",
               "char_len_l_diff_r", "char_len_r_diff_l"]


def _count_features(pairs, keep):
    return lex.lexical_features(pairs, families=("char_len",), keep=keep).select(*keep, *_COUNT_COLS)


def _pair_lines(spark, sf_dir):
    return src.sent_pairs(spark, sf_dir).select(F.concat_ws("\t", "qid", "ql", "qr", "label").alias("value"))


@register("json_lines", O.with_pairs("sent_pairs", O.lex_base("sent_pairs"),
                                     "jl AS (SELECT qid, ql, qr, " + ", ".join(O.length_cols("cl", "cr", "char")[:7])
                                     + " FROM lex JOIN sent_pairs USING (qid, ql, qr))") +
          "SELECT qid, concat_ws(chr(9), qid, ql, qr, '0') || chr(9) || json_object(" +
          ", ".join(f"'{c}', {c}" for c in _COUNT_COLS) + ") AS value FROM jl")
def q_json_lines(spark, sf_dir):
    """K2: each input line followed by a tab and a JSON object of its features."""
    return score.score_batch(_pair_lines(spark, sf_dir), _count_features)


@register("json_lines_repeated", O.with_pairs("sent_pairs", _REPEATED, O.lex_base("rep"),
                                     "jl AS (SELECT qid, ql, qr, " + ", ".join(O.length_cols("cl", "cr", "char")[:7])
                                     + " FROM lex)") +
          "SELECT qid, concat_ws(chr(9), qid, ql, qr, '0') || chr(9) || json_object(" +
          ", ".join(f"'{c}', {c}" for c in _COUNT_COLS) + ") AS value FROM jl")
def q_json_lines_repeated(spark, sf_dir):
    """K2 over lines whose ids repeat: one line out for each line in."""
    lines = _repeated(src.sent_pairs(spark, sf_dir)).select(F.concat_ws("\t", "qid", "ql", "qr", "label").alias("value"))
    return score.score_batch(lines, _count_features)


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """The pair lines land as files in a folder; a Structured Streaming
    query (available-now trigger) scores every line with all features of the
    model and writes line + JSON per micro-batch; the written lines are returned."""
    base = scratch_dir(spark, "stream")
    _pair_lines(spark, sf_dir).write.mode("overwrite").option("compression", "gzip").text(f"{base}/in")
    lexicon = fixture_lexicon(spark, sf_dir)
    direction = sv.fit_direction(src.sent_pairs(spark, sf_dir), lexicon)
    sv.save_direction(spark, direction, f"{base}/direction")
    features = score.model_json(fitted_vocabulary(spark, sf_dir), lexicon, sv.load_direction(spark, f"{base}/direction"))
    q = score.start_scoring_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", features)
    q.awaitTermination()
    return score.read_scored(spark, f"{base}/out")


@register("stream_lines", SQL["json_lines"])
def q_stream_lines(spark, sf_dir):
    """W1 with the count features of ``json_lines``: the stream writes what the batch job returns."""
    base = scratch_dir(spark, "stream")
    _pair_lines(spark, sf_dir).write.mode("overwrite").option("compression", "gzip").text(f"{base}/in")
    score.start_scoring_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", _count_features).awaitTermination()
    t = score.read_scored(spark, f"{base}/out")
    return t.select("qid", F.concat_ws("\t", "line", "features").alias("value"))


_LEX_TAGS = ["n", "v", "a", "d", "nz", "x"]


@register("tokenize_lexicon", O.with_pairs("sent_pairs", _SIDES_SQL,
          f"tk AS (SELECT qid, side, CAST(generate_subscripts({O.terms('t')}, 1) AS INTEGER) AS pos, unnest({O.terms('t')}) AS term FROM sides)") +
          f"""SELECT qid, side, pos, term, CASE WHEN substr(md5(term), 1, 1) < 'c'
            THEN {_LEX_TAGS!r}[CAST('0x' || substr(md5(term), 2, 1) AS INTEGER) % {len(_LEX_TAGS)} + 1] ELSE {O.tag('term')} END AS postag FROM tk""")
def q_tokenize_lexicon(spark, sf_dir):
    """P5 (lexicon form): tags looked up in a (term, postag) table by a join; a term that the
    table lacks keeps the rule's tag. The stand-in table holds about three terms in four of
    ``documents``, under tags that have nothing to do with the rule."""
    docs = src.corpus_texts(spark, sf_dir)
    base = scratch_dir(spark, "tag-lexicon")
    h = F.md5("term")
    tag = F.element_at(F.array(*[F.lit(t) for t in _LEX_TAGS]), (F.conv(F.substring(h, 2, 1), 16, 10).cast("int") % len(_LEX_TAGS)) + 1)
    (docs.select(F.explode(text.terms_of(F.col("text"))).alias("term")).distinct()
     .filter(F.substring(h, 1, 1) < "c").select("term", tag.alias("postag"))
     .write.mode("overwrite").parquet(base))
    lexicon = spark.read.parquet(base)
    t = tagging.tokens_from_lexicon(src.sent_pairs(spark, sf_dir), lexicon, lexicon.count())
    sides = t.select("qid", F.inline(F.array(F.struct(F.lit("l").alias("side"), F.col("tok_l").alias("tok")),
                                             F.struct(F.lit("r").alias("side"), F.col("tok_r").alias("tok")))))
    return (sides.select("qid", "side", F.posexplode("tok").alias("p", "t"))
            .select("qid", "side", (F.col("p") + 1).cast("int").alias("pos"), "t.term", "t.postag"))


@register("tokenize_lattice")
def q_tokenize_lattice(spark, sf_dir):
    """P5 for text without spaces: a lattice model of ``documents`` cuts and tags both texts of every sentence pair, their
    blanks taken out (no SQL twin: two Viterbi passes; tests hold them against all paths and all tag sequences)."""
    model_ = lattice.fit(src.corpus_texts(spark, sf_dir).select(text.tokens(F.col("text")).alias("tok")))
    bare = src.sent_pairs(spark, sf_dir).withColumns({c: F.regexp_replace(c, " +", "") for c in ("ql", "qr")})
    t = lattice.tokens_from_lattice(bare, model_)
    sides = t.select("qid", F.inline(F.array(F.struct(F.lit("l").alias("side"), F.col("tok_l").alias("tok")),
                                             F.struct(F.lit("r").alias("side"), F.col("tok_r").alias("tok")))))
    return (sides.select("qid", "side", F.posexplode("tok").alias("p", "t"))
            .select("qid", "side", (F.col("p") + 1).cast("int").alias("pos"), "t.term", "t.postag"))


@register("features_all")
def q_features_all(spark, sf_dir):
    """The 176 catalogue columns of every sentence pair in one projection (tests hold them against the family queries)."""
    return catalogue.all_features(src.sent_pairs(spark, sf_dir), fitted_vocabulary(spark, sf_dir))
