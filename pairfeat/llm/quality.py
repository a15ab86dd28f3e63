"""Quality rules: one threshold table compiled into one projection.

Every measure is a built-in column expression over the whole text, so the job
is a scan and a projection: no shuffle, no user function.

Defined results: a null or blank text has no word, every measure 0 and fails
the base rule; equal rows get equal results; an empty table gives an empty one;
other columns pass through ``measure`` and ``judge`` untouched unless they carry
the name of a measure or of a verdict (``base_failed``, ``failed_rules``, ``kept``),
which then replaces them; ``filter_documents`` returns all of them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.llm.native import blank_words, whole, without_blanks

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "this", "was", "are", "on", "be",
           "by", "as", "at", "from", "or"],
    "fr": ["le", "la", "de", "et", "les", "des", "que", "un", "une", "en", "du", "dans", "qui", "est", "pour",
           "pas", "sur", "au", "par", "il"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem",
           "nicht", "ein", "eine", "als", "auch", "es"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una",
           "su", "para", "es", "al"],
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws})

#: Words in a window when repeated passages of a text are counted.
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "dup_line_chars"]


@dataclass(frozen=True)
class Rule:
    """Reject where ``a * measure`` leaves [``lo * per``, ``hi * per``]; integers keep every engine's verdict the same.

    The rule holds only for texts of at least ``least_words`` words, and where ``only_if``, if given, fails too.
    """

    name: str
    measure: str
    per: str
    a: int
    lo: int | None = None
    hi: int | None = None
    least_words: int = 1
    only_if: Rule | None = None

    def fails(self) -> Column:
        value, per = F.col(self.measure) * self.a, F.col(self.per)
        bad = F.lit(False)
        if self.lo is not None:
            bad = bad | (value < per * self.lo)
        if self.hi is not None:
            bad = bad | (value > per * self.hi)
        bad = (F.col("n_words") >= self.least_words) & bad
        return bad & self.only_if.fails() if self.only_if else bad


#: The threshold table: word length, symbols per character, stop-word share, repeated lines. The last rejects only where
#: repeated lines are over a fifth of the text's characters as well, so a short title or separator that comes again between
#: long paragraphs does not.
RULES = [
    Rule("word_length", "word_chars", "n_words", 1, lo=2, hi=14),
    Rule("symbols", "n_symbols", "word_chars", 100, hi=5),
    Rule("stop_words", "n_stop_words", "n_words", 100, lo=3, least_words=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", 100, hi=30, only_if=Rule("dup_line_chars", "dup_line_chars", "word_chars", 100, hi=20)),
]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures as long columns."""
    # The row's own columns travel as one, so none of them can clash with a working column.
    row = docs.select(F.struct("*").alias("_doc"), whole(F.col(f"`{text_col}`")).alias("_t"))
    t = F.col("_t")
    staged = row.withColumn("_w", blank_words(t))
    n = F.size("_w")
    staged = staged.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(without_blanks(t)).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(ALL_STOP_WORDS))).cast("long"),
        "_l": F.filter(F.split(t, "\n", -1), lambda line: F.length(without_blanks(line)) > 0),
        "_h": F.when(n > WINDOW, F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WINDOW)]))),
    })
    lines, distinct = F.col("_l"), F.array_distinct("_l")
    staged = staged.withColumns({
        "dup_line_chars": F.when(F.size(distinct) < F.size(lines), F.length(without_blanks(F.array_join(lines, "")))
                                 - F.length(without_blanks(F.array_join(distinct, "")))).otherwise(F.lit(0)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        # Few texts repeat a window; only they sort theirs, with places, to find which.
        "_s": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
            F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    same = lambda x, k: x["h"] == F.get(F.col("_s"), k)["h"]
    staged = staged.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(
        F.filter("_s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))),
        lambda x: x["i"]))))
    # Words covered by the union of the repeated windows.
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    staged = staged.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return staged.select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c not in MEASURES], *MEASURES)


def judge(measured: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add base_failed, failed_rules (names, comma-joined) and kept."""
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = F.concat_ws(",", *[F.when(r.fails(), F.lit(r.name)) for r in rules])
    return (measured.withColumn("base_failed", base).withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with exactly their columns."""
    row = docs.select(F.struct("*").alias("_doc"), F.col("`text`").alias("_text"))   # its columns may have a measure's name
    # The row number (never negative) keeps the filter above the measures: pushed below, it would hold a copy of each of them.
    measured = measure(row, "_text").withColumn("_row", F.monotonically_increasing_id())
    return judge(measured).filter("kept AND _row >= 0").select("_doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(measure(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                       "base_failed", "kept", "n_lines", "n_stop_words", "dup_line_chars", "failed_rules")


def _rule_sql(r: Rule) -> str:
    tests = ([f"{r.measure} * {r.a} < {r.per} * {r.lo}"] if r.lo is not None else []) + (
        [f"{r.measure} * {r.a} > {r.per} * {r.hi}"] if r.hi is not None else [])
    return f"n_words >= {r.least_words} AND ({' OR '.join(tests)})" + (f" AND {_rule_sql(r.only_if)}" if r.only_if else "")


def _rules_sql() -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{r.name}' END" for r in RULES) + ")"


SQL = {"op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () rid, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i FROM w)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) c
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) nxt FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(c, 0)::BIGINT n_repeat_words,
        len(ls)::BIGINT n_lines,
        len(list_filter(ws, lambda x: list_contains({ALL_STOP_WORDS!r}, lower(x))))::BIGINT n_stop_words,
        (length(regexp_replace(array_to_string(ls, ''), '[\x20\x09-\x0D]+', '', 'g'))
         - length(regexp_replace(array_to_string(list_distinct(ls), ''), '[\x20\x09-\x0D]+', '', 'g')))::BIGINT dup_line_chars
      FROM w LEFT JOIN cov USING (rid)),
j AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) base_failed, {_rules_sql()} failed_rules FROM m)
SELECT *, (NOT base_failed AND failed_rules = '') kept FROM j
"""}

QUERIES = {"op5_quality_rules": op5_quality_rules}
