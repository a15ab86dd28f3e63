"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates per row (built-in expressions, no shuffle). Each
candidate's value is hashed, and the whole corpus counts how many owners and
repositories hold that hash: a value that many owners hold is a copied example,
one that stays with ``MAX_OWNERS`` owner(s) and looks random is taken as live, in
however many repositories (copies of one document, say) its owner holds it.

Counting pre-aggregates in three steps (value, owner, repository), (value,
owner), (value), each with a map-side combine, so a value that a third of all
rows share costs one row per task and key. Rows are joined back on a private
key made from their content: equal rows share a key and a result.

Defined results: null or empty text has no candidate; null owners (repositories)
count as one owner (repository) of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.llm.native import count_kind, joined, of_kind, spans, whole
from pairfeat.session import scratch_dir

KINDS = ["assign", "access", "hex", "pem", "jwt", "forge", "chat"]
BASE_KINDS = KINDS[:3]

# The base patterns, then those of the method.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
PEM = r"-----BEGIN [A-Z0-9 ]{0,32}PRIVATE KEY-----"
# The header with its key: all up to the END line or, without one, the lines of base64 that follow.
_BREAK = r"(?:[\x20\x09-\x0D]|\\[nrt])"
PEM_END = r"-----END [A-Z0-9 ]{0,32}PRIVATE KEY-----"
PEM_KEY = (rf"{PEM}(?:(?:[^-]++|-(?!----))*+{PEM_END}"
           rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+=*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]++=++)?+)")
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
FORGE = r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{30,}+"
CHAT = r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"

MAX_OWNERS = 1
#: Distinct characters a value needs to look random.
LEAST_VARIETY = 8


def _assigned(m: Column) -> Column:
    return F.regexp_replace(m, ASSIGN_HEAD, "")


def _key(m: Column) -> Column:
    """The key however its lines are broken, with or without its END line."""
    return F.regexp_replace(m, rf"{_BREAK}++|{PEM_END}", "")


def find(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: candidates as (start, rank, kind, end, hash, random), by start, then kind as listed."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    t = whole(F.col(text_col))
    raw = [
        spans(t, ASSIGN, keep=lambda m: F.length(_assigned(m)) >= 12, value=_assigned),
        spans(t, ACCESS, t.contains("AKIA"), lambda m: F.length(m) >= 18),
        spans(t, HEX),
        spans(t, PEM_KEY, t.contains("-----BEGIN"), value=_key),
        spans(t, JWT, t.contains("eyJ")),
        spans(t, FORGE, t.contains("gh")),
        spans(t, CHAT, t.contains("xox")),
    ]
    staged = kept.withColumns({f"_{k}": of_kind(s, r, k) for r, (k, s) in enumerate(zip(KINDS, raw))})
    merged = F.transform(F.concat(*[F.col(f"_{k}") for k in KINDS]), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.sha2(s["value"], 256).alias("hash"),
        ((s["kind"] == "pem") | (F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_VARIETY)).alias("random")))
    return staged.withColumn(out, F.sort_array(merged)).drop(*[f"_{k}" for k in KINDS])


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, owner, repository`` rows -> ``hash, n_owners, n_repositories`` over the whole corpus."""
    by_repo = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repositories"))


def scan(docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", text_col: str = "text",
         id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols``, ``secrets``, n_live and n_shared per row of ``docs``.

    The scan of the texts runs once: its spans (not the texts) are written to
    the shared folder, and both the counting and the join read them there.
    """
    spark = docs.sparkSession
    key = F.xxhash64(*[F.col(c) for c in id_cols], F.col(owner_col), F.col(text_col))
    path = scratch_dir(spark, "secrets")
    find(docs.withColumns({"_key": key, "_owner": F.col(owner_col), "_repository": F.col(repository_col)}), text_col).select(
        *id_cols, "_key", F.col("_owner").cast("string").alias("_owner"),
        F.col("_repository").cast("string").alias("_repository"), "secrets").write.parquet(path)
    rows = spark.read.parquet(path)
    held = rows.select("_key", "_owner", "_repository", F.explode("secrets").alias("s")).select(
        "_key", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"), F.col("s.hash").alias("hash"),
        F.col("s.random").alias("random"), F.col("s.start").alias("start"), F.col("s.rank").alias("rank"))
    counts = ownership(held)
    live = F.col("random") & (F.col("n_owners") <= MAX_OWNERS)
    # Equal rows share a key, so their spans meet once.
    verdicts = (held.select("_key", "hash", "random", "start", "rank").distinct().join(counts, "hash")
                .groupBy("_key").agg(F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_shared")))
    return rows.join(verdicts, "_key", "left").select(
        *id_cols, "secrets", F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs)
    base = F.filter("secrets", lambda s: s["kind"].isin(BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_kind("secrets", k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), "n_live", "n_shared")


def _sql() -> str:
    head = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
    plain = {
        "assign": head + r"[A-Za-z0-9+/_.=-]+", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
        "pem": rf"{PEM}(?:(?:-{{0,4}}[^-])*{PEM_END}"
               rf"|(?:{_BREAK}*(?:Proc-Type|DEK-Info):[^\n]*)*(?:{_BREAK}*[A-Za-z0-9+/]{{16,}}=*)*(?:{_BREAK}*[A-Za-z0-9+/]+=+)?)",
        # One after a hyphen is matched as well, to be dropped.
        "jwt": r"-eyJ[A-Za-z0-9_-]*|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        "forge": r"\bgh[pousr]_[A-Za-z0-9]{30,}", "chat": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    }
    value = {k: "m" for k in KINDS} | {"assign": f"regexp_replace(m, '^{head}', '')",
                                       "pem": f"regexp_replace(m, '{_BREAK}+|{PEM_END}', '', 'g')"}
    # A word boundary is one of letters and digits there.
    text = {k: "t" for k in KINDS} | {"chat": "translate(t, '_', '~')"}
    ok = {k: "true" for k in KINDS} | {
        "assign": f"length({value['assign']}) >= 12", "access": "length(m) >= 18", "hex": "length(m) >= 16", "jwt": "NOT starts_with(m, '-')"}
    union = "\nUNION ALL".join(rf"""
SELECT rid, doc_id, source, {r} r, '{k}' kind, s, s + length(m) e, {value[k]} v
FROM (SELECT rid, doc_id, source, ms[k] m, (coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0))::BIGINT s
      FROM (SELECT rid, doc_id, source, ms, gs, unnest(range(1, len(ms) + 1)) k FROM (
            SELECT rid, doc_id, source, regexp_extract_all({text[k]}, '{plain[k]}') ms, regexp_split_to_array({text[k]}, '{plain[k]}') gs FROM d
            WHERE regexp_matches({text[k]}, '{plain[k].replace("[0-9a-f]+", "[0-9a-f]{16}")}'))))
WHERE {ok[k]}""" for r, k in enumerate(KINDS))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k in BASE_KINDS)
    return rf"""
WITH d AS (SELECT doc_id, source, row_number() OVER () rid, coalesce(text, '') t FROM documents),
f AS MATERIALIZED ({union}),
o AS (SELECT v, count(DISTINCT coalesce('s' || source, '')) n_owners FROM f GROUP BY v),
j AS (SELECT f.*, (kind = 'pem' OR len(list_distinct(string_split(f.v, ''))) >= {LEAST_VARIETY})
        AND n_owners <= {MAX_OWNERS} live FROM f JOIN o USING (v)),
g AS (SELECT rid, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) spans,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < 3) base,
        count(*) FILTER (live) n_live, count(*) FILTER (NOT live) n_shared FROM j GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) base_sha256,
       coalesce(spans, '') spans, coalesce(n_live, 0)::BIGINT n_live, coalesce(n_shared, 0)::BIGINT n_shared
FROM d LEFT JOIN g USING (rid)
"""


SQL = {"op9_secrets": _sql()}
QUERIES = {"op9_secrets": op9_secrets}
