"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

All of it is built-in expressions over one row: a scan and a projection.

Kinds, in listed order: email, ip, card (Luhn), phone, then the added iban
(mod-97) and ssn (accepted only with a context word before it). A span's score
starts from its pattern's strength, rises with a passed checksum and with a
context word in the ``CONTEXT`` characters before it. The first four kinds are
kept whatever their score; the added ones need ``LEAST_SCORE``.

Defined results: a null text has no span; empty text likewise; repeated rows
give equal results; an empty table gives an empty one; other columns pass
through ``find`` unless they are called ``pii`` (or an underscore and a kind), and
through ``redact`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.llm.native import before_each, between, blocks, count_kind, digits, joined, let, luhn, mod97, sliced, spans, whole

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]

# The base patterns. Possessive forms of the stated ones; the look-behind lets a
# search start only where a run of name characters (digits) starts or the last match ended,
# which is where the leftmost match begins, and keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Characters of an IBAN by country: the match ends there, whatever word follows. Other letters take what fits.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
_KNOWN_IBAN = "(?:{})(?![A-Za-z0-9])".format("|".join(
    rf"(?:{'|'.join(cs.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, cs in IBAN_LENGTHS.items()))
IBAN = (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_KNOWN_IBAN}"
        rf"|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_KNOWN_IBAN})\x20?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Characters before a span in which a context word counts.
CONTEXT = 48
LEAST_SCORE = 0.6

# Fixed values: (pattern strength, gain for a checksum, context words).
SCORES = {
    "email": (0.9, 0.0, "mail|contact|write to"),
    "ip": (0.6, 0.0, "ip|host|server|address|login"),
    "card": (0.5, 0.3, "card|visa|master|credit|debit|pay|karte|carte|tarjeta"),
    "phone": (0.6, 0.0, "phone|tel|call|mobile|fax|whatsapp"),
    "iban": (0.4, 0.4, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (0.4, 0.0, "ssn|social security|tax id"),
}


def _ip_ok(m: Column) -> Column:
    # Leading zeros do not count; a part of over three digits is over 255.
    return ~F.exists(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3)
                     | (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) > 255))


def _card_ok(m: Column) -> Column:
    d = digits(m)
    return (F.length(d) <= 19) & luhn(d)


def _phone_ok(m: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def _iban_ok(m: Column) -> Column:
    return mod97(F.replace(m, F.lit(" "), F.lit("")))


def _scored(kind: str, found: Column) -> Column:
    strength, checksum, words = SCORES[kind]

    def one(s: Column) -> Column:
        near = s["before"].rlike(rf"(?i)(?<![a-z])(?:{words})")
        score = F.round(F.lit(strength + checksum) + F.when(near, F.lit(0.2)).otherwise(F.lit(0.0)), 2)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        F.least(score, F.lit(1.0)).alias("score"))

    scored = F.transform(found, one)
    return scored if kind in BASE_KINDS else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)


def find(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: spans as (kind, start, end, score), by kind in listed order, then start."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    t = whole(F.col(text_col))
    two_digits = t.rlike("[0-9]{2}")
    raw = {
        "email": spans(t, EMAIL, t.contains("@"), context=CONTEXT),
        "ip": spans(t, IP, t.rlike(r"[0-9]\.[0-9]"), _ip_ok, context=CONTEXT),
        "card": spans(t, CARD, t.rlike("[0-9][ -]?[0-9]"), _card_ok, context=CONTEXT),
        "phone": spans(t, PHONE, t.contains("+"), _phone_ok, context=CONTEXT),
        "iban": spans(t, IBAN, two_digits, _iban_ok, context=CONTEXT),
        "ssn": spans(t, SSN, two_digits, context=CONTEXT),
    }
    staged = kept.withColumns({f"_{k}": v for k, v in raw.items()})
    return staged.withColumn(out, F.concat(*[_scored(k, F.col(f"_{k}")) for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every span of ``find`` replaced by its kind in angle brackets, e.g. ``<EMAIL>``.

    Spans of different kinds may overlap: the one that starts first names the
    placeholder and the rest of the overlap goes with it. Null text stays null.
    """
    # The row's own columns travel as one, so none of them can clash with a working column.
    row = docs.select(F.struct("*").alias("_doc"), F.col(f"`{text_col}`").alias("_t"))
    staged = find(row, "_t", out="_pii").withColumn(
        "_pii", F.sort_array(F.transform("_pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    t = F.col("_t")

    def fresh(part: Column, pos: Column) -> Column:
        """Spans of a slice that begin at or after all ends before them, each with the place where its gap begins."""
        def step(acc: Column, s: Column) -> Column:
            one = F.array(F.struct(acc["pos"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                            F.when(s["start"] >= acc["pos"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        none = F.array().cast("array<struct<from:int,start:int,kind:string>>")
        return F.aggregate(part, F.struct(pos.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])

    def replaced(v: Column) -> Column:
        ends = F.transform(v["parts"], lambda part: F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), F.lit(0)))
        starts = before_each(ends, F.lit(0), lambda now, x: F.greatest(now, x), "int")
        pieces = let(starts, lambda ps: F.flatten(F.transform(v["parts"], lambda part, k: F.transform(
            fresh(part, F.get(ps, k)), lambda s: F.concat(between(v["blocks"], s["from"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))))))
        last = F.array_max(ends)
        return F.concat(F.array_join(pieces, ""), between(v["blocks"], last, F.length(t)))

    cut = let(F.struct(sliced(F.col("_pii")).alias("parts"), blocks(t).alias("blocks")), replaced)
    done = staged.select("_doc", F.when(F.size("_pii") > 0, cut).otherwise(t).alias("_t"))
    return done.select(*[F.col("_t").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_kind("pii", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)), 2).alias("top_score"))


def _sql() -> str:
    """One relation of (rid, kind rank, kind, start, end, score) per pattern."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": PHONE,
        "iban": r"\b(?:{})\b".format("|".join(rf"(?:{'|'.join(cs.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, cs in IBAN_LENGTHS.items())),
        "ssn": r"[0-9-]+",
    }
    # Codes of other letters, between those of known countries.
    other_iban = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"
    # A word boundary is one of letters and digits there.
    text = {k: "t" for k in KINDS} | {"iban": "translate(t, '_', '~')"}
    d = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = (f"list_sum(list_transform(range(length({d})), lambda k: CASE WHEN k % 2 = 0 THEN substr({d}, (length({d}) - k)::INT, 1)::INT "
                f"ELSE [0,2,4,6,8,1,3,5,7,9][substr({d}, (length({d}) - k)::INT, 1)::INT + 1] END))")
    ok = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE coalesce(try_cast(p AS INT), 999) END)) <= 255",
        "card": f"length({d}) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"length({d}) BETWEEN 9 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: (CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::INT)), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1",
        "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
    }

    def cut(source: str, pattern: str, gaps: bool = False) -> str:
        """(rid, t, m, s): matches in pieces (x, from o on) of a relation, or what lies between them."""
        ms, gs = ("gs", "ms") if gaps else ("ms", "gs")
        before = f"gs[1:k{'-1' if gaps else ''}]", "ms[1:k-1]"
        return rf"""
SELECT rid, t, {ms}[k] m, (o + coalesce(list_sum(list_transform({before[0]}, lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform({before[1]}, lambda x: length(x))), 0))::BIGINT s
      FROM (SELECT rid, t, o, ms, gs, unnest(range(1, len({ms}) + 1)) k FROM (
            SELECT rid, t, o, regexp_extract_all(x, '{pattern}') ms, regexp_split_to_array(x, '{pattern}') gs FROM ({source})))"""

    source = {k: f"SELECT rid, t, {text[k]} x, 0 o FROM d" for k in KINDS}
    found = {k: cut(source[k], plain[k]) for k in KINDS}
    between = cut(source["iban"], plain["iban"], gaps=True)
    found["iban"] += "\nUNION ALL " + cut(f"SELECT rid, t, m x, s o FROM ({between})", other_iban)
    parts = []
    for rank, k in enumerate(KINDS):
        strength, checksum, words = SCORES[k]
        parts.append(rf"""
SELECT rid, {rank} r, '{k}' kind, s, s + length(m) e, least(1.0, round({strength + checksum} + CASE WHEN regexp_matches(
    substr(t, (greatest(s - {CONTEXT}, 0) + 1)::BIGINT, least(s, {CONTEXT})::BIGINT), '(?i)(^|[^a-z])(?:{words})') THEN 0.2 ELSE 0 END, 2)) score
FROM ({found[k]})
WHERE {ok[k]}""")
    union = "\nUNION ALL".join(parts)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0)::BIGINT n_{k}" for k in KINDS)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () rid, coalesce(text, '') t FROM documents),
f AS (SELECT * FROM ({union}) WHERE r < 4 OR score >= {LEAST_SCORE}),
g AS (SELECT rid, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY r, s) spans,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY r, s) FILTER (r < 4) base, max(score)::DOUBLE top FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) base_sha256,
       coalesce(spans, '') spans, coalesce(top, 0.0)::DOUBLE top_score
FROM d LEFT JOIN g USING (rid)
"""


SQL = {"op8_pii": _sql()}
QUERIES = {"op8_pii": op8_pii}
