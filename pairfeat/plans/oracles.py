"""DuckDB reference SQL for the correctness gate.

Each registered query has, where SQL can state it, an independent formulation
here: multisets by counting, sequence metrics by the textbook dynamic
programme (``list_reduce`` carrying DP rows), vectors by ``unnest`` + ``group
by``. The views ``documents``, ``part``, ``conversations`` ... are registered by
the caller.
"""

from __future__ import annotations

from pairfeat.operators.lexical import LENGTH_NAMES, SEQ_METRICS
from pairfeat.operators.murmur import ADD, C1, C2, MIX1, MIX2
from pairfeat.operators.vectors import HASHERS

# --------------------------------------------------------------------------
# Derived pair tables (FIXTURES.md section 2), as CTE bodies.
# --------------------------------------------------------------------------

_SENT_BASE = """
sp_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
sp_pieces AS (
  SELECT doc_id, i, unnest(string_split(t, '. ')) AS u, generate_subscripts(string_split(t, '. '), 1) AS j
  FROM sp_lines),
sp_f AS (
  SELECT doc_id, u AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k
  FROM sp_pieces WHERE length(u) > 0)"""

PAIR_CTES = {
    "sent_pairs": _SENT_BASE + """,
sent_pairs AS (
  SELECT CAST(a.doc_id AS VARCHAR) || '-' || CAST(a.k AS VARCHAR) AS qid, a.t AS ql, b.t AS qr, '0' AS label
  FROM sp_f a JOIN sp_f b ON a.doc_id = b.doc_id AND b.k = a.k + 1)""",
    "rotated_pairs": _SENT_BASE + """,
rotated_pairs AS (
  SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) || 'r' AS qid, t AS ql,
         array_to_string(list_concat(string_split(t, ' ')[2:], string_split(t, ' ')[1:1]), ' ') AS qr,
         '1' AS label
  FROM sp_f WHERE len(string_split(t, ' ')) > 1)""",
    "name_pairs": """
name_pairs AS (
  SELECT CAST(a.p_partkey AS VARCHAR) || '-' || CAST(b.p_partkey AS VARCHAR) AS qid, a.p_name AS ql,
         b.p_name AS qr,
         CAST(CAST(split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AS INTEGER) AS VARCHAR) AS label
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)""",
    "turn_pairs": """
turn_pairs AS (
  SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS qid, a.text AS ql, b.text AS qr,
         CAST(NULL AS VARCHAR) AS label
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
}
_ROTATED_ONLY = """
rotated_pairs AS (
  SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) || 'r' AS qid, t AS ql,
         array_to_string(list_concat(string_split(t, ' ')[2:], string_split(t, ' ')[1:1]), ' ') AS qr,
         '1' AS label
  FROM sp_f WHERE len(string_split(t, ' ')) > 1)"""
PAIR_CTES["rotated_pairs"] = _SENT_BASE + "," + _ROTATED_ONLY
PAIR_CTES["training_pairs"] = (PAIR_CTES["sent_pairs"] + "," + _ROTATED_ONLY + """,
training_pairs AS (SELECT * FROM sent_pairs UNION ALL SELECT * FROM rotated_pairs)""")


def with_pairs(table: str, *ctes: str) -> str:
    body = ",\n".join([PAIR_CTES[table].strip(), *[c.strip() for c in ctes]])
    return f"WITH {body}\n"


# --------------------------------------------------------------------------
# Expression templates
# --------------------------------------------------------------------------

def chars(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, '') END)"


def terms(s: str) -> str:
    return f"regexp_extract_all({s}, '[\\p{{L}}\\p{{N}}_]+')"


def tag(t: str) -> str:
    return (f"(CASE WHEN ends_with({t}, 'tion') THEN 'n' WHEN ends_with({t}, 'th') THEN 'nz' "
            f"WHEN ends_with({t}, 'ing') THEN 'v' WHEN ends_with({t}, 'ble') THEN 'a' "
            f"WHEN ends_with({t}, 'ly') THEN 'd' ELSE 'x' END)")


def tags(s: str) -> str:
    return f"list_transform({terms(s)}, lambda t: {tag('t')})"


def ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0.0)"


def multiset_inter(a: str, b: str) -> str:
    return (f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least("
            f"len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)")



def length_cols(a: str, b: str, p: str) -> list[str]:
    l, r, i = f"len({a})", f"len({b})", multiset_inter(a, b)
    return [f"CAST({l} AS INTEGER) AS {p}_len_l", f"CAST({r} AS INTEGER) AS {p}_len_r",
            f"CAST({l} + {r} - {i} AS INTEGER) AS {p}_len_union", f"CAST({i} AS INTEGER) AS {p}_len_intersect",
            f"CAST(abs({l} - {r}) AS INTEGER) AS {p}_len_diff",
            f"CAST({l} - {i} AS INTEGER) AS {p}_len_l_diff_r", f"CAST({r} - {i} AS INTEGER) AS {p}_len_r_diff_l",
            f"{ratio(f'{l} - {i}', r)} AS {p}_len_l_diff_r_ratio",
            f"{ratio(f'{r} - {i}', l)} AS {p}_len_r_diff_l_ratio"]


def ngrams(a: str, n: int, sep: str = "chr(1)") -> str:
    if n == 1:
        return a
    return (f"(CASE WHEN len({a}) < {n} THEN []::VARCHAR[] ELSE list_transform(generate_series(1, len({a}) - {n - 1}),"
            f" lambda i: array_to_string({a}[i:i + {n - 1}], {sep})) END)")


def ngram_cols(a: str, b: str, p: str, ns, sep: str = "chr(1)") -> list[str]:
    out = []
    for n in ns:
        ga, gb = ngrams(a, n, sep), ngrams(b, n, sep)
        dl, dr, i = f"len(list_distinct({ga}))", f"len(list_distinct({gb}))", f"len(list_intersect({ga}, {gb}))"
        out += [f"{ratio(i, f'{dl} + {dr} - {i}')} AS {p}_{n}gram_jaccard",
                f"{ratio(f'2 * {i}', f'{dl} + {dr}')} AS {p}_{n}gram_dice",
                f"(CASE WHEN {dl} = 0 OR {dr} = 0 THEN 0.0 ELSE {ratio(i, f'least({dl}, {dr})')} END)"
                f" AS {p}_{n}gram_overlap"]
    return out


# Dynamic programmes over two lists, one DP row per item of the left list.
def dp_lcs(a: str, b: str) -> str:
    return (f"list_reduce(generate_series(1, len({a})), lambda prev, i: list_reduce(generate_series(1, len({b})),"
            f" lambda row, j: list_append(row, CASE WHEN {a}[i] = {b}[j] THEN prev[j] + 1"
            f" ELSE greatest(prev[j + 1], row[-1]) END), [0]), list_transform(generate_series(0, len({b})),"
            f" lambda x: 0))[-1]")


def dp_substring(a: str, b: str) -> str:
    return (f"list_reduce(generate_series(1, len({a})), lambda s, i: list_reduce(generate_series(1, len({b})),"
            f" lambda t, j: {{'row': list_append(t.row, CASE WHEN {a}[i] = {b}[j] THEN s.row[j] + 1 ELSE 0 END),"
            f" 'best': greatest(t.best, CASE WHEN {a}[i] = {b}[j] THEN s.row[j] + 1 ELSE 0 END)}},"
            f" {{'row': [0], 'best': s.best}}), {{'row': list_transform(generate_series(0, len({b})),"
            f" lambda x: 0), 'best': 0}}).best")


def dp_levenshtein(a: str, b: str) -> str:
    return (f"list_reduce(generate_series(1, len({a})), lambda prev, i: list_reduce(generate_series(1, len({b})),"
            f" lambda row, j: list_append(row, least(row[-1] + 1, prev[j + 1] + 1,"
            f" prev[j] + CAST({a}[i] <> {b}[j] AS INTEGER))), [i]), generate_series(0, len({b})))[-1]")


def dp_osa(a: str, b: str) -> str:
    cost = f"CAST({a}[i] <> {b}[j] AS INTEGER)"
    cell = (f"least(row[-1] + 1, s.p[j + 1] + 1, s.p[j] + {cost}, CASE WHEN i > 1 AND j > 1"
            f" AND {a}[i] = {b}[j - 1] AND {a}[i - 1] = {b}[j] THEN s.pp[j - 1] + {cost} ELSE 1000000000 END)")
    return (f"list_reduce(generate_series(1, len({a})), lambda s, i: {{'pp': s.p, 'p': list_reduce("
            f"generate_series(1, len({b})), lambda row, j: list_append(row, {cell}), [i])}},"
            f" {{'pp': []::BIGINT[], 'p': generate_series(0, len({b}))}}).p[-1]")


def prefix(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    return (f"coalesce(list_position(list_transform(generate_series(1, {n}), lambda i: {a}[i] = {b}[i]), false) - 1,"
            f" {n})")


def suffix(a: str, b: str) -> str:
    return prefix(f"list_reverse({a})", f"list_reverse({b})")


def seq_values(a: str, b: str) -> list[str]:
    return [dp_lcs(a, b), dp_substring(a, b), prefix(a, b), suffix(a, b), dp_levenshtein(a, b), dp_osa(a, b)]


def seq_cols(a: str, b: str, p: str) -> list[str]:
    vals = seq_values(a, b)
    out = [f"CAST({v} AS INTEGER) AS {p}_{m}_v" for v, m in zip(vals, SEQ_METRICS)]
    out += [f"{ratio(v, f'len({a})')} AS {p}_{m}_l_ratio" for v, m in zip(vals, SEQ_METRICS)]
    out += [f"{ratio(v, f'len({b})')} AS {p}_{m}_r_ratio" for v, m in zip(vals, SEQ_METRICS)]
    return out


def seq_cols_staged(a: str, b: str, p: str) -> tuple[list[str], list[str]]:
    """Raw values in an inner select (named _v0.._v5), ratios in the outer one."""
    inner = [f"CAST({v} AS INTEGER) AS {p}_{m}_v" for v, m in zip(seq_values(a, b), SEQ_METRICS)]
    inner += [f"CAST(len({a}) AS INTEGER) AS _{p}_nl", f"CAST(len({b}) AS INTEGER) AS _{p}_nr"]
    outer = [f"{p}_{m}_v" for m in SEQ_METRICS]
    outer += [f"{ratio(f'{p}_{m}_v', f'_{p}_nl')} AS {p}_{m}_l_ratio" for m in SEQ_METRICS]
    outer += [f"{ratio(f'{p}_{m}_v', f'_{p}_nr')} AS {p}_{m}_r_ratio" for m in SEQ_METRICS]
    return inner, outer


# --------------------------------------------------------------------------
# Lexical base relation: lists per pair
# --------------------------------------------------------------------------

def lex_base(table: str) -> str:
    return f"""lex AS (
  SELECT qid, ql, qr, {chars('ql')} AS cl, {chars('qr')} AS cr,
         {terms('ql')} AS wl, {terms('qr')} AS wr, {tags('ql')} AS gl, {tags('qr')} AS gr
  FROM {table})"""


PERIPH = {"all": "periph_basic_word", "adj": "periph_adj_basic_word", "adv": "periph_adv_basic_word",
          "verb": "periph_verb_basic_word", "noun": "periph_noun_basic_word"}


def periph_terms(side: str, kind: str) -> str:
    """Terms of one side not contained in the other side's raw text, by tag class."""
    own, other = ("ql", "qr") if side == "l" else ("qr", "ql")
    cond = {"all": "true", "adj": "tg = 'a'", "adv": "tg = 'd'", "verb": "tg = 'v'",
            "noun": "starts_with(tg, 'n')"}[kind]
    pairs = f"list_zip({terms(own)}, {tags(own)})"
    return f"[z[1] for z in {pairs} if NOT contains({other}, z[1]) AND {cond.replace('tg', 'z[2]')}]"


# --------------------------------------------------------------------------
# Vectors (2.7)
# --------------------------------------------------------------------------

def analyzed(s: str) -> str:
    return f"regexp_extract_all(lower({s}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def notional_terms(s: str) -> str:
    return (f"[z[1] for z in list_zip({terms(s)}, {tags(s)}) "
            f"if z[2] IN ('a', 'd', 'v') OR starts_with(z[2], 'n')]")


VOCAB_CTES = [
    "nd AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)",
    f"""vocab AS (
  SELECT term, count(*) AS df FROM (
    SELECT DISTINCT doc_id, term FROM (
      SELECT doc_id, unnest({analyzed('text')}) AS term FROM documents WHERE text IS NOT NULL))
  GROUP BY term)""",
    "vidf AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM vocab, nd)",
]


def vec_tokens(table: str, kinds=("all", "notion")) -> str:
    parts = []
    for kd in kinds:
        for sd, col in (("l", "ql"), ("r", "qr")):
            t = terms(col) if kd == "all" else notional_terms(col)
            parts.append(f"SELECT qid, '{kd}' AS kind, '{sd}' AS side, "
                         f"{analyzed(f'array_to_string({t}, chr(32))')} AS ts FROM {table}")
    return "vt AS (" + " UNION ALL ".join(parts) + ")"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


#: MurmurHash3 of the distinct hashed items, step by step: words of four bytes, their fold, the last bytes, the final mix.
_M = 4294967295


def _murmur_word(k: str) -> str:
    return f"list_transform(list_transform({k}, lambda k: (k * {C1}) & {_M}), lambda k: ((((k << 15) | (k >> 17)) & {_M}) * {C2}) & {_M})"


MURMUR_CTES = [
    "mt AS (SELECT DISTINCT t FROM hi)",
    "mx AS (SELECT t, hex(encode(t)) AS x, length(hex(encode(t))) // 2 AS n FROM mt)",
    "mk AS (SELECT t, n, list_transform(range(0, n // 4), lambda i: ('0x' || substr(x, 8 * i + 7, 2) || substr(x, 8 * i + 5, 2)"
    " || substr(x, 8 * i + 3, 2) || substr(x, 8 * i + 1, 2))::UBIGINT) AS k,"
    " list_transform(range(0, least(n % 4, 1)), lambda i: ('0x' || substr(x, 8 * (n // 4) + 5, 2) || substr(x, 8 * (n // 4) + 3, 2)"
    " || substr(x, 8 * (n // 4) + 1, 2))::UBIGINT) AS tail FROM mx)",
    f"mf AS (SELECT t, n, list_reduce(list_prepend(0::UBIGINT, {_murmur_word('k')}), lambda h, k:"
    f" ((((xor(h, k) << 13) | (xor(h, k) >> 19)) & {_M}) * 5 + {ADD}) & {_M}) AS h,"
    f" coalesce(({_murmur_word('tail')})[1], 0::UBIGINT) AS tail FROM mk)",
    "m1 AS (SELECT t, xor(xor(h, tail), n::UBIGINT) AS h FROM mf)",
    f"m2 AS (SELECT t, (xor(h, h >> 16) * {MIX1}) & {_M} AS h FROM m1)",
    f"m3 AS (SELECT t, (xor(h, h >> 13) * {MIX2}) & {_M} AS h FROM m2)",
    "mm AS (SELECT t, (CASE WHEN xor(h, h >> 16) < 2147483648 THEN xor(h, h >> 16)::BIGINT ELSE xor(h, h >> 16)::BIGINT - 4294967296 END) AS h FROM m3)",
]


def vector_ctes(table: str, kinds=("all", "notion")) -> list[str]:
    """CTEs ending in ``vdist(qid, kind, vec, ped, pcd, pmd)`` for all six vectorisers."""
    bigrams = ("(CASE WHEN len(ts) < 2 THEN []::VARCHAR[] ELSE list_transform(generate_series(1, len(ts) - 1),"
               " lambda i: ts[i] || ' ' || ts[i + 1]) END)")
    hparts = []
    for name, (order, width) in HASHERS.items():
        items = "ts" if order == 1 else f"list_concat(ts, {bigrams})"
        hparts.append(f"SELECT qid, kind, side, '{name}' AS vec, {width} AS width, unnest({items}) AS t FROM vt")
    return VOCAB_CTES + [
        vec_tokens(table, kinds),
        "tv AS (SELECT qid, kind, side, term, count(*) AS tf FROM "
        "(SELECT qid, kind, side, unnest(ts) AS term FROM vt) GROUP BY ALL)",
        "pt AS (SELECT qid, kind, term, CAST(sum(CASE WHEN side = 'l' THEN tf ELSE 0 END) AS DOUBLE) AS x,"
        " CAST(sum(CASE WHEN side = 'r' THEN tf ELSE 0 END) AS DOUBLE) AS y, max(idf) AS idf"
        " FROM tv JOIN vidf USING (term) GROUP BY ALL)",
        "nrm AS (SELECT qid, kind, sqrt(sum((x * idf) * (x * idf))) AS nx, sqrt(sum((y * idf) * (y * idf))) AS ny"
        " FROM pt GROUP BY ALL)",
        "vw AS (SELECT qid, kind, 'count1' AS vec, x AS a, y AS b FROM pt UNION ALL"
        " SELECT qid, kind, 'tfidf1', coalesce(x * idf / nullif(nx, 0), 0), coalesce(y * idf / nullif(ny, 0), 0)"
        " FROM pt JOIN nrm USING (qid, kind))",
        "hi AS (" + " UNION ALL ".join(hparts) + ")",
        *MURMUR_CTES,
        "hb AS (SELECT qid, kind, side, vec, abs(h) % width AS bucket, sum(CASE WHEN h >= 0 THEN 1.0 ELSE -1.0 END) AS v"
        " FROM hi JOIN mm USING (t) GROUP BY ALL)",
        "hn AS (SELECT *, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY qid, kind, side, vec)), 0), 0)"
        " AS vn FROM hb)",
        "hw AS (SELECT qid, kind, vec, bucket, coalesce(sum(CASE WHEN side = 'l' THEN vn END), 0) AS a,"
        " coalesce(sum(CASE WHEN side = 'r' THEN vn END), 0) AS b FROM hn GROUP BY ALL)",
        "allw AS (SELECT qid, kind, vec, a, b FROM vw UNION ALL SELECT qid, kind, vec, a, b FROM hw)",
        "vdist AS (SELECT qid, kind, vec, sqrt(sum((a - b) * (a - b))) AS ped, sum(abs(a - b)) AS pmd,"
        " sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum((a - b) * (a - b)) AS sq FROM allw GROUP BY ALL)",
    ]


def cosine_sql(aa: str, bb: str, ab: str) -> str:
    cos = f"coalesce({ab} / nullif(sqrt({aa}) * sqrt({bb}), 0), 0)"
    return (f"greatest(0.0, 0.5 * ((CASE WHEN {aa} > 0 THEN 1.0 ELSE 0.0 END) + "
            f"(CASE WHEN {bb} > 0 THEN 1.0 ELSE 0.0 END) - 2.0 * {cos}))")


def vector_select(table: str, names_by_kind: dict[str, list[str]]) -> str:
    """Pivot vdist into the named feature columns, one row per pair."""
    cols = []
    for kd, names in names_by_kind.items():
        pre = "" if kd == "all" else "notion_"
        for name in names:
            vec, metric = name.rsplit("_", 1)
            if metric == "PED":
                expr = "ped"
            elif metric == "PMD":
                expr = "pmd"
            else:
                expr = cosine_sql("aa", "bb", "ab") if vec in ("count1", "tfidf1") else "0.5 * sq"
            cols.append(f"{r6(f'coalesce(max(CASE WHEN d.kind = {chr(39)}{kd}{chr(39)} AND d.vec = {chr(39)}{vec}{chr(39)} THEN {expr} END), 0.0)')} AS {pre}{name}")
    return (f"SELECT p.qid, {', '.join(cols)} FROM {table} p LEFT JOIN vdist d ON p.qid = d.qid GROUP BY p.qid")


# --------------------------------------------------------------------------
# Machine-translation scores (2.8)
# --------------------------------------------------------------------------

def mt_base(table: str) -> str:
    grams = []
    for side in ("l", "r"):
        for n in (1, 2, 3, 4):
            grams.append(f"{ngrams(f'c{side}', n, chr(39) * 2)} AS c{side}{n}")
            grams.append(f"{ngrams(f'w{side}', n, 'chr(1)')} AS w{side}{n}")
    return f"""mtb0 AS (
  SELECT qid, {chars('ql')} AS cl, {chars('qr')} AS cr, {terms('ql')} AS wl, {terms('qr')} AS wr FROM {table}),
mtb AS (SELECT *, {', '.join(grams)}, {_one_character_grams('wl')} AS gwl, {_one_character_grams('wr')} AS gwr FROM mtb0)"""


def _gram_counts(a: str, b: str, sep: str) -> list[tuple[str, str, str]]:
    """Per n: (len of a's n-grams, len of b's n-grams, clipped matches), on the
    precomputed gram columns of ``mtb`` (a, b are 'cl'/'cr' or 'wl'/'wr')."""
    out = []
    for n in (1, 2, 3, 4):
        ga, gb = f"{a}{n}", f"{b}{n}"
        out.append((f"len({ga})", f"len({gb})", multiset_inter(ga, gb)))
    return out


def bleu_sql(ref: str, hyp: str, sep: str) -> str:
    g = _gram_counts(ref, hyp, sep)
    ps = []
    for n, (_, lh, i) in enumerate(g):
        den = f"greatest({lh}, 1)"
        zeros_before = " + ".join(f"CAST(({g[k][2]}) = 0 AS INTEGER)" for k in range(n)) or "0"
        ps.append(f"(CASE WHEN ({i}) = 0 THEN 1.0 / (pow(2.0, ({zeros_before}) + 1) * {den}) "
                  f"ELSE CAST({i} AS DOUBLE) / {den} END)")
    geo = "exp(" + " + ".join(f"0.25 * ln({p})" for p in ps) + ")"
    bp = (f"(CASE WHEN len({hyp}) > len({ref}) THEN 1.0 WHEN len({hyp}) = 0 THEN 0.0 "
          f"ELSE exp(1.0 - CAST(len({ref}) AS DOUBLE) / len({hyp})) END)")
    return f"(CASE WHEN ({g[0][2]}) = 0 THEN 0.0 ELSE {bp} * {geo} END)"


def gleu_std_sql(a: str, b: str, sep: str) -> str:
    g = _gram_counts(a, b, sep)
    tp = " + ".join(f"({x[2]})" for x in g)
    na = " + ".join(x[0] for x in g)
    nb = " + ".join(x[1] for x in g)
    return ratio(tp, f"greatest({na}, {nb})")


def _all_grams(n: str) -> str:
    return " + ".join(f"greatest({n} - {k}, 0)" for k in range(4))


def gleu_chars_sql(ref: str, hyp: str) -> str:
    return (f"(CASE WHEN len(list_intersect({ref}, {hyp})) > 0 THEN 1.0 / greatest({_all_grams(f'len({hyp})')}, 1)"
            f" ELSE 0.0 END)")


def _one_character_grams(hyp: str) -> str:
    """1..4-grams of a word sequence that consist of one-character words, joined."""
    return ("list_concat(" + ", ".join(
        f"(CASE WHEN len({hyp}) < {n} THEN []::VARCHAR[] ELSE [array_to_string({hyp}[i:i + {n - 1}], '') "
        f"for i in generate_series(1, len({hyp}) - {n - 1}) "
        f"if list_bool_and(list_transform({hyp}[i:i + {n - 1}], lambda x: length(x) = 1))] END)"
        for n in (1, 2, 3, 4)) + ")")


def gleu_words_sql(ref: str, hyp: str) -> str:
    """Each reference term is a reference read as characters; the hypothesis is
    a word sequence, so only runs of one-character words can match, and only terms
    that hold one of those characters can score. ``g{hyp}`` (``mtb``) has the runs."""
    def char_grams(t):
        return ("list_concat(" + ", ".join(
            f"(CASE WHEN length({t}) < {n} THEN []::VARCHAR[] ELSE list_transform(generate_series(1, length({t}) - {n - 1}),"
            f" lambda i: substring({t}, i, {n})) END)" for n in (1, 2, 3, 4)) + ")")
    grams = f"g{hyp}"
    terms_ = f"list_filter(list_distinct({ref}), lambda t: len(list_filter(list_distinct({grams}), lambda x: contains(t, x))) > 0)"
    per_term = (f"list_transform({terms_}, lambda t: {ratio(multiset_inter(char_grams('t'), grams), f'greatest({_all_grams(f'len({hyp})')}, len({char_grams('t')}))')})")
    return f"(CASE WHEN len({grams}) = 0 THEN 0.0 ELSE coalesce(list_max({per_term}), 0.0) END)"


# --------------------------------------------------------------------------
# Sentence vectors
# --------------------------------------------------------------------------

SIF_CTES = [
    f"""wf AS (SELECT term, count(*) AS freq FROM (
  SELECT unnest({terms('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term)""",
    "tot AS (SELECT sum(freq) AS t FROM wf)",
    "lexw AS (SELECT term, 0.001 / (0.001 + CAST(freq AS DOUBLE) / t) AS weight FROM wf, tot)",
    f"""toks AS (SELECT qid, 'l' AS side, unnest({terms('ql')}) AS term FROM sent_pairs
  UNION ALL SELECT qid, 'r', unnest({terms('qr')}) FROM sent_pairs)""",
    "tw AS (SELECT qid, side, term, weight FROM toks JOIN lexw USING (term))",
    "dims AS (SELECT unnest(generate_series(1, 8)) AS dim)",
    "vals AS (SELECT qid, side, dim, weight * (CAST(('0x' || substr(md5(term), CAST(dim AS INTEGER), 1)) AS INTEGER)"
    " / 7.5 - 1.0) AS x FROM tw, dims)",
]
SIF_MEAN_SQL = (with_pairs("sent_pairs", *SIF_CTES) +
                f"SELECT qid, side, CAST(dim AS INTEGER) AS dim, {r6('sum(x) / count(*)')} AS value "
                f"FROM vals GROUP BY qid, side, dim")


# --------------------------------------------------------------------------
# Model (A1, A4, A5)
# --------------------------------------------------------------------------

def split_ranked(table: str, seed: int = 42, fraction: float = 0.1) -> str:
    """CTE ``split``: the first ceil(fraction * n) pairs by a hash of their content and the seed are the test set."""
    content = " || chr(1) || ".join(f"coalesce({c}, '')" for c in ("qid", "ql", "qr", "label"))
    return (f"keyed AS (SELECT *, CAST(('0x' || substr(md5({content} || chr(1) || '{seed}'), 1, 13)) AS BIGINT) AS sk FROM {table}), "
            f"split AS (SELECT *, rank() OVER (ORDER BY sk) <= ceil({fraction} * count(*) OVER ()) AS is_test FROM keyed)")


RULE_PRED = ("rp AS (SELECT qid, label, CASE WHEN length(ql) = length(qr) THEN '1' ELSE '0' END AS pred "
             "FROM training_pairs)")


def report_sql(names=("paraphrase", "other"), labels=("0", "1")) -> str:
    per = " UNION ALL ".join(
        f"SELECT '{nm}' AS class, coalesce(CAST(sum(CASE WHEN label = '{lb}' AND pred = '{lb}' THEN 1 ELSE 0 END) AS DOUBLE)"
        f" / nullif(sum(CASE WHEN pred = '{lb}' THEN 1 ELSE 0 END), 0), 0.0) AS precision,"
        f" coalesce(CAST(sum(CASE WHEN label = '{lb}' AND pred = '{lb}' THEN 1 ELSE 0 END) AS DOUBLE)"
        f" / nullif(sum(CASE WHEN label = '{lb}' THEN 1 ELSE 0 END), 0), 0.0) AS recall,"
        f" CAST(sum(CASE WHEN label = '{lb}' THEN 1 ELSE 0 END) AS BIGINT) AS support FROM rp"
        for nm, lb in zip(names, labels))
    return (f"per0 AS ({per}), per AS (SELECT class, precision, recall, coalesce(2 * precision * recall / "
            f"nullif(precision + recall, 0), 0.0) AS f1, support FROM per0)")


REPORT_SELECT = ("SELECT class, {p} AS precision, {r} AS recall, {f} AS f1, support FROM per UNION ALL "
                 "SELECT 'avg / total', {wp}, {wr}, {wf}, CAST(sum(support) AS BIGINT) FROM per").format(
    p=r6("precision"), r=r6("recall"), f=r6("f1"),
    wp=r6("sum(precision * support) / sum(support)"), wr=r6("sum(recall * support) / sum(support)"),
    wf=r6("sum(f1 * support) / sum(support)"))
