"""The lexical families (2.3-2.6) of whole Arrow batches.

A batch is numbered once: its characters, and the words and tags of its token
lists. From there on everything is integers: chunks of pairs that fit a core's
cache go through the n-gram counts (``operators.grams``), the suffix index
(``operators.suffixes``) and the bit vectors (``operators.bitlanes``), and the
counts become columns. Only the test of a term against the other side's text is
done term by term.

Missing sides: a length of a missing side is NULL, and so is what needs both,
but a side of more than ``LONG`` items shares nothing with a missing one;
ratios and overlaps are 0.0, sequence metrics NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairfeat.functions import text
from pairfeat.operators.bitlanes import edit_metrics
from pairfeat.operators.grams import gram_counts, localised, shared_items
from pairfeat.operators.suffixes import Pairs, longest_common, pairs_of

#: A side of more items shares nothing with a missing one; a shorter one an unknown number.
LONG = 256
#: Items of the pairs whose bit vectors run together.
CHUNK_ITEMS = 1 << 21

Known = tuple[np.ndarray, np.ndarray]


def _ratio(num: np.ndarray, den: np.ndarray, known: np.ndarray | bool = True) -> pa.Array:
    return pa.array(np.divide(num, den, out=np.zeros(len(num)), where=(den != 0) & known))


def _int(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32), pa.int32(), mask=~known)


def length_columns(sizes: tuple[np.ndarray, np.ndarray], shared: np.ndarray, known: Known, extra: bool) -> list[pa.Array]:
    """2.3: 9 columns (11 with ``extra``) from the sizes of both multisets and of their intersection."""
    l, r = sizes
    both = known[0] & known[1]
    sharing = both | ((known[0] | known[1]) & (np.maximum(l, r) > LONG))
    i = np.where(both, shared, 0)
    out = [_int(l, known[0]), _int(r, known[1]), _int(l + r - i, both), _int(i, sharing), _int(np.abs(l - r), both),
           _int(l - i, known[0] & sharing), _int(r - i, known[1] & sharing), _ratio(l - i, r, both), _ratio(r - i, l, both)]
    return out + ([_ratio(np.abs(l - r), l, both), _ratio(np.abs(l - r), r, both)] if extra else [])


def overlap_columns(p: Pairs, ns: tuple[int, ...]) -> list[pa.Array]:
    """2.4: jaccard, dice and overlap of the n-gram sets, for each n."""
    found = {n: [np.zeros(len(p), np.int64) for _ in range(3)] for n in ns}
    for at, part in p.chunks():
        for n, counts in gram_counts(part, ns).items():
            for whole, k in zip(found[n], ("da", "db", "di")):
                whole[at] = counts[k]
    out = []
    for a, b, i in found.values():
        out += [_ratio(i, a + b - i), _ratio(2 * i, a + b), _ratio(i, np.minimum(a, b))]
    return out


def _common_prefix(p: Pairs) -> np.ndarray:
    size = np.minimum(*p.sizes)
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(p)), size)
    place = np.arange(len(row)) - (ends - size)[row]
    apart = np.flatnonzero(np.not_equal(*[x[(np.cumsum(n) - n)[row] + place] for x, n in zip(p.items, p.sizes)]))
    lead = np.flatnonzero(np.diff(row[apart], prepend=-1))
    out = size.copy()
    out[row[apart[lead]]] = place[apart[lead]]
    return out


def sequence_columns(p: Pairs, known: Known) -> list[pa.Array]:
    """2.5: six metrics, then each over the left and the right length."""
    both = known[0] & known[1]
    lcs, osa, lev = (np.zeros(len(p), np.int64) for _ in range(3))
    for at, part in p.chunks(CHUNK_ITEMS):
        lcs[at], osa[at], lev[at] = edit_metrics(part)
    values = [lcs, longest_common(p), _common_prefix(p), _common_prefix(p.reversed()), lev, osa]
    return [_int(v, both) for v in values] + [_ratio(v, n, both) for n in p.sizes for v in values]


class Tokens:
    """Both sides' tokens of a batch, numbered."""

    def __init__(self, left: pa.Array, right: pa.Array) -> None:
        sides = [_given(c) if pa.types.is_list(c.type) else _cut(c) for c in (left, right)]
        self.known = tuple(s[2] for s in sides)
        sizes = tuple(s[1] for s in sides)
        coded = pa.concat_arrays([s[0] for s in sides]).dictionary_encode()
        n = int(sizes[0].sum())
        self.terms = coded.dictionary
        self.code = coded.indices.fill_null(len(self.terms)).to_numpy().astype(np.int64)
        self.words = Pairs((self.code[:n] + 2, self.code[n:] + 2), sizes)
        if sides[0][3] is None:
            tag_of = rule_tags(self.terms).dictionary_encode()
            self.tag_names, tag = tag_of.dictionary.to_pylist(), np.append(tag_of.indices.to_numpy(), 0)[self.code].astype(np.int64)
        else:
            given = pa.concat_arrays([s[3] for s in sides]).dictionary_encode()
            self.tag_names = [*given.dictionary.to_pylist(), None]
            tag = given.indices.fill_null(len(self.tag_names) - 1).to_numpy().astype(np.int64)
        self.tag = tag
        self.tags = Pairs((tag[:n] + 2, tag[n:] + 2), sizes)

    def outside(self, left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """P7, for every token of each side: its term is no part of the other side's text."""
        terms = np.array([*self.terms.to_pylist(), None], dtype=object)[self.code].tolist()
        out, at = [], 0
        for sizes, other in zip(self.words.sizes, (right, left)):
            flags: list[bool] = []
            for n, t in zip(sizes.tolist(), other.to_pylist()):
                flags += [True] * n if t is None else [w is None or w not in t for w in terms[at:at + n]]
                at += n
            out.append(np.array(flags, bool))
        return out[0], out[1]

    def kind(self, kind: str) -> np.ndarray:
        """Of all tokens, which belong to a class of content words."""
        if kind == "all":
            return np.ones(len(self.tag), bool)
        tag = {"adj": text.ADJ, "adv": text.ADV, "verb": text.VERB}.get(kind)
        of_name = np.array([n is not None and (n.startswith(text.NOUN_PREFIX) if kind == "noun" else n == tag) for n in self.tag_names] or [False], bool)
        return of_name[self.tag]


def _given(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array | None]:
    """Terms, number of each row's, rows that are no null, and tags, of a column of token lists."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) * known
    flat = column.flatten()
    if pa.types.is_struct(flat.type):
        terms, tags = (pc.struct_field(flat, [k]) for k in (0, 1))
        return terms, sizes, known, tags
    return flat, sizes, known, None


def _cut(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, None]:
    """As ``_given``, of terms with one blank between (``text.spaced_terms``)."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.utf8_trim(column.fill_null(""), " "), " ")
    sizes = np.where(pc.equal(pc.binary_length(pc.utf8_trim(column.fill_null(""), " ")), 0).to_numpy(zero_copy_only=False), 0,
                     np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    if int(sizes.sum()) != len(flat):
        flat = flat.filter(pc.not_equal(flat, ""))
    return flat, sizes.astype(np.int64), known, None


def flat_terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms, and the number of each row's, of a column of term lists or of texts of terms with one blank between."""
    return (_given(column) if pa.types.is_list(column.type) else _cut(column))[:2]


def rule_tags(terms: pa.Array) -> pa.Array:
    """``text.suffix_tag`` of string terms."""
    out = pa.array([text.DEFAULT_TAG] * len(terms), pa.string())
    for suffix, tag in reversed(text.SUFFIX_TAGS):
        out = pc.if_else(pc.ends_with(terms, suffix), tag, out)
    return out


def lexical_columns(left: pa.Array, right: pa.Array, tokens: Tokens | None, families: tuple[str, ...], extra: bool,
                    ns: dict[str, tuple[int, ...]]) -> list[pa.Array]:
    """The columns of the families, in the order given. ``ns``: orders of the n-grams of each n-gram family."""
    out: list[pa.Array] = []
    parts: dict[str, tuple[Pairs, Known]] = {}
    if any(f.startswith("char") for f in families):
        parts["char"] = pairs_of(left, right), tuple(c.is_valid().to_numpy(zero_copy_only=False) for c in (left, right))
    if tokens is not None:
        parts["postag"] = tokens.tags, tokens.known
        if any(f.startswith("word") for f in families):
            parts["word"] = localised(tokens.words), tokens.known
    for family in families:
        level, _, what = family.partition("_")
        if level == "periph":
            out += _periph_columns(left, right, tokens, extra)
            continue
        p, known = parts[level]
        if what == "len":
            out += length_columns(p.sizes, shared_items(p), known, extra)
        elif what == "ngram":
            out += overlap_columns(p, ns[family])
        else:
            out += sequence_columns(p, known)
    return out


def _periph_columns(left: pa.Array, right: pa.Array, tokens: Tokens, extra: bool) -> list[pa.Array]:
    outside = tokens.outside(left, right)
    n = len(outside[0])
    rows = [np.repeat(np.arange(len(left)), size) for size in tokens.words.sizes]
    out = []
    for kind in text.PERIPH_KINDS:
        of_kind = tokens.kind(kind)
        keep = outside[0] & of_kind[:n], outside[1] & of_kind[n:]
        p = Pairs(tuple(x[k] for x, k in zip(tokens.words.items, keep)),
                  tuple(np.bincount(r[k], minlength=len(left)) for r, k in zip(rows, keep)))
        out += length_columns(p.sizes, shared_items(p), tokens.known, extra)
    return out
