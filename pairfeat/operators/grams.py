"""N-gram counts of whole Arrow batches.

Items are numbers; a pair, an n-gram and its side are packed into one word, and one
sort of these serves all orders. Where items are too many for that, an n-gram's
number is that of (its first n - 1 items, its last item), given by one sort an
order. From the counts by side come the sizes of both multisets and sets and of
their intersections.
"""

from __future__ import annotations

import numpy as np

from pairfeat.operators.suffixes import Pairs, dense

#: Of every pair: n-grams and distinct n-grams of each side, and of both (``i``: multisets, ``di``: sets).
COUNTS = ("a", "b", "i", "da", "db", "di")


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


#: Counters of one table of ``shared_items``; with more kinds of items than KINDS these are sorted.
CELLS, KINDS = 1 << 20, 1 << 14


def shared_items(pairs: Pairs) -> np.ndarray:
    """Size of the intersection of both sides' multisets, for every pair."""
    out = np.zeros(len(pairs), np.int64)
    item, kinds = dense(np.concatenate(pairs.items))
    if kinds > KINDS:
        for at, part in pairs.chunks():
            out[at] = gram_counts(part, (1,))[1]["i"]
        return out
    sides = item[:len(pairs.items[0])], item[len(pairs.items[0]):]
    ends = [np.append(0, np.cumsum(n)) for n in pairs.sizes]
    step = max(1, CELLS // max(kinds, 1))
    for lo in range(0, len(pairs), step):
        hi = min(lo + step, len(pairs))
        counts = [np.bincount(np.repeat(np.arange(hi - lo) * kinds, n[lo:hi]) + x[e[lo]:e[hi]], minlength=(hi - lo) * kinds)
                  for x, n, e in zip(sides, pairs.sizes, ends)]
        out[lo:hi] = np.minimum(*counts).reshape(hi - lo, kinds).sum(1)
    return out


def localised(pairs: Pairs) -> Pairs:
    """The same pairs with items numbered from 2 within each pair, so that numbers stay small."""
    rows = np.concatenate([np.repeat(np.arange(len(pairs)), n) for n in pairs.sizes])
    items = np.concatenate(pairs.items)
    most = int(items.max(initial=0)) + 1
    keys, at = np.unique(rows * most + items, return_inverse=True)
    first = np.searchsorted(keys // most, np.arange(len(pairs)))
    items = at - first[rows] + 2
    return Pairs((items[:len(pairs.items[0])], items[len(pairs.items[0]):]), pairs.sizes)


#: Bits of the words that hold a pair, an n-gram and a side.
WORD_BITS = 64


def gram_counts(pairs: Pairs, orders: tuple[int, ...], sets: bool = True) -> dict[int, dict[str, np.ndarray]]:
    """``COUNTS`` of every pair, for each order; without ``sets`` those of multisets alone."""
    longest = max(orders)
    row_bits = max(len(pairs) - 1, 1).bit_length()
    for numbered in (lambda: pairs, lambda: localised(pairs)):
        p = numbered()
        bits = max(int(max(x.max(initial=0) for x in p.items)) - 1, 1).bit_length()
        if row_bits + longest * bits + 1 <= WORD_BITS:
            return _packed_counts(p, orders, sets, bits)
    return _numbered_counts(pairs, orders, sets)


def _packed_counts(pairs: Pairs, orders: tuple[int, ...], sets: bool, bits: int) -> dict[int, dict[str, np.ndarray]]:
    """One sort of (pair, n-gram of the highest order, side) as numbers serves all orders: the lower ones are prefixes."""
    n_rows, longest = len(pairs), max(orders)
    sizes = np.concatenate(pairs.sizes)
    ends = np.cumsum(sizes + 1)
    total = int(ends[-1]) if len(ends) else 0
    text = np.zeros(total + longest, np.uint64)       # sides behind each other, a 0 after each
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    at = np.flatnonzero(inside)
    text[at] = np.concatenate(pairs.items) - 1
    key = np.repeat(np.tile(np.arange(n_rows, dtype=np.uint64), 2), sizes)
    alive = np.ones(len(at), bool)
    for k in range(longest):
        item = text[at + k]
        alive &= item != 0
        key = key << np.uint64(bits) | item * alive
    key = key << np.uint64(1)
    key[int(pairs.sizes[0].sum()):] |= np.uint64(1)
    key.sort()
    rights = np.append(0, np.cumsum((key & np.uint64(1)).astype(np.int64)))
    starts_of = np.arange(n_rows, dtype=np.uint64)
    low = np.uint64((1 << bits) - 1)
    out = {}
    for n in orders:
        gram = key >> np.uint64(1 + (longest - n) * bits)
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        start = np.flatnonzero(new)
        gram = gram[start]
        whole = (gram & low) != 0                     # not cut off by the end of its side
        edge = np.append(start, len(key))
        right = np.diff(rights[edge])
        left = np.diff(edge) - right
        first = np.append(np.searchsorted(gram >> np.uint64(n * bits), starts_of), len(gram))

        def total_of(values: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[first])

        out[n] = {**{k: np.maximum(m - (n - 1), 0) for k, m in zip("ab", pairs.sizes)}, "i": total_of(np.minimum(left, right) * whole)}
        if sets:
            has = (left > 0) & whole, (right > 0) & whole
            out[n] |= {"da": total_of(has[0]), "db": total_of(has[1]), "di": total_of(has[0] & has[1])}
    return out


def _numbered_counts(pairs: Pairs, orders: tuple[int, ...], sets: bool = True) -> dict[int, dict[str, np.ndarray]]:
    """``gram_counts`` by a sort for every order, with any number of kinds of items."""
    n_rows = len(pairs)
    sizes = np.concatenate(pairs.sizes)
    row = np.repeat(np.tile(np.arange(n_rows), 2), sizes)
    side = np.repeat(np.repeat([0, 1], n_rows), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))     # items from here to the end of the side
    item, kinds = dense(np.concatenate(pairs.items))
    out = {}
    at, gram = np.arange(len(row)), row                                 # of no items: its pair
    for n in range(1, max(orders) + 1):
        fits = left[at] >= n
        at = at[fits]
        gram = _numbered(gram[fits] * kinds + item[at + n - 1])
        if n not in orders:
            continue
        grams = int(gram.max(initial=-1)) + 1
        count = np.bincount(side[at] * grams + gram, minlength=2 * grams).reshape(2, grams)
        owner = np.zeros(grams, np.int64)
        owner[gram] = row[at]

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=values, minlength=n_rows).astype(np.int64)

        out[n] = {**{k: np.maximum(m - (n - 1), 0) for k, m in zip("ab", pairs.sizes)}, "i": total(np.minimum(*count))}
        if sets:
            out[n] |= {"da": total(count[0] > 0), "db": total(count[1] > 0), "di": total((count > 0).all(0))}
    return out
