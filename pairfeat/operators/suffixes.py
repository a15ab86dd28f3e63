"""One suffix index for all pairs of an Arrow batch.

Both sides of every pair, each closed by an end mark of its own, stand behind
each other as one array of integers. The number of the pair and the first items
of a suffix are packed into one word, as many as fit; one sort of these words
orders nearly all suffixes, the pair first, so suffixes of one pair are
neighbours. Prefix doubling goes on with those that are still tied, a round at a
time. The ranks of every round are kept: from the widest down they give the prefix
that neighbours share (LCP); what is left of it is read off the packed words.
Everything after that is a segmented scan over the sorted suffixes. There is no
loop over rows or items.

``longest_common`` (Q2) is the largest LCP of neighbours from different sides.
``lone_contexts`` finds, for every item, the shortest run of items from it on
that occurs just once on either side (RIBES aligns by them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Items that are indexed at once, few enough that sorts stay in a core's cache; a longer pair is indexed alone.
CHUNK_ITEMS = 1 << 16


@dataclass
class Pairs:
    """Items of both sides of some pairs, as numbers: equal items have equal numbers, from 2 on."""

    items: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]

    def __len__(self) -> int:
        return len(self.sizes[0])

    def chunks(self, limit: int | None = None) -> Iterator[tuple[slice, "Pairs"]]:
        """Bounded parts, in order."""
        limit = CHUNK_ITEMS if limit is None else limit
        starts = [np.append(0, np.cumsum(n)) for n in self.sizes]
        both = starts[0] + starts[1]
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(both, both[at] + limit, "right")) - 1)
            yield slice(at, end), Pairs(tuple(x[s[at]:s[end]] for x, s in zip(self.items, starts)),
                                        tuple(n[at:end] for n in self.sizes))
            at = end

    def reversed(self) -> "Pairs":
        """Each side back to front."""
        return Pairs(tuple(_backwards(x, n) for x, n in zip(self.items, self.sizes)), self.sizes)


def _backwards(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return items[ends[row] - 1 - (np.arange(len(items)) - (ends - sizes)[row])]


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def dense(items: np.ndarray) -> tuple[np.ndarray, int]:
    """Small numbers numbered without gaps, and how many there are."""
    present = np.zeros(int(items.max(initial=0)) + 1, bool)
    present[items] = True
    number = np.cumsum(present, dtype=np.int64)
    return number[items] - 1, int(number[-1])


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a column of strings, and how many each has; a null has none."""
    column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    offsets, data = string_parts(column)
    text = data[offsets[0]:offsets[-1]].tobytes().decode("utf-8", "surrogatepass")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), pc.utf8_length(column).to_numpy().astype(np.int64)


def pairs_of(left: pa.Array, right: pa.Array) -> Pairs:
    """Two columns of strings (an item is a code point) or of arrays of strings; a null is empty."""
    if pa.types.is_list(left.type):
        flat = [c.flatten() for c in (left, right)]
        codes = pa.concat_arrays(flat).dictionary_encode().indices.fill_null(-1).to_numpy() + 3   # 2 is a null item
        sizes = [np.diff(c.offsets.to_numpy()) * c.is_valid().to_numpy(zero_copy_only=False) for c in (left, right)]
        return Pairs((codes[:len(flat[0])].astype(np.int64), codes[len(flat[0]):].astype(np.int64)), tuple(sizes))
    (a, n), (b, m) = _points(left), _points(right)
    items = dense(np.concatenate((a, b)))[0] + 2
    return Pairs((items[:len(a)], items[len(a):]), (n, m))


class Index:
    """Sorted suffixes of some pairs: ``order`` (places), ``lcp`` with the one before, and each place's ``row`` and ``side``."""

    def __init__(self, pairs: Pairs) -> None:
        n = len(pairs)
        sizes = np.stack(pairs.sizes, 1).ravel() + 1           # a, b, a, b, ... with end marks
        ends = np.cumsum(sizes)
        part = np.repeat(np.arange(2 * n), sizes)
        self.start = (ends - sizes).reshape(n, 2)               # first place of each side
        self.row, self.side = part >> 1, part & 1
        total = len(part)
        items = np.zeros(total, np.int64)
        mark = np.zeros(total, bool)
        mark[ends - 1] = True
        for s in (0, 1):
            items[(self.side == s) & ~mark] = pairs.items[s]
        items[mark] = self.side[mark]                           # 0 ends a left side, 1 a right one
        self.items, self.mark = items, mark
        self._sort()

    def _sort(self) -> None:
        total = len(self.items)
        bits = max(int(self.items.max(initial=0)).bit_length(), 1)
        row_bits = max(len(self.start) - 1, 1).bit_length()
        code = self.items
        if bits + row_bits > 62:
            code = np.unique(self.items, return_inverse=True)[1]
            bits = max(int(code.max(initial=0)).bit_length(), 1)
        # The pair and the first items of each suffix. Past an end mark anything may follow: a mark is like no other item of its pair.
        width = (62 - row_bits) // bits
        code = np.append(code, np.zeros(width, np.int64))
        key = self.row.astype(np.int64)
        for k in range(width):
            key = key << bits | code[k:k + total]
        order = np.argsort(key)
        rank = self._ranked(order, np.diff(key[order]) != 0)
        levels = [rank]
        step = width
        tied = np.flatnonzero(np.bincount(rank, minlength=total)[rank] > 1)
        while len(tied):
            # A tied suffix has no end mark within ``step`` items, so the next place is inside its pair.
            both = rank[tied].astype(np.int64) * total + rank[tied + step]
            by = np.argsort(both)
            tied, both = tied[by], both[by]
            group, new = both // total, np.append(True, np.diff(both) != 0)
            first = np.maximum.accumulate(np.where(np.append(True, np.diff(group) != 0), np.arange(len(both)), 0))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))
            rank = rank.copy()
            rank[tied] = group + lead - first
            levels.append(rank)
            step *= 2
            tied = tied[~(new & np.append(new[1:], True))]
        self.order = np.empty(total, np.int64)
        self.order[rank] = np.arange(total)
        lcp = np.zeros(total, np.int64)
        i, j = self.order[1:].copy(), self.order[:-1].copy()
        same = np.flatnonzero(levels[0][i] == levels[0][j])
        a, b, shared = i[same], j[same], np.zeros(len(same), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            equal = np.flatnonzero(levels[k][a] == levels[k][b])
            shared[equal] += width << k
            a[equal] += width << k
            b[equal] += width << k
        lcp[1 + same] = shared
        i[same], j[same] = a, b
        differ = key[i] ^ key[j]
        differ &= ~(differ >> 1)        # the highest bit stays, and no rounding reaches the next one
        high = np.frexp(differ.astype(np.float64))[1]
        lcp[1:] += np.maximum((width * bits - high) // bits, 0)
        self.lcp = lcp

    @staticmethod
    def _ranked(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
        """Rank of each place: where its group of equals begins."""
        lead = np.maximum.accumulate(np.where(np.append(True, differs), np.arange(len(order)), 0))
        rank = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
        rank[order] = lead
        return rank

    def longest_common(self) -> np.ndarray:
        """Q2: for every pair the length of the longest run of items that both sides have."""
        out = np.zeros(len(self.start), np.int64)
        side = self.side[self.order]
        across = np.append(0, self.lcp[1:] * (side[1:] != side[:-1]))
        np.maximum.at(out, self.row[self.order], across)
        return out

    def lone_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place the least length (2 at least; 0 without one) of the runs from it on that occur just
        once on both sides, and the place of that run on the other side.

        A prefix of a suffix occurs once on both sides if it is longer than what the suffix shares with any other of
        its own side, and is shared with exactly one suffix of the other side. Nearest neighbours in the order decide.
        """
        up = self._neighbours(self.order, self.lcp)
        down = self._neighbours(self.order[::-1], np.append(0, self.lcp[:0:-1]))
        own = np.maximum(up[0], down[0])
        upper = up[1] >= down[1]
        most = np.where(upper, up[1], down[1])
        second = np.where(upper, np.maximum(up[2], down[1]), np.maximum(down[2], up[1]))
        least = np.maximum(np.maximum(own, second) + 1, 2)
        return np.where((least <= most) & ~self.mark, least, 0), np.where(upper, up[3], down[3])

    def _neighbours(self, order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each place, by the suffixes before it in ``order``: the prefix shared with the last of its own side, with
        the last and the last but one of the other side, and the place of that last one (0 and -1 where there is none)."""
        total = len(order)
        side = self.side[order]
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))     # of runs of one side
        run = np.cumsum(np.append(0, side[1:] != side[:-1]))
        start = first[run]
        # Least LCP from a run's start on: a minimum that falls back at each run.
        far = total + 1
        since = np.minimum.accumulate(lcp - run * far) + run * far
        whole = np.concatenate(([0, 0], np.minimum.reduceat(lcp, first)))  # of runs; two empty ones in front
        before = np.concatenate(([0], np.diff(first), [0]))                # length of the run before
        within = np.arange(total) > start
        own = np.where(within, lcp, np.minimum(lcp, whole[run + 1]))
        link = np.where(start > 0, lcp[np.maximum(start - 1, 0)], 0)       # of the last of the run before
        second = np.where(before[run] > 1, np.minimum(since, link), np.minimum(since, np.minimum(whole[run + 1], whole[run])))
        none = start == 0
        out = [np.zeros(total, np.int64) for _ in range(4)]
        for at, values in zip(out, (own, np.where(none, 0, since), np.where(none, 0, second),
                                    np.where(none, -1, order[np.maximum(start - 1, 0)]))):
            at[order] = values
        return tuple(out)


def longest_common(pairs: Pairs) -> np.ndarray:
    out = np.zeros(len(pairs), np.int64)
    for at, part in pairs.chunks():
        out[at] = Index(part).longest_common()
    return out
