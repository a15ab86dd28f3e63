"""LCS length, Levenshtein and OSA distance of whole batches of pairs.

All three metrics have bit-vector recurrences (Allison-Dix / Hyyro for LCS, Myers
for edit distance, Hyyro 2003 with adjacent transpositions) whose state is one bit
per item of the shorter side; one step moves all rows on by one item of their
longer side. Rows are ordered by the longer side's length, longest first, so rows
that are done are always the last ones, which are read out and cut off.

Rows whose shorter side fits in a few words are columns of arrays of words
(``_run_columns``). For others every row owns a lane of words inside one wide
integer, with at least one spare bit on top, so a carry never leaves its lane
(``_run``); there is no length limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pairfeat.operators.suffixes import Pairs, pairs_of

#: Lane words and items of one run; a single longer row runs alone.
CHUNK_WORDS, CHUNK_ITEMS = 4096, 1 << 18
#: Rows that are columns: words of the shorter side and items of the longer one at most; columns and masks of one run.
COLUMN_WORDS, COLUMN_ITEMS = 8, 256
COLUMNS, COLUMN_MASKS = 4096, 1 << 20


def lcs_osa_batch(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """LCS length and OSA distance of each pair."""
    lcs, osa, _ = edit_metrics(pairs_of(pa.array(left, pa.string()), pa.array(right, pa.string())))
    return lcs, osa


def _taken(pairs: Pairs, sides: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The items of these rows, of the side given for each, behind each other."""
    whole = np.concatenate(pairs.items)
    first = np.stack([np.cumsum(n) - n for n in pairs.sizes])
    first[1] += len(pairs.items[0])
    size = np.stack(pairs.sizes)[sides, rows]
    return whole[np.repeat(first[sides, rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def edit_metrics(pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LCS length, OSA distance and Levenshtein distance of each pair."""
    sizes = np.stack(pairs.sizes) if len(pairs) else np.zeros((2, 0), np.int64)
    m, n = sizes.min(0), sizes.max(0)
    shorter = (sizes[0] > sizes[1]).astype(np.int64)
    out = np.zeros(len(pairs), np.int64), n.copy(), n.copy()      # right where the shorter side is empty
    order = np.argsort(-n, kind="stable")
    order = order[m[order] > 0]
    words = m // 64 + 1
    columns = (-(-m // 64) <= COLUMN_WORDS) & (n <= COLUMN_ITEMS)
    kinds = int(max((x.max(initial=0) for x in pairs.items), default=0)) + 1
    high = -(-m // 64)
    for least, most in ((1, 1), (2, 2), (3, 4), (5, COLUMN_WORDS)):
        these = order[(columns & (high >= least) & (high <= most))[order]]
        size = max(min(COLUMNS // most, COLUMN_MASKS // (kinds * most)), 1)
        for at in range(0, len(these), size):
            rows = these[at:at + size]
            found = _run_columns(_taken(pairs, shorter[rows], rows), _taken(pairs, 1 - shorter[rows], rows), m[rows], n[rows], kinds)
            for whole, part in zip(out, found):
                whole[rows] = part
    for rows in _chunks(order[~columns[order]], words, m + n):
        found = _run(_taken(pairs, shorter[rows], rows), _taken(pairs, 1 - shorter[rows], rows), m[rows], n[rows], words[rows])
        for whole, part in zip(out, found):
            whole[rows] = part
    return out


def _chunks(order: np.ndarray, words: np.ndarray, items: np.ndarray) -> Iterator[np.ndarray]:
    start = w = c = 0
    for k, row in enumerate(order):
        if k > start and (w + words[row] > CHUNK_WORDS or c + items[row] > CHUNK_ITEMS):
            yield order[start:k]
            start, w, c = k, 0, 0
        w += words[row]
        c += items[row]
    if start < len(order):
        yield order[start:]


def _shifted(x: np.ndarray) -> np.ndarray:
    """One bit up, across the words (the last axis but one)."""
    out = x + x
    if x.shape[-2] > 1:
        out[..., 1:, :] |= x[..., :-1, :] >> _TOP
    return out


def _added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum, with carries across the words (the last axis but one)."""
    out = x + y
    if x.shape[-2] > 1:
        carry = out < x
        for k in range(1, x.shape[-2]):
            out[..., k, :] += carry[..., k - 1, :]
            carry[..., k, :] |= carry[..., k - 1, :] & (out[..., k, :] == 0)
    return out


_ONE, _TOP = np.uint64(1), np.uint64(63)


def _run_columns(short: np.ndarray, long: np.ndarray, m: np.ndarray, n: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the longest first, as columns; items under ``kinds``. Bits above a row's shorter side carry nothing that counts."""
    rows, words = len(m), -(-int(m.max()) // 64)
    row_s, row_l = np.repeat(np.arange(rows), m), np.repeat(np.arange(rows), n)
    place = np.arange(len(short)) - np.repeat(np.cumsum(m) - m, m)
    masks = np.zeros((words, rows * kinds), np.uint64)
    np.add.at(masks.reshape(-1), (place >> 6) * (rows * kinds) + row_s * kinds + short, _ONE << (place & 63).astype(np.uint64))
    alive = np.searchsorted(-n, -np.arange(int(n[0])))              # rows that have an item at each step
    begin = np.append(0, np.cumsum(alive))
    at = np.empty(len(long), np.int64)
    at[begin[np.arange(len(long)) - np.repeat(np.cumsum(n) - n, n)] + row_l] = row_l * kinds + long
    fill = np.clip(m - 64 * np.arange(words)[:, None], 0, 64)
    full = np.where(fill > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - np.maximum(fill, 1)).astype(np.uint64), np.uint64(0))
    up = np.full((3, words, rows), 0xFFFFFFFFFFFFFFFF, np.uint64)   # of LCS, Levenshtein and OSA
    down = np.zeros((2, words, rows), np.uint64)
    crossed, before = (np.zeros((words, rows), np.uint64) for _ in range(2))
    out = np.zeros((3, rows), np.int64)

    def read(lo: int, hi: int) -> None:
        ups = np.bitwise_count(up[:, :, lo:hi] & full[:, lo:hi]).astype(np.int64).sum(1)
        downs = np.bitwise_count(down[:, :, lo:hi] & full[:, lo:hi]).astype(np.int64).sum(1)
        out[0, lo:hi] = m[lo:hi] - ups[0]
        out[1:, lo:hi] = n[lo:hi] + ups[1:] - downs

    count = rows
    for step, now in enumerate(alive.tolist()):
        if now < count:
            read(now, count)
            up, down, crossed, before = up[:, :, :now], down[:, :, :now], crossed[:, :now], before[:, :now]
            count = now
        mask = masks.take(at[begin[step]:begin[step + 1]], axis=1)
        total = _added(up & mask, up)
        total[0] |= up[0] & ~mask
        ups = up[1:]
        cross = total[1:] ^ ups
        cross |= mask
        cross |= down
        np.invert(crossed, out=crossed)
        crossed &= mask
        cross[1] |= _shifted(crossed) & before
        plus = cross | ups
        np.invert(plus, out=plus)
        plus |= down
        plus = _shifted(plus)
        plus[:, 0] |= _ONE
        minus = _shifted(cross & ups)
        down = plus & cross
        plus |= cross
        np.invert(plus, out=plus)
        np.bitwise_or(plus, minus, out=total[1:])
        up, crossed, before = total, cross[1], mask
    read(0, count)
    return out[0], out[2], out[1]


def _run(short: np.ndarray, long: np.ndarray, m: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the longest first, as lanes."""
    rows = len(m)
    lane = np.concatenate(([0], np.cumsum(words)))            # first word of each row's lane
    first_s = np.concatenate(([0], np.cumsum(m)))[:-1]
    first_l = np.concatenate(([0], np.cumsum(n)))[:-1]
    row_s, row_l = np.repeat(np.arange(rows), m), np.repeat(np.arange(rows), n)
    # Masks: one lane of words for each distinct (row, item) of the shorter sides; the last entry is all zero.
    kinds = int(max(short.max(initial=0), long.max(initial=0))) + 1
    keys, inverse = np.unique(row_s * kinds + short, return_inverse=True)
    width = words[keys // kinds]
    base = np.concatenate(([0], np.cumsum(width)))
    masks = np.zeros(base[-1] + int(words.max()), np.uint64)
    place = np.arange(len(row_s)) - first_s[row_s]
    np.bitwise_or.at(masks, base[inverse] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    wanted = row_l * kinds + long
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    at = np.where(keys[found] == wanted, base[found], base[-1])
    word_row = np.repeat(np.arange(rows), words)
    word_in = np.arange(lane[-1]) - lane[word_row]

    def wide(parts: np.ndarray) -> int:
        return int.from_bytes(parts.tobytes(), "little")

    bits = np.zeros(lane[-1], np.uint64)
    fill = np.clip(m[word_row] - 64 * word_in, 0, 64)
    some = fill > 0
    bits[some] = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - fill[some]).astype(np.uint64)
    full = wide(bits)
    ones = np.zeros(lane[-1], np.uint64)
    ones[lane[:-1]] = 1
    low = wide(ones)
    lcs, osa, lev = (np.zeros(rows, np.int64) for _ in range(3))
    v, vp, vn, d0, before, lp, ln = full, full, 0, 0, 0, full, 0
    alive = rows
    step = 0
    while alive:
        if n[alive - 1] == step:
            done = int(np.searchsorted(-n, -step))            # rows from here on end at this step
            lo, hi = int(lane[done]), int(lane[alive])
            counts = []
            for state in (v, vp, vn, lp, ln):
                top = (state >> (64 * lo)).to_bytes(8 * (hi - lo), "little")
                ones_of = np.bitwise_count(np.frombuffer(top, np.uint64)).astype(np.int64)
                counts.append(np.add.reduceat(ones_of, lane[done:alive] - lo))
            lcs[done:alive] = m[done:alive] - counts[0]
            osa[done:alive] = n[done:alive] + counts[1] - counts[2]
            lev[done:alive] = n[done:alive] + counts[3] - counts[4]
            alive = done
            keep = (1 << (64 * lo)) - 1
            v, vp, vn, d0, before, lp, ln, full, low = (x & keep for x in (v, vp, vn, d0, before, lp, ln, full, low))
            continue
        w = int(lane[alive])
        mask = wide(masks[at[first_l[:alive] + step][word_row[:w]] + word_in[:w]])
        u = v & mask
        v = ((v + u) | (v - u)) & full
        swapped = (((full ^ d0) & mask) << 1) & before
        d0 = ((((mask & vp) + vp) ^ vp) | mask | vn | swapped) & full
        hp = vn | (full ^ (d0 | vp))
        hn = d0 & vp
        hp = ((hp << 1) | low) & full
        hn = (hn << 1) & full
        vp = hn | (full ^ (d0 | hp))
        vn = hp & d0
        before = mask
        l0 = ((((mask & lp) + lp) ^ lp) | mask | ln) & full
        hp = ln | (full ^ (l0 | lp))
        hn = ((l0 & lp) << 1) & full
        hp = ((hp << 1) | low) & full
        lp = hn | (full ^ (l0 | hp))
        ln = hp & l0
        step += 1
    return lcs, osa, lev
