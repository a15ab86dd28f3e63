"""Substring dedup by recompression.

A text is a sequence of words. Rounds name what stands side by side: a run
round names maximal runs of one symbol, a pair round splits all symbols into
left and right ones (by a bit of their name) and names every left-right pair.
A name is a hash of what it stands for, so it is the same in every task and
document. Whether two neighbours merge depends on a few symbols around them;
each symbol carries the words it depends on (its extent), so inside two equal
stretches every symbol whose extent lies within them is the same.

Of the symbols whose extent lies within a window, the highest ones, the one with
the smallest name stands for the window. Two Spark rounds follow:

1. The names that stand for windows are dealt out by name. A window whose name
   stands nowhere else cannot be repeated and is dropped here.
2. The windows left are dealt out by the same names, each with a hash of all its
   words. Of equal name and hash, all but the first window (by document id, then
   start) are repeats, and their words go.

Windows in a row with the same symbol travel as one row. A task settles what it
can before it sends anything: of a name or a window that it holds more than
once one row travels, so a passage in a third of all documents costs a task one
row for each of its names. Groups are read as sorted streams and never held.
Long texts are cut into overlapping pieces; a window's symbol depends on the
window's words alone, so the pieces change nothing.

Defined results: a null or empty text has no words and comes back empty; texts
shorter than a window come back whole, their words joined by one space; rows
with equal id and text are one document given twice and get the same result;
among rows of one id with other texts a hash of the text decides which is
earlier; null ids come last; an empty table gives an empty one; columns other
than the id and the text are not read. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 20
#: Kinds of rounds. More of them name longer symbols, which stand for fewer windows each.
ROUNDS = ("run", "pair", "pair", "pair", "pair")
#: Words that a task reads at a time.
PIECE = 400_000
#: Odd multipliers of the names.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _runs(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | stop[1:] | stop[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(name)))
    first = name[at]
    named = np.where(size > 1, _mixed(first * _C + size.astype(np.uint64)), first)
    # Where a run ends depends on the symbols before and after it.
    return named, lo[np.maximum(at - 1, 0)], hi[np.minimum(at + size, len(name) - 1)], stop[at]


def _pairs(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, stop: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    right = (_mixed(name ^ np.uint64(level)) >> np.uint64(17)) & np.uint64(1) == 1
    left = ~right & ~stop
    right &= ~stop
    joins = np.zeros(len(name), bool)
    joins[:-1] = left[:-1] & right[1:]
    joined = np.zeros(len(name), bool)
    joined[1:] = joins[:-1]
    at = np.flatnonzero(~joined)
    two = joins[at]
    after, before = np.minimum(at + 1, len(name) - 1), np.maximum(at - 1, 0)
    named = np.where(two, _mixed(name[at] * _B + _mixed(name[after] + _C)), name[at])
    # A single left symbol depends on the next one, a single right symbol on the one before.
    return named, np.where(right[at], lo[before], lo[at]), np.where(left[at], hi[after], hi[at]), stop[at]


class Words:
    """Hashes of any stretch of a sequence of names: a polynomial in ``_A``, by its sums from the start."""

    def __init__(self, name: np.ndarray) -> None:
        n = len(name)
        power, self.back = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, x, np.uint64)))
                            for x in (_A, np.uint64(pow(int(_A), -1, 1 << 64))))
        self.upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(name) * power[:n], dtype=np.uint64)))

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mixed((self.upto[hi] - self.upto[lo]) * self.back[lo])


def anchors(name: np.ndarray, stop: np.ndarray, words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows without a stop inside (their starts), the name of the symbol that stands for each, and which one it is."""
    n = len(name)
    blocked = np.concatenate(([0], np.cumsum(stop)))
    starts = np.flatnonzero(blocked[window:] == blocked[:n - window + 1]) if n >= window else np.zeros(0, np.int64)
    lo = np.arange(n)
    state = (name, lo, lo + 1, stop)
    levels = [state]
    for level, kind in enumerate(ROUNDS, 1):
        state = _runs(*state) if kind == "run" else _pairs(*state, level)
        levels.append(state)
    chosen, which = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    left = np.arange(len(starts))
    for level in range(len(ROUNDS), -1, -1):
        names, lo, hi, _ = levels[level]
        # A name is taken with the words it depends on: the window has them all.
        names = _mixed(names + np.uint64(level)) ^ words.hashes(lo, hi)
        first = np.searchsorted(lo, starts[left])
        end = np.searchsorted(hi, starts[left] + window, "right")
        ok = first < end
        at, first, end = left[ok], first[ok], end[ok]
        best, where = names[first], first.copy()
        for k in range(1, int((end - first).max(initial=0))):
            more = np.flatnonzero(first + k < end)
            other = names[first[more] + k]
            less = other < best[more]
            best[more[less]], where[more[less]] = other[less], first[more[less]] + k
        chosen[at], which[at] = best, level * n + where
        left = left[~ok]
    return starts, chosen, which


class _Pieces:
    """Texts of a batch as pieces of bounded length; a stop symbol begins a piece and ends each part of a text."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.names: list[np.ndarray] = []
        self.rows: list[tuple[int, int, int]] = []   # row, first word of the part, words of the part
        self.size = 1

    def add(self, row: int, at: int, names: np.ndarray) -> None:
        self.rows.append((row, at, len(names)))
        self.names.append(names)
        self.size += len(names) + 1

    def parts(self, texts: pa.Array) -> Iterator[None]:
        """Yields whenever a piece is full; the caller takes it."""
        for row, text in enumerate(texts):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            for at in range(0, max(len(words) - self.window + 1, 0), PIECE):
                self.add(row, at, word_names(words[at:at + PIECE + self.window - 1]))
                if self.size >= PIECE:
                    yield
        if self.rows:
            yield

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, stops, and the row and word number of each symbol."""
        sizes = np.array([1, *(n + 1 for _, _, n in self.rows)])
        ends = np.cumsum(sizes) - 1
        names = np.zeros(self.size, np.uint64)
        stop = np.zeros(self.size, bool)
        stop[ends] = True
        names[~stop] = np.concatenate(self.names)
        row = np.repeat([0, *(r for r, _, _ in self.rows)], sizes)
        word = np.arange(self.size) - np.repeat(ends + 1 - sizes - np.array([0, *(a for _, a, _ in self.rows)]), sizes)
        self.names, self.rows, self.size = [], [], 1
        return names, stop, row, word


def _stretches(*columns: np.ndarray) -> np.ndarray:
    """Where a new stretch begins: the first column rises by one within it, the others stay."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = columns[0][1:] != columns[0][:-1] + 1
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_NAMED = pa.schema([("name", pa.int64()), ("known", pa.bool_()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _named(window: int):
    """Stretches of windows by the symbol that stands for them. Of a name that the task has met twice (``known``) one row keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            pieces = _Pieces(window)
            for _ in pieces.parts(batch.column(1)):
                names, stop, row, word = pieces.take()
                starts, chosen, which = anchors(names, stop, Words(names), window)
                at = _stretches(starts, which)
                if not len(at):
                    continue
                size = np.diff(np.append(at, len(starts)))
                name, first = chosen[at], starts[at]
                _, lead, inverse, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64), mask=lead[inverse] != np.arange(len(name))), pa.array(count[inverse] > 1),
                     pa.array(docs[row[first]]), pa.array(word[first].astype(np.int32)), pa.array(size.astype(np.int32))], schema=_NAMED)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name, those whose name another row or their own task has. The last row waits for the next batch."""
    held: list[pa.RecordBatch] = []
    met = False   # whether the held row has the name of the row before it

    def chosen(rows: pa.Table, met: bool, last: bool) -> tuple[pa.Table, bool]:
        unnamed = rows.column("name").is_null().to_numpy()
        name = rows.column("name").fill_null(0).to_numpy()
        same = np.zeros(len(name) + 1, bool)   # as the row before
        same[0] = met
        same[1:-1] = (name[1:] == name[:-1]) & ~unnamed[1:] & ~unnamed[:-1]
        ok = same[:-1] | same[1:] | rows.column("known").to_numpy()
        ok[len(ok) - (not last):] = False
        return rows.select(["doc", "start", "n"]).filter(pa.array(ok)), bool(same[-2])

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch])
            found, met = chosen(rows, met, False)
            yield from found.to_batches()
            held = [batch.slice(batch.num_rows - 1)]
    if held:
        yield from chosen(pa.Table.from_batches(held), met, True)[0].to_batches()


_WINDOWS = pa.schema([("name", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
                      ("hashes", pa.list_(pa.int64()))])


def _wanted(marks: pa.ListArray, stop: np.ndarray, row: np.ndarray, word: np.ndarray, window: int) -> np.ndarray:
    """Places of a piece where a window of one of its row's ranges begins."""
    out = np.zeros(len(stop), bool)
    stops = np.flatnonzero(stop)
    held = -1
    for c, e in zip(stops[:-1] + 1, stops[1:]):
        r, first, most = int(row[c]), int(word[c]), int(e - c) - window + 1
        if r != held:
            held = r
            start, n = (marks[r].values.field(f).to_numpy() for f in ("start", "n"))
        edge = np.zeros(most + 1, np.int32)
        np.add.at(edge, np.clip(start - first, 0, most), 1)
        np.add.at(edge, np.clip(start + n - first, 0, most), -1)
        out[c:c + most] = np.cumsum(edge[:most]) > 0
    return out


def _windows(window: int):
    """Candidate windows by their names and hashes; those that the task itself has earlier come out as repeats (no name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs = (batch.column(k).to_numpy() for k in (1, 2))
            order = np.lexsort((docs, ids))
            rank = np.empty(len(ids), np.int64)   # of documents; rows of one document are equal
            rank[order] = np.cumsum(np.append(True, (np.diff(ids[order]) != 0) | (np.diff(docs[order]) != 0)))
            pieces = _Pieces(window)
            for _ in pieces.parts(batch.column(3)):
                names, stop, row, word = pieces.take()
                words = Words(names)
                starts, chosen, which = anchors(names, stop, words, window)
                wanted = _wanted(batch.column(4), stop, row, word, window)[starts]
                starts, chosen, which = starts[wanted], chosen[wanted], which[wanted]
                if not len(starts):
                    continue
                hashes = words.hashes(starts, starts + window)
                r, w = row[starts], word[starts]
                order = np.lexsort((w, rank[r], hashes, chosen))
                new = np.ones(len(order), bool)
                new[1:] = (chosen[order[1:]] != chosen[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                first = np.empty(len(order), bool)
                first[order] = (rank[r[order]] == rank[r[lead]]) & (w[order] == w[lead])
                for own, by in ((True, which), (False, r)):
                    at = np.flatnonzero(first == own)
                    if not len(at):
                        continue
                    cut = _stretches(starts[at], by[at])
                    size = np.diff(np.append(cut, len(at)))
                    head = at[cut]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)), pa.int32()), pa.array(hashes[at].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(chosen[head].view(np.int64)) if own else pa.nulls(len(head), pa.int64()), pa.array(ids[r[head]]),
                         pa.array(docs[r[head]]), pa.array(w[head].astype(np.int32)), pa.array(size.astype(np.int32)),
                         lists if own else pa.nulls(len(head), _WINDOWS.field("hashes").type)], schema=_WINDOWS)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name, hash, id, doc and start, all that differ from the first of their name and hash; unnamed rows pass."""
    lead: tuple | None = None   # the first row of the name and hash at the end of the batch before
    for batch in batches:
        if not batch.num_rows:
            continue
        passes = batch.column("name").is_null().to_numpy(zero_copy_only=False)
        name, hashed = (batch.column(k).fill_null(0).to_numpy() for k in ("name", "hash"))
        place = [batch.column(k).to_numpy() for k in ("id", "doc", "start")]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (hashed[1:] != hashed[:-1]) | passes[1:] | passes[:-1]
        if lead is not None and not passes[0] and (name[0], hashed[0]) == lead[:2]:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(name)), -1))
        differs = np.zeros(len(name), bool)
        for k, column in enumerate(place):
            differs |= column != np.where(at >= 0, column[np.maximum(at, 0)], lead[2 + k] if lead else 0)
        if at[-1] >= 0:
            lead = None if passes[-1] else (name[at[-1]], hashed[at[-1]], *(c[at[-1]] for c in place))
        out = pa.Table.from_batches([batch]).select(["id", "doc", "start", "n"]).filter(pa.array(differs | passes))
        yield from out.to_batches()


def _without(window: int):
    """The text without the words of its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            n_words, n_removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            ids, marks = batch.column(1).to_numpy(), batch.column(4)
            for k, text in enumerate(batch.column(3)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words[k] = len(words)
                if marks[k].is_valid:
                    own, start, n = (marks[k].values.field(f).to_numpy() for f in ("id", "start", "n"))
                    start, n = start[own == ids[k]], n[own == ids[k]]
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed[k] = gone.sum()
                    words = [words[i] for i in np.flatnonzero(~gone)]
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_words), pa.array(n_removed)],
                                             names=["id", "text", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, text, n_words, n_removed`` of every row: its words outside windows that occur earlier, joined by one space."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be integers, not {kind}")
    keyed = docs.select(id_.alias("given"), F.coalesce(id_.cast("long"), F.lit(_LAST)).alias("id"),
                        F.xxhash64(text, id_).alias("doc"), text.alias("text"))
    named = keyed.select("doc", "text").mapInArrow(_named(window), "name long, known boolean, doc long, start int, n int")
    # Rows without a name need no answer from others and go anywhere.
    dealt = F.coalesce("name", F.xxhash64("doc", "start"))
    shared = named.repartition(dealt).sortWithinPartitions("name").mapInArrow(_shared, "doc long, start int, n int")
    # Sets: rows given twice bring the same ranges twice.
    ranges = shared.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    near = keyed.join(ranges, "doc").select("given", "id", "doc", "text", "ranges")
    windows = near.mapInArrow(_windows(window), "name long, id long, doc long, start int, n int, hashes array<long>").repartition(dealt)
    single = windows.select("name", "id", "doc", "start", "n", F.posexplode_outer("hashes").alias("k", "hash")).select(
        "name", "hash", "id", "doc", (F.col("start") + F.coalesce("k", F.lit(0))).alias("start"),
        F.when(F.col("k").isNull(), F.col("n")).otherwise(1).alias("n"))
    repeats = single.sortWithinPartitions("name", "hash", "id", "doc", "start").mapInArrow(_later, "id long, doc long, start int, n int")
    gone = repeats.groupBy("doc").agg(F.collect_set(F.struct("id", "start", "n")).alias("ranges"))
    done = keyed.join(gone, "doc", "left").select("given", "id", "doc", "text", "ranges")
    return done.mapInArrow(_without(window), f"`{id_col}` {kind}, text string, n_words long, n_removed long")


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op12_substrings": op12_substrings}
SQL = {"op12_substrings": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) s FROM d),
k AS (SELECT doc_id, s, md5_number(array_to_string(w[s:s + {WINDOW - 1}], ' ')) k FROM x),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) r FROM k) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) i FROM f),
p AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i FROM d),
g AS (SELECT p.doc_id, count(c.i) gone, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) kept
      FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(gone, 0)::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""}
