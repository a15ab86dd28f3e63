"""Term tables as tries that tasks look up in place.

A table of distinct terms, at any size, becomes shards of sorted terms (range
partitions, so no task and not the driver sees more than one shard). A shard is
a trie in level order: the edges of all nodes as one sorted array of
``256 * parent + byte``, the child of the k-th edge being node ``k + 1``. So a
whole batch of terms is looked up with one binary search a byte, and from a
text's positions all terms that begin there are found together. In a task the
shards stand behind each other as one array with nodes numbered throughout, so
a look-up takes as many searches with a thousand shards as with one.

Shards lie under the checkpoint folder. An executor fetches them once (a folder
that all machines mount is read where it is), turns them into plain arrays in
the folder that Spark keeps for the application's files, and all its Python
workers map these into memory: pages are shared and loaded when touched. Tokens
are never exchanged to meet their term.
"""

from __future__ import annotations

import bisect
import fcntl
import json
import math
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairfeat.operators.suffixes import string_parts
from pairfeat.session import scratch_dir

SHARD_TERMS = 200_000
_TYPES = {"double": np.float64, "float": np.float32, "bigint": np.int64, "int": np.int32}


def built(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(edges, id of the term that ends at each node or -1) of sorted distinct terms."""
    offsets, data = string_parts(terms)
    sizes = np.diff(offsets)
    node = np.zeros(len(terms), np.int64)
    ids = [np.full(1, -1, np.int32)]
    ids[0][0] = 0 if len(terms) and not sizes[0] else -1     # the empty term comes first
    edges = [np.zeros(0, np.int64)]
    count, depth = 1, 0
    active = np.flatnonzero(sizes > 0)
    while len(active):
        key = node[active] * 256 + data[offsets[active] + depth]
        new = np.append(True, np.diff(key) != 0)
        edges.append(key[new])
        node[active] = count + np.cumsum(new) - 1
        depth += 1
        done = sizes[active] == depth
        level = np.full(int(new.sum()), -1, np.int32)
        level[node[active[done]] - count] = active[done]
        ids.append(level)
        count += len(level)
        active = active[~done]
    return np.concatenate(edges), np.concatenate(ids)


@dataclass
class Trie:
    """Tries behind each other, or one of them. Of the tree with number t, the root is node ``root`` and the child of the
    k-th edge (of all) is node ``k + t + 1``; ``edges`` and ``ids`` may be the stretch of one tree alone."""

    edges: np.ndarray
    ids: np.ndarray
    root: int = 0

    def _down(self, node: np.ndarray, byte: np.ndarray, tree: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Children along these bytes, and which of them exist. Nodes count from ``root``."""
        key = (node + self.root) * 256 + byte
        at = np.searchsorted(self.edges, key)
        found = at < len(self.edges)
        found[found] = self.edges[at[found]] == key[found]
        return at + 1 + tree, found

    def find(self, terms: pa.Array, roots: np.ndarray | None = None, trees: np.ndarray | None = None) -> np.ndarray:
        """Id of each term, -1 for those its tree lacks."""
        offsets, data = string_parts(terms)
        sizes = np.diff(offsets)
        node = np.zeros(len(terms), np.int64) if roots is None else roots.copy()
        tree = np.zeros(len(terms), np.int64) if trees is None else trees
        active = np.arange(len(terms))
        out = np.full(len(terms), -1, np.int64)
        depth = 0
        while len(active):
            done = sizes[active] == depth
            out[active[done]] = self.ids[node[active[done]]]
            active = active[~done]
            child, found = self._down(node[active], data[offsets[active] + depth], tree[active])
            node[active] = child
            active = active[found]
            depth += 1
        return out

    def prefixes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """All terms that begin at ``starts`` and end by ``ends``: (numbers of the starts, bytes of the terms, ids), by length."""
        active, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        depth = 0
        while len(active):
            inside = starts[active] + depth < ends[active]
            active, node = active[inside], node[inside]
            child, found = self._down(node, data[starts[active] + depth])
            active, node = active[found], child[found]
            depth += 1
            term = self.ids[node]
            whole = term >= 0
            if whole.any():
                yield active[whole], depth, term[whole].astype(np.int64)


class Opened:
    """A term table in a task: tries by first term, and the value columns in the order of the ids."""

    def __init__(self, folder: str) -> None:
        with open(f"{folder}/shards.json", encoding="utf-8") as f:
            meta = json.load(f)
        self.firsts = [bytes.fromhex(x) for x in meta["firsts"]]
        nodes = np.array(meta["nodes"], np.int64)
        self.roots = np.cumsum(nodes) - nodes
        edges, ids = (_mapped(f"{folder}/{x}.bin", kind) for x, kind in (("edges", np.int64), ("ids", np.int32)))
        self.forest = Trie(edges, ids)
        self.tries = [Trie(edges[r - k:r - k + n - 1], ids[r:r + n], r) for k, (r, n) in enumerate(zip(self.roots.tolist(), nodes.tolist()))]
        self.values = {c: np.load(f"{folder}/{c}.npy", mmap_mode="r") for c in meta["columns"]}

    def find(self, terms: pa.Array) -> np.ndarray:
        """Id of each term (no nulls), -1 for those the table lacks."""
        out = np.full(len(terms), -1, np.int64)
        by = pc.sort_indices(terms).to_numpy()      # neighbours in the table are looked up one after the other
        terms = terms.take(pa.array(by))
        begins = [bisect.bisect_left(terms, first, key=lambda t: t.as_py().encode("utf-8", "surrogatepass")) for first in self.firsts]
        home = np.searchsorted(begins, np.arange(len(terms)), "right") - 1      # of sorted terms a shard has a stretch
        at = np.flatnonzero(home >= 0)
        if len(at):
            out[by[at]] = self.forest.find(terms.take(pa.array(at)), self.roots[home[at]], home[at])
        return out

    def find_all(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The distinct terms of a flat string column and, for every entry, (its number among them, its id or -1 for a null)."""
        coded = column.dictionary_encode()
        ids = np.append(self.find(coded.dictionary), -1)
        code = coded.indices.fill_null(len(coded.dictionary)).to_numpy().astype(np.int64)
        return coded.dictionary, np.stack((code, ids[code]))

    def prefixes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        for trie in self.tries:
            yield from trie.prefixes(data, starts, ends)


def _mapped(path: str, kind: type) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


_opened: dict[str, Opened] = {}


@dataclass(frozen=True)
class TermTable:
    """Where a written term table lies; small enough to travel with every task."""

    path: str
    name: str
    mounted: bool
    n_terms: int

    def open(self) -> Opened:
        """Called in tasks; arrays are made once for an executor and opened once for a worker."""
        if self.name not in _opened:
            root = SparkFiles.getRootDirectory()
            folder = f"{root}/{self.name}.maps"
            if not os.path.isdir(folder):
                with open(f"{folder}.lock", "w", encoding="utf-8") as lock:
                    fcntl.flock(lock, fcntl.LOCK_EX)      # one worker writes, the others wait
                    if not os.path.isdir(folder):
                        made = tempfile.mkdtemp(dir=root)
                        try:
                            _write_arrays(re.sub(r"^file:/*", "/", self.path) if self.mounted else SparkFiles.get(self.name), made)
                        except BaseException:
                            shutil.rmtree(made)
                            raise
                        os.rename(made, folder)
            _opened[self.name] = Opened(folder)
        return _opened[self.name]


def _write_arrays(source: str, folder: str) -> None:
    """Fetched shards as plain arrays, one shard in memory at a time."""
    parts = [pq.ParquetFile(f"{source}/{f}") for f in sorted(os.listdir(source)) if f.endswith(".parquet")]
    order = sorted((first, k, g, i) for k, p in enumerate(parts) for g in range(p.num_row_groups)
                   for i, first in enumerate(p.read_row_group(g, ["first"]).column(0).to_pylist()))
    columns: list[str] = []
    files: dict[str, list] = {}
    nodes: list[int] = []
    first, terms = 0, 0      # of the next shard's nodes and terms
    with open(f"{folder}/edges.bin", "wb") as edges_file, open(f"{folder}/ids.bin", "wb") as ids_file:
        for _, k, g, i in order:
            row = parts[k].read_row_group(g).slice(i, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int32)
            edges_file.write((np.frombuffer(row["edges"], np.int64) + 256 * first).tobytes())
            ids_file.write(np.where(ids >= 0, ids + np.int32(terms), ids).tobytes())
            for c in row["columns"]:
                values = np.frombuffer(c["data"], c["kind"])
                if c["name"] not in files:
                    total = sum(p.read_row_group(g, ["n"]).column(0).to_numpy().sum() for p in parts for g in range(p.num_row_groups))
                    shape = (int(total), c["width"]) if c["width"] else (int(total),)
                    columns.append(c["name"])
                    files[c["name"]] = [np.lib.format.open_memmap(f"{folder}/{c['name']}.npy", "w+", values.dtype, shape), 0]
                out, at = files[c["name"]]
                out[at:at + row["n"]] = values.reshape((row["n"], *out.shape[1:]))
                files[c["name"]][1] += row["n"]
            nodes.append(len(ids))
            first += len(ids)
            terms += row["n"]
    for out, _ in files.values():
        out.flush()
    with open(f"{folder}/shards.json", "w", encoding="utf-8") as f:
        json.dump({"firsts": [x[0].hex() for x in order], "columns": columns, "nodes": nodes}, f)


_SHARDS = ("first binary, n int, edges binary, ids binary, "
           "columns array<struct<name:string,kind:string,width:int,data:binary>>")


def write_terms(table: DataFrame, n_terms: int, columns: tuple[str, ...], term: str = "term", shard_terms: int | None = None) -> TermTable:
    """``table`` (distinct terms) with its numeric ``columns`` (or arrays of one width) as a term table.

    A null term is left out; a null value counts as 0."""
    spark = table.sparkSession
    per = SHARD_TERMS if shard_terms is None else shard_terms
    kinds, widths = {}, {}
    for c in columns:
        kind = table.schema[c].dataType
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        kinds[c] = np.dtype(_TYPES[inner.simpleString()])
        widths[c] = int(table.agg(F.max(F.size(c))).first()[0] or 0) if isinstance(kind, T.ArrayType) else 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            terms = rows.column(0).combine_chunks() if isinstance(rows.column(0), pa.ChunkedArray) else rows.column(0)
            edges, ids = built(terms)
            cells = []
            for c in columns:
                values = rows.column(c).combine_chunks()
                flat = (values.flatten() if widths[c] else values).fill_null(0).to_numpy(zero_copy_only=False).astype(kinds[c])
                cells.append({"name": c, "kind": kinds[c].str, "width": widths[c], "data": flat.tobytes()})
            held.clear()
            return pa.RecordBatch.from_pylist([{"first": terms[0].as_py().encode("utf-8", "surrogatepass"), "n": len(terms), "edges": edges.tobytes(),
                                                "ids": ids.tobytes(), "columns": cells}], schema=_arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, per):
                piece = batch.slice(lo, per)
                if held and sum(b.num_rows for b in held) + piece.num_rows > per:
                    yield shard()
                held.append(piece)
        if held:
            yield shard()

    path = scratch_dir(spark, "terms")
    parts = max(1, math.ceil(n_terms / per))
    (table.filter(F.col(term).isNotNull()).select(F.col(term).alias("term"), *columns).repartitionByRange(parts, "term")
     .sortWithinPartitions("term").mapInArrow(shards, _SHARDS).write.parquet(path))
    mounted = re.match(r"(file:)?/", path) is not None
    if not mounted:
        spark.sparkContext.addFile(path, recursive=True)
    return TermTable(path, os.path.basename(path), mounted, n_terms)


_arrow = pa.schema([("first", pa.binary()), ("n", pa.int32()), ("edges", pa.binary()), ("ids", pa.binary()),
                    ("columns", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("width", pa.int32()), ("data", pa.binary())])))])
