"""Embedding near-dedup by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of random signs
and a fast Hadamard transform; its hash is the place and sign of its largest
coordinate, and ``HASHES`` independent hashes make one of ``TABLES`` bucket
codes. It also visits the ``PROBES`` buckets that its next largest coordinates
would give. In a bucket the residents (own code) meet each other and the
visitors; every candidate pair is verified with its cosine in double precision,
so nothing below the threshold is linked.

A pair that meets more than once counts once: rows carry their codes of all
tables, and a pair belongs to the first meeting (table, then smaller bucket) that both rows show.
Equal vectors are collapsed before hashing; buckets of any size are compared in
blocks of bounded size that return counts and a spanning forest only.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component links with nothing; vectors of different lengths do not
link; repeated rows are vectors of their own that link with each other; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pairfeat.llm.blocks import by_group, deal
from pairfeat.llm.components import components
from pairfeat.llm.simhash import trees
from pairfeat.session import scratch_dir

THRESHOLD = 0.95
TABLES = 6
HASHES = 2
PROBES = 4
SEED = 20
SMALL = 24


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket codes, a row's own bucket first; x holds unit vectors."""
    n, d = x.shape
    width = max(1 << (d - 1).bit_length(), 2)
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng(SEED)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    top = min(probes + 1, width)
    for t in range(tables):
        place = np.zeros((n, hashes, top), np.int64)
        loss = np.full((n, hashes, top), np.inf)
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice((-1.0, 1.0), width))
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :top]
            at = rows[:, None]
            place[:, k] = 2 * best + (y[at, best] < 0)
            loss[:, k] = size[at, best[:, :1]] - size[at, best]
        weight = (2 * width) ** np.arange(hashes)
        own = (place[:, :, 0] * weight).sum(1)
        out[:, t, 0] = own
        # One hash moved to a lower coordinate, the smallest losses first.
        moved = own[:, None, None] + (place[:, :, 1:] - place[:, :, :1]) * weight[None, :, None]
        order = np.argsort(loss[:, :, 1:].reshape(n, -1), axis=1, kind="stable")[:, :probes]
        out[:, t, 1:1 + order.shape[1]] = np.take_along_axis(moved.reshape(n, -1), order, 1)
        out[:, t, 1 + order.shape[1]:] = own[:, None]
    return out


def _packed(vectors: list, dtype: type) -> list[bytes | None]:
    """The components as bytes; None for a vector that links with nothing."""
    out = []
    for v in vectors:
        ok = v is not None and len(v) > 0 and not any(c is None for c in v)
        x = np.array(v, dtype) if ok else None
        out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
    return out


def _unit(blobs: list[bytes], dtype: type) -> np.ndarray:
    """Unit vectors (rows, double precision) of vectors of one length."""
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)   # squares of very large or small components would leave the range of doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _code_type(dim: int, hashes: int) -> type:
    """The smallest integers that hold the codes of vectors of this length."""
    most = (2 * max(1 << (dim - 1).bit_length(), 2)) ** hashes
    return np.uint16 if most <= 1 << 16 else np.uint32 if most <= 1 << 32 else np.uint64


def _coded(points: DataFrame, dtype: type, tables: int, hashes: int, probes: int) -> DataFrame:
    """``points`` (node, vec, weight) with ``dim`` and ``codes`` (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            dims = np.array([len(v) for v in blobs], np.int64) // np.dtype(dtype).itemsize
            made: list = [None] * len(blobs)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c = codes(_unit([blobs[i] for i in at], dtype), tables, hashes, probes).astype(_code_type(int(d), hashes))
                for i, row in zip(at, c):
                    made[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(made, pa.binary())],
                                             names=[*batch.schema.names, "dim", "codes"])

    return points.mapInArrow(run, "node long, vec binary, weight long, dim int, codes binary")


def _members(coded: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """``tbl, code, dim, node, own``: a point in its own bucket and those it visits."""
    per = 1 + probes
    schema = pa.schema([("tbl", pa.int32()), ("code", pa.int64()), ("dim", pa.int32()), ("node", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, dims, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c = np.frombuffer(b"".join([blobs[i] for i in at]), _code_type(int(d), hashes)).reshape(len(at), tables, per)
                for t in range(tables):
                    # A probe that falls on an earlier bucket of the same row is no second visit.
                    new = np.ones((len(at), per), bool)
                    for p in range(1, per):
                        new[:, p] = (c[:, t, :p] != c[:, t, p:p + 1]).all(1)
                    r, p = np.nonzero(new)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(r), t, np.int32)), pa.array(c[r, t, p].astype(np.int64)),
                        pa.array(np.full(len(r), d, np.int32)), pa.array(node[at][r]), pa.array(p == 0)], schema=schema)

    return coded.select("node", "dim", "codes").mapInArrow(run, "tbl int, code long, dim int, node long, own boolean")


def _kernel(dtype: type, threshold: float, tables: int, hashes: int, probes: int):
    per = 1 + probes
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        tbl, code, dim, left, right, half, node, own = (
            rows.column(k).to_numpy() for k in ("tbl", "code", "dim", "_left", "_right", "_half", "node", "own"))
        weight_col = rows.column("weight").to_numpy()
        blobs, code_blobs = rows.column("vec").to_pylist(), rows.column("codes").to_pylist()
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        count = np.zeros(len(node))   # linked vectors, by row

        def first_here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Pairs for which this bucket is the first meeting."""
            x, y = all_codes[i], all_codes[j]
            meet = np.zeros((len(i), tables, 2), bool)
            meet[:, :, 0] = (y == x[:, :, :1]).any(2)       # j comes to i's bucket
            meet[:, :, 1] = (x == y[:, :, :1]).any(2)       # i comes to j's
            t0 = meet.any(2).argmax(1)
            at = np.arange(len(i))
            home_x, home_y = x[at, t0, 0], y[at, t0, 0]
            only = np.where(meet[at, t0, 0] & meet[at, t0, 1], np.minimum(home_x, home_y),
                            np.where(meet[at, t0, 0], home_x, home_y))
            return (t0 == tbl[i]) & (only == code[i])

        def add(i: np.ndarray, j: np.ndarray) -> None:
            for u, v in ((i, j), (j, i)):
                count[:] += np.bincount(u, weights=weight_col[v], minlength=len(node))

        sizes = np.diff(starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        # Rows of one width at a time (buckets never mix widths).
        for d in np.unique(dim):
            unit = np.zeros((len(node), d))
            all_codes = np.zeros((len(node), tables, per), np.int64)
            mine = np.flatnonzero(dim == d)
            unit[mine] = _unit([blobs[i] for i in mine], dtype)
            all_codes[mine] = np.frombuffer(b"".join([code_blobs[i] for i in mine]), _code_type(int(d), hashes)).reshape(len(mine), tables, per)
            small = (sizes <= SMALL) & (dim[starts[:-1]] == d)
            large = (sizes > SMALL) & (dim[starts[:-1]] == d)
            for k in range(1, int(sizes[small].max(initial=0))):
                i = np.flatnonzero((group[k:] == group[:-k]) & small[group[:-k]])
                j = i + k
                ok = ((left[i] == right[i]) | (half[i] != half[j])) & (own[i] | own[j])
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[ok], j[ok]
                ok = first_here(i, j)
                i, j = i[ok], j[ok]
                if len(i):
                    a.append(node[i])
                    b.append(node[j])
                    add(i, j)
            for g in np.flatnonzero(large):
                s = slice(starts[g], starts[g + 1])
                x = unit[s]
                links = (x @ x.T >= threshold) & (own[s][:, None] | own[s][None, :])
                if left[starts[g]] != right[starts[g]]:
                    links &= half[s][:, None] != half[s][None, :]
                np.fill_diagonal(links, False)
                for seed, members in trees(links):
                    a.append(np.full(len(members), node[s][seed]))
                    b.append(node[s][members])
                i, j = np.nonzero(np.triu(links))
                for lo in range(0, len(i), 200_000):
                    p, q = i[lo:lo + 200_000] + starts[g], j[lo:lo + 200_000] + starts[g]
                    ok = first_here(p, q)
                    add(p[ok], q[ok])
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], schema=schema)
        nodes, at = np.unique(node, return_inverse=True)
        total = np.bincount(at, weights=count, minlength=len(nodes)).astype(np.int64)
        nodes, total = nodes[total > 0], total[total > 0]
        if len(nodes):
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(total)], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row of ``vectors``."""
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    dtype = np.float32 if isinstance(element, FloatType) else np.float64

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = _packed(rows.column(1).to_pylist(), dtype)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made, pa.binary())], names=["id", "vec"])

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    kind = vectors.schema[id_col].dataType.simpleString()
    # Equal vectors are one point. Its node is a number that is written before anything reads it.
    rows = written(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).mapInArrow(
        packed, f"id {kind}, vec binary").withColumn("digest", F.unhex(F.sha2("vec", 256))), "vectors")
    points = written(rows.filter("vec IS NOT NULL").groupBy("digest").agg(
        F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()), "points")
    coded = written(_coded(points.select("node", "vec", "weight"), dtype, tables, hashes, probes), "codes")
    members = _members(coded, tables, hashes, probes)
    bucket = ["tbl", "code", "dim"]
    # Vectors travel once: the narrow rows are dealt out first.
    dealt = deal(members, bucket, "node").select(*bucket, "_left", "_right", "_half", "node", "own")
    carried = dealt.join(coded.select("node", "vec", "codes", "weight"), "node").select(
        *bucket, "_left", "_right", "_half", "node", "own", "vec", "codes", "weight")
    found = written(by_group(carried, [*bucket, "_left", "_right"], _kernel(dtype, threshold, tables, hashes, probes),
                             "a long, b long, n long"), "links")
    n_links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = points.select("digest", "weight", "least", "node").join(n_links, "node", "left").join(
        comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    done = named.join(ids, "component").select(
        "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return rows.select("id", "digest").join(done, "digest", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = {"op1_embeddings": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true)
       AND list_contains(list_transform(e, lambda x: x <> 0), true)),
l AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id n, vec_id c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
m AS (SELECT n, min(c) c FROM r GROUP BY n),
k AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT n_links, m.c component_id, vec_id = m.c kept
FROM v LEFT JOIN k ON k.a = vec_id JOIN m ON m.n = vec_id
"""}
QUERIES = {"op1_embeddings": op1_embeddings}
