"""Embedding whitening: centred covariance in Spark, leading components by Sturm counts and inverse iteration.

Entries become whole numbers, ``x = floor(64 c) + 1000000``. The fit list is
each distinct vector once. Three passes go over it: the number of vectors ``n``
and the sums ``S``; the covariance ``V``, centred before multiplying as
``(n x - S) / n`` (exact up to the division); and the covariance of the whitened
vectors, which should be the identity. Each task sends one matrix, added up by
rows in a shuffle; only sums of the width of a vector and matrices of its square
reach the driver.

There Householder reflections make ``V`` tridiagonal; counts of sign changes
(Sturm) bisect for the leading eigenvalues alone; inverse iteration finds their
vectors, made orthogonal again to others of their cluster; the reflections take
them back. Mean and components are broadcast and every vector is projected.

Defined results: rows whose vector is null or has a null or non-finite entry are
dropped; others, repeated or with null or repeated ids, come back row by row;
vectors of different widths are fits of their own; empty vectors and fits
without variance have no components, and of a fit of lower rank those whose
eigenvalue is zero to double precision are left out; 64 times an entry beyond
2**61 either way counts as 2**61; a deviation that no long holds is null; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.session import scratch_dir

COMPONENTS = 16
SCALE, BASE = 64, 1_000_000
LIMIT = 1 << 61
SEED = 11
EPS = np.finfo(np.float64).eps


# ---- eigenvectors ----

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and the reflections (unit vectors)."""
    a = v.astype(np.float64).copy()
    n = len(a)
    turns = []
    for k in range(n - 2):
        u = a[k + 1:, k].copy()
        size = np.abs(u[1:]).max(initial=0)
        if size == 0:
            turns.append(np.zeros(n - k - 1))
            continue
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        turns.append(u)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        w = 2 * (p - (u @ p) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def taken_back(z: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """Columns in the coordinates before the reflections."""
    z = z.copy()
    for k in range(len(turns) - 1, -1, -1):
        z[k + 1:] -= 2 * np.outer(turns[k], turns[k] @ z[k + 1:])
    return z


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative pivots of the shifted matrix."""
    least = np.finfo(np.float64).tiny * max(1.0, float((off * off).max(initial=0)))
    count = np.zeros(len(shifts), np.int64)
    q = np.ones(len(shifts))
    for k, d in enumerate(diagonal):
        q = d - shifts - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until no double lies between."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    size = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)))
    lo = np.full(k, (diagonal - reach).min() - 4 * EPS * n * size)
    hi = np.full(k, (diagonal + reach).max() + 4 * EPS * n * size)
    rank = n - np.arange(k)   # as many eigenvalues are at most the wanted one
    while True:
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi) | (hi - lo <= EPS * EPS * size)):
            return mid
        more = below(diagonal, off, mid) >= rank
        hi, lo = np.where(more, mid, hi), np.where(more, lo, mid)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of the shifted tridiagonal system by elimination with row exchange; pivots are at least ``least``."""
    n = len(diagonal)
    b = right.copy()
    main, one, two = diagonal - shift, np.append(off, 0.0), np.zeros(n)   # of the upper triangle
    for k in range(n - 1):
        under = off[k]
        if abs(main[k]) >= abs(under):
            if abs(main[k]) < least:
                main[k] = least
            f = under / main[k]
            main[k + 1] -= f * one[k]
            b[k + 1] -= f * b[k]
        else:
            f = main[k] / under
            main[k], one[k], main[k + 1] = under, main[k + 1], one[k] - f * main[k + 1]
            two[k], one[k + 1] = one[k + 1], -f * one[k + 1]
            b[k], b[k + 1] = b[k + 1], b[k] - f * b[k + 1]
    if abs(main[n - 1]) < least:
        main[n - 1] = least
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - (one[k] * x[k + 1] if k + 1 < n else 0) - (two[k] * x[k + 2] if k + 2 < n else 0)) / main[k]
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors as columns; values nearer than a thousandth of the norm form a cluster."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    rng = np.random.default_rng(SEED)
    out = np.zeros((n, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        # Equal values are set apart by the last digits, as their systems would else be the same.
        shift = value - (k - first) * 4 * EPS * norm
        x = rng.normal(size=n)
        for _ in range(rounds):
            x = _solved(diagonal, off, shift, x / np.abs(x).max(), EPS * norm)
            for _ in range(2):
                x = x / np.linalg.norm(x)
                x = x - out[:, first:k] @ (out[:, first:k].T @ x)
            x = x / np.linalg.norm(x)
        out[:, k] = x
    return out


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and unit eigenvectors as columns; none that is zero to double precision."""
    size = float(np.abs(v).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off, turns = tridiagonal(v / size)
    values = leading_values(diagonal, off, min(k, len(v)))
    values = values[values > len(v) * EPS * np.trace(v / size)]
    z = taken_back(leading_vectors(diagonal, off, values), turns)
    return values * size, z / np.linalg.norm(z, axis=0)


# ---- Spark ----

@dataclass
class Fit:
    """What is known of the vectors of one width."""

    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray | None = None
    components: np.ndarray | None = None   # columns
    identity_error: float = 0.0

    def moved(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` of rows: int64, or Python integers where those could overflow."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * most < LIMIT and all(abs(s) < LIMIT for s in self.sums):
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.moved(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        m = self.moved(x)
        most = max(int(m.max(initial=0)), -int(m.min(initial=0)))
        if m.dtype != object and most * most * m.shape[1] < 1 << 63:
            return (m * m).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in (m.astype(object) ** 2).sum(1).tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def _coded(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x``: whole numbers as bytes, of rows that are not dropped."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts, sizes = lists.offsets.to_numpy(), np.diff(lists.offsets.to_numpy())
            values = lists.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.clip(np.nan_to_num(np.floor(SCALE * values)), -float(LIMIT), float(LIMIT)).astype(np.int64) + BASE
            at = np.flatnonzero(ok)
            made = [x[s:s + n].tobytes() for s, n in zip(starts[at], sizes[at])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(made, pa.binary())], names=["id", "x"])

    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(
        run, f"id {kind}, x binary")


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, vectors) of a batch."""
    blobs = column.to_pylist()
    widths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
    for w in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == w)
        yield int(w), at, np.frombuffer(b"".join([blobs[i] for i in at]), np.int64).reshape(len(at), w)


def _matrices(points: DataFrame, matrix: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each width the sum of ``matrix(width, vectors)`` over all points. Tasks add up their own, then rows are added across tasks."""
    schema = "width int, row int, cells array<double>"

    def rows(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([w for w, _ in sums], pa.int32()), pa.array([r for _, r in sums], pa.int32()),
            pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["width", "row", "cells"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, _, x in _by_width(batch.column(0)):
                m = matrix(w, x)
                sums[w] = sums[w] + m if w in sums else m
        yield rows({(w, r): row for w, m in sums.items() for r, row in enumerate(m)})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for w, r, cells in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2)):
                row = cells.values.to_numpy()
                sums[w, r] = sums[w, r] + row if (w, r) in sums else row
        yield rows(sums)

    found = points.mapInArrow(partial, schema).repartition("width", "row").mapInArrow(added, schema).collect()
    out: dict[int, np.ndarray] = {}
    for r in sorted(found, key=lambda r: (r["width"], r["row"])):
        out.setdefault(r["width"], []).append(r["cells"])
    return {w: np.array(m) for w, m in out.items()}


def _sums(points: DataFrame) -> dict[int, Fit]:
    """Number and sums of the points, by width. Sums travel as text: they may exceed a long."""
    schema = "width int, n long, sums array<string>"

    def run(total: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, list] = {}
            for batch in batches:
                for w, n, s in total(batch):
                    old = kept.setdefault(w, [0, np.zeros(w, object)])
                    old[0] += n
                    old[1] = old[1] + s
            yield pa.RecordBatch.from_arrays([
                pa.array(kept, pa.int32()), pa.array([n for n, _ in kept.values()], pa.int64()),
                pa.array([list(map(str, s)) for _, s in kept.values()], pa.list_(pa.string()))], names=["width", "n", "sums"])
        return go

    def of_points(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for w, _, x in _by_width(batch.column(0)):
            most = max(int(x.max()), -int(x.min()))
            yield w, len(x), (x if most * len(x) < LIMIT else x.astype(object)).sum(0).astype(object)

    def of_sums(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for r in batch.to_pylist():
            yield r["width"], r["n"], np.array(list(map(int, r["sums"])), object)

    found = points.mapInArrow(run(of_points), schema).repartition("width").mapInArrow(run(of_sums), schema).collect()
    return {r["width"]: Fit(r["n"], list(map(int, r["sums"]))) for r in found}


def fit(points: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Means and components of ``points`` (x: distinct vectors as bytes), by width; those without a component are left out."""
    fits = _sums(points)

    def covariance(w: int, x: np.ndarray) -> np.ndarray:
        y = fits[w].centred(x)
        return y.T @ y

    for w, m in _matrices(points, covariance).items():
        v = m / fits[w].n
        fits[w].values, fits[w].components = leading((v + v.T) / 2, components)
        fits[w].trace = float(np.trace(v))
    fits = {w: f for w, f in fits.items() if f.values is not None and len(f.values)}

    def of_whitened(w: int, x: np.ndarray) -> np.ndarray:
        """Sums and products of whitened vectors (none for a width without components)."""
        if w not in fits:
            return np.zeros((0, 0))
        y = fits[w].whitened(x)
        return np.vstack((y.sum(0), y.T @ y))

    for w, m in _matrices(points, of_whitened).items():
        mean = m[0] / fits[w].n
        fits[w].identity_error = float(np.abs(m[1:] / fits[w].n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every vector and component."""
    spark = vectors.sparkSession
    coded = _coded(vectors, id_col, vector_col)
    path = scratch_dir(spark, "fit-list")
    coded.select("x").distinct().write.parquet(path)
    fits = spark.sparkContext.broadcast(fit(spark.read.parquet(path), components))
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, at, x in _by_width(batch.column(1)):
                f = fits.value.get(w)
                if f is None:
                    continue
                k = len(f.values)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, f.n)), pa.array(f.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(f.whitened(x).ravel()), pa.array(np.tile(f.values / f.trace, len(at))),
                    pa.array(np.full(len(at) * k, f.identity_error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return coded.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, "
                                 "explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op11_whitening": op11_whitening}
