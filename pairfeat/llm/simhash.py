"""SimHash near-dedup by anchor-point covering.

Fingerprints are cut into two 32-bit halves; two fingerprints within three bits
agree to one bit in one half at least. In each half the anchors are the words
of the perfect [31, 26] Hamming code over its lower 31 bits: every point has
one anchor within radius 1 (its home), so a fingerprint is replicated to the
anchors within 2 (covering radius plus the half's threshold): 16 of them, or 1
where the point is an anchor itself. If two halves differ by a bit, the one
meets the other at its home. Each anchor compares its fingerprints to each other,
in blocks of bounded size; whole fingerprints decide, so nothing is missed and
nothing is linked in excess.

Equal fingerprints are collapsed first (aggregated before the shuffle), so
exact copies, however many, are one point.

Defined results: null text counts as empty; a text without words has
fingerprint zero and is linked like any other; repeated rows have equal results;
a null id never names a component unless all ids in it are null; an empty
table gives an empty one; other columns are ignored by ``group`` and kept by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfeat.llm.blocks import by_group, deal
from pairfeat.llm.components import components
from pairfeat.llm.native import content
from pairfeat.session import scratch_dir

SHINGLE = 3
MAX_BITS = 3
#: Fixed value: the seed of the shingles' XXH64.
SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Groups up to this size are compared by shifts over a whole batch, larger ones as a matrix.
SMALL = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII case and blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo:lo + CHUNK].tolist(), ends[lo:lo + CHUNK].tolist())], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in rows.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], fps], names=[*keep, "fp"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = ", ".join([f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep] + ["fp long"])
    return chosen.mapInArrow(run, schema)


def _replicas(points: DataFrame) -> DataFrame:
    """``bucket, home, fp``: each fingerprint at every anchor within reach, in both halves."""
    def syndrome(x: Column) -> Column:
        parts = []
        for j in range(5):
            mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
            parts.append(F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), j))
        return sum(parts[1:], parts[0])

    def flip(x: Column, place: Column) -> Column:
        return x.bitwiseXOR(F.element_at(F.array(*[F.lit(1 << k) for k in range(31)]), place).cast("long"))

    halves = points.select("fp", F.explode(F.array(*[F.struct(
        F.lit(h).alias("half"), F.shiftright("fp", 32 * h).bitwiseAND(F.lit((1 << 31) - 1)).alias("x")) for h in (0, 1)])).alias("h"))
    placed = halves.select("fp", "h.half", "h.x").withColumn("s", syndrome(F.col("x")).cast("int"))
    far = F.transform(F.filter(F.sequence(F.lit(1), F.lit(31)), lambda a: a < a.bitwiseXOR(F.col("s"))),
                      lambda a: flip(flip(F.col("x"), a), a.bitwiseXOR(F.col("s"))))
    near = F.when(F.col("s") == 0, F.col("x")).otherwise(flip(F.col("x"), F.greatest("s", F.lit(1))))
    anchors = F.when(F.col("s") == 0, F.array(near)).otherwise(F.concat(F.array(near), far))
    spread = placed.select("fp", "half", F.posexplode(anchors).alias("at", "anchor"))
    return spread.select((F.col("half").cast("long") * (1 << 31) + F.col("anchor")).alias("bucket"),
                         (F.col("at") == 0).alias("home"), "fp")


def _kernel(max_bits: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y) <= max_bits

    def run(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right, half = (rows.column(k).to_numpy() for k in ("_left", "_right", "_half"))
        home = rows.column("home").to_numpy()
        fp = rows.column("fp").to_numpy().view(np.uint64)
        sizes = np.diff(starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes <= SMALL
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        inner = left == right
        for k in range(1, int(sizes[small].max(initial=0))):
            i = np.flatnonzero((group[k:] == group[:-k]) & small[group[:-k]])
            j = i + k
            i, j = (v[(inner[i] | (half[i] != half[j])) & (home[i] | home[j]) & close(fp[i], fp[j])] for v in (i, j))
            a.append(fp[i])
            b.append(fp[j])
        for g in np.flatnonzero(~small):
            at = slice(starts[g], starts[g + 1])
            x, own, side = fp[at], home[at], half[at]
            links = close(x[:, None], x[None, :]) & (own[:, None] | own[None, :])
            if not inner[starts[g]]:
                links &= side[:, None] != side[None, :]
            for seed, members in trees(links):
                a.append(np.full(len(members), x[seed]))
                b.append(x[members])
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].view(np.int64)) for k in (0, 1)], schema=schema)

    return run


def trees(links: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Components of a symmetric link matrix with two members or more: (first member, the others)."""
    free = links.any(0)
    while free.any():
        seed = int(np.argmax(free))
        free[seed] = False
        found = front = np.array([seed])
        while len(front):
            front = np.flatnonzero(links[front].any(0) & free)
            free[front] = False
            found = np.concatenate((found, front))
        yield seed, found[1:]


def _link_points(points: DataFrame, max_bits: int) -> DataFrame:
    """``fp, component`` (a fingerprint of the component) for fingerprints that link with another."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with covering radius 1 reach three bits at most")
    replicas = _replicas(points)
    homes = replicas.filter("home").select("bucket").distinct()
    met = replicas.join(homes, "bucket", "left_semi")
    dealt = deal(met, ["bucket"], "fp").select("bucket", "_left", "_right", "_half", "home", "fp")
    links = by_group(dealt, ["bucket", "_left", "_right"], _kernel(max_bits), "a long, b long")
    return components(links).select(F.col("node").alias("fp"), "component")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
          max_bits: int = MAX_BITS) -> DataFrame:
    """``id, fp, component_id`` of every row: the smallest id reachable by links, the row's own included."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "simhash")
    with_fingerprints(docs, [id_col], text_col, shingle).write.parquet(path)
    prints = spark.read.parquet(path)
    points = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    joined = points.join(_link_points(points.select("fp"), max_bits), "fp", "left")
    named = joined.withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "component").join(ids, "component").select("fp", "component_id"), "fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: smallest id (null last), then row hashes; equal rows are one."""
    spark = docs.sparkSession
    columns = content(docs)
    # The row's own columns travel as one, so none of them can clash with a working column.
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"),
                        F.xxhash64(*columns).alias("_k1"), F.hash(*columns).alias("_k2"))
    path = scratch_dir(spark, "simhash")
    with_fingerprints(keyed, ["_id", "_k1", "_k2"], "_t", shingle).write.parquet(path)
    prints = spark.read.parquet(path)
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_k1", "_k2")).alias("best")
    points = prints.groupBy("fp").agg(best)
    joined = points.join(_link_points(points.select("fp"), max_bits), "fp", "left")
    kept = joined.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("best").alias("best"))
    # The rows of the kept keys; the second step merges equal rows and needs no further shuffle.
    chosen = keyed.select("_doc", "_k1", "_k2").join(kept.select("best._k1", "best._k2"), ["_k1", "_k2"], "left_semi")
    return chosen.dropDuplicates(["_k1", "_k2"]).select("_doc.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
