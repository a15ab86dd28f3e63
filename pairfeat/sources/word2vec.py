"""The word2vec binary format as a Spark data source.

A file is a line ``<terms> <width>``, then for every term its bytes, a blank,
``width`` float32 numbers and, by some writers, a line end. Records vary in
length and hold arbitrary bytes, so a reader that starts in the middle must find
a record: it tries each byte after a blank's possible place until ``CHAIN``
records in a row make sense (a term without blanks and control characters in
UTF-8, finite numbers of sane size), and begins with the one after. Ranges of
bytes are read in parallel; a reader checks that its last record ends where the
next range begins.

Files are opened by path, so the folder must be one that all machines mount.
``writer`` writes one part file a task; every part has its own header, and a
folder of parts is read as one table.

Where a range begins is no matter of its reader alone: the reader before it finds
the same place by the same rule, and stops there.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, records that must make sense in a row, the longest term, the largest number.
RANGE, CHAIN, LONGEST, LARGEST = 32 << 20, 4, 4096, 1e6
SCHEMA = "term string, vec array<float>"


def _local(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def _parts(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        return [f"{path}/{f}" for f in sorted(os.listdir(path)) if f.endswith(".bin")]
    return [path]


def _header(path: str) -> tuple[int, int, int]:
    """Terms, width and bytes of the first line."""
    with open(path, "rb") as f:
        line = f.readline(100)
    n, width = map(int, line.split())
    return n, width, len(line)


@dataclass
class _Range(InputPartition):
    path: str
    width: int
    first: int     # byte of the first record of the file
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(None)


def _record(data: bytes, at: int, width: int) -> tuple[bytes, int, int] | None:
    """(term, start of its numbers, start of the next record) of what may be a record, or None."""
    if data[at:at + 1] == b"\n":
        at += 1
    blank = data.find(b" ", at, at + LONGEST)
    if blank <= at or blank + 1 + 4 * width > len(data):
        return None
    return data[at:blank], blank + 1, blank + 1 + 4 * width


def _sane(data: bytes, at: int, width: int) -> int | None:
    """The start of the next record, if one that makes sense begins here."""
    found = _record(data, at, width)
    if found is None:
        return None
    term, numbers, after = found
    try:
        text = term.decode("utf-8")
    except UnicodeDecodeError:
        return None
    values = np.frombuffer(data, "<f4", width, numbers)
    if any(ord(c) < 32 for c in text) or not np.isfinite(values).all() or np.abs(values).max(initial=0) > LARGEST:
        return None
    return after


def _begins(data: bytes, at: int, width: int, whole: bool) -> bool:
    """Whether ``CHAIN`` records make sense from here on (fewer at the end of the file)."""
    for _ in range(CHAIN):
        if whole and data[at:at + 2] in (b"", b"\n"):
            return True
        after = _sane(data, at, width)
        if after is None:
            return False
        at = after
    return True


def _next_start(data: bytes, width: int, whole: bool) -> int:
    """Where a record surely begins: after the first stretch that makes sense as one. Its own term may be taken too long,
    by bytes of the number before it, but not its end."""
    for at in range(len(data)):
        if _begins(data, at, width, whole):
            return _sane(data, at, width) or len(data)
    return len(data)


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[_Range]:
        out = []
        for part in _parts(self.path):
            _, width, first = _header(part)
            total = os.path.getsize(part)
            out += [_Range(part, width, first, at, min(at + self.size, total)) for at in range(first, total, self.size)]
        return out or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.path:
            return
        ahead = (CHAIN + 2) * (LONGEST + 4 * p.width + 2)      # holds a start that is sure, whatever the end of the range cuts
        total = os.path.getsize(p.path)
        with open(p.path, "rb") as f:
            f.seek(p.start)
            data = f.read(p.end - p.start + ahead)
        whole = p.start + len(data) == total
        at = 0 if p.start == p.first else _next_start(data[:ahead], p.width, whole and len(data) <= ahead)
        size = p.end - p.start
        stop = len(data) if p.end == total else size + _next_start(data[size:], p.width, whole)
        terms: list[str] = []
        places: list[int] = []
        while at < stop and not (whole and data[at:at + 2] in (b"", b"\n")):
            found = _record(data, at, p.width)
            if found is None:
                raise ValueError(f"no record at byte {p.start + at} of {p.path}")
            terms.append(found[0].decode("utf-8", "replace"))
            places.append(found[1])
            at = found[2]
        if at > stop:
            raise ValueError(f"records of {p.path} do not meet at byte {p.start + stop}")
        if terms:
            values = np.stack([np.frombuffer(data, "<f4", p.width, k) for k in places])
            offsets = pa.array(np.arange(len(terms) + 1, dtype=np.int32) * p.width)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["term", "vec"])


class Word2Vec(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word2vec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE))))


def read_word2vec(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(term, vec) of a word2vec binary file, or of a folder of such parts."""
    spark.dataSource.register(Word2Vec)
    return spark.read.format("word2vec").option("rangeBytes", range_bytes).load(path)


def write_word2vec(vectors: DataFrame, path: str) -> None:
    """``vectors`` (term, vec of one width) as a folder of parts. Terms that are null, empty or hold a blank or a control
    character cannot be written and are left out."""
    folder = _local(path)
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        n = 0
        if rows is not None:
            column = rows.column(1).combine_chunks()
            width = len(column[0])
            values = column.flatten().to_numpy().astype("<f4").reshape(-1, width)
            n = rows.num_rows
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}.bin"
            with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                f.write(f"{n} {width}\n".encode())
                for term, row in zip(rows.column(0).to_pylist(), values):
                    f.write(term.encode() + b" " + row.tobytes() + b"\n")
            os.replace(f.name, name)     # a retried task writes the same part
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ok = F.col("term").isNotNull() & (F.col("term") != "") & ~F.col("term").rlike(r"[\x00-\x20]")
    vectors.filter(ok).select("term", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
