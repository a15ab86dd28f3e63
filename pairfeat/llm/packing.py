"""Harmonic packing of token sequences.

Classes are reciprocals of the capacity: class k holds pieces of ``capacity / 2^k``
tokens and fills a bin (a sequence) with exactly ``2^k`` of them. A document is
cut along the binary digits of its token count, largest piece first, so every
piece has the exact size of its class and a full bin has no padding.

Each task packs its own rows, class by class, with at most one open bin per
class in memory: no shuffle, no state between tasks, and a lost task is redone
alone (its sequence ids come from its partition number). Bins still open at the
end hold m < 2^k pieces; they go out as sequences of as many pieces as the
binary digits of m say, whose lengths are powers of two.

Defined results: null text counts as empty; an empty text is the end token
alone; repeated rows are packed once each; a null id stays null; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 4096
#: Fixed value: the id that ends each document.
END = 2
#: Parts (words) whose ids a Python worker remembers, about 0.2 KB each; past it the memory starts anew.
CACHE_PARTS, CACHE_WORDS = 600_000, 100_000
#: Rows and bytes that a task holds back before it hands on a batch.
BATCH_ROWS, BATCH_BYTES = 20_000, 16 << 20


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordCache:
    """Token ids of whole texts as little-endian uint32 bytes, remembered part by part.

    The tokenizer lower-cases, cuts at white space and between letter runs,
    single digits and other runs, and then merges inside each part alone. Texts
    of Latin letters, digits and plain marks are cut by ``PART`` in the same way
    and each part's ids come from the tokenizer's own model, once. A text with
    anything else goes word by word (no rule of the tokenizer reaches across
    white space); one with control characters that only Python takes for white
    space, or with the special tokens' strings, is encoded in one piece.
    """

    WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
    #: No apostrophe: the tokenizer has rules of its own for it.
    PART = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # The byte alphabet of byte-level models: printable bytes stand for themselves, the rest follow from 256 on.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = str.maketrans({chr(b): chr(256 + k) for k, b in enumerate(rest)})

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes | None:
        """Ids by parts, or None where ``PART`` does not cover the text."""
        low = text.lower()
        parts = self.PART.findall(low)
        if "".join(parts) != "".join(low.split()):
            return None
        known = self.parts
        new = [p for p in set(parts) if p not in known]
        if len(known) + len(new) > CACHE_PARTS:
            known.clear()
            new = list(set(parts))
        for p in new:
            known[p] = self._part(p)
        return b"".join([known[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if any(c in text for c in self.WHOLE):
            return self._whole(text)
        ids = self._plain(text)
        if ids is not None:
            return ids
        out = []
        for w in text.split():
            if w not in self.words:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                ids = self._plain(w)
                self.words[w] = self._whole(w) if ids is None else ids
            out.append(self.words[w])
        return b"".join(out)


#: One memory for each Python worker process and tokenizer file; it outlives a task.
_CACHES: dict[str, WordCache] = {}


def cache_for(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def _packer(path: str, capacity: int, id_type: pa.DataType):
    top = capacity.bit_length() - 1
    schema = pa.schema([("id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    end = END.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache_for(path)
        sequence = TaskContext.get().partitionId() << 40
        open_bins: list[list[tuple]] = [[] for _ in range(top + 1)]
        out: list[tuple] = []
        held = 0

        def close(pieces: list[tuple], size: int) -> None:
            nonlocal sequence, held
            for k, piece in enumerate(pieces):
                out.append((*piece, sequence, k * size))
            sequence += 1
            held += len(pieces) * size * 4

        def batch() -> pa.RecordBatch:
            nonlocal held
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            held = 0
            return made

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                ids = words.encode(text.as_py() or "") + end
                n = len(ids) // 4
                start = 0
                while start < n:
                    k = min((n - start).bit_length() - 1, top)
                    size = 1 << k
                    bin_ = open_bins[k]
                    bin_.append((doc, start, size, ids[4 * start:4 * (start + size)], n))
                    start += size
                    if len(bin_) << k == capacity:
                        close(bin_, size)
                        open_bins[k] = []
                if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch()
        for k, bin_ in enumerate(open_bins):
            while bin_:
                take = 1 << (len(bin_).bit_length() - 1)
                close(bin_[:take], 1 << k)
                bin_ = bin_[take:]
        if out:
            yield batch()

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two: its classes are its halves")
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    fn = _packer(tokenizer or default_tokenizer(), capacity, to_arrow_type(kind))
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        fn, f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
