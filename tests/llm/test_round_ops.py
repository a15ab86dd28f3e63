"""Whitening, substring dedup and spelling variants against plain Python on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pairfeat.llm import blocks, spelling, substrings, whitening

# ---- whitening ----


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 40])
def test_leading_eigenvectors(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q, _ = np.linalg.qr(a)
    twice = (q * np.where(np.arange(n) < 3, 5.0, 1.0)) @ q.T
    low = rng.normal(size=(n, min(n, 4)))
    for v in (a @ a.T, 3 * np.eye(n), (twice + twice.T) / 2, low @ low.T, np.zeros((n, n)), 1e-200 * (a @ a.T), 1e200 * (a @ a.T)):
        e, z = whitening.leading(v)
        size = max(np.abs(v).max(), 1e-300)
        want = np.linalg.eigvalsh(v / size)[::-1]
        assert len(e) == min(16, int((want > 1e-12 * max(want[0], 1e-300)).sum()))
        assert np.allclose(e / size, want[:len(e)], rtol=0, atol=1e-12 * n)
        assert np.abs((v / size) @ z - z * (e / size)).max(initial=0) < 1e-11
        assert np.abs(z.T @ z - np.eye(len(e))).max(initial=0) < 1e-12


def _brute_white(x):
    """(n, deviations, whitened up to sign, explained) of whole-number rows."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    y = (n * u - s) / n
    e, z = np.linalg.eigh(y.T @ y / n)
    e, z = e[::-1][:16], z[:, ::-1][:, :16]
    keep = e > 1e-10 * e.sum()
    e, z = e[keep], z[:, keep]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ (z / np.sqrt(e)), e / np.trace(y.T @ y / n)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 20)) * np.linspace(2, 0.5, 20)
    rows = [(i, [float(v) for v in base[i % 60]]) for i in range(80)]   # 20 rows are given twice
    odd = [(100, None), (101, [1.0, None]), (102, [float("nan")] * 20), (103, [float("inf")] * 20), (104, []), (105, [2.0, 3.0, 4.0]), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, component string")
    got = whitening.whiten(docs).orderBy("vec_id", "component").collect()
    none, got = got[:16], got[16:]
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1000000
    n, dev, white, share = _brute_white(x)
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, k) for i in range(80) for k in range(1, 17)]
    assert {r["n"] for r in got} == {n} and [r["deviation"] for r in got[::16]] == dev.tolist()
    w = np.array([r["whitened"] for r in got]).reshape(80, 16)
    assert np.abs(w * np.sign((w * white).sum(0)) - white).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:16]], share, rtol=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert [r["whitened"] for r in none] == [r["whitened"] for r in got[:16]]


def test_whitening_of_few_and_large(spark):
    schema = "vec_id string, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 3, schema)).count() == 0   # no variance
    got = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 2.0]), ("b", [3.0, 2.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 12)), r["explained"]) for r in got) == [
        ("a", 1, 2, 128 ** 2, 1.0, 1.0), ("b", 1, 2, 128 ** 2, 1.0, 1.0), ("b", 1, 2, 128 ** 2, 1.0, 1.0)]
    huge = whitening.whiten(spark.createDataFrame([("a", [1e30, 0.0]), ("b", [-1e30, 1.0]), ("c", [1e9, 2.0])], "vec_id string, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge} == {None} and all(np.isfinite(r["whitened"]) for r in huge)


def test_whitening_of_the_table(spark):
    t = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    got = whitening.op11_whitening(spark, SF_SMALL).toPandas().sort_values(["vec_id", "component"])
    n, dev, white, share = _brute_white(np.floor(64 * np.stack(t.embedding).astype(float)).astype(np.int64) + 1000000)
    w = got.whitened.to_numpy().reshape(len(t), 16)
    assert np.abs(w * np.sign((w * white).sum(0)) - white).max() < 1e-9 and (got.n == n).all()
    assert (got.deviation.to_numpy().reshape(len(t), 16) == dev[:, None]).all()
    assert np.allclose(got.explained.to_numpy()[:16], share, rtol=1e-10) and got.identity_error.max() < 1e-9


# ---- substring dedup ----

def _kept(rows, window):
    """Words kept and removed of rows (id, text) with distinct ids, in the order given."""
    out = {}
    seen = set()
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def _texts(seed, words, n):
    rng = random.Random(seed)

    def some(k):
        return " ".join(f"w{rng.randrange(words)}" for _ in range(k))

    shared = [some(k) for k in (19, 20, 21, 45, 120)]
    out = [None, "", " \n", "one", " ".join(["same"] * 75), " ".join(["a", "b"] * 60), " ".join(["a", "b", "c"] * 30), some(400) + "\n\t" + some(20)]
    for k in range(n):
        parts = [some(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared + out[7:8]), some(rng.randrange(25))]
        out.append("  ".join(parts))
    return out + out[8:14] + [" ".join(["same"] * 90), " ".join(["b", "a"] * 70), shared[4][5:]]


@pytest.mark.parametrize("words", [2, 3, 8, 5000])
def test_substrings(spark, words):
    texts = _texts(words, words, 40)
    rng = random.Random(words)
    ids = rng.sample(range(1000), len(texts))
    ids[3] = None
    docs = spark.createDataFrame([(i, t, {"k": "v"}, 1, 2) for i, t in zip(ids, texts)],
                                 "doc_id int, text string, n map<string,string>, start int, id int").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == _kept(list(zip(ids, texts)), 20)


def test_equal_windows_have_equal_symbols():
    rng = random.Random(3)
    for trial in range(60):
        size = (2, 3, 1000)[trial % 3]
        core = [rng.randrange(size) for _ in range(45)]
        found = {}
        for _ in range(6):
            words = [rng.randrange(size) for _ in range(rng.randrange(30))] + core + [rng.randrange(size) for _ in range(rng.randrange(30))]
            names = np.concatenate(([0], substrings.word_names([str(w).encode() for w in words]), [0])).astype(np.uint64)
            stop = np.zeros(len(names), bool)
            stop[[0, -1]] = True
            starts, chosen, _ = substrings.anchors(names, stop, substrings.Words(names))
            assert starts.tolist() == list(range(1, len(words) - 18))
            for s, c in zip(starts - 1, chosen):
                assert found.setdefault(tuple(words[s:s + 20]), c) == c


def test_long_texts_in_pieces():
    import pyarrow as pa
    texts = pa.array([" ".join(f"w{k % 83}" for k in range(1000)), None, "x " * 30])
    whole = {}
    for size in (50, 400_000):
        pieces, substrings.PIECE = substrings._Pieces(20), size
        try:
            seen = {}
            for _ in pieces.parts(texts):
                names, stop, row, word = pieces.take()
                starts, chosen, _ = substrings.anchors(names, stop, substrings.Words(names))
                for s, c in zip(starts, chosen):
                    assert (row[s], word[s]) not in seen
                    seen[row[s], word[s]] = c
        finally:
            substrings.PIECE = 400_000
        assert whole.setdefault("all", seen) == seen
    assert len(whole["all"]) == 981 + 11


def test_substrings_of_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text + " more"), (7, text), (7, "other " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect())
    assert got == {(1, 0): 2, (None, 30): 2, (2, 30): 1, (7, 30): 2}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        substrings.remove_repeats(docs.withColumn("doc_id", F.lit("a")))


# ---- spelling variants ----

def _variants(rows):
    runs = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            runs[run] += 1
    words = {w: n for w, n in runs.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + (len(a) == len(b)):] == b[k + 1:]

    out = {}
    form = {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        ok = others and -others[0][0] >= 10 * n
        form[w] = others[0][1] if ok else None
        out[w] = [n, len(others), form[w], -others[0][0] if ok else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def _misspelt(seed, n):
    rng = random.Random(seed)
    letters = "abcdeéÿñ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice((7, 8, 8, 9, 12)))) for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base[:3] if rng.random() < 0.5 else base))
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice(([], [rng.choice(letters)], [w[k], rng.choice(letters)]))
        out.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
    return out


def _rows(words, sizes):
    rows = []
    at = 0
    for i, size in enumerate(sizes):
        rows.append((i, " ".join(words[at:at + size])))
        at += size
    return rows


def test_spelling(spark):
    words = _misspelt(1, 6000)
    rows = [*_rows(words, [0, 1, 5, 200, 3000, 700, 2000]), (None, " ".join(words[:300])), (9, None), (9, "Straße's STRASSE-fassade " * 3),
            (9, "Straße's STRASSE-fassade " * 3), (10, "a" * 3000 + " " + "a" * 3001 + " " + "a" * 3000 + " " + "a" * 3001)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"])
           for r in spelling.group_variants(spelling.vocabulary(docs)).collect()}
    want = _variants(rows)
    assert got == want
    assert sum(v[2] is not None for v in want.values()) > 50 and any(v[2] and v[4] != v[2] for v in want.values())
    assert spelling.group_variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_spelling_in_many_blocks(spark, monkeypatch):
    """A bucket of many blocks gives the same as one block."""
    words = sorted(set(_misspelt(2, 4000)))
    table = spark.createDataFrame([(w, 1 + zlib.crc32(w.encode()) % 50) for w in words if len(w) > 6], "word string, n long").cache()
    one = {tuple(r) for r in spelling.near_words(table).collect()}
    monkeypatch.setattr(spelling, "deal", lambda members, bucket, node: blocks.deal(members, bucket, node, 7))
    assert {tuple(r) for r in spelling.near_words(table).collect()} == one and len(one) > 300


@pytest.mark.parametrize("name", ["op12_substrings", "op13_spelling"])
def test_matches_duckdb(spark, name):
    from oracle_check import compare
    assert compare(spark, SF_SMALL, [name], verbose=False)[name] == "OK"
