"""RIBES helper against a literal reading of its definition; BLEU/GLEU on words
and characters against a direct Python computation."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from pairfeat.operators import mt as mtf
from pairfeat.operators import suffixes
from pairfeat.operators.lexical import with_tokens


def _ngrams(seq, n):
    return [tuple(seq[i:i + n]) for i in range(len(seq) - n + 1)]


def _starts(seq, run):
    return [k for k in range(len(seq) - len(run) + 1) if seq[k:k + len(run)] == run]


def ribes_by_definition(ref, hyp):
    """SURVEY T3, read literally: align each item, score the runs of rising places."""
    ref, hyp = list(ref), list(hyp)
    places = []
    for i, item in enumerate(hyp):
        here, there = hyp.count(item), ref.count(item)
        if there and here == there == 1:
            places.append(ref.index(item))
        elif there:
            for width in range(1, max(i, len(hyp) - i + 1)):
                # A context to the right that fits, then one to the left.
                tries = [(hyp[i:i + width + 1], 0)] * (i + width < len(hyp)) + [(hyp[i - width:i + 1], width)] * (i >= width)
                hit = [at[0] + shift for run, shift in tries if len(at := _starts(ref, run)) == len(_starts(hyp, run)) == 1]
                if hit:
                    places.append(hit[0])
                    break
    n = len(places)
    if n < 2:
        return 0.0
    rising = [b - a == 1 for a, b in zip(places, places[1:])]
    lengths = [len(r) + 1 for r in "".join("x" if r else " " for r in rising).split()]
    tau = sum(k * (k - 1) / 2 for k in lengths) / (n * (n - 1) / 2)
    return tau * (n / len(hyp)) ** 0.25 * min(1.0, math.exp(1 - len(ref) / len(hyp))) ** 0.10


def bleu_by_definition(ref, hyp):
    if not hyp:
        return 0.0
    nums, dens = [], []
    for n in range(1, 5):
        h, r = Counter(_ngrams(hyp, n)), Counter(_ngrams(ref, n))
        nums.append(sum(min(c, r[g]) for g, c in h.items()))
        dens.append(max(1, sum(h.values())))
    if nums[0] == 0:
        return 0.0
    k, logs = 1, []
    for a, d in zip(nums, dens):
        if a == 0:
            logs.append(math.log(1 / (2 ** k * d)))
            k += 1
        else:
            logs.append(math.log(a / d))
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return bp * math.exp(sum(0.25 * x for x in logs))


def _ribes(pairs):
    return mtf.ribes_batch(*(pa.array([p[s] for p in pairs]) for s in (0, 1)))


def test_ribes_matches_definition():
    rng = random.Random(1)
    pairs = []
    for k in range(400):
        most = 9 if k < 370 else 40
        letters = rng.choice(("a", "ab", "abcd", "abcdefghij"))
        pairs.append([[rng.choice(letters) for _ in range(rng.randint(0, most))] for _ in range(2)])
    left, right = _ribes(pairs)
    chars = _ribes([("".join(a), "".join(b)) for a, b in pairs])
    assert left.tolist() == chars[0].tolist() and right.tolist() == chars[1].tolist()
    for (a, b), l, r in zip(pairs, left, right):
        assert l == pytest.approx(ribes_by_definition(a, b), abs=1e-12), (a, b)
        assert r == pytest.approx(ribes_by_definition(b, a), abs=1e-12), (a, b)


def test_ribes_of_every_sentence_pair(spark):
    """All rows of the sf0.001 sentence pairs, words and characters, against the definition."""
    from pairfeat.plans.queries import QUERIES
    pairs = {r["qid"]: r for r in with_tokens(QUERIES["sent_pairs"](spark, SF_SMALL)).collect()}
    got = mtf.mt_features(QUERIES["sent_pairs"](spark, SF_SMALL)).collect()
    assert len(got) == len(pairs)
    for r in got:
        p = pairs[r["qid"]]
        sides = {"basic_word": [[t["term"] for t in p[k]] for k in ("tok_l", "tok_r")], "char": [p["ql"], p["qr"]]}
        for level, (a, b) in sides.items():
            if len(a) + len(b) < 90:   # the definition takes more than the square of the length
                assert r[f"{level}_ribes_score_l"] == pytest.approx(ribes_by_definition(a, b), abs=1e-12)
                assert r[f"{level}_ribes_score_r"] == pytest.approx(ribes_by_definition(b, a), abs=1e-12)


def _occurrences(seq: str, run: str) -> list[int]:
    return [i for i in range(len(seq) - len(run) + 1) if seq.startswith(run, i)]


def test_contexts_and_common_runs_of_long_texts():
    """The index against a direct search, in one index and pair by pair."""
    rng = random.Random(4)
    pairs = []
    for n, alphabet in ((500, "ab"), (300, "abcdefgh"), (120, "a"), (0, "a"), (200, "a😀é\ud800")):
        a = "".join(rng.choice(alphabet) for _ in range(n))
        pairs.append((a, a[: n // 2] + "".join(rng.choice(alphabet) for _ in range(n // 3))))
    pairs += [("", "x"), (None, "y")]
    p = suffixes.pairs_of(*(pa.array([x[s].encode("utf-8", "replace").decode() if x[s] else x[s] for x in pairs]) for s in (0, 1)))
    index = suffixes.Index(p)
    least, place = index.lone_contexts()
    pairs = [tuple((x or "").encode("utf-8", "replace").decode() for x in q) for q in pairs]
    for k, (a, b) in enumerate(pairs):
        for i in rng.sample(range(len(b)), min(len(b), 40)):
            want = (0, None)
            for size in range(2, len(b) - i + 1):
                in_a, in_b = _occurrences(a, b[i:i + size]), _occurrences(b, b[i:i + size])
                if not in_a:
                    break
                if len(in_a) == len(in_b) == 1:
                    want = (size, in_a[0])
                    break
            at = index.start[k, 1] + i
            assert (least[at], place[at] - index.start[k, 0] if least[at] else None) == want
    common = [max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i:i + n] in b), default=0) if len(a) < 400 else None
              for a, b in pairs]
    for limit in (1, 1000, 1 << 19):
        got = np.concatenate([suffixes.Index(part).longest_common() for _, part in p.chunks(limit)])
        assert all(w is None or g == w for g, w in zip(got, common))


def test_long_pairs_are_fast():
    began = time.process_time()
    got = suffixes.longest_common(suffixes.pairs_of(pa.array(["ab" * 50_000]), pa.array(["ab" * 49_000 + "ba" * 1000])))
    assert got.tolist() == [98_000] and time.process_time() - began < 5    # a fraction of a second on an idle machine
    many = [str(k) for k in range(1_200_000)]                               # more distinct words than code points
    left, right = _ribes([(many, many)])
    assert left.tolist() == right.tolist() == [1.0]


def test_mt_columns_match_direct_computation(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        a = " ".join(rng.choice(["a", "b", "cc", "d"]) for _ in range(rng.randint(0, 7)))
        b = " ".join(rng.choice(["a", "b", "cc", "d"]) for _ in range(rng.randint(0, 7)))
        rows.append((str(i), a, b, "0"))
    df = spark.createDataFrame(rows, "qid string, ql string, qr string, label string")
    got = {r["qid"]: r for r in mtf.mt_features(df).collect()}
    for qid, a, b, _ in rows:
        wa, wb = a.split(), b.split()
        r = got[qid]
        assert r["basic_word_bleu_score_l"] == pytest.approx(bleu_by_definition(wa, wb), abs=1e-12)
        assert r["char_bleu_score_r"] == pytest.approx(bleu_by_definition(list(b), list(a)), abs=1e-12)
        assert r["basic_word_ribes_score_r"] == pytest.approx(ribes_by_definition(wb, wa), abs=1e-12)
        assert r["char_ribes_score_l"] == pytest.approx(ribes_by_definition(list(a), list(b)), abs=1e-12)
