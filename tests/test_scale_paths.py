"""Plans and formats that hold at any size."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pairfeat.operators import joins, sentvec as sv, tagging, trie, vectors as vec
from pairfeat.plans import model, queries as Q
from pairfeat.sources import pairs as src


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_looked_up_features_do_not_shuffle(spark):
    """Tokens meet vocabulary and word vectors where they are."""
    word = Q.fitted_vocabulary(spark, SF_SMALL).table.first()["term"]
    pairs = spark.createDataFrame([("1", f"a {word}", "b c", "0")] * 50, "qid string, ql string, qr string, label string")
    vocab, lexicon = Q.fitted_vocabulary(spark, SF_SMALL), Q.fixture_lexicon(spark, SF_SMALL)
    u = np.ones(lexicon.dims)
    for out in (vec.vector_features(pairs, vocab), vec.vocab_vectors_long(pairs, vocab, True), sv.sif_features(pairs, lexicon, u),
                sv.sentence_vectors(pairs, lexicon), model.model_features(pairs, vocab, lexicon, u)):
        assert _exchanges(out) == 0
        assert out.count()


def _terms(rng, n):
    out = {"", "a", "ab", "abc", "\u00e9", "\u00e9a", "😀", "😀b", "x" * 3000}
    while len(out) < n:
        out.add("".join(rng.choice("abcdéñ😀") for _ in range(rng.randrange(1, 9))))
    return sorted(out)


def test_trie_against_a_dict():
    rng = random.Random(1)
    terms = sorted(_terms(rng, 2000), key=lambda t: t.encode())
    t = trie.Trie(*trie.built(pa.array(terms)))
    asked = terms[::3] + ["zz", "abcabcabc", "é😀é", "a" * 50, ""]
    place = {x: k for k, x in enumerate(terms)}
    assert t.find(pa.array(asked)).tolist() == [place.get(x, -1) for x in asked]
    assert t.find(pa.array([], pa.string())).tolist() == [] and trie.Trie(*trie.built(pa.array([], pa.string()))).find(pa.array(["a"])).tolist() == [-1]
    text = "abcab😀bé" * 3
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    got = {(int(starts[k]), size, int(i)) for at, size, ids in t.prefixes(data, starts, np.full(len(starts), len(data))) for k, i in zip(at, ids)}
    raw = text.encode()
    want = {(int(s), len(x.encode()), k) for s in starts for k, x in enumerate(terms) if x and raw.startswith(x.encode(), s)}
    assert got == want


@pytest.mark.parametrize("shard", [100, 200_000])
def test_term_tables(spark, shard):
    rng = random.Random(2)
    terms = _terms(rng, 1000)
    rows = [(t, float(k), [float(k), -1.0], k) for k, t in enumerate(terms)] + [(None, 1.0, [0.0, 0.0], 5)]
    table = spark.createDataFrame(rows, "term string, w double, v array<float>, n int").repartition(4)
    made = trie.write_terms(table, len(rows), ("w", "v", "n"), shard_terms=shard)
    opened = made.open()
    assert (len(opened.tries) > 5) == (shard == 100) and opened.values["v"].dtype == np.float32
    asked = terms[::2] + ["nowhere"]
    ids = opened.find(pa.array(asked))
    assert ids[-1] == -1 and (ids[:-1] >= 0).all()
    assert opened.values["w"][ids[:-1]].tolist() == [float(k) for k in range(0, len(terms), 2)]
    assert opened.values["v"][ids[:-1]].tolist() == [[float(k), -1.0] for k in range(0, len(terms), 2)]
    empty = trie.write_terms(table.limit(0), 0, ("w",)).open()
    assert empty.find(pa.array(["a", ""])).tolist() == [-1, -1]


def test_sharded_tables_give_the_same_features(spark, monkeypatch):
    pairs = src.sent_pairs(spark, SF_SMALL).limit(300)
    vocab, lexicon = Q.fitted_vocabulary(spark, SF_SMALL), Q.fixture_lexicon(spark, SF_SMALL)
    u = sv.fit_direction(pairs, lexicon)
    one = sorted(vec.vector_features(pairs, vocab).join(sv.sif_features(pairs, lexicon, u), "qid").collect())
    monkeypatch.setattr(trie, "SHARD_TERMS", 300)
    vocab._terms = lexicon._terms = None
    assert sorted(vec.vector_features(pairs, vocab).join(sv.sif_features(pairs, lexicon, u), "qid").collect()) == one


def test_empty_vocabulary_and_lexicon(spark):
    pairs = spark.createDataFrame([("1", "a bb", "bb cc", "0")], "qid string, ql string, qr string, label string")
    vocab = vec.fit_vocabulary(spark.createDataFrame([], "doc_id long, text string"))
    r = vec.vector_features(pairs, vocab, ("all",)).first()
    assert r["count1_PED"] == r["tfidf1_PCD"] == 0.0 and r["hash1_18_PED"] > 0
    assert vec.vocab_vectors_long(pairs, vocab, True).count() == 0


def test_salted_lexicon_join_matches_broadcast(spark, monkeypatch):
    """The tagger's join above the broadcast limit, its hottest terms tied in weight."""
    pairs = src.sent_pairs(spark, SF_SMALL).limit(200)
    docs = src.corpus_texts(spark, SF_SMALL)
    lexicon = (docs.select(F.explode(F.split("text", " ")).alias("term")).distinct()
               .select("term", F.lit("q").alias("postag"), (F.length("term") % 3).alias("weight")).cache())
    n = lexicon.count()
    small = sorted(map(str, tagging.tokens_from_lexicon(pairs, lexicon, n, weight="weight").collect()))
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_KEYS", 50)
    monkeypatch.setattr(joins, "SALT_BUCKETS", 7)
    plan = tagging.tokens_from_lexicon(pairs, lexicon, n, weight="weight")
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in physical and "_salt" in physical
    assert sorted(map(str, plan.collect())) == small


def test_murmur_vectors():
    """Published values of MurmurHash3 x86_32."""
    from pairfeat.operators.murmur import murmur3_32
    for text, seed, want in (("", 0, 0), ("", 1, 0x514E28B7), ("", 0xFFFFFFFF, 0x81F16F39), ("test", 0, 0xBA6BD213), ("abc", 0, 0xB3DD93FA),
                             ("Hello, world!", 0, 0xC0363E43), ("The quick brown fox jumps over the lazy dog", 0, 0x2E4FF723),
                             ("aaaa", 0x9747B28C, 0x5A97808A), ("aaa", 0x9747B28C, 0x283E0130), ("foo", 0, -156908512 & 0xFFFFFFFF),
                             ("ππππππππ", 0x9747B28C, 0xD58063C1)):
        assert int(murmur3_32(pa.array(["x", text, "yyyyy"]), seed)[1]) & 0xFFFFFFFF == want, text
    assert len(murmur3_32(pa.array([], pa.string()))) == 0


def test_all_features_equal_the_families(spark):
    from pairfeat.operators import catalogue, lexical as lex, mt
    pairs = src.sent_pairs(spark, SF_SMALL).limit(400)
    vocab = Q.fitted_vocabulary(spark, SF_SMALL)
    whole = catalogue.all_features(pairs, vocab)
    assert len(whole.columns) == 177
    rows = {r["qid"]: r.asDict() for r in whole.collect()}
    assert len(rows) == 400
    for part in (lex.lexical_features(pairs, families=lex.FAMILIES), vec.vector_features(pairs, vocab), mt.mt_features(pairs)):
        for r in part.collect():
            assert all(rows[r["qid"]][c] == v for c, v in r.asDict().items())
    wide = spark.createDataFrame([("1", "a b", "b", "0")], "qid string, ql string, qr string, label string")
    assert _exchanges(catalogue.all_features(wide, vocab)) == 0


@pytest.mark.parametrize("end", [b"\n", b""])
def test_word2vec_round_trip(spark, tmp_path, end):
    """One file with and without line ends, read by ranges that begin anywhere; numbers hold every byte."""
    from pairfeat.sources import word2vec as w2v
    rng = np.random.default_rng(1)
    terms = [f"wort{k}" if k % 3 else f"é{k}😀" for k in range(500)] + ["a", "123", "x" * 900]
    vecs = (rng.normal(size=(len(terms), 25)) * 10.0 ** rng.integers(-20, 3, (len(terms), 1))).astype("<f4")
    vecs[7] = np.frombuffer(b" \n a" * 25, "<f4")     # numbers that look like ends of terms
    path = tmp_path / "v.bin"
    path.write_bytes(f"{len(terms)} 25\n".encode() + b"".join(t.encode() + b" " + v.tobytes() + end for t, v in zip(terms, vecs)))
    for size in (97, 1000, 1 << 20):
        got = {r["term"]: r["vec"] for r in w2v.read_word2vec(spark, str(path), size).collect()}
        assert list(map(len, (got, terms))) == [len(terms)] * 2
        assert all(np.array_equal(np.array(got[t], "<f4"), v) for t, v in zip(terms, vecs))


def test_word2vec_folder(spark):
    from pairfeat.session import scratch_dir
    from pairfeat.sources import word2vec as w2v
    rows = [(f"t{k}", [float(k), 0.5]) for k in range(50)] + [(None, [1.0, 2.0]), ("a b", [1.0, 2.0]), ("", [1.0, 2.0])]
    path = scratch_dir(spark, "w2v")
    w2v.write_word2vec(spark.createDataFrame(rows, "term string, vec array<double>").repartition(4), path)
    assert sorted(map(tuple, w2v.read_word2vec(spark, path, 64).collect())) == sorted(rows[:50])


def _waiting(df):
    """Of every Python operator of a plan, the (name, type) columns of the rows that wait for it."""
    out = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.inputPlan())
        children = [node.children().apply(i) for i in range(node.children().size())]
        if "EvalPython" in kind:
            attributes = children[0].output()
            out.append([(a.name(), a.dataType().catalogString()) for a in (attributes.apply(i) for i in range(attributes.size()))])
        for child in children:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_rows_that_wait_for_a_kernel_are_narrow(spark):
    """Each text once, and no characters or tokens: Spark holds these rows, on disk if memory is short."""
    from pairfeat.operators import catalogue, lexical as lex, mt
    pairs = spark.createDataFrame([("1", "a b", "b c", "0")], "qid string, ql string, qr string, label string")
    vocab, lexicon = Q.fitted_vocabulary(spark, SF_SMALL), Q.fixture_lexicon(spark, SF_SMALL)
    for out in (lex.lexical_features(pairs, families=lex.FAMILIES), vec.vector_features(pairs, vocab), mt.mt_features(pairs),
                model.model_features(pairs, vocab, lexicon, np.ones(lexicon.dims)), catalogue.all_features(pairs, vocab)):
        assert all(not kind.startswith("array") for row in _waiting(out) for _, kind in row)
        assert max(sum(kind == "string" for _, kind in row) for row in _waiting(out)) <= 4


def test_kernels_run_once_a_row(spark):
    pairs = spark.createDataFrame([("1", "a b", "b c", "0")], "qid string, ql string, qr string, label string")
    vocab, lexicon = Q.fitted_vocabulary(spark, SF_SMALL), Q.fixture_lexicon(spark, SF_SMALL)
    for out in (vec.vocab_vectors_long(pairs, vocab, True), vec.hashed_vectors_long(pairs, 2), sv.sentence_vectors(pairs, lexicon)):
        assert len(_waiting(out)) == 1


def _written(spark, names):
    import os
    import re
    base = re.sub(r"^file:/*", "/", spark.sparkContext.getCheckpointDir())
    return {f for f in os.listdir(base) if any(f"pairfeat-{n}-" in f for n in names)}


def test_split_and_direction_write_no_texts_or_vectors(spark):
    names = ("rows", "split-pairs", "sentence-vectors")
    pairs = spark.createDataFrame([(str(k), f"a b{k}", "b c", "0") for k in range(50)], "qid string, ql string, qr string, label string")
    lexicon = Q.fixture_lexicon(spark, SF_SMALL)
    before = _written(spark, names)
    flags = model.with_split_flag(pairs)
    sv.fit_direction(flags.filter("NOT is_test"), lexicon)
    assert flags.filter("is_test").count() == 5 and _written(spark, names) == before


def test_stream_files_are_compressed(spark, tmp_path):
    from pairfeat.streaming import score
    spark.createDataFrame([(f"{k}\ta b\tb c",) for k in range(20)] + [("short",)], "value string").write.text(str(tmp_path / "in"))
    score.start_scoring_stream(spark, *[str(tmp_path / x) for x in ("in", "out", "chk")]).awaitTermination()
    files = [f.name for f in (tmp_path / "out").rglob("part-*")]
    assert files and all(f.endswith(".gz") for f in files)
    assert score.read_scored(spark, str(tmp_path / "out")).count() == 20


def test_tags_of_many_texts_equal_one_at_a_time():
    from pairfeat.operators import lattice
    rng = np.random.default_rng(3)
    k, sizes = 4, [0, 7, 1, 30, 7, 2]
    steps = np.log(rng.random((k + 1, k + 1, k)))
    emit = np.log(rng.random((sum(sizes), k)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = lattice.best_tags(emit, row, steps)
    for r in range(len(sizes)):
        assert whole[row == r].tolist() == lattice.best_tags(emit[row == r], row[row == r], steps).tolist()


def test_a_lookup_searches_all_shards_at_once(spark, monkeypatch):
    """The searches of a batch do not grow with the number of shards."""
    rng = random.Random(5)
    terms = _terms(rng, 3000)
    table = spark.createDataFrame([(t, float(k)) for k, t in enumerate(terms)], "term string, w double")
    few, many = (trie.write_terms(table, len(terms), ("w",), shard_terms=n).open() for n in (3000, 50))
    assert len(many.tries) > 20 * len(few.tries)
    asked = pa.array(terms[::-2] + ["nowhere", "", "éééé"])
    calls, down = [], trie.Trie._down
    monkeypatch.setattr(trie.Trie, "_down", lambda self, *a: calls.append(1) or down(self, *a))
    counts = []
    for opened in (few, many):
        calls.clear()
        ids = opened.find(asked)
        counts.append(len(calls))
        assert [opened.values["w"][i] if i >= 0 else None for i in ids] == [float(terms.index(t)) if t in terms else None for t in asked.to_pylist()]
    assert counts[0] == counts[1]


def test_vector_terms_of_a_text_equal_those_of_its_tokens(spark):
    from pairfeat.operators.lexical import with_tokens
    rows = [("1", "  Ab_c, dÉf-g 'ΣαΣ'α İx a", "", "0"), ("2", None, "!?", "0"), ("3", "ΣΣ.", "x1 22 漢字", "0")]
    p = spark.createDataFrame(rows, "qid string, ql string, qr string, label string")
    assert p.select(*vec.side_terms(p, ("all",))).collect() == (t := with_tokens(p)).select(*vec.side_terms(t, ("all",))).collect()
    assert "transform" not in str(p.select(*vec.side_terms(p, ("all",)))._jdf.queryExecution().optimizedPlan())


def test_shared_characters(spark, monkeypatch):
    """The character lengths of pairs against plain counters, and no array functions for them."""
    from collections import Counter
    from pairfeat.operators import grams, lexical as lex, suffixes
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("aab cé漢\U0001F600") for _ in range(rng.randrange(n)))
    pairs = [(text(30), text(600)) for _ in range(60)] + [("", ""), ("a", "")]
    want = [sum((Counter(a) & Counter(b)).values()) for a, b in pairs]
    p = suffixes.pairs_of(*(pa.array(side) for side in zip(*pairs)))
    for cells, kinds in ((1 << 20, 1 << 14), (40, 1 << 14), (1 << 20, 2)):
        monkeypatch.setattr(grams, "CELLS", cells)
        monkeypatch.setattr(grams, "KINDS", kinds)
        assert grams.shared_items(p).tolist() == want
    df = spark.createDataFrame([(str(k), *x, "0") for k, x in enumerate([*pairs, (None, "a"), ("a" * 300, None)])],
                               "qid string, ql string, qr string, label string")
    f = lex.lexical_features(df, families=("char_len",))
    got = {r["qid"]: r for r in f.collect()}
    assert [got[str(k)]["char_len_intersect"] for k in range(len(pairs))] == want
    assert [got[str(len(pairs) + k)]["char_len_intersect"] for k in (0, 1)] == [None, 0]
    assert "array_intersect" not in str(f._jdf.queryExecution().optimizedPlan())


def test_word_codes_are_written_at_once(monkeypatch):
    """One text for a batch, cut into sides; also past the private-use code points."""
    from pairfeat.operators import wordcodes
    calls, plain = [], wordcodes._text
    monkeypatch.setattr(wordcodes, "_text", lambda codes: calls.append(1) or plain(codes))
    left = [["a", "b", "a"], None, [], [f"w{k}" for k in range(7000)], ["w6999", "a"]]
    right = [["b"], ["a"], None, ["a", "w6998"], []]
    l, r = wordcodes.encode(left, right)
    assert len(calls) == 1
    assert [None if x is None else len(x) for x in l + r] == [None if x is None else len(x) for x in left + right]
    code = {w: c for side, s in zip(left + right, l + r) if side for w, c in zip(side, s)}
    assert len(set(code.values())) == len(code) == 7002
    assert all(s == "".join(code[w] for w in side) for side, s in zip(left + right, l + r) if side is not None)


def test_lexicon_look_up_is_a_projection(spark, monkeypatch):
    """Any size of lexicon: no token is exchanged; repeated terms, null terms and tags give a plain join's tokens."""
    rows = [("cat", "n"), ("cat", "v"), ("cat", None), ("runs", "v"), (None, "q"), ("é", "a"), ("thing", None), ("cat", "n")]
    lexicon = spark.createDataFrame(rows, "term string, postag string")
    pairs = spark.createDataFrame([("1", "the cat runs, é cat", "nothing"), (None, None, "thing cat"), ("1", "", "é"), ("1", "", "é"), (None, None, None)],
                                  "qid string, ql string, qr string")
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    for table, n in ((lexicon, len(rows)), (lexicon.limit(0), 0)):
        found = tagging.tokens_from_lexicon(pairs, table, n)
        assert _exchanges(found) == 0 and found.columns == ["qid", "ql", "qr", "tok_l", "tok_r"]
        monkeypatch.setattr(tagging, "MAX_KINDS", -1)      # more kinds than may be listed: the join
        joined = tagging.tokens_from_lexicon(pairs, table, n)
        monkeypatch.undo()
        assert _exchanges(joined) > 0 and sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))
        monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)


@pytest.mark.parametrize("widths", [(2 ** 20, 2 ** 24), (7, 40)])
def test_hashed_distances_by_definition(monkeypatch, widths):
    """One pass over the counts serves all hashed widths; couples whose items share a bucket are done by bucket."""
    from pairfeat.operators.murmur import murmur3_32
    rng = random.Random(3)
    lists = [[[rng.choice("abcdefghijkl") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 12))] for _ in range(2)] for _ in range(60)] + [[["a"], ["a"]], [[], []]]
    monkeypatch.setattr(vec, "HASHERS", {f"h{o}_{w}": (o, w) for o in (1, 2) for w in widths})
    calls = []
    distances = vec._distances
    monkeypatch.setattr(vec, "_distances", lambda *a, **k: calls.append(1) or distances(*a, **k))
    got = vec._pair_distances(pa.array(lists, pa.list_(pa.list_(pa.string()))), tuple(vec.HASHERS), None)
    if widths[0] > 1000:
        assert len(calls) == 2      # not one for every width

    def vector(items, order, width):
        out = np.zeros(width)
        for t in items + [f"{a} {b}" for a, b in zip(items, items[1:])] * (order == 2):
            h = int(murmur3_32(pa.array([t]))[0])
            out[abs(h) % width] += 1 if h >= 0 else -1
        return out / (np.linalg.norm(out) or 1)

    for name, (order, width) in vec.HASHERS.items():
        if width < 1000:
            for k, (a, b) in enumerate(lists):
                x, y = vector(a, order, width), vector(b, order, width)
                want = {"PED": np.linalg.norm(x - y), "PCD": 0.5 * ((x - y) ** 2).sum(), "PMD": np.abs(x - y).sum()}
                for m, value in want.items():
                    assert abs(got[f"{name}_{m}"][k] - value) < 1e-12
        else:
            assert all(got[f"{name}_{m}"][k] == 0 for m in ("PED", "PCD", "PMD") for k in (-1, -2)) and got[f"{name}_PED"].max() > 1


def test_vectorised_terms_are_cut_from_the_text(spark):
    """No tokens are built for terms that are only joined again; capital sigma, letters that lower-case to two, long runs."""
    from pairfeat.functions import text
    rows = ["a ΑΣ b", "ΑΣ'Α Σ", "İX ǅa nation NATION nation's", "x_tion the th ing-ly ably_", "", None, "😀th 😀𐀀th𐀀 𐀀th", "ⅣⅣ Ⓐⓐ ble", "é́th", "th" * 100_000 + "x"]
    df = spark.createDataFrame([(r, r, r) for r in rows], "qid string, ql string, qr string")
    bare = df.select(*vec.side_terms(df, ("all", "notion")))
    assert "endswith" not in bare._jdf.queryExecution().optimizedPlan().toString().lower()
    given = df.select(text.tokens(F.col("ql")).alias("tok_l"), text.tokens(F.col("qr")).alias("tok_r"))
    assert bare.collect() == given.select(*vec.side_terms(given, ("all", "notion"))).collect()
