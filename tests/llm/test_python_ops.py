"""Operators with Python in their tasks, and the pipeline, against brute force on small fixtures."""

from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import pytest
import xxhash

from pairfeat.llm import blocks, langid, mixing, packing, pages, simhash, vectors
from pairfeat.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long"


def _docs(spark, texts, ids=None, lang=lambda i: "en", source=lambda i: "s"):
    return spark.createDataFrame([(ids[i] if ids else i, t, lang(i), source(i), len(t or ""), 0) for i, t in enumerate(texts)], DOC)


def _closure(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(root[i], root[j])
            if root[i] != low or root[j] != low:
                root[i] = root[j] = low
                changed = True
    return root


# ---- components and blocks ----

def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [
        (900, 901 + i) for i in range(60)] + [(-5, 7), (3, 3)]
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    root = _closure(len(nodes), [(at[a], at[b]) for a, b in edges])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: nodes[root[at[x]]] for x in nodes if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dealt_blocks_hold_every_pair(spark):
    members = spark.createDataFrame([(k % 3, k) for k in range(90)] + [(9, 900)], "bucket long, node long")
    rows = blocks.deal(members, ["bucket"], "node", block=8).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["bucket"], r["_left"], r["_right"]), []).append((r["_half"], r["node"]))
    met = set()
    for (b, left, right), own in groups.items():
        for h, x in own:
            for g, y in own:
                if x < y and (left == right or h != g):
                    assert (b, x, y) not in met    # no pair twice
                    met.add((b, x, y))
    assert met == {(x % 3, x, y) for x in range(90) for y in range(x + 1, 90) if x % 3 == y % 3}


# ---- op1 ----

def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    near = [c + rng.normal(scale=s, size=24) for c in base[:6] for s in (0.02, 0.1, 0.2, 0.3) for _ in range(12)]
    xs = [x.astype(np.float32) for x in [*base, *near, *[base[0]] * 40, base[1] * 3]]
    rows = [(k, x.tolist(), 0) for k, x in enumerate(xs)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] + [1.0] * 23, 1), (n + 3, [], 1), (n + 4, [1.0] * 5, 1),
             (n + 5, [float("inf")] + [1.0] * 23, 1), (n + 6, [None] + [1.0] * 23, 1)]
    unit = np.array(xs, dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    root = _closure(n, zip(*np.nonzero(links)))
    monkeypatch.setattr(blocks, "BLOCK", 16)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(_vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k in range(n):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (links[k].sum(), root[k], root[k] == k), k
    for k in range(n, n + 7):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert vectors.near_duplicates(_vectors(spark, rows[:0])).count() == 0


def test_embedding_recall_at_the_threshold():
    """Pairs of exactly the threshold's cosine meet in some bucket: measured recall."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * z
    a, b = (vectors.codes(v, vectors.TABLES, vectors.HASHES, vectors.PROBES) for v in (x, y))
    met = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert met.mean() > 0.998


# ---- op2 ----

def _slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


TEXTS = [None, "", " \n\t", "One", "one two", "A B c", "é À ü\x0b😀 x", "\xa0 a b c", "a b a b a b a b", "x " * 70_000]


def test_fingerprints(monkeypatch):
    for t in TEXTS[:-1]:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == _slow_fingerprint(t), t
    whole = simhash.fingerprint(TEXTS[-1] + "y z " * 50_000)
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    assert simhash.fingerprint(TEXTS[-1] + "y z " * 50_000) == whole


def test_covering_finds_every_link(spark, monkeypatch):
    """Random points, dense clusters and far ones: all links of three bits or fewer, none beyond."""
    rng = random.Random(2)
    points = {rng.getrandbits(64) for _ in range(400)} | {0, (1 << 64) - 1}
    for c in list(points)[:30]:
        for bits in (1, 2, 3, 4, 5):
            points |= {c ^ sum(1 << b for b in rng.sample(range(64), bits)) for _ in range(4)}
    hot = rng.getrandbits(64)
    points |= {hot ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i, 64, 9)}
    points = sorted(points)
    a = np.array(points, dtype=np.uint64)
    linked = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3) + i + 1]
    root = _closure(len(points), linked)
    monkeypatch.setattr(blocks, "BLOCK", 32)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "fp long")
    got = {r["fp"] & (1 << 64) - 1: r["component"] for r in simhash._link_points(df, 3).collect()}
    groups = {}
    for p, c in got.items():
        groups.setdefault(c, set()).add(p)
    want = {}
    for k, r in enumerate(root):
        want.setdefault(r, set()).add(points[k])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_simhash_groups_and_dedup(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [*TEXTS[:-1], long, long, long + " end", " ".join(f"v{i}" for i in range(50))]
    ids = [*range(100, 100 + len(TEXTS) - 1), 7, 9, 8, None]
    docs = _docs(spark, texts, ids)
    rows = simhash.group(docs.unionByName(docs.filter("doc_id = 7"))).collect()
    assert len(rows) == len(texts) + 1
    fps = [(r["fp"] & (1 << 64) - 1, r["doc_id"], r["component_id"]) for r in rows]
    for f, i, c in fps:
        near = [j for g, j, _ in fps if (f ^ g).bit_count() <= 3 and j is not None]
        assert c == (min(near) if near else None)
    kept = simhash.deduplicate(docs.unionByName(docs.filter("doc_id = 7")))
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted({c for _, i, c in fps if c is not None}) and got.count(None) == 1
    assert simhash.group(docs.filter("false")).count() == 0 == simhash.deduplicate(docs.filter("false")).count()


# ---- op3 ----

ODD = [None, "", "don't I'll 12.5 a'b", "ÉÀ K Å ẞ Ÿ İ ſ µ ª × ÷", "é x́ 日本 語", "a\x1cb <|endoftext|> <|x", "ΑΣ ΣΑΣ­ x­y",
       "ﬁ １２ Ⅷ ²", "a_b__c `x` \\\\ [] {}|~", "\x00\x01 a\x7fb", "word " * 9000, "one", "one"]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(packing.default_tokenizer())
    ids = [array("I", tk.encode(t or "", add_special_tokens=False).ids + [2]) for t in ODD]
    rows = packing.pack(_docs(spark, ODD).repartition(2)).collect()
    for k, want in enumerate(ids):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == want.tobytes(), ODD[k]
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert all(len(r["ids"]) == 4 * r["length"] and r["doc_tokens"] == len(want) for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1])
        total = sum(n for _, n in pieces)
        assert total <= 4096 and total & (total - 1) == 0     # no padding at all
    assert packing.pack(_docs(spark, ODD).filter("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(_docs(spark, ODD), capacity=1000)


def test_word_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 3)
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    cache = packing.WordCache(packing.default_tokenizer())
    for t in ("some words to cut here again", "it's a don't can't won't text", "some more words"):
        assert cache.encode(t) == array("I", cache.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
    assert len(cache.parts) <= 6 and len(cache.words) <= 2


# ---- op4 ----

def test_langid(spark):
    rng = random.Random(6)
    own = {"aa": "ka lo mi ne tu so".split(), "bb": "xyr qwe zzt prg hjk vbn".split()}
    make = lambda lang, n: " ".join(rng.choice(own[lang]) + rng.choice(own[lang]) for _ in range(n))
    texts = [make("aa" if i % 2 else "bb", 60) for i in range(160)] + [None, "", "123 !!", "²", "KALO MINE TUSO LOKA NETU SOMI " * 4]
    lang = lambda i: ("aa" if i % 2 else "bb") if i < 150 else None
    docs = _docs(spark, texts, lang=lang).withColumn("held_out", langid.held_out("doc_id"))
    assert {r["doc_id"]: r["held_out"] for r in docs.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(165)}
    learned = langid.train(docs.filter("NOT held_out"))
    assert [x for x, _ in learned] in (["aa", "bb"], ["bb", "aa"])
    got = {r["doc_id"]: r for r in langid.predict(docs, learned, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(160))
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["lang"]) == ("und", 0.0, None) for i in range(160, 164))
    assert got[164]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.predict(docs, [], ["doc_id"]).collect()} == {"und"}
    assert langid.train(docs.filter("false")) == [] and langid.predict(docs.filter("false"), learned, ["doc_id"]).count() == 0


def test_langid_training_is_bounded(spark):
    docs = _docs(spark, [f"text number {i} of many" for i in range(300)] + ["same"] * 50)
    content = dict(langid.train(docs, texts=10, chars=8))["en"].decode()
    assert len(content) <= 10 * (8 + 2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out("doc_id"))
    learned = langid.train(docs.filter("NOT held_out"))
    rows = langid.predict(docs.filter("held_out"), learned, ["doc_id", "lang"]).toPandas()
    rows.columns = ["doc_id", "lang", "lang_pred", "score", "accepted", "own"][:rows.shape[1]]
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.98


# ---- op7 ----

def _water(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= 3 * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mixing_plan(spark):
    rng = random.Random(9)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(300)] + [None, ""]
    source = lambda i: ["hot", "hot", "hot", "b", "é", None, "tiny"][i % 7 if i % 7 < 6 else (6 if i < 14 else 0)]
    docs = _docs(spark, texts, source=source)
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    rows = mixing.plan(docs, slots=256).collect()
    assert len(rows) == 305 and sorted(r["taken"] for r in rows) == sorted(r["taken"] for r in mixing.plan(docs.repartition(4), slots=256).collect())
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = _water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.5 + 1e-6
        assert {r["source_size"] for r in rows if r["source"] == s} == {sizes[s]}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.plan(docs.filter("false")).count() == 0 == mixing.mix(docs.filter("false")).count()


def test_schedule_spreads_sources(spark):
    goals = spark.createDataFrame([("a", 600), ("b", 300), (None, 100)], "source string, goal long")
    rows = [r for r in mixing.schedule(spark, goals, slots=64).collect()]
    assert {s: sum(r["tokens"] for r in rows if r["source"] == s) for s in ("a", "b", None)} == {"a": 600, "b": 300, None: 100}
    early = [r["source"] for r in sorted(rows, key=lambda r: r["slot"])[:16]]
    assert 8 <= early.count("a") <= 11 and 3 <= early.count("b") <= 6     # any stretch is near the weights


def test_mix_in_the_order_of_the_schedule(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randint(1, 12)) for _ in range(900)] + [None]
    docs = _docs(spark, texts, source=lambda i: ["a", "b", "b", None][i % 4])
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    rows = mixing.mix_in_order(docs).collect()
    assert sorted(str(r[:6]) for r in rows) == sorted(str(tuple(r)) for r in mixing.mix(docs).collect())
    rows.sort(key=lambda r: (r["slot"], r["block"]))
    words = [(r["source"], len(r["text"].split())) for r in rows]
    total = {s: sum(n for x, n in words if x == s) for s in ("a", "b", None)}
    budget, seen, so_far = sum(total.values()), 0, dict.fromkeys(total, 0)
    for s, n in words:
        so_far[s], seen = so_far[s] + n, seen + n
        if seen >= budget // 20:
            assert all(abs(so_far[x] - seen * total[x] / budget) <= 3 * 12 + 0.01 * budget for x in total), seen


def test_map_columns_and_nulls_that_change_places(spark):
    """Rows with a map column go through, and rows that differ only in which column is null stay apart."""
    rows = [(1, "a b c d", "s", {"k": 1}, None, 5), (1, "a b c d", "s", {"k": 1}, 5, None), (2, None, None, None, 1, 1), (3, "e f", "t", {}, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, x int, y int")
    mixed = mixing.mix(docs).collect()
    assert mixed and all(r["m"] is not None and r["doc_id"] in (1, 3) for r in mixed)
    assert len({r["tie"] for r in mixing.sized(docs).collect()}) == 4
    assert len(simhash.deduplicate(docs).collect()) == 3


def test_schedule_grows_with_the_sources(spark):
    """More sources than the least number of slots allows: still every stretch is near the weights."""
    docs = spark.createDataFrame([(i, "w " * 40, f"s{i % 600:03d}") for i in range(1800)], "doc_id long, text string, source string")
    rows = sorted(mixing.mix_in_order(docs, slots=1 << 10).collect(), key=lambda r: (r["slot"], r["block"]))
    assert max(r["slot"] for r in rows) >= 1 << 12
    early = {r["source"] for r in rows[:600]}
    assert len(early) > 350
    whole = [r["source"] for r in mixing.mix(docs).collect()]
    assert sorted(whole) == sorted(r["source"] for r in rows)


# ---- op10 ----

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x}</style><script>var t="</p><p>no</p>";</script></head>
<body><nav><ul><li><a href="/a">Home</a><li><a href='/b>c'>About us</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy this now.</div>
<article><h1>The  title&nbsp;here</h1><p><b>First line &lt;b&gt; of text.<br>and more<p>Second &amp paragraph of the text, long enough to read.
<div class="comments"><p>Nice article, thanks!</p></div></article><footer>&copy; site</footer></body></html>"""


def test_blocks_of_a_page():
    got = pages.blocks(PAGE)
    assert [b.text for b in got] == ["T & t", "Home", "About us", "Buy this now.", "The title here", "First line <b> of text. and more",
                                     "Second & paragraph of the text, long enough to read.", "Nice article, thanks!", "© site"]
    assert [b.mark for b in got] == [0, 0, 0, 0, 1, 1, 1, 0, 0]
    assert got[1].linked == 4 and got[4].linked == 0
    for t in ("", "<", "a<b", "<p", "<p class='x", "<script>x", "&am", "</p></p>", "<![CDATA[x]]>", "<" * 3000, "<p>" * 3000, "<a " + "'\"" * 999):
        pages.blocks(t)
    assert [b.text for b in pages.blocks("a &am")] == ["a &am"] and pages.blocks("x<p")[0].text == "x"


@pytest.mark.parametrize("tag", ["math", "svg", "object", "template", "noscript", "iframe", "noembed", "noframes", "xmp"])
def test_text_of_every_element_but_scripts_and_styles_is_read(tag):
    assert [b.text for b in pages.blocks(f"<p>so <{tag}><i>x</i></{tag}> holds.<p>more")] == [
        "so <i>x</i> holds." if tag == "xmp" else "so x holds.", "more"]
    assert [b.text for b in pages.blocks(f"<article><p>one<{tag} a='b'> two</p><p>three</p></article><p>four")] == ["one two", "three", "four"]


def test_content_that_is_no_text():
    drawn = "<p>a <svg><style>p{}</style><title>t</title><text>l</text><text>m</text></svg> b<script>if (x<y) {}</script> c<textarea>d</textarea> e</p>"
    assert [b.text for b in pages.blocks(drawn)] == ["a t l m b c e"]
    assert [b.text for b in pages.blocks("<p>a<textarea> b</p><p>c<textarea> d</p><script>no")] == ["a b", "c d"]
    assert len(pages.blocks("<p>a<textarea>" * 20_000)) == 20_000      # one search for the missing end


def test_outer_marks_reach_the_network_past_many_classes():
    styled = "".join(f'<div class="{" ".join(f"u{k}x{j}" for j in range(15))}">' for k in range(3))
    first = [pages.blocks(f"<{outer}>{styled}text here.") for outer in ("nav", "article")]
    assert all(len(b) == 1 and len(b[0].path) > 40 for b in first)
    assert [b[0].mark for b in first] == [0.0, 1.0]
    for b in first:
        assert all(pages.vectors(b)[0, s] for s in pages._slots(b[0].path[0]))
    assert not np.array_equal(*map(pages.vectors, first))


def test_gradient_of_the_labeller():
    rng = np.random.default_rng(0)
    model = pages.BiLstm(dims=6, hidden=3)
    for p in model.parameters():
        p[...] = rng.normal(size=p.shape) * 0.5
    x = rng.normal(size=(5, 2, 6)).astype(np.float32)
    mask = np.ones((5, 2), np.float32)
    mask[3:, 1] = 0
    y = (rng.random((5, 2)) > 0.5).astype(np.float32)
    _, grads = model.gradient(x, mask, y, mask)
    for p, g in zip(model.parameters(), grads):
        for at in list(np.ndindex(p.shape))[:: max(p.size // 5, 1)]:
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = model.gradient(x, mask, y, mask)[0]
            p[at] = old - eps
            down = model.gradient(x, mask, y, mask)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_extraction_on_pages_not_seen(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id")
    rows = df.collect()
    model = pages.train([r["html"] for r in rows[:60]], epochs=10)
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<p"), (-4, "u", rows[70]["html"]), (-4, "u", rows[70]["html"])],
                                "page_id long, url string, html string")
    got = pages.extract(df.unionByName(odd), ["page_id", "url"], model=model).collect()
    text = {r["page_id"]: r["text"] for r in got}
    wrong = 0
    for r in rows[60:]:
        want = "\n\n".join(b.text for b in pages.blocks(r["html"]) if b.mark == 1)
        wrong += text[r["page_id"]] != want
    assert wrong <= 2 and len(got) == len(rows) + 5
    assert text[-1] == text[-2] == text[-3] == "" and text[-4] == text[rows[70]["page_id"]]
    assert pages.extract(df.filter("false"), ["page_id"]).count() == 0


# ---- pipeline ----

def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    frame = docs
    counts = []
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, SF_SMALL)
        if name != "packing":
            assert frame.columns == docs.columns and frame.schema == docs.schema, name
            frame = spark.createDataFrame(frame.collect(), docs.schema)
            counts.append(frame.count())
    assert counts[0] >= counts[1] == counts[2] > 0
    total = frame.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in total)
    assert cp.run(spark, SF_SMALL).count() > 0
