"""Schemas, sources, stream-equals-batch, sentence vectors, model, entry."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pairfeat.operators import lexical as lex
from pairfeat.operators import sentvec as sv
from pairfeat.operators import vectors as vec
from pairfeat.plans import model
from pairfeat.session import scratch_dir
from pairfeat.sources import pairs as src
from pairfeat.streaming import score


def test_lexical_schema(spark):
    df = spark.createDataFrame([("1", "ab c", "a bc", "0")], "qid string, ql string, qr string, label string")
    out = lex.lexical_features(df)
    assert out.columns[1:] == lex.LEXICAL_NAMES and len(lex.LEXICAL_NAMES) == 87
    out2 = lex.lexical_features(df, families=lex.FAMILIES)
    assert len(out2.columns) - 1 == 132
    assert len(vec.DIST_NAMES) == 16


def test_tsv_edge_rows(spark, tmp_path):
    p = tmp_path / "pairs.tsv"
    p.write_text('q1\t"q""3"\tb\t0\nq2\ta"b\tc\t1\nq3\t\tc\t0\nq4\tNA\tc\t0\nq5\ta\tb\n', encoding="utf-8")
    rows = {r["qid"]: r for r in src.read_pairs(spark, str(p)).collect()}
    assert rows["q1"]["ql"] == 'q"3'
    assert rows["q2"]["ql"] == 'a"b'
    assert rows["q3"]["ql"] is None
    assert rows["q4"]["ql"] == "NA"
    assert rows["q5"]["label"] is None
    ok, rejects = src.split_rejects(src.read_pairs(spark, str(p)))
    assert [r["qid"] for r in rejects.collect()] == ["q3"]


def test_stream_equals_batch(spark):
    lines = src.sent_pairs(spark, SF_SMALL).limit(200).select(
        F.concat_ws("\t", "qid", "ql", "qr", "label").alias("value"))
    lines = spark.createDataFrame(lines.collect(), "value string")   # a fixed small input for this test
    base = scratch_dir(spark, "stream-test")
    lines.union(spark.createDataFrame([("only-two\tfields",)], "value string")) \
        .repartition(3).write.text(f"{base}/in")
    q = score.start_scoring_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", max_files_per_trigger=1)
    q.awaitTermination()
    streamed = sorted(r["value"] for r in spark.read.text(f"{base}/out/batch=*").collect())
    batch = sorted(r["value"] for r in score.score_batch(lines).select("value").collect())
    assert streamed == batch and len(batch) == 200
    assert [r["value"] for r in spark.read.text(f"{base}/out/_rejects/batch=*").collect()] == ["only-two\tfields"]


def test_sif_direction_matches_numpy(spark):
    wv = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 2.0, 0.0]), ("c", [1.0, 1.0, 1.0])],
                               "term string, vec array<double>")
    wf = spark.createDataFrame([("a", 10), ("b", 1), ("c", 5)], "term string, freq long")
    lexicon = sv.build_lexicon(wv, wf)
    pairs = spark.createDataFrame([("1", "a b", "c", "0"), ("2", "b b", "a c", "0"), ("3", "zz", "a", "0")],
                                  "qid string, ql string, qr string, label string")
    sent = {(r["qid"], r["side"]): np.array(r["vec"]) for r in sv.sentence_vectors(pairs, lexicon).collect()}
    p = {"a": 10 / 16, "b": 1 / 16, "c": 5 / 16}
    vecs = {"a": np.array([1.0, 0, 0]), "b": np.array([0, 2.0, 0]), "c": np.array([1.0, 1, 1])}
    w = {t: 1e-3 / (1e-3 + p[t]) for t in p}
    want = {("1", "l"): (w["a"] * vecs["a"] + w["b"] * vecs["b"]) / 2, ("1", "r"): w["c"] * vecs["c"],
            ("2", "l"): w["b"] * vecs["b"], ("2", "r"): (w["a"] * vecs["a"] + w["c"] * vecs["c"]) / 2,
            ("3", "r"): w["a"] * vecs["a"]}
    assert set(sent) == set(want)
    for k in want:
        assert np.allclose(sent[k], want[k])
    u = sv.first_direction(sv.sentence_vectors(pairs, lexicon), 3)
    m = np.array([want[k] for k in sorted(want)])
    top = np.linalg.svd(m)[2][0]
    assert abs(abs(float(u @ top)) - 1.0) < 1e-9
    f = {r["qid"]: r for r in sv.sif_features(pairs, lexicon).collect()}
    vl = (want[("3", "l")] if ("3", "l") in want else np.zeros(3))
    vr = want[("3", "r")] - (want[("3", "r")] @ top) * top
    assert f["3"]["sif_PED"] == pytest.approx(float(np.linalg.norm(vl - vr)))
    assert f["3"]["sif_PCD"] == pytest.approx(0.5)


def test_split_is_reproducible_and_exact(spark):
    for n in (20003, 7, 1, 0):
        df = spark.range(n).select((F.col("id") % 5).cast("string").alias("qid"), F.col("id").cast("string").alias("ql"),
                                   F.lit("x").alias("qr"), F.lit("0").alias("label"))
        a = {r["ql"] for r in model.with_split_flag(df).filter("is_test").collect()}
        b = {r["ql"] for r in model.with_split_flag(df.repartition(3)).filter("is_test").collect()}
        assert a == b and len(a) == -(-n // 10)


def test_split_of_tied_pairs_is_exact(spark):
    """A third of all rows are one pair, wherever the threshold falls."""
    for n, fraction in ((300, 0.1), (300, 0.5), (301, 0.9), (60, 1.0)):
        rows = [("q", "same", "pair", "1") if i % 3 == 0 else (str(i), "a", "b", "0") for i in range(n)]
        out = model.with_split_flag(spark.createDataFrame(rows, "qid string, ql string, qr string, label string").repartition(4), fraction)
        assert out.columns == ["qid", "ql", "qr", "label", "is_test"]
        assert out.count() == n and out.filter("is_test").count() == -(-n * fraction // 1)


def _dense_svm(x, y):
    """Newton's method on the whole matrix."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    f = lambda v: v @ v / 2 + (np.maximum(1 - y * (x @ v), 0) ** 2).sum()
    for _ in range(500):
        gap = np.maximum(1 - y * (x @ w), 0)
        g = w - 2 * x.T @ (y * gap)
        inner = x[gap > 0]
        step = np.linalg.solve(np.eye(len(w)) + 2 * inner.T @ inner, -g)
        t = 1.0
        while f(w + t * step) > f(w) + 1e-4 * t * (g @ step) and t > 1e-14:
            t /= 2
        w = w + t * step
        if np.linalg.norm(g) < 1e-10:
            break
    return w


def test_squared_hinge_svm_matches_a_dense_solution(spark, tmp_path):
    from pairfeat.plans import svm
    rng = np.random.default_rng(5)
    for n, d, noise in ((400, 6, 2.0), (300, 3, 0.0), (50, 20, 1.0)):
        x = rng.normal(size=(n, d)) * np.linspace(0.1, 30, d) + 2
        y = np.where(x @ rng.normal(size=d) + noise * 10 * rng.normal(size=n) > 3, 1.0, -1.0)
        cols = [f"f{k}" for k in range(d)]
        df = spark.createDataFrame([("p" if s > 0 else "n", *map(float, r)) for s, r in zip(y, x)], ["label", *cols]).repartition(3)
        m = svm.fit_svm(df, cols, "label", "p", "n", tol=1e-13)
        want = _dense_svm(x, y)
        assert np.allclose([*m.weights, m.bias], want, rtol=0, atol=1e-6)
        m.save(spark, str(tmp_path / f"m{n}"))
        assert svm.LinearSvm.load(spark, str(tmp_path / f"m{n}")) == m
        pred = {tuple(r)[:-1]: r["pred"] for r in df.select(*cols, m.predicted().alias("pred")).collect()}
        assert [pred[tuple(map(float, r))] for r in x] == ["p" if v > 0 else "n" for v in x @ want[:-1] + want[-1]]


def test_trained_model_matches_a_dense_solution(spark):
    """All features of the sf0.001 training pairs."""
    from pairfeat.plans import queries as Q, svm
    result = Q._trained(spark, SF_SMALL)
    pairs = src.training_pairs(spark, SF_SMALL)
    flags = model.with_split_flag(pairs)
    lexicon = Q.fixture_lexicon(spark, SF_SMALL)
    u = sv.fit_direction(flags.filter("NOT is_test"), lexicon)
    f = model.model_features(flags.filter("NOT is_test"), Q.fitted_vocabulary(spark, SF_SMALL), lexicon, u).toPandas()
    assert len(f) == result.n_train and model.feature_columns(flags.limit(0).sparkSession.createDataFrame(f.head(1))) == result.features
    want = _dense_svm(f[result.features].to_numpy(float), np.where(f.label == max(f.label), 1.0, -1.0))
    m = svm.fit_svm(spark.createDataFrame(f), result.features, "label", max(f.label), min(f.label), tol=1e-13)
    assert np.abs(np.array([*m.weights, m.bias]) - want).max() < 1e-6
    assert result.report.count() == 3 and 0.5 < result.micro_f1 <= 1


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_projections_do_not_shuffle(spark):
    from pairfeat.operators import mt as mtf
    pairs = spark.createDataFrame([("1", "a b", "b c", "0")] * 50, "qid string, ql string, qr string, label string")
    assert _exchanges(lex.lexical_features(pairs, families=lex.FAMILIES)) == 0
    assert _exchanges(mtf.mt_features(pairs)) == 0


def test_repeated_and_missing_ids(spark):
    """Every pair has its own values, whatever its id, and every line one line out."""
    rows = [("q1", "the thing", "the thing", "1"), ("q1", "a nation", "other words", "0"), (None, "b", "b c", "0"),
            ("q1", "the thing", "the thing", "1")]
    schema = "qid string, ql string, qr string, label string"
    vocab = vec.fit_vocabulary(spark.createDataFrame([(i, r[1] + " " + r[2]) for i, r in enumerate(rows)], "doc_id long, text string"))
    wv = spark.createDataFrame([(w, [float(len(w)), 1.0, float(i)]) for i, w in enumerate(("the", "thing", "nation", "other"))],
                               "term string, vec array<double>")
    lexicon = sv.build_lexicon(wv, spark.createDataFrame([("the", 5), ("thing", 2)], "term string, freq long"))
    u = np.array([1.0, 0.0, 0.0])
    features = score.model_json(vocab, lexicon, u)
    together = features(spark.createDataFrame(rows, schema), ("ql", "qr")).collect()
    assert len(together) == 4 and len(together[0]) == 2 + 87 + 16 + 3
    for r in rows:
        alone = features(spark.createDataFrame([r], schema), ("ql", "qr")).first()
        assert [x for x in together if (x["ql"], x["qr"]) == (r[1], r[2])][0] == alone
    lines = spark.createDataFrame([("\t".join(x or "" for x in r),) for r in rows], "value string")
    assert score.score_batch(lines).count() == 4
    v = {(r["qid"], r["count1_PED"]) for r in vec.vector_features(spark.createDataFrame(rows, schema), vocab, ("all",)).collect()}
    assert ("q1", 0.0) in v and len(v) == 3


def test_stream_equals_batch_for_the_model(spark):
    pairs = src.sent_pairs(spark, SF_SMALL).limit(60)
    lines = spark.createDataFrame(pairs.select(F.concat_ws("\t", "qid", "ql", "qr", "label").alias("value")).collect(), "value string")
    vocab = vec.fit_vocabulary(src.corpus_texts(spark, SF_SMALL), persist_to=scratch_dir(spark, "vocab-test"))
    wf = spark.createDataFrame([("the", 50), ("of", 20), ("and", 9)], "term string, freq long")
    wv = spark.createDataFrame([("the", [1.0, 2.0]), ("of", [0.5, -1.0]), ("and", [2.0, 0.0])], "term string, vec array<double>")
    lexicon = sv.build_lexicon(wv, wf)
    path = scratch_dir(spark, "direction")
    sv.save_direction(spark, sv.fit_direction(pairs, lexicon), path)
    features = score.model_json(vocab, lexicon, sv.load_direction(spark, path))
    base = scratch_dir(spark, "stream-model")
    lines.repartition(3).write.text(f"{base}/in")
    score.start_scoring_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", features, max_files_per_trigger=1).awaitTermination()
    streamed = sorted(r["value"] for r in spark.read.text(f"{base}/out/batch=*").collect())
    assert streamed == sorted(r["value"] for r in score.score_batch(lines, features).collect()) and len(streamed) == 60


def test_common_directions_of_any_width(spark, monkeypatch):
    rng = np.random.default_rng(0)
    for d, whole in ((3, 512), (128, 512), (300, 512), (300, 64), (40, 4)):
        monkeypatch.setattr(sv, "WHOLE", whole)
        m = rng.normal(size=(80, d)) @ np.diag(0.8 ** np.arange(d)) + 0.3
        df = spark.createDataFrame([(x.tolist(),) for x in m], "vec array<double>").repartition(3)
        got, want = sv.common_directions(df, d, 3), np.linalg.svd(m)[2][:3]
        assert np.abs(np.abs((got * want).sum(1)) - 1).max() < 1e-9 and np.allclose(got @ got.T, np.eye(3))
    assert np.isfinite(sv.common_directions(df.filter("false"), 40, 2)).all()


def test_checkpoint_folder_must_be_shared():
    from pairfeat.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_report_rows(spark):
    pred = spark.createDataFrame([("1", "0", "0"), ("2", "0", "1"), ("3", "1", "1"), ("4", "1", "1")],
                                 "qid string, label string, pred string")
    rows = {r["class"]: r for r in model.classification_report(pred, ["0", "1"]).collect()}
    assert rows["paraphrase"]["precision"] == 1.0 and rows["paraphrase"]["recall"] == 0.5
    assert rows["other"]["precision"] == pytest.approx(2 / 3) and rows["other"]["support"] == 2
    assert rows["avg / total"]["support"] == 4
    assert model.micro_f1(pred).first()["micro_f1"] == 0.75


def test_entry_smoke(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    assert df.count() > 0 and len(df.columns) == 88
    assert set(oracle_sql()) <= set(queries())


def test_lexicon_tagger(spark):
    from pairfeat.operators import tagging
    lexicon = spark.createDataFrame([("cat", "n"), ("runs", "v"), ("fast", "d")], "term string, postag string")
    pairs = spark.createDataFrame([("1", "the cat runs fast", "cat walking", "0"), ("2", "", "nation", "0")],
                                  "qid string, ql string, qr string, label string")
    got = {r["qid"]: r for r in tagging.tokens_from_lexicon(pairs, lexicon, 3).collect()}
    assert [(t["term"], t["postag"]) for t in got["1"]["tok_l"]] == [("the", "x"), ("cat", "n"), ("runs", "v"),
                                                                     ("fast", "d")]
    assert [(t["term"], t["postag"]) for t in got["1"]["tok_r"]] == [("cat", "n"), ("walking", "v")]
    assert got["2"]["tok_l"] == [] and [t["postag"] for t in got["2"]["tok_r"]] == ["n"]
    feats = lex.lexical_features(tagging.tokens_from_lexicon(pairs, lexicon, 3), families=("postag_len",))
    assert {r["qid"]: r["postag_len_intersect"] for r in feats.collect()} == {"1": 2, "2": 0}   # {n, v}
