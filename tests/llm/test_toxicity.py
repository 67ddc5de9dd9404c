import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm.toxicity import Model, features, fit, held_out, op11_toxicity, risk, score, train, words

FOLDER = "/root/testdata/sf0.1"


def plain_score(model, text):
    z = model.offset
    for w in {x for x in words(text)}:
        z += sum(model.weights.get(f, 0.0) for f in features(w))
    return 1 / (1 + np.exp(-z))


def test_op11_held_out(spark):
    """Labels of documents that training never saw: most toxic ones are found, clean ones left alone."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    found = op11_toxicity(spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = found.join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"])
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == rows["predicted"]).all()
    rank, toxic = rows["score"].rank(), rows["toxic"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()
    assert auc > 0.93
    assert rows.loc[toxic, "predicted"].mean() > 0.85 and rows.loc[~toxic, "predicted"].mean() < 0.02


def test_scores_equal_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = Model({"=the": 0.5, "<ing": 0.25, "ing>": 0.125, "<uni": 2.0}, -1.5)
    want = {r["doc_id"]: plain_score(model, r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_risk_is_never_paid_for_going_below_zero():
    rng = np.random.default_rng(1)
    p, u, prior = rng.normal(size=20), rng.normal(size=50), 0.3

    def parts(a, b):
        toxic = prior * np.log1p(np.exp(-a)).mean()
        return toxic, np.log1p(np.exp(b)).mean() - prior * np.log1p(np.exp(a)).mean()

    for shift in (0.0, 6.0):  # with 6 the estimate for clean text is negative
        a = p + shift
        toxic, clean, on_p, on_u = risk(a, u - shift, prior)
        assert (toxic, clean) == pytest.approx(parts(a, u - shift))
        target = (lambda x, y: sum(parts(x, y))) if clean >= 0 else (lambda x, y: -parts(x, y)[1])
        e = 1e-6
        for i in range(5):
            d = np.eye(20)[i] * e
            assert on_p[i] == pytest.approx((target(a + d, u - shift) - target(a - d, u - shift)) / (2 * e), abs=1e-6)
            d = np.eye(50)[i] * e
            assert on_u[i] == pytest.approx((target(a, u - shift + d) - target(a, u - shift - d)) / (2 * e), abs=1e-6)
    assert risk(p + 6, u - 6, prior)[1] < 0


def test_beginnings_of_words_are_learnt():
    """Toxic words that were never seen whole, in long texts; no text is known to be clean."""
    rng = np.random.default_rng(2)
    clean = lambda n: " ".join(f"{a}{b}" for a, b in zip(rng.choice(list("bcdfg"), n), rng.integers(0, 500, n)))
    bad = lambda n: f"{clean(n)} zorq{rng.integers(10**6)} {clean(n)}"
    positive = [bad(60) for _ in range(80)]
    unlabelled = [clean(120) for _ in range(270)] + [bad(60) for _ in range(30)]
    model = train(positive, unlabelled, 0.1)
    assert np.mean([plain_score(model, bad(150)) >= 0.5 for _ in range(50)]) > 0.95
    assert np.mean([plain_score(model, clean(300)) >= 0.5 for _ in range(50)]) < 0.05


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(5, 1), (5, 0), (6, 1), (7, 1), (8, 0), (9, None), (None, 1), (4, 2)], "doc_id long, toxic int"
    )
    model = fit(odd, labels, least=1, lift=0.0)
    rows = score(odd.withColumn("score", F.lit("mine")), model)
    assert rows.count() == odd.count() and "text" not in rows.columns
    want = {r["text"]: plain_score(model, r["text"]) for r in odd.collect()}
    texts = score(odd.withColumn("same", F.col("text")), model).select("same", "score").collect()
    assert all(abs(r["score"] - want[r["same"]]) < 1e-12 for r in texts)
    assert score(none, model).count() == 0
    assert fit(none, labels).weights == {} and fit(odd, labels.limit(0)).weights == {}
    assert fit(odd, labels.limit(0)).offset < -9


def test_an_id_in_a_third_of_the_rows_is_one_text(spark):
    rows = [(1, f"vile{i} words") for i in range(500)] + [(i, f"calm{i} words") for i in range(2, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    model = fit(docs, labels, least=1, lift=0.0, steps=3)
    assert not any(f.startswith("=vile") for f in model.weights if f != "=vile0")


def test_labels_held_out_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit(docs, x, learn=~held_out(), steps=5) for x in (labels, turned))
    assert a == b
