import math
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tidegauge.llm.compression_classifier import fit, held_out, op4_compression_quality, score

SF = "/root/testdata/sf0.1"


def test_op4_on_held_out_documents(spark):
    rows = op4_compression_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = [s for s, _, y in seen if y == 1]
    bad = [s for s, _, y in seen if y == 0]
    assert len(good) > 100 and len(bad) > 20
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.95
    assert sum(p == y for _, p, y in seen) / len(seen) > 0.94
    # Calibrated: the mean score is near the share of good documents.
    assert abs(sum(s for s, _, _ in seen) / len(seen) - len(good) / len(seen)) < 0.05


def test_held_out_rows_are_never_learnt(spark):
    """Turning the labels of the held-out rows round changes nothing."""
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (fit(docs, x, learn=~held_out()) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("values", [[], [(5, 1)], [(5, 1), (10, 0), (6, None), (None, 1)]])
def test_odd_rows(spark, odd, none, values):
    labels = spark.createDataFrame(values, "doc_id long, quality int")
    model = fit(odd, labels)
    rows = score(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert score(none, model).count() == 0
    assert fit(none, labels).slope == 0


def test_scores_equal_plain(spark):
    """A score recomputed text by text: sizes under both dictionaries of every pair, the limit and the curve."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), learn=~held_out())
    assert model.good and model.slope > 0

    def size(dictionary, data):
        used = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=used).compress(data))

    some = docs.where("doc_id % 40 = 0")
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in score(some, model).collect():
        data = (texts[r.doc_id] or "").encode()
        saved = sum(size(b, data) - size(g, data) for g, b in zip(model.good, model.bad)) / len(model.good)
        x = max(-model.limit, min(model.limit, saved / math.sqrt(len(data) + 1))) / model.limit
        assert abs(r.score - 1 / (1 + math.exp(-(model.slope * x + model.offset)))) < 1e-6


def test_an_id_in_a_third_of_the_rows_is_one_text(spark):
    """A labelled id that stands in very many documents brings one of them, and no other changes the model."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    one = labels.where("quality = 1").agg(F.min("doc_id")).first()[0]
    copies = spark.range(500).select(F.lit(one).alias("doc_id"), F.concat(F.lit("\uffff"), "id").alias("text"))
    assert fit(docs.unionByName(copies), labels) == fit(docs, labels)
