"""The pipeline against plain Python versions of its five stages."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_mixing import plain_budgets
from test_quality_rules import bits, plain_counts, plain_models
from test_simhash import grouped
from test_simhash import plain as plain_print
from test_suffix_dedup import plain as plain_cut

import corpus_pipeline
from tidegauge.llm.mixing import WEIGHTS
from tidegauge.llm.sentencepiece_codec import Codec, default_model

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_quality(docs):
    models, measured = plain_models((d[2], d[1]) for d in docs), []
    by_lang = defaultdict(dict)
    for d in docs:
        n = plain_counts(d[1])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        b = None if failed else bits(models[d[2]], d[1])
        measured.append(b)
        if b is not None:
            by_lang[d[2]][d[1]] = round(round(b, 6), 3)
    out = []
    for d, b in zip(docs, measured):
        if b is None:
            continue
        x = sorted(by_lang[d[2]].values())
        q1, q3 = x[-(-len(x) // 4) - 1], x[-(-3 * len(x) // 4) - 1]
        wide = 3 * max(q3 - q1, 0.1)
        if q1 - wide - 1e-9 <= round(b, 6) <= q3 + wide + 1e-9:
            out.append(d)
    return out


def plain_near(docs):
    docs = sorted(docs, key=lambda d: d[0])
    roots = grouped([plain_print(d[1]) for d in docs], 3)
    return [d for i, d in enumerate(docs) if roots[i] == i]


def plain_suffix(docs):
    kept = plain_cut([(d[0], d[1]) for d in docs])
    texts = [k[2].decode(errors="ignore") for k in kept]
    return [(d[0], t, d[2], d[3], len(t)) for d, t in zip(docs, texts)]


def plain_mix(docs):
    def leaf(d):
        return (f"domain{int(d[3][-1]) % 4}", d[2], d[3])

    available = defaultdict(int)
    for d in docs:
        available[leaf(d)] += plain_counts(d[1])[0]
    given = plain_budgets(available, WEIGHTS, sum(available.values()), 2)
    out = []
    for path, b in given.items():
        own = [d for d in docs if leaf(d) == path]
        whole, rest = divmod(b, available[path]) if available[path] else (0, 0)
        out += own * whole
        used = 0
        for d in sorted(own, key=lambda d: hashlib.md5(f"1:{whole}:{d[0]}".encode()).hexdigest()):
            used += plain_counts(d[1])[0]
            if used > rest or not (rest or not whole):
                break
            out.append(d)
    return out


def test_run_equals_plain_stages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    sizes = [len(docs)]
    for stage in (plain_quality, plain_near, plain_suffix, plain_mix):
        docs = stage(docs)
        sizes.append(len(docs))
    assert sizes[0] > sizes[1] > sizes[2] and sizes[4] > 0
    codec = Codec(default_model())
    want = []
    for i, t, lang, source, _ in docs:
        ids = codec.processor.encode(t, add_eos=True)
        want.append((i, lang, source, len(ids), ids, codec.processor.decode(ids) == t))
    got = [(*r[:4], list(r.ids), r.round_trip) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, none, k):
    """Nulls, empty, long and repeated rows; the columns of documents come back."""
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd.select(*COLUMNS), odd.withColumn("_part", F.lit("mine"))):
        rows = stage(spark, docs, SF)
        if k < 4:
            assert rows.columns == docs.columns
        assert rows.count() <= 2 * docs.count()
    if k in (2, 4):
        assert rows.count() == 13
    if k == 1:
        assert rows.where("doc_id in (5, 6)").count() == 1
    assert stage(spark, none.select(*COLUMNS), SF).count() == 0
