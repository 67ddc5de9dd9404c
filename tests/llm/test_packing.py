import random
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers

from tidegauge.llm.packing import Tokenizer, best_fit_decreasing, op3_packing, pack_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return Tokenizer(ranks, public_tokenizers.PATTERN)


def plain(lengths, capacity):
    bins, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [b for b in range(len(bins)) if room[b] >= lengths[i]]
        if fit:
            b = min(fit, key=lambda b: (room[b], b))
        else:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] -= lengths[i]
    return bins


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 1000])
def test_best_fit_equals_scanning_all_bins(capacity):
    rnd = random.Random(capacity)
    for _ in range(40):
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 120))]
        assert best_fit_decreasing(lengths, capacity) == plain(lengths, capacity)


def test_words_encode_as_whole_texts(tokenizer):
    rnd = random.Random(1)
    for _ in range(5000):
        text = "".join(rnd.choice(["the", "a", " ", "  ", "\n", "\t", "é", "漢", "12", "'s", "...", " ", "😀", "!"]) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(tokenizer.encode(text), "<u2").tolist() == tokenizer.own.encode_ordinary(text)


def check(docs, packed, capacity, end, tokenizer, kind="<u2"):
    """Every row is full or padded, and the segments put together are the documents' ids."""
    got = defaultdict(list)
    for r in packed:
        ids, at = np.frombuffer(r.ids, dtype=kind), np.frombuffer(r.position_ids, dtype="<u2")
        cu = r.cu_seqlens
        assert len(ids) == len(at) == capacity and cu[0] == 0 and cu[-1] == r.n_ids <= capacity
        assert (ids[r.n_ids :] == (end or 0)).all() and (at[r.n_ids :] == 0).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, cu, cu[1:]):
            assert at[a:b].tolist() == list(range(b - a))
            got[d].append((s, ids[a:b].tolist()))
    want = defaultdict(list)
    for d, t in docs:
        ids = tokenizer.own.encode_ordinary(t or "") + ([end] if end is not None else [])
        want[d] += [(a, ids[a : a + capacity]) for a in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_op3_round_trip(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op3_packing(spark, SF).collect()
    check(docs, rows, 2048, 50_256, tokenizer)
    assert len({(r.shard, r.row) for r in rows}) == len(rows)


def test_packing_is_tight(spark, ranks):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    rows = pack_documents(docs, ranks, public_tokenizers.PATTERN, end_id=50_256).select("n_ids").collect()
    assert sum(r.n_ids for r in rows) > 0.97 * 2048 * len(rows)


@pytest.mark.parametrize("end", [None, 50_256])
def test_odd_rows(spark, odd, none, ranks, tokenizer, end):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rows = pack_documents(odd, ranks, public_tokenizers.PATTERN, capacity=100, end_id=end).collect()
    check(docs, rows, 100, end, tokenizer)
    assert pack_documents(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_rows_do_not_depend_on_settings(spark, ranks):
    """The number of shards follows from the documents, not from the session's shuffle partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key, found = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    try:
        for n in ("3", "11"):
            spark.conf.set(key, n)
            rows = pack_documents(docs, ranks, public_tokenizers.PATTERN, end_id=50_256, shard_bytes=100_000).collect()
            found.append(sorted(map(repr, rows)))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] and len({r.shard for r in rows}) > 3
