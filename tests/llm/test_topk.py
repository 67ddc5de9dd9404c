import numpy as np
import pytest

import oracle
from tidegauge.llm import topk
from tidegauge.llm.topk import OP5_SQL, Basis, Best, op5_segment_topk, search, segment_features, top_k


def test_op5_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    count, difference = oracle.compare(op5_segment_topk(spark, folder), oracle.connect(folder), OP5_SQL)
    assert difference is None and count > 0


@pytest.mark.parametrize("width", [1, 2, 7, 30, 64])
def test_bounds_hold(width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-900, 900, (50, width)), rng.integers(-900, 900, (40, width))
    basis = Basis.of(b)
    assert np.allclose(basis.rotation @ basis.rotation.T, np.eye(width))
    scores, last = a @ b.T, np.inf
    for starts in basis.starts:
        bound = segment_features(a @ basis.rotation, starts) @ segment_features(b @ basis.rotation, starts).T
        assert (bound + 1e-6 * abs(bound) + 1e-6 >= scores).all()
        assert bound.mean() <= last + 1e-6  # finer is tighter
        last = bound.mean()


@pytest.mark.parametrize("known", [False, True])
@pytest.mark.parametrize("width,big", [(64, 300), (5, 3), (1, 2), (0, 1), (8, 2**40)])
def test_search_equals_sorting(width, big, known):
    rng = np.random.default_rng(width)
    c = rng.integers(-big, big + 1, (2500, width))
    cid = rng.permutation(2500)
    q, qid = c[:20], cid[:20]
    basis = Basis.of(c[:100])
    floor = None
    if known:  # what a sample reaches is asked from the start
        first = Best(20, 10)
        search(qid, q, cid[:300], c[:300], first, basis)
        floor = first.floor
    best = Best(20, 10, floor)
    search(qid, q, cid, c, best, basis)
    for i in range(20):
        full = [
            (-max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(q[i], v)))), int(n))
            for v, n in zip(c, cid)
            if n != qid[i]
        ]
        want = [(n, -s) for s, n in sorted(full)[:10]]
        assert list(zip(best.id[best.row == i].tolist(), best.score[best.row == i].tolist())) == want


def test_few_pairs_get_an_exact_score(spark):
    """At most one pair in ten at sf0.1; the rest is ruled out by bounds."""
    rows = topk.whole_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding", 1024).collect()
    cid, c = np.array([r["_id"] for r in rows]), np.array([r["_v"] for r in rows])
    q = cid % 100 == 0
    work = search(cid[q], c[q], cid, c, Best(int(q.sum()), 10), Basis.of(c))
    assert work.pairs == q.sum() * (len(c) - 1) and work.exact <= 0.1 * work.pairs


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [0.5, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [nan, 1.0]),
            (5, [1.0, None]), (6, [inf, 0.0]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [9.0, 9.0]), (100, [-0.0001, 0.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in top_k(rows.where("vec_id in (0, 3, 4, 8, 100)"), rows, k=3).collect()]
    assert sorted(got) == [
        (0, 1, 1, 1572864), (0, 2, 2, 1572864), (0, 3, 2, 1572864),
        (100, 1, 0, -512), (100, 2, 1, -1024), (100, 3, 2, -1024),
    ]
    assert top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_blocks_and_partitions_change_nothing(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = rows.where("vec_id % 7 = 0")
    a = top_k(queries, rows).collect()
    b = top_k(queries, rows.repartition(7), query_block=9, sample_rows=13).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
