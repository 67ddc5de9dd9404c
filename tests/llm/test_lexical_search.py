import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from tidegauge.llm import lexical_search as ls
from tidegauge.llm.lexical_search import OP12_SQL, bounds, op12_pair_maxscore, rank, search_block

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item_id, rank, doc_id, score) from scoring every document for every item."""
    bags = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                for t in set(cut(text))
                if t in b
            )
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def same(found, docs, items, k):
    got = sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=key)
    assert got == sorted(plain(docs, items, k), key=key)
    return got


def test_op12_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    count, difference = oracle.compare(op12_pair_maxscore(spark, folder), oracle.connect(folder), OP12_SQL)
    assert difference is None and count > 0


@pytest.mark.parametrize("size", [{}, {"block_docs": 7}, {"block_terms": 500, "chunk_terms": 40, "first": 3}])
def test_equals_plain(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").limit(12)
    rows, asked = ([tuple(r) for r in x.collect()] for x in (docs, items))
    assert same(rank(docs, spark.createDataFrame(asked, items.schema), k=5, **size), rows, asked, 5)


def test_odd_rows(spark, odd, none):
    asked = [(1, "river, STONE river"), (1, "river, STONE river"), (2, None), (3, "..."), (4, "漢字 äöü ÄÖÜ nowhere"),
             (None, "garden THE of"), (5, "words"), (1, "letter")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("rank", F.lit("mine"))
    docs = odd.withColumns({c: F.lit("mine") for c in ("rank", "score", "number", "terms", "item_id", "_id", "_text")})
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for size in ({}, {"block_docs": 1}, {"block_terms": 100}):
        got = same(rank(docs, items, k=9, **size), rows, asked, 9)
        assert any(r[2] is None for r in got)
    assert rank(none, items).count() == 0 and rank(odd, items.limit(0)).count() == 0


def test_ties_go_by_id(spark):
    rows = [(i, "same words here") for i in range(300)] + [(1000, "same words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(1, "same now")]
    same(rank(docs, spark.createDataFrame(items, "item_id long, text string"), k=50, block_docs=16), rows, items, 50)


def test_bounds_hold_and_pairs_tighten():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lists = [{int(d): int(rng.integers(1, 100)) for d in rng.choice(40, rng.integers(1, 12), False)} for _ in range(6)]
        most = [max(x.values()) for x in lists]
        mates = [[(i, max((lists[i][d] + lists[j][d] for d in lists[i].keys() & lists[j].keys()), default=0)) for i in range(j)] for j in range(6)]
        got, alone = bounds(most, mates), bounds(most, [[]] * 6)
        assert alone == [sum(most[:p]) for p in range(7)]
        for p in range(7):
            real = max((sum(x.get(d, 0) for x in lists[:p]) for d in range(40)))
            assert real <= got[p] <= alone[p]
    assert bounds([5, 7], [[], [(0, 0)]]) == [0, 5, 7]


def test_pairs_rule_out_more(spark):
    """With pairs fewer documents are scored in full than with the maxima of single terms."""
    folder = "/root/testdata/sf0.1"
    index = ls.build_index(spark.read.parquet(f"{folder}/documents.parquet").limit(4000)).cache()
    asked = ls.numbered_items(spark.read.parquet(f"{folder}/benchmark.parquet").limit(40), "item_id", "text").collect()
    stats = ls.statistics(index)
    wanted = spark.createDataFrame([(t,) for r in asked for t in r["terms"]], "term string").distinct()
    df = {r["term"]: r["df"] for r in ls.document_frequencies(index, wanted).collect()}
    chunk = ls.Chunk.of([(r["number"], r["terms"]) for r in asked], {t: ls.weight(stats.docs, x) for t, x in df.items()}, 4)
    full = {True: 0, False: 0}
    for row in ls.impacts(index, chunk, stats).collect():
        block = ls.Block(row)
        for own in chunk.items.values():
            best = [search_block(block, own, 10, 1, pairs) for pairs in (True, False)]
            assert (best[0][0] == best[1][0]).all() and (best[0][1] == best[1][1]).all()
            least = int(best[0][1][-1]) if len(best[0][1]) else 1
            for pairs in full:
                full[pairs] += search_block(block, own, 10, least, pairs)[2]
    index.unpersist()
    assert full[True] <= full[False]
