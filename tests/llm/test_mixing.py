import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import oracle
from tidegauge.llm import mixing
from tidegauge.llm.mixing import OP7_SQL, budgets, mix, op7_mixing, words


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op7_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    count, difference = oracle.compare(op7_mixing(spark, folder), oracle.connect(folder), OP7_SQL)
    assert difference is None and count > 0


def plain_budgets(leaves, weights, budget, epochs, default=1):
    """Fill siblings step by step with exact fractions, from the top down."""
    weight = lambda p: weights.get(p, default)
    room = defaultdict(int)
    for path, available in leaves.items():
        open_ = all(weight(path[:k]) for k in range(1, len(path) + 1))
        for k in range(len(path) + 1):
            room[path[:k]] += available * epochs * open_
    given = {(): min(budget, room[()])}
    for k in range(len(next(iter(leaves)))):
        for parent in {p[:k] for p in leaves}:
            todo = {p[: k + 1] for p in leaves if p[:k] == parent}
            left = given[parent]
            while True:
                total = sum(max(weight(p), 1) for p in todo)
                full = {p for p in todo if room[p] <= Fraction(left * max(weight(p), 1), total)}
                if not full:
                    break
                for p in full:
                    given[p] = room[p]
                    left -= room[p]
                todo -= full
                if not todo:
                    break
            for p in todo:
                given[p] = left * max(weight(p), 1) // total
    return {p: given[p] for p in leaves}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_step_by_step_filling(spark, seed):
    rnd = random.Random(seed)
    leaves = {
        (f"d{rnd.randint(0, 3)}", rnd.choice(["x", "y", None]), f"s{rnd.randint(0, 6)}"): rnd.choice(
            [0, 1, 5, 100, 10_000, 999_999]
        )
        for _ in range(30)
    }
    weights = {p[:k]: rnd.randint(0, 9) for p in leaves for k in (1, 2, 3) if rnd.random() < 0.6}
    df = spark.createDataFrame([(*p, a) for p, a in leaves.items()], "d string, l string, s string, available long")
    for budget in (0, 7, 50_000, 10**8):
        got = budgets(df, ["d", "l", "s"], weights, budget, 3).collect()
        assert {(r.d, r.l, r.s): r.budget for r in got} == plain_budgets(leaves, weights, budget, 3)


def test_prefixes_of_epochs(spark):
    """A hot leaf with repeated ids: whole epochs, then the prefix of the next in its seeded order."""
    rows = [(i % 900, "hot" if i % 3 else f"s{i % 5}", i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").repartition(5)
    for budget in (1, 500, 2600, 4000, 9000):
        got = defaultdict(list)
        for r in mix(df, ["source"], {("hot",): 5}, budget, tokens=F.col("n"), epochs=3, seed=9).collect():
            got[r.source].append((r.doc_id, r.epoch, r.tokens))
        leaves = defaultdict(int)
        for _, s, n in rows:
            leaves[(s,)] += n
        for (s,), b in plain_budgets(leaves, {("hot",): 5}, budget, 3).items():
            own = [(i, n) for i, t, n in rows if t == s]
            whole, rest = divmod(b, leaves[(s,)])
            want = [(i, e, n) for e in range(whole) for i, n in own]
            by_key, used = defaultdict(list), 0
            for i, n in own:
                by_key[hashlib.md5(f"9:{whole}:{i}".encode()).hexdigest()].append((i, whole, n))
            for key in sorted(by_key):
                used += sum(n for _, _, n in by_key[key])
                if used > rest or not (rest or not whole):
                    break
                want += by_key[key]
            assert sorted(got[s]) == sorted(want)


@pytest.mark.parametrize("few", [0, 3, 40])
def test_buckets_are_divided_until_they_are_small(spark, monkeypatch, few):
    """The same prefix whatever the size from which a bucket is looked at by document."""
    rows = [(i % 700, f"s{i % 2}", i % 7) for i in range(1000)] + [(5, "s1", 3)] * 500
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    draw = lambda: sorted(tuple(r) for r in mix(df, ["source"], {("s1",): 2}, 1700, tokens=F.col("n")).collect())
    want = draw()
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert draw() == want and want


def test_odd_rows(odd, none):
    out = mix(odd, ["lang", "source"], {}, epochs=1)
    assert out.count() == 13 and {r.ids for r in out.collect()} == {"mine"}  # all tokens, one epoch
    half = mix(odd, ["lang", "source"], {(None,): 0}, epochs=1).collect()
    assert all(r.lang is not None or r.tokens == 0 for r in half)
    assert mix(none, ["lang"], {}).count() == 0


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0b\n",), ("a b c",)], "text string")
    assert [r[0] for r in df.select(words(F.col("text"))).collect()] == [0, 0, 2, 2]


def test_plan_has_no_python_and_does_not_shuffle_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mix(docs, ["lang", "source"], {})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
