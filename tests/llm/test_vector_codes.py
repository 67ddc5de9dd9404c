import hashlib
from math import floor, isfinite

import numpy as np
import pytest

import oracle
from tidegauge.llm import vector_codes
from tidegauge.llm.vector_codes import OP13_SQL, fit, nearest, op13_vector_codes, quantise

FOLDER = "/root/testdata/sf0.01"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """The whole definition over rows (id, vector, label), in plain Python."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and isfinite(x) for x in r[1])]
    if not rows:
        return []
    ints = [[floor(scale * float(np.float32(x))) for x in v] for _, v, _ in rows]
    width = -(-max(map(len, ints)) // parts)
    ints = [v + [0] * (width * parts - len(v)) for v in ints]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [floor(scale * float(np.float32(x))) for x in rows[i][1]]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(near(p, v[p])[0], []).append(v[p])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])])
        books = new
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    error = [sum(d for _, d in f) for f in found]
    of = {}
    for r, e in zip(rows, error):
        of[r[2]] = of.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (r[0], r[2], "".join(f"{i:02x}" for i, _ in f), e, of[r[2]], sha) for r, f, e in zip(rows, found, error)
    ]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_op13_equals_sql(spark):
    count, difference = oracle.compare(op13_vector_codes(spark, FOLDER), oracle.connect(FOLDER), OP13_SQL)
    assert difference is None and count > 0


def test_equals_plain(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").limit(150)
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in rows.collect()]
    got = [tuple(r) for r in quantise(rows, owner_members=40).collect()]
    assert sorted(got, key=key) == sorted(plain(data), key=key)


def test_odd_rows(spark):
    """Nulls, ragged and empty vectors, repeated ids and rows, few rows, and names that clash."""
    nan, inf = float("nan"), float("inf")
    data = [
        (3, [0.5, -0.25, 1.0], 1), (3, [0.5, -0.25, 1.0], 1), (3, [0.25, 0.0, 1.0], None), (1, [1.0] * 33, 2), (2, [], 2),
        (4, None, 1), (5, [1.0, None], 1), (6, [nan], 1), (7, [inf, 0.0], 1), (8, [-inf], None), (None, [2.0, 2.0], None),
    ]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    for name in ("position", "entry", "salt", "n", "rows", "error", "code", "_v", "_id", "_label", "_of"):
        rows = rows.withColumn(name, rows["vec_id"])
    got = [tuple(r) for r in quantise(rows).collect()]
    assert sorted(got, key=key) == sorted(plain(data), key=key)
    assert quantise(rows.limit(0)).count() == 0 and fit(rows.limit(0)) is None
    assert quantise(rows.where("vec_id = 4")).collect() == []


def test_large_values_are_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**62), 2**62, (30, 3))
    at, d = nearest(x, x[:7])
    for i in range(30):
        want = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], e)) for e in x[:7]]
        assert d[i] == min(want) and at[i] == want.index(min(want))


def test_a_hot_vector_is_one_member(spark):
    """A third of all rows with one vector: its owner holds one member with many copies."""
    data = [(i, [float(i % 50), 1.0, 0.0, 2.0] if i % 3 else [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(900)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    how = {"parts": 2, "entries": 8}
    got = [tuple(r) for r in quantise(rows, **how, owner_members=100).collect()]
    assert sorted(got, key=key) == sorted(plain(data, **how), key=key)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_rounds(spark, rounds):
    rng = np.random.default_rng(rounds)
    data = [(int(i), [float(x) for x in rng.normal(size=8)], int(i) % 3) for i in rng.permutation(400)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    how = {"parts": 4, "entries": 5, "rounds": rounds}
    got = [tuple(r) for r in quantise(rows, **how, owner_members=90).collect()]
    assert sorted(got, key=key) == sorted(plain(data, **how), key=key)


def test_residents_are_not_shuffled(spark):
    """The next round reads the bucketed table without an exchange; only what moves is exchanged."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    vectors = vector_codes.kept_vectors(rows, "vec_id", "embedding", None, 256)
    books = vector_codes.first_codebooks(vectors, 64, 16, 64)
    with vector_codes._residence(spark) as reside:
        state = reside(vector_codes._settle_first(vectors, books, 2))
        after = vector_codes._settle_next(state, vector_codes._updated(books, state), 2)
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 2
        moved = after.count()
    assert moved > 0 and not spark.catalog.databaseExists("members_")
