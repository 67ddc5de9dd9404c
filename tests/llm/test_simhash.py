import re

import numpy as np
import xxhash

from tidegauge.llm.shared import components
from tidegauge.llm.simhash import (
    fingerprint,
    gray_rank,
    in_buckets,
    near_duplicates,
    near_edges,
    near_links,
    op8_simhash,
)

SF = "/root/testdata/sf0.001"


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, most):
    """Root per row by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(docs, rows, most=3):
    docs = sorted(docs, key=lambda d: (d.doc_id is None, d.doc_id or 0))
    prints = [plain(d.text) for d in docs]
    roots = grouped(prints, most)
    want = sorted(
        ((d.doc_id, p, docs[r].doc_id) for d, p, r in zip(docs, prints, roots)), key=str
    )
    assert sorted(rows, key=str) == want


def test_op8_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op8_simhash(spark, SF).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    check(docs, [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows])
    assert len({r.component_id for r in rows}) < len(rows)


def test_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    check(odd.collect(), [(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in rows])
    assert near_duplicates(none).count() == 0


def test_hierarchy_equals_all_pairs():
    """Buckets of random, clustered and dense fingerprints, for several distances."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        start, parts = [0], []
        for _ in range(rng.integers(1, 5)):
            m = int(rng.integers(1, 70))
            x = rng.integers(0, 2**63, size=max(1, m // 9), dtype=np.uint64)
            x = x[rng.integers(0, len(x), m)]
            for _ in range(rng.integers(0, 6)):
                x = x ^ (np.uint64(1) << rng.integers(0, rng.choice([4, 64]), m).astype(np.uint64))
            x = np.unique(x)
            parts.append(x[np.argsort(gray_rank(x))])
            start.append(start[-1] + len(x))
        most = trial % 6
        edges = near_edges(np.concatenate(parts), np.array(start), most)
        root = dict(edges.tolist())
        for part, a in zip(parts, start):
            want = [a + r for r in grouped([int(p) for p in part], most)]
            assert [root.get(a + i, a + i) for i in range(len(part))] == want


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").repartition(5)
    rows = components(edges).collect()
    assert len(rows) == 201 and {r.root for r in rows} == {0}
    assert components(edges.limit(0)).count() == 0


def test_long_text_is_read_to_its_end():
    text = " ".join(f"w{i}" for i in range(60_000))
    assert fingerprint(text, 3, 42) == plain(text) != fingerprint(text[:-4000], 3, 42)


def test_crowded_buckets_are_split_and_lose_no_link(spark):
    """A third of all fingerprints agree in one block, and the limit is low."""
    rng = np.random.default_rng(5)
    for most in (0, 3):
        x = rng.integers(0, 2**64, size=240, dtype=np.uint64)
        x[:80] = (x[:80] & ~np.uint64(0xFFFF)) | np.uint64(0xABCD)
        for _ in range(4):
            x[120:] ^= np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
            x[100:160] = x[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
        x = np.unique(x)
        df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fingerprint long")
        if most:
            sizes = [
                in_buckets(df, most, n).groupBy("bucket").count().agg({"count": "max"}).first()[0]
                for n in (1000, 8)
            ]
            assert sizes[0] >= 80 and sizes[1] < 20
        links = components(near_links(df, most, 8)).collect()
        root = {r.node % 2**64: r.root % 2**64 for r in links}
        words = [int(v) for v in x]
        want = [words[r] for r in grouped(words, most)]
        got = {}
        for w, r in zip(words, want):
            got.setdefault(root.get(w, w), set()).add(r)
        assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want))


def test_split_buckets_give_the_same_components(odd):
    rows = near_duplicates(odd, largest=2).collect()
    check(odd.collect(), [(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in rows])
