"""Near-duplicates by SimHash fingerprints, searched in a Gray-ordered hierarchy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, partitions, table, tidy, written

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Children of a node of the hierarchy.
FAN = 8
#: Pairs of fingerprint and node that are compared at once; bounds memory.
AT_ONCE = 1 << 20
#: Fingerprints in a bucket beyond which it is split by further blocks of bits; bounds a task's memory.
LARGEST = 1 << 18
#: Times that a bucket is split.
SPLITS = 2


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """SimHash of a text: a bit is set if more than half of the shingles' XXH64 have it.

    A-Z is lower-cased; words are runs without ASCII white space. Fewer words than a shingle make
    one shingle; no word (also a null text) makes the fingerprint zero.
    """
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, seed)
    starts = [0, *ends]
    hashes = np.array(
        [digest(line[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])], dtype="<u8"
    )
    set_ = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        block = hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * set_ > len(hashes), bitorder="little")
    return int(over.view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int, seed: int, text: str = "text") -> DataFrame:
    """Replace the text by ``fingerprint``, a long with the 64 bits."""
    kept = [c for c in docs.columns if c not in (text, "fingerprint")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(x, shingle, seed) for x in batch[text]], dtype=np.uint64)
            yield batch[kept].assign(fingerprint=bits.view(np.int64))
        tidy()

    schema = docs.select(*kept).schema.add("fingerprint", "long")
    return docs.select(*kept, text).mapInPandas(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the Gray code: neighbours in it differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def hierarchy(prints: np.ndarray, start: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels of nodes over sorted fingerprints, from the leaves to one root per bucket.

    ``start`` holds where buckets begin, and the end. A node is (first, last row, first child, mask,
    pattern): ``mask`` are the bits that all its rows share, ``pattern`` their values. Bits that a
    parent already has are taken out of its children's masks, so differences add up on a path.
    """
    full = np.uint64(2**64 - 1)
    lo = np.arange(len(prints))
    level = (lo, lo + 1, lo, np.full(len(prints), full), prints)
    bucket = np.repeat(np.arange(len(start) - 1), np.diff(start))
    levels = [level]
    while True:
        lo, hi, _, mask, pattern = levels[-1]
        size = np.bincount(bucket, minlength=len(start) - 1)
        if size.max(initial=0) <= 1 and len(levels) > 1:
            break
        within = np.arange(len(lo)) - np.repeat(np.cumsum(size) - size, size)
        heads = np.flatnonzero(within % FAN == 0)
        ones = np.bitwise_and.reduceat(mask & pattern, heads)
        zeros = np.bitwise_and.reduceat(mask & ~pattern, heads)
        upper = ones | zeros
        count = np.diff(np.append(heads, len(lo)))
        levels[-1] = (lo, hi, levels[-1][2], mask & ~np.repeat(upper, count), pattern)
        last = np.append(heads[1:], len(lo)) - 1
        levels.append((lo[heads], hi[last], heads, upper, ones))
        bucket = bucket[heads]
    return levels


def near_edges(prints: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Edges that connect all rows within ``most`` bits of each other in their bucket.

    Every fingerprint goes down the hierarchy of its bucket. A group whose accumulated
    difference is over ``most`` is dropped whole. A group in which no row can differ by more is
    linked by one edge to its first row, as its rows are linked to each other anyway.
    """
    levels = hierarchy(prints, start)
    edges = []
    rows = np.arange(len(prints))
    root = np.searchsorted(levels[-1][0], rows, side="right") - 1
    todo = [(len(levels) - 1, rows, root, np.zeros(len(rows), dtype=np.int64))]
    free = []  # bits that rows of a node may differ in, per level
    shared = None
    for k in range(len(levels) - 1, -1, -1):
        lo, hi, child, mask, pattern = levels[k]
        if shared is None:
            own = mask
        else:
            above, heads = shared
            own = mask | np.repeat(above, np.diff(np.append(heads, len(lo))))
        free.insert(0, 64 - np.bitwise_count(own).astype(np.int64))
        shared = (own, child) if k else None
    # Groups whose rows are all within reach of each other: linked to their first row.
    for k in range(1, len(levels)):
        lo, hi = levels[k][0], levels[k][1]
        tight = np.flatnonzero(free[k] <= most)
        count = hi[tight] - lo[tight]
        first = np.repeat(lo[tight], count)
        each = first + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        edges.append(np.stack([each, first], 1)[each != first])
    while todo:
        k, q, node, acc = todo.pop()
        if len(q) > AT_ONCE:
            half = len(q) // 2
            todo += [(k, q[half:], node[half:], acc[half:]), (k, q[:half], node[:half], acc[:half])]
            continue
        lo, hi, child, mask, pattern = levels[k]
        acc = acc + np.bitwise_count((prints[q] ^ pattern[node]) & mask[node]).astype(np.int64)
        near = (acc <= most) & (lo[node] < q)  # each pair once: the smaller row is in the node
        q, node, acc = q[near], node[near], acc[near]
        whole = acc + free[k][node] <= most
        if whole.any():
            edges.append(np.stack([q[whole], lo[node[whole]]], 1))
            q, node, acc = q[~whole], node[~whole], acc[~whole]
        if k == 0 or not len(q):
            continue
        last = np.append(child[1:], len(levels[k - 1][0]))
        count = last[node] - child[node]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        todo.append((k - 1, np.repeat(q, count), np.repeat(child[node], count) + step, np.repeat(acc, count)))
    out = np.concatenate(edges) if edges else np.zeros((0, 2), dtype=np.int64)
    return spanning(len(prints), out)


def spanning(n: int, edges: np.ndarray) -> np.ndarray:
    """At most n - 1 links (row, root) with the same components as the edges."""
    root = np.arange(n)
    while len(edges):
        a, b = root[edges[:, 0]], root[edges[:, 1]]
        edges = edges[a != b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    rows = np.flatnonzero(root != np.arange(n))
    return np.stack([rows, root[rows]], 1)


def _by_block(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows (fingerprint, bucket, rest, free) once for each of ``blocks`` blocks of their free bits.

    ``rest`` holds the ``free`` bits that are not yet part of the bucket, moved together. A block's
    value goes into the bucket and out of ``rest``. Buckets are named by a hash: two that get the
    same name are searched together, which adds no wrong link.
    """
    each = []
    for j in range(blocks):
        low, up = f"int(free * {j} div {blocks})", f"int(free * {j + 1} div {blocks})"
        value = f"shiftrightunsigned(rest, {low}) & shiftrightunsigned(-1L, 64 - ({up} - {low}))"
        above = f"if({up} = {BITS}, 0L, shiftrightunsigned(rest, {up}))"
        below = f"rest & ~shiftleft(-1L, {low})"
        each.append(
            f"struct(xxhash64(bucket, {j}, {value}) AS bucket,"
            f" ({below}) | shiftleft({above}, {low}) AS rest, free - ({up} - {low}) AS free)"
        )
    return rows.select("fingerprint", F.expr(f"inline(array({', '.join(each)}))"))


def in_buckets(prints: DataFrame, most: int, largest: int) -> DataFrame:
    """Rows (fingerprint, bucket) in which any two within ``most`` bits share a bucket.

    Two words that differ in at most ``most`` bits agree in one of ``most + 1`` blocks of bits, so each
    fingerprint goes once per block to the bucket of the block's value. The fingerprints of a bucket
    with more than ``largest`` agree in that block, and any near two of them agree in one of
    ``most + 1`` blocks of the other bits too: such a bucket is split by these, up to ``SPLITS`` times.
    Each time multiplies the copies of its fingerprints, and words that still share a bucket then
    agree in over half of their bits (37 with ``most`` 3): these are dense, and the hierarchy links
    dense groups whole.
    """
    blocks = most + 1
    rows = prints.selectExpr("fingerprint", "0L AS bucket", "fingerprint AS rest", f"{BITS} AS free")
    done = None
    for left in range(SPLITS, -1, -1):
        rows = _by_block(rows, blocks)
        if not left:
            break
        crowded = (
            rows.where(F.col("free") >= blocks).groupBy("bucket").count().where(F.col("count") > largest)
        )
        crowded = written(crowded.select("bucket"))
        if crowded.isEmpty():
            break
        ready = rows.join(crowded, "bucket", "left_anti").select("fingerprint", "bucket")
        done = ready if done is None else done.unionByName(ready)
        rows = written(rows.join(crowded, "bucket", "left_semi"))
    rows = rows.select("fingerprint", "bucket")
    return rows if done is None else done.unionByName(rows)


def near_links(prints: DataFrame, most: int, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``most`` bits into components.

    Buckets are dealt over the tasks by a hash; a task sorts its buckets by Gray rank and searches
    their hierarchies.
    """
    keyed = in_buckets(prints, most, largest)
    keyed = keyed.repartition(partitions(prints.sparkSession), "bucket")

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        bits = np.concatenate([b["fingerprint"].to_numpy() for b in parts]).view(np.uint64)
        bucket = np.concatenate([b["bucket"].to_numpy() for b in parts])
        order = np.lexsort((gray_rank(bits), bucket))
        bits, bucket = bits[order], bucket[order]
        start = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bits)]])
        found = near_edges(bits, start, most)
        signed = bits.view(np.int64)
        yield pd.DataFrame({"a": signed[found[:, 0]], "b": signed[found[:, 1]]})

    return keyed.mapInPandas(search, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    most: int = 3,
    seed: int = 42,
    keep: tuple[str, ...] = (),
    largest: int = LARGEST,
) -> DataFrame:
    """Rows (id, fingerprint long, component_id): documents whose fingerprints are connected.

    ``keep`` names further columns to return. Buckets of over ``largest`` fingerprints are split.

    Fingerprints link at ``most`` or fewer differing bits; a component holds all that links reach.
    ``component_id`` is its smallest id; ids that are null are never it (null if there is no other).
    Equal fingerprints are searched once, however many documents have them. Null and empty texts
    have fingerprint zero, which links like any other. Repeated rows stay repeated. No rows give
    no rows.
    """
    if not 0 <= most < BITS:
        raise ValueError("most must be a number of bits from 0 to 63")
    prints = written(with_fingerprints(docs.select(id_, text, *keep), shingle, seed, text))
    nodes = written(prints.groupBy("fingerprint").agg(F.min(id_).alias("least")))
    found = components(near_links(nodes.select("fingerprint"), most, largest))
    joined = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    joined = joined.withColumn("root", F.coalesce("root", "fingerprint"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(named, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(id_, "fingerprint", "component_id", *keep)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component: 3-word shingles, 3 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
