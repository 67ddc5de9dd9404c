"""Exact top-k inner products, pruned by segment means and deviations in a rotated basis.

The inner product of two vectors is that of their rotations. A rotation that puts the directions in which a
sample of the vectors is long first makes their segments tell: short segments where much is decided, long ones where
little is. Bounds come level by level, each only for the pairs that the level before left, and exact integer
scores only for what is left after the finest level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, tidy, written

#: Per level, coarse to fine: the share of the components that are segments by themselves, and how many segments
#: the others make.
LEVELS = ((1 / 8, 1), (1 / 2, 2), (7 / 8, 4))
#: Candidates that are compared with a block of queries at once, and pairs whose bounds or scores are computed at once.
AT_ONCE, PAIRS = 1024, 1 << 16
FOUND = "query_id long, _id long, score long"


def whole_vectors(rows: DataFrame, id_: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, _v): components turned into floor(scale * x). Rows with a null id, a null vector,
    or a null or non-finite component are left out."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id_).alias("_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("_v")
    )


class Basis(NamedTuple):
    """An orthogonal matrix, and per level where the segments of a rotated vector begin."""

    rotation: np.ndarray
    starts: list[np.ndarray]

    @classmethod
    def of(cls, sample: np.ndarray) -> Basis:
        """Directions in which the sample is longest first."""
        width = sample.shape[1]
        x = sample.astype(np.float64)
        x = x / max(1.0, abs(x).max(initial=0))
        _, vectors = np.linalg.eigh(x.T @ x) if width else (None, np.zeros((0, 0)))
        starts = []
        for share, rest in LEVELS:
            lead = min(width, int(np.ceil(width * share)))
            cuts = np.linspace(lead, width, min(rest, width - lead) + 1)[:-1].astype(int)
            starts.append(np.concatenate([np.arange(lead), cuts]))
        return cls(vectors[:, ::-1], starts)


def segment_features(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments of vectors, weighted by the root of their lengths.

    With these, the squared distance of two vectors is at least that of their features, and so their
    inner product is at most that of their features. A segment of one component has no deviation.
    """
    if not len(starts):
        return np.zeros((len(v), 1))
    length = np.diff(np.append(starts, v.shape[1]))
    total = np.add.reduceat(v, starts, axis=1)
    mean = total / np.sqrt(length)
    long = np.flatnonzero(length > 1)
    left = np.add.reduceat(v * v, starts, axis=1)[:, long] - mean[:, long] ** 2
    return np.concatenate([mean, np.sqrt(np.maximum(left, 0))], axis=1)


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows (a[i], b[j])."""
    out = np.empty(len(i), dtype=a.dtype)
    for at in range(0, len(i), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = np.einsum("ij,ij->i", a[i[some]], b[j[some]])
    return out


def exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs of rows; sums beyond a long stay at its ends."""
    top = float(abs(q.astype(np.float64)).max(initial=0)) * float(abs(c.astype(np.float64)).max(initial=0))
    if top * max(q.shape[1], 1) < 2**62:
        return dots(q, c, i, j)
    wide = [sum(int(x) * int(y) for x, y in zip(q[m], c[n])) for m, n in zip(i, j)]
    return np.array([max(-(2**63), min(2**63 - 1, w)) for w in wide], dtype=np.int64)


class Best:
    """The k best of what was offered to each query, ties to smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.row, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(queries, -np.inf) if floor is None else floor.astype(np.float64)

    def offer(self, row: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        row, id_, score = (np.concatenate(x) for x in ((self.row, row), (self.id, id_), (self.score, score)))
        # ~score falls where the score rises, also at the ends of a long.
        order = np.lexsort((id_, ~score, row))
        row, id_, score = row[order], id_[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        some = place < self.k
        self.row, self.id, self.score = row[some], id_[some], score[some]
        full = place == self.k - 1
        self.floor[row[full]] = np.maximum(self.floor[row[full]], score[full].astype(np.float64))


class Work(NamedTuple):
    """How many pairs there were, and how many got an exact score."""

    pairs: int
    exact: int


def search(
    qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, best: Best, basis: Basis
) -> Work:
    """Offer to ``best`` what can be among the k best of ``c`` for each row of ``q``.

    Long vectors first, so that the k-th score rises soon, and of a run of candidates those with the highest bounds.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", c.astype(np.float64), c.astype(np.float64)))
    order = np.lexsort((cid, -norm))
    cid, c, norm = cid[order], c[order], norm[order]
    turned = q.astype(np.float64) @ basis.rotation
    slack = 1e-9 * np.sqrt(np.einsum("ij,ij->i", turned, turned))  # beyond what rounding can amount to
    fq = [segment_features(turned, x) for x in basis.starts]
    pairs = done = 0
    for at in range(0, len(c), AT_ONCE):
        run = slice(at, at + AT_ONCE)
        ids, rows, lengths = cid[run], c[run], norm[run]
        there = rows.astype(np.float64) @ basis.rotation
        fc = [segment_features(there, x) for x in basis.starts]
        other = qid[:, None] != ids[None, :]
        pairs += int(other.sum())
        bound = fq[0] @ fc[0].T + slack[:, None] * lengths[None, :] + 1e-6
        i, j = np.nonzero(other & (bound >= best.floor[:, None]))
        bound = bound[i, j]
        for a, b in zip(fq[1:], fc[1:]):
            bound = dots(a, b, i, j) + slack[i] * lengths[j] + 1e-6
            left = bound >= best.floor[i]
            i, j, bound = i[left], j[left], bound[left]
        # The highest bounds first: what they reach rules out pairs behind them.
        order = np.lexsort((-bound, i))
        i, j, bound = i[order], j[order], bound[order]
        many = best.k
        while len(i):
            first = np.arange(len(i)) - np.searchsorted(i, i) < many
            best.offer(i[first], ids[j[first]], exact(q, rows, i[first], j[first]))
            done += int(first.sum())
            left = ~first & (bound >= best.floor[i])
            i, j, bound = i[left], j[left], bound[left]
            many *= 2
    return Work(pairs, done)


def _by_width(ids: Iterable, vectors: Iterable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of vectors by their length."""
    out: dict[int, tuple[list, list]] = {}
    for n, v in zip(ids, vectors):
        a, b = out.setdefault(len(v), ([], []))
        a.append(n)
        b.append(v)
    return {
        w: (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64).reshape(len(a), w)) for w, (a, b) in out.items()
    }


def top_k(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 10,
    id_: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    query_block: int = 8192,
    sample_rows: int = 4096,
) -> DataFrame:
    """Rows (query_id, rank, id, score): the ``k`` largest integer inner products of every query.

    Components become floor(scale * x). Ties go to the smaller id. A query does not meet rows with its
    own id. Rows with null ids, vectors or components, or with components that are not finite take
    no part. Vectors meet those of their own length only. Repeated query ids count
    once, with the first vector in order; repeated rows all count. Fewer rows give fewer results.

    Queries go in blocks of about ``query_block``, each to all tasks in a broadcast of that size; rows stay where
    they are read, and a task hands on k rows per query. A sample of ``sample_rows`` rows gives the rotation, and
    the k-th score of each query in the sample is asked of all rows from the start.
    """
    spark = queries.sparkSession
    q = written(whole_vectors(queries, id_, vector, scale).groupBy("_id").agg(F.min("_v").alias("_v")))
    c = whole_vectors(rows, id_, vector, scale)
    blocks = max(1, -(-q.count() // query_block))
    drawn = c.orderBy(F.xxhash64("_id", "_v"), "_id").limit(sample_rows).collect()
    sample = _by_width((r["_id"] for r in drawn), (r["_v"] for r in drawn))
    bases = {w: Basis.of(v) for w, (_, v) in sample.items()}
    parts = []
    for block in range(blocks):
        own = q.where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(blocks)) == block).collect()
        asked = {}
        for w, (qid, v) in _by_width((r["_id"] for r in own), (r["_v"] for r in own)).items():
            known = Best(len(qid), k)
            if w in sample:
                search(qid, v, *sample[w], known, bases[w])
            # Rows of the sample come again with all others: only what they reach is kept.
            asked[w] = (qid, v, known.floor, bases.get(w) or Basis.of(v[:0]))
        shared = spark.sparkContext.broadcast((asked, k))

        def run(batches: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked, k = shared.value
            best = {w: Best(len(qid), k, floor) for w, (qid, _, floor, _) in asked.items()}
            for batch in batches:
                for w, (cid, vectors) in _by_width(batch["_id"], batch["_v"]).items():
                    if w in asked:
                        qid, v, _, basis = asked[w]
                        search(qid, v, cid, vectors, best[w], basis)
            for w, b in best.items():
                yield pd.DataFrame({"query_id": asked[w][0][b.row], "_id": b.id, "score": b.score})
            tidy()

        parts.append(c.mapInPandas(run, FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")  # k rows a task
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("_id").alias(id_), "score")


def op5_segment_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows.where("vec_id % 100 = 0"), rows)


OP5_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
