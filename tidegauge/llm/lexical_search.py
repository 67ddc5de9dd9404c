"""Ranked lexical search: MaxScore whose bounds are tightened by lists of term pairs.

The index is made of blocks of documents, each a row: its documents, its terms, and the postings of every term.
A block never leaves the task that read its documents, so no text is shuffled. For a chunk of items, impacts
are then precomputed per block: those of each term, the largest of them, and for pairs of terms that stand
together in an item the largest impact that both have in one document, found by intersecting their lists.

A search takes a block and an item at a time. What a set of terms can add to a document is bounded by the sum
over disjoint pairs of what a pair can add, instead of the sum of the terms' own maxima: two terms that share no
document of the block add only the larger one of both maxima.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import remembering, table, tidy, written

#: Bytes of UTF-8 as they count in terms: digits, letters in lower case, all beyond ASCII; others part terms.
_BYTES = bytes(
    x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256)
)
INDEX = (
    "number long, docs long, total long, ids binary, nulls binary, lengths binary, terms binary, "
    "starts binary, holders binary, counts binary"
)
IMPACTS = (
    "number long, docs long, ids binary, nulls binary, terms binary, starts binary, holders binary, "
    "impacts binary, firsts binary, seconds binary, together binary"
)
FOUND = "item long, id long, score long"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters; only A to Z are lower-cased."""
    return (text or "").encode().translate(_BYTES).split()


def build_index(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", block_docs: int = 4096, block_terms: int = 2_000_000
) -> DataFrame:
    """The index: a row per block of at most ``block_docs`` documents with ``block_terms`` terms together.

    A longer document is a block by itself. Documents without a term are in no list and no block.
    Documents stand in a block by id, null ids last.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[int | None, np.ndarray]] = []
        number: dict[bytes, int] = {}
        size = 0

        def block() -> pd.DataFrame:
            nonlocal size
            waiting.sort(key=lambda d: (d[0] is None, d[0] or 0))
            names = sorted(number)
            place = np.empty(len(names), dtype=np.int64)
            place[[number[t] for t in names]] = np.arange(len(names))
            lengths = np.array([len(own) for _, own in waiting], dtype=np.int64)
            cell = place[np.concatenate([own for _, own in waiting])] * len(waiting)
            cell, counts = np.unique(cell + np.repeat(np.arange(len(waiting)), lengths), return_counts=True)
            row = {
                "number": 0,
                "docs": len(waiting),
                "total": size,
                "ids": np.array([i or 0 for i, _ in waiting], dtype="<i8").tobytes(),
                "nulls": np.array([i is None for i, _ in waiting], dtype=bool).tobytes(),
                "lengths": lengths.astype("<i4").tobytes(),
                "terms": b"\n".join(names),
                "starts": np.searchsorted(cell, np.arange(len(names) + 1) * len(waiting)).astype("<i8").tobytes(),
                "holders": (cell % len(waiting)).astype("<u4").tobytes(),
                "counts": counts.astype("<u4").tobytes(),
            }
            waiting.clear()
            number.clear()
            size = 0
            return pd.DataFrame([row])

        with remembering():
            for batch in batches:
                for i, t in zip(batch["_id"], batch["_text"]):
                    own = terms(t)
                    if not own:
                        continue
                    if waiting and size + len(own) > block_terms:
                        yield block()
                    numbers = np.array([number.setdefault(x, len(number)) for x in own], dtype=np.int32)
                    waiting.append((None if i is None else int(i), numbers))
                    size += len(own)
                    if len(waiting) >= block_docs:
                        yield block()
            if waiting:
                yield block()

    # As text, ids keep all their digits beside nulls.
    source = docs.select(F.col(id_).cast("string").alias("_id"), F.col(text).alias("_text"))
    return source.mapInPandas(run, INDEX).withColumn("number", F.monotonically_increasing_id())


class Statistics(NamedTuple):
    """Documents that have a term, and all terms of theirs."""

    docs: int
    terms: int


def statistics(index: DataFrame) -> Statistics:
    docs, total = index.agg(F.sum("docs"), F.sum("total")).first()
    return Statistics(int(docs or 0), int(total or 0))


def document_frequencies(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (term, df): how many documents hold each term of ``wanted`` (term); no row if none does."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                names = row.terms.decode().split("\n")
                yield pd.DataFrame({"term": names, "df": np.diff(np.frombuffer(row.starts, dtype="<i8"))})
        tidy()

    each = index.select("terms", "starts").mapInPandas(run, "term string, df long")
    return each.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Chunk(NamedTuple):
    """Items to be searched together: terms that weigh something by item, heaviest first, and the pairs."""

    items: dict[int, list[bytes]]
    weights: dict[bytes, int]
    pairs: list[tuple[bytes, bytes]]

    @classmethod
    def of(cls, items: Iterable[tuple[int, list[str]]], weights: dict[str, int], reach: int) -> Chunk:
        """Terms at most ``reach`` places apart in an item make a pair, the smaller one first."""
        w = {t.encode(): x for t, x in weights.items() if x > 0}
        own = {i: sorted((t for t in map(str.encode, ts) if t in w), key=lambda t: (-w[t], t)) for i, ts in items}
        near = {(min(a, b), max(a, b)) for ts in own.values() for i, a in enumerate(ts) for b in ts[i + 1 : i + 1 + reach]}
        return cls(own, w, sorted(near))


def joint_most(lists: list[tuple[np.ndarray, np.ndarray]], pairs: list[tuple[int, int]], docs: int) -> np.ndarray:
    """Of each pair of lists (documents, impacts), the largest sum in a document of both; 0 if there is none."""
    out, dense, last = np.zeros(len(pairs), dtype=np.int64), np.zeros(docs, dtype=np.int64), -1
    for n, (a, b) in enumerate(pairs):
        if a != last:
            if last >= 0:
                dense[lists[last][0]] = 0
            dense[lists[a][0]] = lists[a][1]
            last = a
        there = dense[lists[b][0]]
        out[n] = np.where(there > 0, there + lists[b][1], 0).max()
    return out


def impacts(index: DataFrame, chunk: Chunk, stats: Statistics) -> DataFrame:
    """Per block, what a search of the chunk's items reads: lists of impacts, and those of pairs.

    Blocks without a term of the chunk have no row.
    """
    shared = index.sparkSession.sparkContext.broadcast((chunk.weights, chunk.pairs))
    n, total = stats

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, pairs = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, dtype="<i4").astype(np.int64)
                m = 100 - 50 + (50 * lengths * n) // total
                starts = np.frombuffer(row.starts, dtype="<i8")
                holders, counts = (np.frombuffer(x, dtype="<u4").astype(np.int64) for x in (row.holders, row.counts))
                names, lists = [], []
                for at, t in enumerate(row.terms.split(b"\n")):
                    w = weights.get(t)
                    if w is not None:
                        own, tf = holders[starts[at] : starts[at + 1]], counts[starts[at] : starts[at + 1]]
                        names.append(t)
                        lists.append((own, w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[own]))))
                if not names:
                    continue
                place = dict(zip(names, range(len(names))))
                here = [(place[a], place[b]) for a, b in pairs if a in place and b in place]
                ends = np.cumsum([0, *[len(own) for own, _ in lists]])
                yield pd.DataFrame(
                    [
                        {
                            "number": row.number,
                            "docs": row.docs,
                            "ids": row.ids,
                            "nulls": row.nulls,
                            "terms": b"\n".join(names),
                            "starts": ends.astype("<i8").tobytes(),
                            "holders": np.concatenate([x for x, _ in lists]).astype("<u4").tobytes(),
                            "impacts": np.concatenate([x for _, x in lists]).astype("<i8").tobytes(),
                            "firsts": np.array([a for a, _ in here], dtype="<u4").tobytes(),
                            "seconds": np.array([b for _, b in here], dtype="<u4").tobytes(),
                            "together": joint_most(lists, here, row.docs).astype("<i8").tobytes(),
                        }
                    ]
                )
        tidy()

    return index.drop("total").mapInPandas(run, IMPACTS)


class Block:
    """One row of ``impacts``, opened: a list per term, its largest impact, and what pairs have together."""

    def __init__(self, row):
        self.docs = row.docs
        self.ids = np.frombuffer(row.ids, dtype="<i8")
        self.nulls = np.frombuffer(row.nulls, dtype=bool)
        names = row.terms.split(b"\n")
        starts = np.frombuffer(row.starts, dtype="<i8")
        holders = np.frombuffer(row.holders, dtype="<u4").astype(np.int64)
        values = np.frombuffer(row.impacts, dtype="<i8")
        self.most = dict(zip(names, np.maximum.reduceat(values, starts[:-1]).tolist()))
        self.lists = {t: (holders[a:b], values[a:b]) for t, a, b in zip(names, starts, starts[1:])}
        self.mates: dict[bytes, list[tuple[bytes, int]]] = {}
        pairs = (np.frombuffer(x, dtype=kind).tolist() for x, kind in ((row.firsts, "<u4"), (row.seconds, "<u4"), (row.together, "<i8")))
        for a, b, together in zip(*pairs):
            self.mates.setdefault(names[a], []).append((names[b], together))
            self.mates.setdefault(names[b], []).append((names[a], together))


def bounds(most: list[int], mates: list[list[tuple[int, int]]]) -> list[int]:
    """The most that the first 0, 1, 2, ... of some lists can add to one document.

    ``most`` has the largest impact of each list, ``mates`` for each list earlier ones with what both have
    together in one document. Of a and b, a document gets max(a, b, together) at most, so a pair saves the rest
    of a + b. Every list pairs with the earlier, still single one that saves most.
    """
    out, total, paired = [0], 0, set()
    for j, own in enumerate(most):
        total += own
        saved, mate = max(
            ((min(most[i], own, most[i] + own - t), i) for i, t in mates[j] if i not in paired), default=(0, -1)
        )
        if saved > 0:
            paired |= {mate, j}
            total -= saved
        out.append(total)
    return out


def kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k])


def search_block(
    block: Block, names: list[bytes], k: int, least: int, pairs: bool = True
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of what can be among the ``k`` best with a score of ``least``, best first, and how
    many documents were scored in full.

    Lists come by their largest impact. As soon as those left cannot lift a document to what is asked for by
    themselves, they bring in none; they are only looked up for documents of the lists before.
    """
    own = sorted((t for t in names if t in block.lists), key=block.most.__getitem__)
    at = {t: i for i, t in enumerate(own)}
    mates = [[(at[u], x) for u, x in block.mates.get(t, ()) if at.get(u, len(own)) < i] if pairs else [] for t, i in at.items()]
    upto = bounds([block.most[t] for t in own], mates)
    need = max(least, 1)
    none = np.zeros(0, dtype=np.int64)
    if upto[-1] < need:
        return none, none, 0
    score, done = np.zeros(block.docs, dtype=np.int64), len(own)
    while done and upto[done] >= need:
        done -= 1
        holders, values = block.lists[own[done]]
        score[holders] += values
        some = score[score > 0]
        if len(some) > k:
            need = max(need, kth(some, k))
    left = np.flatnonzero((score > 0) & (score + upto[done] >= need))
    for i in range(done - 1, -1, -1):
        if not len(left):
            break
        holders, values = block.lists[own[i]]
        where = np.minimum(np.searchsorted(holders, left), len(holders) - 1)
        hit = holders[where] == left
        score[left[hit]] += values[where[hit]]
        if len(left) > k:
            need = max(need, kth(score[left], k))
        left = left[score[left] + upto[i] >= need]
    best = left[np.lexsort((left, -score[left]))[:k]]
    return best, score[best], len(left)


def search(lists: DataFrame, chunk: Chunk, k: int, least: dict[int, int]) -> DataFrame:
    """Rows (item, id, score): of every partition of ``lists``, the ``k`` best documents of every item.

    ``least`` has, by item, scores that ``k`` documents are known to reach. Equal scores go by id, null ids last.
    """
    shared = lists.sparkSession.sparkContext.broadcast((chunk.items, least))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, least = shared.value
        heaps: dict[int, list[tuple]] = {i: [] for i in items}  # the worst first: (score, has an id, -id)
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = Block(row)
                for item, own in items.items():
                    heap = heaps[item]
                    need = max(least.get(item, 1), heap[0][0] if len(heap) >= k else 1)
                    places, scores, _ = search_block(block, own, k, need)
                    for p, s in zip(places.tolist(), scores.tolist()):
                        entry = (s, not block.nulls[p], -int(block.ids[p]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        rows = [(i, -e[2] if e[1] else None, e[0]) for i, heap in heaps.items() for e in heap]
        if rows:
            yield pd.DataFrame(rows, columns=["item", "id", "score"]).astype({"id": "Int64"})
        tidy()

    return lists.mapInPandas(run, FOUND)


def numbered_items(items: DataFrame, id_: str, text: str) -> DataFrame:
    """Rows (number, _item, terms) of the distinct (id, text) that have a term."""
    lower = F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    found = items.select(F.col(id_).alias("_item"), F.col(text).alias("_text")).distinct()
    found = found.select("_item", F.array_distinct(cut).alias("terms"))
    return found.where(F.size("terms") > 0).withColumn("number", F.monotonically_increasing_id())


def rank(
    docs: DataFrame,
    items: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 50,
    chunk_terms: int = 100_000,
    reach: int = 4,
    first: int = 16,
    **size: int,
) -> DataFrame:
    """Rows (item_id, rank, id, score): the ``k`` best documents of every item with a score above 0.

    Equal scores go by id, null ids last; repeated rows of a document rank one by one. Items are told
    apart by id and text, and equal ones count once. Null texts, and texts without a term, find nothing and
    are not found. Further columns play no part, so their names do not matter. Ids of documents are integers.

    Items go in chunks of about ``chunk_terms`` terms, which bounds what is broadcast. One block of ``first`` is
    searched first; what its results reach is asked of all other blocks from the start. A task hands on ``k``
    rows per item at most.
    """
    spark = docs.sparkSession
    index = written(build_index(docs, id_, text, **size))
    asked = written(numbered_items(items, item_id, item_text))
    stats = statistics(index)
    frequencies = written(document_frequencies(index, asked.select(F.explode("terms").alias("term")).distinct()))
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    chunks = -(-n_terms // chunk_terms)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    out = None
    for c in range(chunks):
        own = asked.where(F.pmod(F.xxhash64("number"), F.lit(chunks)) == c)
        used = own.select(F.explode("terms").alias("term")).distinct()
        df = {r["term"]: r["df"] for r in frequencies.join(used, "term", "left_semi").collect()}
        listed = [(r["number"], r["terms"]) for r in own.select("number", "terms").collect()]
        chunk = Chunk.of(listed, {t: weight(stats.docs, x) for t, x in df.items()}, reach)
        lists = written(impacts(index, chunk, stats))
        early = F.pmod(F.xxhash64("number"), F.lit(first)) == 0
        some = written(search(lists.where(early), chunk, k, {}))
        reached = some.withColumn("_r", F.row_number().over(place)).where(F.col("_r") == k)
        least = {r["item"]: r["score"] for r in reached.collect()}
        found = some.unionByName(search(lists.where(~early), chunk, k, least))
        best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        named = best.join(own.select("_item", "number"), F.col("item") == F.col("number")).select(
            F.col("_item").alias(item_id), "rank", F.col("id").alias(id_), "score"
        )
        out = named if out is None else out.unionByName(named)
    if out is None:
        schema = items.select(item_id).schema.add("rank", "integer").add(id_, "long").add("score", "long")
        return spark.createDataFrame([], schema)
    return out


def op12_pair_maxscore(spark, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for every benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP12_SQL = f"""
WITH d AS (
    SELECT rid, doc_id, ts, len(ts) AS n FROM (
        SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS ts FROM documents WHERE text IS NOT NULL
    ) WHERE len(ts) > 0
), s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), items AS (
    SELECT row_number() OVER () AS number, item_id, list_distinct({_SQL_TERMS}) AS ts
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (SELECT number, item_id, unnest(ts) AS term FROM items
), held AS (
    SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, s GROUP BY term
), scores AS (
    SELECT a.number, any_value(a.item_id) AS item_id, h.rid, any_value(d.doc_id) AS doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked a JOIN held h USING (term) JOIN weights USING (term) JOIN d USING (rid), s
    GROUP BY a.number, h.rid
), ranked AS (
    SELECT item_id, doc_id, score,
        row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
