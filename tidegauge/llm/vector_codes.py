"""Product codes of vectors: codebooks by Lloyd rounds over members that stay with their owners.

A part of a vector is a member of the entry that is nearest to it. Members live in a table that is
bucketed by (position, entry, salt); the rows of one such owner never leave their bucket unless their
entry changes. A round reads the table twice: once to find the members that change their entry, which are
shuffled to their new owners, and once, without an exchange, to settle what stays and what arrives.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import ensure_checkpoint_dir

from .shared import partitions, table, tidy, written

OWNER = ["position", "entry", "salt"]
MEMBERS = (
    "position int, entry int, salt int, n long, members binary, copies binary, "
    "rows long, sums array<decimal(38,0)>"
)
#: Vectors that a task assigns before it hands their parts on.
AT_ONCE = 1 << 15
_BIGGEST = 2**63 - 1


class Codebooks(NamedTuple):
    """``entries[position, entry, place]``; parts have ``width`` places each, the last ones padded by 0."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``y``, whatever the size of the values."""
    most = max((int(abs(a.astype(object)).max()) if a.size else 0) for a in (x, y)) if x.dtype == object else int(
        max(abs(x).max(initial=0), abs(y).max(initial=0))
    )
    if 4 * most * most * max(1, x.shape[1]) < 2**52:  # sums stay exact in doubles
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = x.astype(object), y.astype(object)
    out = np.zeros((len(a), len(b)), dtype=object)
    for j in range(a.shape[1]):
        out += (a[:, j][:, None] - b[:, j][None, :]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of equally near ones, and the squared distance."""
    d = squares(x, entries)
    if d.dtype != object:
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at]
    at = np.array([min(range(len(r)), key=r.__getitem__) for r in d], dtype=np.int64)
    return at, np.array([r[i] for r, i in zip(d, at)], dtype=object)


def _salts(x: np.ndarray, salts: int) -> np.ndarray:
    """A number below ``salts`` for every part, by its values alone: equal parts have one owner."""
    if salts == 1:
        return np.zeros(len(x), dtype=np.int64)
    h = np.full(len(x), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for j in range(x.shape[1]):
        h = (h ^ x[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(salts)).astype(np.int64)


def _collapsed(x: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``x`` and how often each stands there."""
    if not len(x) or not x.shape[1]:
        return x[:1], np.array([copies.sum()], dtype=np.int64)[: len(x)]
    order = np.lexsort(x.T)
    x, copies = x[order], copies[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]).any(1)
    return x[new], np.add.reduceat(copies, np.flatnonzero(new))


def _packed(x: np.ndarray, copies: np.ndarray) -> dict:
    """Members as binary values, in 32 bits if they fit, and the sums that the owner's entry needs."""
    fits = not x.size or -(2**31) <= x.min() and x.max() < 2**31
    total = (x.astype(object) * copies.astype(object)[:, None]).sum(0) if not fits else copies @ x
    return {
        "n": len(x),
        "members": x.astype("<i4" if fits else "<i8").tobytes(),
        "copies": copies.astype("<i8").tobytes(),
        "rows": int(copies.sum()),
        "sums": [Decimal(int(v)) for v in total],
    }


def _unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(row.members) // max(1, row.n * width)
    x = np.frombuffer(row.members, dtype="<i4" if size == 4 else "<i8").astype(np.int64)
    return x.reshape(row.n, width), np.frombuffer(row.copies, dtype="<i8")


def _blocks(position: int, entry: np.ndarray, x: np.ndarray, copies: np.ndarray, salts: int) -> Iterator[dict]:
    """One row per owner of the parts ``x`` of one position."""
    salt = _salts(x, salts)
    order = np.lexsort((salt, entry))
    entry, salt = entry[order], salt[order]
    cuts = np.flatnonzero((np.diff(entry) != 0) | (np.diff(salt) != 0)) + 1
    for at in np.split(np.arange(len(order)), cuts):
        if len(at):
            who = {"position": position, "entry": int(entry[at[0]]), "salt": int(salt[at[0]])}
            yield who | _packed(x[order[at]], copies[order[at]])


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in MEMBERS.split(", ")])


def kept_vectors(rows: DataFrame, id_: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """Rows (_id, _label, _v): whole vectors as integers floor(scale * x), in 64 bits at most."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(v.isNotNull() & ~F.exists(v, lambda x: odd(x.cast("double")))).select(
        F.col(id_).alias("_id"),
        (F.col(label) if label else F.lit(None).cast("string")).alias("_label"),
        whole.alias("_v"),
    )


def _matrix(values: Iterable, places: int) -> np.ndarray:
    values = list(values)
    if all(len(v) == places for v in values):
        return np.array(values, dtype=np.int64).reshape(len(values), places)
    out = np.zeros((len(values), places), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def first_codebooks(vectors: DataFrame, places: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids; equal ids in order of their vectors, null ids last."""
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    x = _matrix((r["_v"] for r in first), places)
    return Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy())


def _settle_first(vectors: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """Members of every owner under the first codebooks."""
    parts, _, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, waiting, size = shared.value, [], 0

        def blocks() -> pd.DataFrame:
            x = np.concatenate(waiting).reshape(size, parts, width)
            out = []
            for p in range(parts):
                own, copies = _collapsed(x[:, p, :], np.ones(size, dtype=np.int64))
                at, _ = nearest(own, entries[p])
                out += _blocks(p, at, own, copies, salts)
            return _frame(out)

        for batch in batches:
            waiting.append(_matrix(batch["_v"], parts * width))
            size += len(batch)
            if size >= AT_ONCE:
                yield blocks()
                waiting, size = [], 0
        if size:
            yield blocks()
        tidy()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both = [_unpacked(r, width) for r in rows.itertuples(index=False)]
        x, copies = _collapsed(np.concatenate([a for a, _ in both]), np.concatenate([b for _, b in both]))
        return _frame([dict(zip(OWNER, map(int, key))) | _packed(x, copies)])

    return vectors.select("_v").mapInPandas(assign, MEMBERS).groupBy(*OWNER).applyInPandas(merge, MEMBERS)


def _settle_next(state: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """Members of every owner under new codebooks; only those that change their entry are shuffled."""
    width = books.width
    shared = state.sparkSession.sparkContext.broadcast(books.entries)

    def leave(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x, copies = _unpacked(row, width)
                at, _ = nearest(x, shared.value[row.position])
                gone = at != row.entry
                out += _blocks(row.position, at[gone], x[gone], copies[gone], salts)
            yield _frame(out)
        tidy()

    def settle(key: tuple, own: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        position, entry = int(key[0]), int(key[1])
        x, copies = np.zeros((0, width), dtype=np.int64), np.zeros(0, dtype=np.int64)
        for row in own.itertuples(index=False):
            x, copies = _unpacked(row, width)
            stays = nearest(x, shared.value[position])[0] == entry
            x, copies = x[stays], copies[stays]
        arrived = [_unpacked(row, width) for row in new.itertuples(index=False)]
        x = np.concatenate([x, *[a for a, _ in arrived]])
        copies = np.concatenate([copies, *[b for _, b in arrived]])
        return _frame([dict(zip(OWNER, map(int, key))) | _packed(x, copies)] if len(x) else [])

    moved = state.mapInPandas(leave, MEMBERS)
    return state.groupBy(*OWNER).cogroup(moved.groupBy(*OWNER)).applyInPandas(settle, MEMBERS)


@contextmanager
def _residence(spark: SparkSession) -> Iterator:
    """A function that writes a frame of members as a table bucketed by owner and reads it again.

    The tables lie in the shared checkpoint folder and go when the block ends.
    """
    name = f"members_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{ensure_checkpoint_dir(spark)}/tables/{name}'")
    n, tables = partitions(spark), []

    def reside(members: DataFrame) -> DataFrame:
        tables.append(f"{name}.round{len(tables)}")
        members.write.bucketBy(n, *OWNER).format("parquet").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    try:
        yield reside
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _updated(books: Codebooks, state: DataFrame) -> Codebooks:
    """Entries as the mean of their members, rounded down; what has no member stays.

    A row per owner is read, not its members; entries times places values reach the driver.
    """
    sums = (
        state.select("position", "entry", "rows", F.posexplode("sums").alias("place", "total"))
        .groupBy("position", "entry", "place")
        .agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    )
    entries = books.entries.copy()
    for r in sums.collect():
        entries[r["position"], r["entry"], r["place"]] = int(r["total"]) // r["rows"]
    return Codebooks(entries)


def _fit(vectors: DataFrame, parts: int, entries: int, rounds: int, owner_members: int) -> Codebooks | None:
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    if not n:
        return None
    width = -(-longest // parts)
    books = first_codebooks(vectors, parts * width, parts, entries)
    salts = -(-n // owner_members)
    with _residence(vectors.sparkSession) as reside:
        state = None
        for _ in range(rounds):
            settled = _settle_first(vectors, books, salts) if state is None else _settle_next(state, books, salts)
            state = reside(settled)
            books = _updated(books, state)
    return books


def fit(
    rows: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    owner_members: int = 1 << 16,
) -> Codebooks | None:
    """Codebooks of all whole vectors of ``rows`` after ``rounds`` rounds; None if there is none.

    Vectors become integers floor(scale * x) and are cut into ``parts`` equal parts; those that are shorter
    than the longest one, or than a multiple of ``parts``, are filled up with zeros. Codebooks start as the
    parts of the ``entries`` vectors with the smallest ids. Repeated vectors all count.

    Equal parts are one member with a number of copies, combined in each task before they are shuffled. An
    entry has as many owners as it takes to give each about ``owner_members`` members if all parts were of
    this entry, so no owner grows with the data.
    """
    return _fit(kept_vectors(rows, id_, vector, None, scale), parts, entries, rounds, owner_members)


def _encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    parts, _, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["_v"], parts * width).reshape(len(batch), parts, width)
            found = [nearest(x[:, p, :], shared.value[p]) for p in range(parts)]
            code = np.stack([at for at, _ in found], 1).astype(np.uint8)
            error = sum(d.astype(object) for _, d in found)
            out = batch[["_id", "_label"]].reset_index(drop=True)
            out["code"] = [bytes(c).hex() for c in code]
            out["error"] = np.array([min(e, _BIGGEST) for e in error], dtype=np.int64)
            yield out
        tidy()

    schema = vectors.select("_id", "_label").schema.add("code", "string").add("error", "long")
    return vectors.mapInPandas(run, schema)


def quantise(
    rows: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    owner_members: int = 1 << 16,
    **how: int,
) -> DataFrame:
    """Rows (id, label, code, error, label_error, codebooks_sha256), one per whole vector.

    ``how`` is as in ``fit``. ``code`` has two hex digits per part, the index of its entry; ``error`` is the squared
    distance of the vector to its code, ``label_error`` its sum over the vectors with that label, nulls being
    one label. Both are 2 ** 63 - 1 at most. Vectors that are null or hold null or non-finite components take
    no part; null ids do. No whole vector gives no rows. Further columns of ``rows`` are not returned, so
    their names do not matter.
    """
    spark = rows.sparkSession
    vectors = kept_vectors(rows, id_, vector, label, scale)
    how = {"parts": 16, "entries": 64, "rounds": 2} | how
    books = _fit(vectors, **how, owner_members=owner_members)
    if books is None:
        books = Codebooks(np.zeros((how["parts"], 1, 0), dtype=np.int64))
    coded = written(_encoded(vectors, books))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_BIGGEST)))
    totals = coded.groupBy(F.col("_label").alias("_of")).agg(total.cast("long").alias("label_error"))
    return coded.join(totals, F.col("_label").eqNullSafe(F.col("_of")), "left").select(
        F.col("_id").alias(id_),
        F.col("_label").alias(label),
        "code",
        "error",
        "label_error",
        F.lit(books.sha256()).alias("codebooks_sha256"),
    )


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """A code of 16 parts for every whole vector of ``embeddings``."""
    found = quantise(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql_round(books: str, k: int) -> str:
    """Nearest entries under the codebooks of round ``k``, named near<k>."""
    return f"""near{k} AS (
    SELECT rn, pos, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT p.rn, p.pos, c.entry, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d
        FROM places p JOIN {books} c ON p.pos = c.pos AND p.j = c.j GROUP BY ALL
    ) GROUP BY ALL
)"""


def _sql_update(books: str, k: int) -> str:
    return f"""books{k + 1} AS (
    SELECT c.pos, c.entry, c.j, coalesce(m.x, c.x) AS x FROM {books} c LEFT JOIN (
        SELECT p.pos, n.entry, p.j,
            (sum(p.x) - (((sum(p.x) % count(*)) + count(*)) % count(*))) // count(*) AS x
        FROM places p JOIN near{k} n ON p.rn = n.rn AND p.pos = n.pos GROUP BY ALL
    ) m ON c.pos = m.pos AND c.entry = m.entry AND c.j = m.j
)"""


OP13_SQL = f"""
WITH v AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), places AS (
    SELECT rn, i // w AS pos, i % w AS j, x FROM (
        SELECT rn, len(v) // 16 AS w, unnest(range(len(v))) AS i, unnest(v) AS x FROM v
    )
), books0 AS (SELECT pos, rn - 1 AS entry, j, x FROM places WHERE rn <= 64),
{_sql_round("books0", 0)},
{_sql_update("books0", 0)},
{_sql_round("books1", 1)},
{_sql_update("books1", 1)},
{_sql_round("books2", 2)},
coded AS (
    SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error
    FROM near2 GROUP BY rn
)
SELECT v.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY pos, entry, j)) FROM books2) AS codebooks_sha256
FROM v JOIN coded c USING (rn)
"""
