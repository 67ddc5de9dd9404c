"""Removal of byte strings that an earlier document has, by bucket-pointer refinement.

Every position of every text starts a string of ``match`` bytes. Two such strings are equal if their
first q-grams are (initial buckets) and if, bucket by bucket, the buckets of the later offsets are.
Of each string only its rarest-looking q-gram (the smallest by a hash, the same in equal strings) names
the bucket that it is sorted into. Short q-grams meet by chance, the more the larger the corpus, so a
bucket is told apart by a longer gram: the q-gram and what the string has on its longer side, half as
much as it can have. Grams that one document alone has are dropped before any text moves. So of most
texts little is sent.

A text that a smaller document has as a whole goes as a whole: such copies are found by their digests
and take part in nothing else, as their strings are judged by the smallest document's.

1. Texts are dealt to parts by a hash (one shuffle, used three times).
2. Each part sends the initial buckets its texts have; those that two documents share come back.
3. Each part sends, per shared bucket, the distinct stretches of text that it stands for.
4. Per bucket, the strings in these stretches are refined: 4-gram buckets by the bucket 4 further
   on give those of 8 bytes, those 16, 32 and at last ``match``, each from the last ones' identifiers.
   The smallest document of every string decides what goes; the decisions go back to the parts.
   A bucket of very many different stretches is not gathered: its strings are sent one by one, with the part's
   smallest document, to groups named by a hash of the whole string.
5. Each part cuts its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from .shared import carried, partitions, table, tidy, written

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 17  # positions in a buffer; a worker has a score of arrays of as many words at a time
_LOW = np.uint64((1 << _BITS) - 1)
#: Bytes of a piece of text that is worked on at once; a buffer has at most two pieces' size.
_PIECE = 1 << (_BITS - 1)
#: A part counts the different stretches of q-grams that have more than these.
_FEW = 4
#: Bytes of stretches that are refined at once, beyond which another gram's wait.
_AT_ONCE = 1 << 20
_TAG_BITS = 32  # low bits of a gram's hash, which name its bucket; the others travel
_BUCKET = np.uint64((1 << _TAG_BITS) - 1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up = np.full((1 << _BITS) + 1, _BASE, dtype=np.uint64)
    down = np.full((1 << _BITS) + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _summed(buffer: bytes) -> np.ndarray:
    """Sums of a buffer of at most 1 << _BITS bytes, from which its parts' hashes come."""
    if not _POWERS:
        _POWERS.extend(_powers())
    x = np.frombuffer(buffer, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * _POWERS[0][: len(x)], out=sums[1:])
    return sums


def _hashed(sums: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``a`` to before ``z``, the same wherever they stand."""
    return _mix(((sums[z] - sums[a]) * _POWERS[1][a]) ^ ((z - a).astype(np.uint64) * _STEP))


def _longer(at: np.ndarray, start: np.ndarray, match: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the longer grams go of q-grams at ``at`` in strings that begin at ``start``."""
    half = (match - q) // 2
    later = at - start > half
    return np.where(later, at - half - 1, at), np.where(later, at + q, at + match - half)


class Stretches:
    """Arrays over runs of strings that one gram stands for, in successive order.

    ``doc``: index of the text; ``first``, ``last``: where the run's strings start; ``gram``: low bits of
    the hash of the q-gram, above them bits of the hash of the longer gram; ``print``: hash of the bytes
    from ``first`` to the end of the last string; ``place``: how far from ``first`` the q-gram is. The
    longer gram lies in every string of the run: it ends with the q-gram if that begins in the strings'
    later half, and begins with it if not.
    """

    def __init__(self, texts: list[bytes], match: int, q: int):
        found = list(self._runs(texts, match, q))
        join = lambda k, t: np.concatenate([x[k] for x in found]) if found else np.zeros(0, t)
        self.doc, self.first, self.last = (join(k, np.int64) for k in range(3))
        self.gram, self.print = (join(k, np.uint64) for k in (3, 4))
        self.place = join(5, np.uint8)

    @staticmethod
    def _pieces(texts: list[bytes], match: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (text, first, end of string starts) of at most two pieces' bytes each."""
        run, size = [], 0
        most = _PIECE - match
        for i, text in enumerate(texts):
            starts = len(text) - match + 1
            for a in range(0, max(0, starts), most):
                b = min(a + most, starts)
                run.append((i, a, b))
                size += b - a + match
                if size >= _PIECE:
                    yield run
                    run, size = [], 0
        if run:
            yield run

    @classmethod
    def _runs(cls, texts: list[bytes], match: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
        half = (match - q) // 2
        for pieces in cls._pieces(texts, match):
            sums = _summed(b"".join([texts[i][a : b - 1 + match] for i, a, b in pieces]))
            grams = len(sums) - q
            hashes = _mix((sums[q:] - sums[:grams]) * _POWERS[1][:grams])
            keys = (hashes & ~_LOW) | np.arange(grams, dtype=np.uint64)
            least = _sliding_min(keys, match - q + 1)
            count = np.array([b - a for _, a, b in pieces])
            offset = np.concatenate([[0], np.cumsum(count + match - 1)[:-1]])
            piece = np.repeat(np.arange(len(pieces)), count)
            step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
            start = offset[piece] + step
            at = (least[start] & _LOW).astype(np.int64)
            later = at - start > half
            new = (at[1:] != at[:-1]) | (later[1:] != later[:-1])
            heads = np.flatnonzero(np.concatenate([[True], new]))
            tails = np.concatenate([heads[1:], [len(at)]]) - 1
            a, z = start[heads], start[tails]
            own, at = piece[heads], at[heads]
            gram = (_hashed(sums, *_longer(at, a, match, q)) & ~_BUCKET) | (hashes[at] & _BUCKET)
            doc = np.array([p[0] for p in pieces])[own]
            shift = np.array([p[1] for p in pieces])[own] - offset[own]
            yield doc, a + shift, z + shift, gram, _hashed(sums, a, z + match), (at - a).astype(np.uint8)


def _tags(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket number, what travels of the hash) of grams."""
    low = grams & np.uint64(buckets - 1)
    return low.astype(np.int64), grams >> np.uint64(_TAG_BITS)


def _named(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Tag and bucket number of grams as one number."""
    bucket, tag = _tags(grams, buckets)
    return (tag << np.uint64(_TAG_BITS)) | bucket.astype(np.uint64)


def _strings(
    texts: list[bytes], s: Stretches, which: np.ndarray, match: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in ``s``, step in the stretch, hash) of all single strings in the stretches ``which``."""
    found = []
    most = _PIECE // (2 * match + 62)
    for k in range(0, len(which), most):
        own = which[k : k + most]
        count = (s.last - s.first + 1)[own]
        places = zip(s.doc[own].tolist(), s.first[own].tolist(), s.last[own].tolist())
        sums = _summed(b"".join([texts[d][a : z + match] for d, a, z in places]))
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(count + match - 1) - (count + match - 1), count) + step
        found.append((np.repeat(own, count), step, _hashed(sums, start, start + match)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(tags: np.ndarray) -> bytes:
    return tags.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - _TAG_BITS // 8].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    width = 8 - _TAG_BITS // 8
    out = np.zeros((len(blob) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def refined(text: bytes, match: int) -> np.ndarray:
    """Bucket numbers of the strings of ``match`` bytes at each position of ``text``.

    Initial buckets are the 4-grams. Sorting on (own bucket, bucket at the offset reached) doubles the
    length; the last step overlaps. Positions fewer than ``match`` bytes before the end mean nothing.
    """
    x = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    x = np.concatenate([x, np.zeros(match, dtype=np.uint64)])
    ids = x[:-3] | x[1:-2] << np.uint64(8) | x[2:-1] << np.uint64(16) | x[3:] << np.uint64(24)
    length = 4
    while length < match:
        step = min(length, match - length)
        pairs = (ids[:-step] << np.uint64(32)) | ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        length += step
    return ids[: len(text)].astype(np.int64)


def _shared_buckets(blobs: pd.DataFrame, most_alike: int) -> pd.DataFrame:
    """Of one bucket's tags by part: those that come twice, back to each part that has them.

    ``hot``: those of them that may have more than ``most_alike`` different stretches.
    """
    parts = [_unpack(b) for b in blobs["tags"]]
    tags, count = np.unique(np.concatenate(parts), return_counts=True)
    alike = count * _FEW
    often = np.frombuffer(b"".join(blobs["often"]), dtype="<u8").reshape(-1, 2)
    np.add.at(alike, np.searchsorted(tags, often[:, 0]), often[:, 1].astype(np.int64))
    twice = tags[count > 1]
    hot = tags[(count > 1) & (alike > most_alike)]
    back, crowded = [], []
    for x in parts:
        x = np.unique(x)
        back.append(_pack(x[np.isin(x, twice, assume_unique=True)]))
        crowded.append(_pack(x[np.isin(x, hot, assume_unique=True)]))
    out = pd.DataFrame({"_part": blobs["_part"], "bucket": blobs["bucket"], "tags": back, "hot": crowded})
    return out[out["tags"].map(len) > 0]


class Sent:
    """Distinct stretches that a part sends to one bucket group, as one compressed value.

    ``place``: where each has its q-gram, from which its tag comes, or ``WHOLE`` for a single string.
    """

    WHOLE = 255

    @staticmethod
    def pack(q: int, place: np.ndarray, doc: np.ndarray, texts: list[bytes]) -> bytes:
        import zstandard

        sizes = np.array([len(t) for t in texts], dtype="<u2")
        parts = [np.array([len(texts), q], dtype="<u4").tobytes(), place.astype("u1").tobytes()]
        parts += [doc.astype("<i8").tobytes(), sizes.tobytes(), *texts]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    def __init__(self, blob: bytes):
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(blob)
        (n, self.q), at = np.frombuffer(data, "<u4", 2).tolist(), 8
        found = []
        for kind in ("u1", "<i8", "<u2"):
            found.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.place, self.doc, self.size = found
        self.data = data[at:]

    @property
    def texts(self) -> list[bytes]:
        ends = np.cumsum(self.size, dtype=np.int64).tolist()
        return [self.data[a:z] for a, z in zip([0, *ends], ends)]


def _marks(data: bytes, size: np.ndarray, place: np.ndarray, match: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(print, tag) of stretches that stand one after the other in ``data``."""
    ends = np.cumsum(size, dtype=np.int64)
    print_, tag = np.zeros(len(size), dtype=np.uint64), np.zeros(len(size), dtype=np.uint64)
    k = 0
    while k < len(size):
        base = int(ends[k - 1]) if k else 0
        after = max(k + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        sums = _summed(data[base : ends[after - 1]])
        z = ends[k:after] - base
        a = z - size[k:after]
        at = a + np.where(place[k:after] == Sent.WHOLE, 0, place[k:after])
        lo, hi = _longer(at, a, match, q)
        own = _hashed(sums, a, z)
        print_[k:after] = own
        tag[k:after] = np.where(place[k:after] == Sent.WHOLE, own, _hashed(sums, lo, hi)) >> np.uint64(_TAG_BITS)
        k = after
    return print_, tag


def _masks(texts: list[bytes], doc: np.ndarray, tag: np.ndarray, match: int) -> np.ndarray:
    """A bit per string of each stretch: whether it also starts in a stretch of a smaller document."""
    code, stretch = pd.factorize(np.array(texts, dtype=object))
    least = np.full(len(stretch), np.iinfo(np.int64).max)
    np.minimum.at(least, code, doc)
    size = np.array([len(s) for s in stretch]) - match + 1
    gram = np.zeros(len(stretch), dtype=np.int64)
    gram[code] = tag
    # Stretches that share their gram with another one may share some of their strings with it.
    _, where, count = np.unique(gram, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[where] > 1)
    mask = np.zeros(len(stretch), dtype=np.int64)
    if len(mixed):
        lengths = size[mixed] + match - 1
        ids = refined(b"".join([stretch[i] for i in mixed]), match)
        owner = np.repeat(mixed, size[mixed])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size[mixed]) - size[mixed], size[mixed])
        string = ids[np.repeat(np.cumsum(lengths) - lengths, size[mixed]) + step]
        smallest = np.full(string.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, string, least[owner])
        np.bitwise_or.at(mask, owner, np.where(smallest[string] < least[owner], 1 << step, 0))
    return np.where(doc > least[code], (1 << size[code]) - 1, mask[code])


def _decide(rows: pd.DataFrame, match: int) -> pd.DataFrame:
    """Which strings of each part's stretches also start in a smaller document, per part.

    ``masks`` holds a bit per string of each stretch of ``prints``, for the part's smallest document with it.
    Names of a part's hot grams (groups below 0) go back as they are, without masks.
    """
    if rows["group"].iloc[0] < 0:
        return pd.DataFrame({"_part": rows["_part"], "prints": rows["stretches"], "masks": b""})
    sent = [Sent(b) for b in rows["stretches"]]
    doc, place, size = (np.concatenate([getattr(x, k) for x in sent]) for k in ("doc", "place", "size"))
    counts = np.cumsum([len(x.size) for x in sent])
    q, data = sent[0].q, b"".join([x.data for x in sent])
    del sent
    print_, tag = _marks(data, size, place, match, q)
    # Stretches of one tag are decided together, so whole tags at a time, as many as are small together.
    order = np.argsort(tag, kind="stable")
    tags = np.flatnonzero(np.concatenate([[True], tag[order][1:] != tag[order][:-1], [True]]))
    sums = np.concatenate([[0], np.cumsum(size[order], dtype=np.int64)])[tags]
    ends = np.cumsum(size, dtype=np.int64)
    masks = np.zeros(len(order), dtype=np.int64)
    k = 0
    while k < len(tags) - 1:
        after = max(k + 1, int(np.searchsorted(sums, sums[k] + _AT_ONCE, side="right")) - 1)
        own = order[tags[k] : tags[after]]
        texts = [data[a:z] for a, z in zip((ends[own] - size[own]).tolist(), ends[own].tolist())]
        masks[own] = _masks(texts, doc[own], tag[own], match)
        k = after
    out = []
    for part, marks, own in zip(rows["_part"], np.split(print_, counts[:-1]), np.split(masks, counts[:-1])):
        hit = own != 0
        if hit.any():
            out.append((part, marks[hit].tobytes(), own[hit].astype("<i8").tobytes()))
    del data, texts
    tidy()
    return pd.DataFrame(out, columns=["_part", "prints", "masks"])


def _cut(text: bytes, starts: np.ndarray, match: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text without the strings at ``starts``; (start, length) of what goes."""
    steps = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + match, -1)
    gone = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
    edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
    left = np.frombuffer(text, dtype=np.uint8)[~gone[1:-1]].tobytes()
    return left, [(int(a), int(b - a)) for a, b in edges]


def remove_repeats(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    match: int = 50,
    q: int = 20,
    part_bytes: int = 8 << 20,
    as_text: bool = False,
    most_alike: int = 1 << 15,
) -> DataFrame:
    """Replace the text by what is left without strings that a document with a smaller id has, too.

    Texts are taken as UTF-8 bytes. A byte goes if it lies in a string of ``match`` bytes (at most
    ``q`` + 62) that also starts in a document with a smaller id; strings are judged on the
    texts as given and never cross documents. Adds ``n_bytes`` (long), ``kept`` (binary: bytes may end
    inside a character) and ``spans`` (array of start and length of what went). Null and
    empty texts keep nothing and lose nothing. With ``as_text``, ``kept`` is a string without the
    characters that lost a part of their bytes. A null id is neither smaller nor larger than others: such
    rows lose nothing. Rows of one id don't cut each other. Repeated rows stay repeated. Other columns
    stay; columns with the names added are replaced. The id must be a long. The strings of a gram with
    more than about ``most_alike`` different stretches are compared one by one.
    """
    if not 4 <= q <= match <= q + 62:
        raise ValueError("the q-gram must have 4 to `match` bytes and at most 62 bytes less")
    return carried(
        docs,
        [id_, text],
        ["n_bytes", "kept", "spans"],
        lambda rows: _remove_repeats(rows, id_, text, match, q, part_bytes, as_text, most_alike),
    )


def _remove_repeats(
    docs: DataFrame, id_: str, text: str, match: int, q: int, part_bytes: int, as_text: bool, most_alike: int
) -> DataFrame:
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != text]
    bytes_ = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    # Digest of the text, then the id: null for a null id.
    row = F.concat(F.unhex(F.sha2(bytes_, 256)), F.unhex(F.lpad(F.hex(id_), 16, "0")))
    sizes = F.octet_length(text).cast("long")
    hash_ = F.xxhash64(id_, text)
    facts = written(docs.select(F.col(id_).alias("_id"), row.alias("_row"), sizes.alias("_size"), hash_.alias("_hash")))
    total = facts.agg(F.sum("_size")).first()[0] or 0
    parts = max(partitions(spark), -(-total // part_bytes))
    buckets = 1
    while buckets < max(partitions(spark), total // (part_bytes * 6)) and buckets < 1 << _TAG_BITS:
        buckets *= 2
    part_of = lambda x: F.pmod(x, F.lit(parts)).alias("_part")
    keyed = docs.select(*kept, bytes_.alias("_text"), row.alias("_row"), part_of(hash_))
    able = facts.where(F.col("_row").isNotNull() & (F.col("_size") >= match))
    able = able.withColumn("_digest", F.substring("_row", 1, 32))
    first = able.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    # Written, so that the join has exchanges of its own, which can be split where a text is very common.
    first = written(first.where("_first < _last").select("_digest", "_first"))
    copies = able.join(first, "_digest").where("_id > _first")
    copies = written(copies.select(part_of(F.col("_hash")), "_row"))

    def stretches(frame: pd.DataFrame, copies: pd.Series) -> tuple[list[bytes], np.ndarray, Stretches]:
        """Texts, those of null ids and copies as empty ones; their ids and stretches."""
        known = frame[id_].notna().to_numpy()
        used = known & ~frame["_row"].isin(set(copies)).to_numpy()
        texts = [t if k else b"" for t, k in zip(frame["_text"], used)]
        ids = np.array([int(x) if k else 0 for x, k in zip(frame[id_], known)], dtype=np.int64)
        return texts, ids, Stretches(texts, match, q)

    def send_buckets(frame: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["bucket", "_part", "tags", "often"])
        _, ids, s = stretches(frame, copies["_row"])
        order = np.lexsort((ids[s.doc], s.gram))
        gram, doc = s.gram[order], ids[s.doc][order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        # A gram of two documents is sent twice, however many have it.
        gram, count = np.unique(gram[new], return_counts=True)
        bucket, tag = _tags(np.repeat(gram, np.minimum(count, 2)), buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, tag = bucket[order], tag[order]
        number, at = np.unique(bucket, return_index=True)
        blobs = [_pack(x) for x in np.split(tag, at[1:])] if len(tag) else []
        # How many different stretches the tags have that have more than a few.
        named = _named(s.gram, buckets)
        order = np.lexsort((s.print, named))
        named, mark = named[order], s.print[order]
        new = np.ones(len(named), dtype=bool)
        new[1:] = (named[1:] != named[:-1]) | (mark[1:] != mark[:-1])
        named, count = np.unique(named[new], return_counts=True)
        named, count = named[count > _FEW], count[count > _FEW]
        own = (named & np.uint64((1 << _TAG_BITS) - 1)).astype(np.int64)
        pairs = np.stack([named >> np.uint64(_TAG_BITS), count.astype(np.uint64)], axis=1).astype("<u8")
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], number, side="right")
        begins = np.searchsorted(own[order], number)
        often = [pairs[order[a:z]].tobytes() for a, z in zip(begins, ends)]
        tidy()
        return pd.DataFrame({"bucket": number, "_part": frame["_part"].iloc[0], "tags": blobs, "often": often})

    def single(texts: list[bytes], ids: np.ndarray, s: Stretches, which: np.ndarray, part: int) -> list[tuple]:
        """Rows of single strings, each with the part's smallest document; groups from ``buckets`` on."""
        owner, step, hashes = _strings(texts, s, which, match)
        order = np.lexsort((ids[s.doc[owner]], hashes))
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        order = order[new]
        group = (hashes[order] & np.uint64(buckets - 1)).astype(np.int64)
        order = order[np.lexsort((step[order], owner[order], group))]
        group, at = np.unique(group, return_index=True)[0], np.unique(np.sort(group), return_index=True)[1]
        out = []
        for g, own in zip(group, np.split(order, at[1:])):
            doc, a = s.doc[owner[own]], s.first[owner[own]] + step[own]
            pieces = [texts[d][x : x + match] for d, x in zip(doc.tolist(), a.tolist())]
            out.append((buckets + int(g), part, Sent.pack(q, np.full(len(own), Sent.WHOLE), ids[doc], pieces)))
        return out

    def send_stretches(frame: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        columns = ["group", "_part", "stretches"]
        copies, back = back["tags"][back["bucket"] < 0], back[back["bucket"] >= 0]
        if not len(frame) or not len(back):
            return pd.DataFrame(columns=columns)
        texts, ids, s = stretches(frame, copies)
        bucket, _ = _tags(s.gram, buckets)
        wanted, hot = (
            np.concatenate(
                [(_unpack(t) << np.uint64(_TAG_BITS)) | np.uint64(b) for b, t in zip(back["bucket"], back[name])]
            )
            for name in ("tags", "hot")
        )
        own = _named(s.gram, buckets)
        hit = np.flatnonzero(np.isin(own, wanted))
        # One row for equal stretches, with the smallest of their documents.
        hit = hit[np.lexsort((ids[s.doc[hit]], s.print[hit]))]
        new = np.concatenate([[True], s.print[hit][1:] != s.print[hit][:-1]])
        hit = hit[new[: len(hit)]]
        part = frame["_part"].iloc[0]
        more = []
        if len(hot):
            crowded = np.isin(own[hit], hot)
            more = [(-1 - part, part, hot.astype("<u8").tobytes()), *single(texts, ids, s, hit[crowded], part)]
            hit = hit[~crowded]
        hit = hit[np.argsort(bucket[hit], kind="stable")]
        group, at = np.unique(bucket[hit], return_index=True)
        blobs = []
        for own in np.split(hit, at[1:]):
            own = own[np.lexsort((s.first[own], s.doc[own]))]
            places = zip(s.doc[own].tolist(), s.first[own].tolist(), s.last[own].tolist())
            pieces = [texts[d][a : z + match] for d, a, z in places]
            blobs.append(Sent.pack(q, s.place[own], ids[s.doc[own]], pieces))
        blobs = blobs[: len(group)]
        tidy()
        return pd.DataFrame([*zip(group, [part] * len(group), blobs), *more], columns=columns)

    out_names = [*kept, "n_bytes", "kept", "spans"]

    def cut(frame: pd.DataFrame, decided: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=out_names)
        copies = set(decided["prints"][decided["masks"].isna()])
        decided = decided[decided["masks"].notna()]
        texts, ids, s = stretches(frame, copies)
        n = len(s.doc)
        mask = np.zeros(n, dtype=np.int64)
        order = np.lexsort((ids[s.doc], s.print))
        doc, mark = ids[s.doc][order], s.print[order].view(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if n else np.zeros(0, int)
        count = np.diff(np.append(heads, n))
        smallest = np.repeat(doc[heads], count)
        named = decided["masks"].map(len) == 0
        hot = np.frombuffer(b"".join(decided["prints"][named]), dtype="<u8")
        decided = decided[~named]
        said = pd.Series(
            np.frombuffer(b"".join(decided["masks"]), dtype="<i8"),
            index=np.frombuffer(b"".join(decided["prints"]), dtype="<i8"),
        )
        here = said.reindex(mark, fill_value=0).to_numpy() if n else np.zeros(0, dtype=np.int64)
        whole = (1 << (s.last - s.first + 1)[order]) - 1
        mask[order] = np.where(doc > smallest, whole, here)
        if len(hot):
            which = np.flatnonzero(np.isin(_named(s.gram, buckets), hot))
            owner, step, hashes = _strings(texts, s, which, match)
            _, string = np.unique(hashes, return_inverse=True)
            doc = ids[s.doc[owner]]
            least = np.full(len(hashes), np.iinfo(np.int64).max)
            np.minimum.at(least, string, doc)
            gone = (doc > least[string]) | (said.reindex(hashes.view(np.int64), fill_value=0).to_numpy() != 0)
            mask[which] = 0
            np.bitwise_or.at(mask, owner[gone], 1 << step[gone])
        hit = np.flatnonzero(mask)
        bits = (mask[hit][:, None] >> np.arange(match - q + 1)) & 1
        row, step = np.nonzero(bits)
        owner, starts = s.doc[hit][row], s.first[hit][row] + step
        by = np.argsort(owner, kind="stable")
        owner, starts = owner[by], starts[by]
        lost, at = np.unique(owner, return_index=True)
        cuts = {int(d): x for d, x in zip(lost, np.split(starts, at[1:]))} if len(lost) else {}
        left, spans = [], []
        for i, (t, known_as) in enumerate(zip(frame["_text"], frame["_row"])):
            if known_as in copies:
                l, p = b"", [(0, len(t))]
            else:
                l, p = _cut(t, cuts[i], match) if i in cuts else (t, [])
            left.append(l.decode(errors="ignore") if as_text else l)
            spans.append([{"start": a, "length": b} for a, b in p])
        sizes = frame["_text"].map(len)
        tidy()
        return frame[kept].assign(n_bytes=sizes, kept=left, spans=spans)[out_names]

    span = StructType().add("start", LongType()).add("length", LongType())
    schema = docs.select(*kept).schema.add("n_bytes", LongType()).add("kept", StringType() if as_text else BinaryType())
    schema = schema.add("spans", ArrayType(span))
    texts = keyed.groupBy("_part")
    sent = texts.cogroup(copies.groupBy("_part")).applyInPandas(
        send_buckets, "bucket long, _part long, tags binary, often binary"
    )
    back = sent.groupBy("bucket").applyInPandas(
        lambda x: _shared_buckets(x, most_alike), "_part long, bucket long, tags binary, hot binary"
    )
    # Parts get their copies with each answer: under a bucket below 0, and without masks.
    nothing = F.lit(None).cast("binary")
    back = back.union(copies.select("_part", F.lit(-1).cast("long"), "_row", nothing))
    rows = texts.cogroup(back.groupBy("_part")).applyInPandas(
        send_stretches, "group long, _part long, stretches binary"
    )
    decided = rows.groupBy("group").applyInPandas(
        lambda x: _decide(x, match), "_part long, prints binary, masks binary"
    )
    decided = decided.union(copies.select("_part", "_row", nothing))
    return texts.cogroup(decided.groupBy("_part")).applyInPandas(cut, schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of earlier documents, as digests."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
