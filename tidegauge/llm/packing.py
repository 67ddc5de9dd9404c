"""Token ids of documents, packed into rows of equal length."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .shared import remembering, table

#: Words that a worker remembers; beyond that it starts anew. Bounds memory, not the result.
REMEMBERED = 800_000


class Tokenizer:
    """Byte-level BPE from a file of ranks, encoding word by word to ids in binary.

    The split pattern never joins a single space between two other characters to what is before it, so
    texts are cut there and the ids of words are remembered.
    """

    def __init__(self, ranks: bytes, pattern: str, end_id: int | None = None):
        import base64

        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
        self.kind = id_type(max(max(table_.values()), end_id or 0) + 1)
        self.end = b"" if end_id is None else np.array([end_id], dtype=self.kind).tobytes()
        self.first, self.later = Words(self, ""), Words(self, " ")

    def ids(self, text: str) -> bytes:
        return np.array(self.own.encode_ordinary(text), dtype=self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, the end id last if there is one, little-endian."""
        if not text:
            return self.end
        words = text.split(" ")
        if plain_spaces(text):  # every space is a place to cut
            return b"".join([self.first[words[0]], *map(self.later.__getitem__, words[1:]), self.end])
        out, held, known = [], words[0], self.first
        for word in words[1:]:
            # Only a lone space between two characters that are not white space is a place to cut.
            if held and word and not held[-1].isspace() and not word[0].isspace():
                out.append(known[held])
                held, known = word, self.later
            else:
                held = f"{held} {word}"
        return b"".join([*out, known[held], self.end])


_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_ASCII_WHITE = [c for c in _WHITE if c.isascii()]


def plain_spaces(text: str) -> bool:
    """Whether each space stands between two characters that are not white space (line breaks may)."""
    if text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (_ASCII_WHITE if text.isascii() else _WHITE))


class Words(dict):
    """Ids of words after a prefix, filled on demand."""

    def __init__(self, tokenizer: Tokenizer, prefix: str):
        super().__init__()
        self.tokenizer, self.prefix = tokenizer, prefix

    def __missing__(self, word: str) -> bytes:
        ids = self.tokenizer.ids(self.prefix + word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


_TOKENIZERS: dict[int, Tokenizer] = {}


def _tokenizer(ranks: bytes, pattern: str, end_id: int | None) -> Tokenizer:
    """The worker's tokenizer; built once a worker."""
    key = hash((ranks, pattern, end_id))
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(ranks, pattern, end_id)
    return _TOKENIZERS[key]


class Capacities:
    """Segment tree over the room left in bins: finds the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.some = bytearray(2 * self.size)  # whether a subtree has a bin
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, bin_: int) -> None:
        heapq.heappush(self.bins[room], bin_)
        at = room + self.size
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the first bin among those with the least room of at least ``need``: (room, bin)."""
        at = need + self.size
        if not self.some[at]:
            while at > 1 and not (at % 2 == 0 and self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at + (not self.some[2 * at])
        room = at - self.size
        bin_ = heapq.heappop(self.bins[room])
        if not self.bins[room]:
            while at:
                self.some[at] = at < self.size and (self.some[2 * at] or self.some[2 * at + 1])
                if self.some[at]:
                    break
                at >>= 1
        return room, bin_


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that still has room for it.

    Of equal lengths the first comes first, of equally full bins the first opened is taken.
    """
    lengths = list(lengths)
    tree, bins = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        room, at = found or (capacity, len(bins))
        if found is None:
            bins.append([])
        bins[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return bins


def chunks(
    docs: DataFrame, ranks: bytes, pattern: str, capacity: int, end_id: int | None,
    id_: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Rows (id, start, ids binary): each document's ids in successive chunks of ``capacity`` at most.

    ``end_id`` closes each document if given. Ids are little-endian, 2 bytes each if all ids fit, else 4.
    A document without ids (an empty or null text, without ``end_id``) has no chunk.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(ranks, pattern, end_id)
        width = np.dtype(t.kind).itemsize
        with remembering():
            for batch in batches:
                owner, starts, blobs = [], [], []
                for i, x in enumerate(batch[text]):
                    data = t.encode(x)
                    for a in range(0, len(data) // width, capacity):
                        owner.append(i)
                        starts.append(a)
                        blobs.append(data[a * width : (a + capacity) * width])
                ids_ = batch[id_].iloc[owner].reset_index(drop=True)
                yield pd.DataFrame({id_: ids_, "start": np.array(starts, dtype=np.int64), "ids": blobs})

    schema = docs.select(id_).schema.add("start", LongType()).add("ids", BinaryType())
    return docs.select(id_, text).mapInPandas(run, schema)


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def pack(
    pieces: DataFrame, capacity: int, width: int, shards: int, pad: int = 0, id_: str = "doc_id"
) -> DataFrame:
    """Pack chunks (id, start, ids) of at most ``capacity`` ids into rows of exactly that many.

    Chunks are dealt to ``shards`` by a hash, so that a shard fits into a task's memory; each shard is
    packed by itself, best fit decreasing. Rows: shard (int), row (int, from 0 in a shard),
    ids (binary: the row of the id matrix, ``width`` bytes an id, filled up with ``pad``), n_ids (int: ids
    that are not padding), cu_seqlens (0 and the ends of the row's segments), position_ids (binary: of every
    id, starting from 0 at each segment; 0 for padding), doc_ids and starts (of each segment: the
    document and the place in it, so nothing is lost). Chunks of null ids are dealt by their content.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    places = id_type(capacity)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(id_, "start", "ids"), F.lit(shards)).cast("int"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        # Any order of the rows gives the same packing, but for chunks that are equal in all.
        frame = frame.sort_values([id_, "start"], kind="stable", ignore_index=True)
        lengths = frame["ids"].map(len) // width
        rows = []
        for at, members in enumerate(best_fit_decreasing(lengths, capacity)):
            sizes = [int(lengths[i]) for i in members]
            ends = [0, *np.cumsum(sizes).tolist()]
            row = np.full(capacity, pad, dtype=kind)
            row[: ends[-1]] = np.frombuffer(b"".join(frame["ids"].iloc[members]), dtype=kind)
            position = np.zeros(capacity, dtype=places)
            for n, a in zip(sizes, ends):
                position[a : a + n] = np.arange(n)
            docs = [None if pd.isna(x) else int(x) for x in frame[id_].iloc[members]]
            starts = frame["start"].iloc[members].tolist()
            rows.append((at, row.tobytes(), ends[-1], ends, position.tobytes(), docs, starts))
        out = pd.DataFrame(rows, columns=["row", "ids", "n_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"])
        out.insert(0, "shard", frame["shard"].iloc[0])
        return out

    schema = (
        StructType().add("shard", IntegerType()).add("row", IntegerType()).add("ids", BinaryType())
        .add("n_ids", IntegerType()).add("cu_seqlens", ArrayType(IntegerType()))
        .add("position_ids", BinaryType()).add("doc_ids", ArrayType(LongType()))
        .add("starts", ArrayType(LongType()))
    )
    return dealt.groupBy("shard").applyInPandas(one, schema)


def pack_documents(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    capacity: int = 2048,
    end_id: int | None = None,
    shard_bytes: int = 16 << 20,
    id_: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Tokenize whole texts and pack their ids; see ``chunks`` and ``pack``. The id must be a long.

    A shard gets about ``shard_bytes`` of text, whatever the session's settings, so rows depend on the documents
    alone. Repeated rows are packed as often as they come.
    """
    size = sum(1 for line in ranks.splitlines() if line)
    width = np.dtype(id_type(max(size, (end_id or 0) + 1))).itemsize
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    found = chunks(docs, ranks, pattern, capacity, end_id, id_, text)
    return pack(found, capacity, width, shards, end_id or 0, id_)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as rows of 2,048 ids, each document closed by an end id."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()  # under 1 MB; travels with the tasks
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, ranks, public_tokenizers.PATTERN, end_id=50_256)
