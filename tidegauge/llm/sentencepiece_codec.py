"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The merge order of such a model is a score per piece: of all neighbouring symbols whose join is a
piece, those with the highest score merge first, the leftmost of equals. The encoder does not replay
the merges of a whole text. A sequence of pieces is the model's encoding exactly if each piece next
to another would also stay apart from it when the two are merged alone, because the first merge that
crosses a border only depends on the two pieces at that border. So the encoder takes the longest
piece at each position (Aho-Corasick finds all pieces of the text in one pass), checks it against
the piece before by re-merging the two, goes on to the next shorter piece when they don't agree, and
back by one piece when none is left. A bit field marks positions from which no encoding exists, so no position
fails twice.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .shared import remembering, table, tidy

SPACE = "▁"
#: Words that a worker remembers, in all, and pairs of pieces; beyond that it starts anew. Bounds memory, not the result.
REMEMBERED = 400_000
REMEMBERED_PAIRS = 200_000
#: Ids are kept and joined as the bytes of such numbers: less room than tuples, and nothing for the garbage collector.
ID = np.dtype(np.int32)


class Words(dict):
    """Ids of words, filled on demand. Words with many ids are not remembered."""

    def __init__(self, codec: Codec, prefix: str):
        super().__init__()
        self.codec, self.prefix = codec, prefix

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.encode_run(self.prefix + word)
        if len(word) <= 64 and len(ids) <= 64 * ID.itemsize:
            self.codec.make_room()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of a merge-type model that is given as its file's content."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.eos = p.eos_id()
        self.names = [str(i) for i in range(p.get_piece_size())]
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: list[int] = [-1] * 256
        automaton = ahocorasick.Automaton()
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.ids[piece], self.score[piece] = i, p.get_score(i)
                if len(piece) > 1:
                    automaton.add_word(piece, piece)
        automaton.make_automaton()
        self.automaton = automaton
        # Spaces start pieces and never follow other characters in one: words encode by themselves.
        self.by_words = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.ids)
        # Signs that follow no letter in any piece: where one stands after a character that no piece has
        # before such a sign, what is before it and what follows encode by themselves.
        pairs = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        signs = {x for piece in self.ids for x in piece if not x.isalnum()} - {SPACE}
        signs -= {b for a, b in pairs if a.isalpha()}
        joined = "".join(map(re.escape, sorted({a for a, b in pairs if b in signs})))
        some = "".join(map(re.escape, sorted(signs)))
        self.split = re.compile(f"(?<=[^{joined}])(?=[{some}])" if joined and some else r"(?!)").split
        # No piece has a line break: lines encode by themselves.
        self.by_lines = not any("\n" in x for x in self.ids)
        self.line_break = array("i", self.encode_bytes("\n")).tobytes()
        self.end = array("i", [self.eos]).tobytes()
        self.agree: dict[tuple[str, str], bool] = {}
        self.first, self.later, self.raw = Words(self, SPACE), Words(self, ""), Words(self, "")
        self.runs = Words(self, "")  # what words have from a sign on
        self.words = (self.first, self.later, self.raw, self.runs)

    def encode_bytes(self, char: str) -> list[int]:
        ids = [self.bytes[b] for b in char.encode()]
        return [self.processor.unk_id()] if -1 in ids else ids

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of two pieces gives these two pieces again."""
        known = self.agree.get((left, right))
        if known is None:
            if len(self.agree) >= REMEMBERED_PAIRS:
                self.agree.clear()
            known = self.agree[left, right] = self.merge(left + right) == [left, right]
        return known

    def merge(self, text: str) -> list[str]:
        """Replay the merges of a short text: the highest score first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        joins = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(joins):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(joins):
                joins[at] = score(parts[at] + parts[at + 1])

    def pieces(self, run: str) -> list[str]:
        """Encode a run of text in which spaces are already marked."""
        size = len(run)
        # Pieces of two characters or more at each position, shorter ones first: the automaton reports by
        # end. Below them, every position has its character alone; one without a piece merges with nothing.
        at: list[list[str] | None] = [None] * size
        for end, piece in self.automaton.iter(run):
            start = end - len(piece) + 1
            if at[start] is None:
                at[start] = [piece]
            else:
                at[start].append(piece)
        failed = 0  # bit field of positions from which no encoding goes on
        agree, ids = self.agree, self.ids
        out: list[str] = []
        tries: list[int] = []  # how many of its position's pieces each taken piece leaves
        pos, last = 0, ""
        left = len(at[0]) + 1 if at[0] else 1
        while pos < size:
            options = at[pos]
            while left:
                left -= 1
                piece = options[left - 1] if left else run[pos]
                end = pos + len(piece)
                if failed and failed >> end & 1:
                    continue
                if last:
                    known = agree.get((last, piece))
                    if known is None:
                        known = last not in ids or piece not in ids or self.stay_apart(last, piece)
                    if not known:
                        continue
                out.append(piece)
                tries.append(left)
                pos, last = end, piece
                if pos < size:
                    left = len(at[pos]) + 1 if at[pos] else 1
                break
            else:
                failed |= 1 << pos
                if not out:
                    raise ValueError("the model has no encoding of a text")
                pos -= len(out.pop())
                left = tries.pop()
                last = out[-1] if out else ""
        return out

    def make_room(self) -> None:
        if sum(map(len, self.words)) >= REMEMBERED:
            for known in self.words:
                known.clear()

    def encode_run(self, run: str) -> bytes:
        parts = self.split(run)
        if len(parts) == 1:
            return self.encode_part(run)
        # What stands before the first sign is mostly a word that also stands alone.
        return b"".join([self.first[x[1:]] if x[0] == SPACE else self.runs[x] for x in parts])

    def encode_part(self, run: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(run):
            found = self.ids.get(piece)
            if found is None:
                ids += self.encode_bytes(piece)
            else:
                ids.append(found)
        return array("i", ids).tobytes()

    def parts(self, text: str) -> list[bytes]:
        """Ids of the words of ``text`` in order, without the end id."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.by_words:
            return [self.raw[SPACE + text.replace(" ", SPACE)]]
        out: list[bytes] = []
        lines = text.split("\n") if self.by_lines else [text]
        for k, line in enumerate(lines):
            if k:
                out.append(self.line_break)
                if not line:
                    continue
            words = line.split(" ")
            if "" in words:  # runs of spaces belong together
                marked = (SPACE if k == 0 else "") + line.replace(" ", SPACE)
                out += [self.raw[x] for x in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)]
            else:
                head = self.first if k == 0 else self.later
                out.append(head[words[0]])
                out += map(self.first.__getitem__, words[1:])
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.parts(text)), ID).tolist()

    def encode_whole(self, text: str | None) -> np.ndarray:
        """Ids of a text, the end id last; a null text has the end id alone."""
        return np.frombuffer(b"".join([*self.parts(text or ""), self.end]), ID)

    def forget(self) -> None:
        for known in (*self.words, self.agree):
            known.clear()

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


_CODECS: dict[str, Codec] = {}


@contextmanager
def codec(model: bytes) -> Iterator[Codec]:
    """The worker's codec of a model, built once a worker; words and pairs of pieces are remembered for one task.

    Other stages use the worker afterwards, and what it kept would add to their memory, as what they kept adds here.
    """
    tidy()
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    with remembering():
        try:
            yield _CODECS[key]
        finally:
            _CODECS[key].forget()


def read_model(path: str) -> bytes:
    """The model file's content. It has a few hundred kB and travels with the task."""
    with open(path, "rb") as f:
        return f.read()


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` characters: ids take many times the room of their text."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def encode_texts(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int, end id last) and ``decoded`` to every row.

    A null or empty text has the end id alone and decodes to an empty text. Rows keep their
    columns; columns called ids or decoded are replaced. Words are remembered by each worker up
    to a fixed number, which only saves time. Memory is bounded by a batch and its longest text: rows
    stay in Arrow, and texts become Python strings a slice at a time.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(model) as c:
            for batch in batches:
                for rows in slices(batch, text):
                    ids = [c.encode_whole(x) for x in rows.column(text).to_pylist()]
                    decoded = pa.array([c.decode(x.tolist()) for x in ids], rows.column(text).type)
                    arrays = [*rows.columns, pa.array(ids, pa.list_(pa.int32())), decoded]
                    yield pa.RecordBatch.from_arrays(arrays, [*rows.schema.names, "ids", "decoded"])

    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return docs.select(*kept).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead of the ids and texts.

    The same encoding as ``encode_texts``; only digests leave the worker.
    """
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in docs.columns if c not in names]
    out = [c for c in kept if c != text]

    def digest(c: Codec, value: str | None) -> tuple[int, str, str]:
        ids = c.encode_whole(value).tolist()
        line = " ".join(map(c.names.__getitem__, ids))
        return (
            len(ids),
            hashlib.sha256(line.encode()).hexdigest(),
            hashlib.sha256(c.decode(ids).encode()).hexdigest(),
        )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with codec(model) as c:
            for batch in batches:
                rows = [digest(c, x) for x in batch[text]]
                found = pd.DataFrame(rows, columns=list(names), index=batch.index)
                yield batch[out].assign(**{n: found[n] for n in names})

    schema = docs.select(*out).schema.add("n_tokens", "long")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select(*kept).mapInPandas(run, schema)


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with an end id and decoded again, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return encode_digests(docs, default_model())
