"""Word, symbol and repetition rules, and perplexity bands of an n-gram model per language."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import remembering, table, tidy, written

ORDER = 5  # bytes of an n-gram; a code has eight bits for each
#: The byte 0 stands before the first one of a text.
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are counted at once.
AT_ONCE = 1 << 21
#: Bytes that are scored at once: a dozen arrays of eight bytes for each, which fit the processor's cache.
SCORED_AT_ONCE = 1 << 17
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PART = "language string, part int, codes binary, counts binary, with_n array<long>, heads binary"
MODEL = "language string, part int, grams long, tables binary"
_WHITE = " \t\n\x0b\x0c\r"
#: Bytes of words: ASCII letters and all beyond ASCII.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts named in ``BASE`` of one text; a null text has none of anything.

    Words are runs without ASCII white space. ``n_repeat_words`` are the words in windows of
    three that occur twice or more in the text, the first occurrence included.
    """
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(map(text.count, _WHITE))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    if len(set(windows)) < len(windows):
        seen: set = set()
        again: set = set()
        for x in windows:
            (again if x in seen else seen).add(x)
        until = 0
        for i, x in enumerate(windows):
            if x in again:
                repeat += i + 3 - max(i, until)
                until = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat


def words_in(texts: list[bytes]) -> np.ndarray:
    """How many words each text has: runs of ASCII letters and bytes beyond ASCII."""
    # What stands between texts is no letter, so words do not cross them.
    letter = _LETTER[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", dtype=np.uint8)]
    begins = np.flatnonzero(letter[1:] & ~letter[:-1])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.diff(np.searchsorted(begins, ends), prepend=0)


def grams(texts: Iterable[bytes], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, place of each one's text) of successive runs of at most ``at_once`` bytes; each text starts at an edge.

    A longer text is cut into pieces, each with the bytes before it.
    """
    lead = bytes(ORDER - 1)
    run: list[bytes] = []  # pieces after the bytes before them
    places: list[int] = []
    size = 0

    def codes() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) - ORDER + 1 for x in run], dtype=np.int64)
        x = np.frombuffer(b"".join(run), dtype=np.uint8)
        starts = np.cumsum(lengths + ORDER - 1) - lengths
        all_ = np.zeros(len(x), dtype=np.uint64)
        for k in range(ORDER):
            all_[k:] |= x[: len(x) - k].astype(np.uint64) << np.uint64(8 * k)
        real = np.ones(len(x), dtype=bool)
        for k in range(1, ORDER):
            real[starts - k] = False
        return all_[real], np.repeat(places, lengths)

    for place, text in enumerate(texts):
        for at in range(0, len(text), at_once):
            piece = text[at : at + at_once]
            if size + len(piece) > at_once:
                yield codes()
                run, places, size = [], [], 0
            run.append((lead + text[max(0, at - ORDER + 1) : at])[1 - ORDER :] + piece)
            places.append(place)
            size += len(piece)
    if run:
        yield codes()


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[new], np.add.reduceat(counts, new) if len(new) else counts


def _pack(codes: np.ndarray) -> bytes:
    """Sorted codes as distances, which Spark's compression makes small."""
    return np.diff(codes, prepend=np.uint64(0)).astype("<u8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u8"), dtype=np.uint64)


def _shorter(codes: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` bytes of each n-gram."""
    return codes & np.uint64((1 << 8 * k) - 1)


def by_order(codes: np.ndarray, counts: np.ndarray, lowest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of orders ``lowest`` to ORDER; below the highest, in how many contexts an n-gram stands."""
    out = [(codes, counts.astype(np.float64))]
    for k in range(ORDER - 1, lowest - 1, -1):
        c, n = np.unique(_shorter(out[0][0], k), return_counts=True)
        out.insert(0, (c, n.astype(np.float64)))
    return out


def discounts(with_n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0 to 3 and more, from how many n-grams occur 1 to 4 times."""
    y = with_n[0] / (with_n[0] + 2 * with_n[1]) if with_n[0] else 0.0
    out = np.zeros(4)
    for i in range(1, 4):
        rate = with_n[i] / with_n[i - 1] if with_n[i - 1] else 0.0
        out[i] = min(max(i - (i + 1) * y * rate, 0.1), i - 0.1)
    return out


def _estimated(
    codes: np.ndarray, n: np.ndarray, discount: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log2 probabilities of n-grams, their contexts, and log2 of what each context leaves to the lower order."""
    off = np.minimum(discount[np.minimum(n, 3).astype(int)], n * 0.9)
    contexts, where = np.unique(codes >> np.uint64(8), return_inverse=True)
    total = np.bincount(where, n, len(contexts))
    left = np.bincount(where, off, len(contexts)) / total
    return np.log2((n - off) / total[where] + left[where] * lower), contexts, np.log2(left)


class HashArray(NamedTuple):
    """Values by code in an array sorted by hash. ``first`` tells where the hashes with given leading bits begin, so a
    look-up needs a step or two. The hash is a product with an odd number, so no two codes share one."""

    hashes: np.ndarray
    first: np.ndarray
    shift: np.uint64
    values: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = codes * _ODD
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(1, len(codes).bit_length())
        shift = np.uint64(64 - bits)
        first = np.searchsorted(hashes >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        return cls(hashes, first.astype(np.int32 if len(codes) < 1 << 31 else np.int64), shift, values[order])

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether there is one) of the codes; 0 where there is none."""
        if not len(self.hashes):
            return np.zeros(len(codes)), np.zeros(len(codes), dtype=bool)
        wanted = codes * _ODD
        lead = (wanted >> self.shift).astype(np.int64)
        at = self.first[lead]
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == wanted
        rest = np.flatnonzero(~hit)
        ends = self.first[lead[rest] + 1]
        while len(rest):
            at[rest] += 1
            inside = at[rest] < ends
            rest, ends = rest[inside], ends[inside]
            own = self.hashes[at[rest]] == wanted[rest]
            hit[rest[own]] = True
            rest, ends = rest[~own], ends[~own]
        return np.where(hit, self.values[np.minimum(at, len(self.hashes) - 1)], 0.0), hit


class Tables(NamedTuple):
    """One language: per order from 2, log2 probabilities by n-gram, and by context the log2 of what it leaves to the
    next lower order; of order 1, the log2 probability of every byte. ``parts`` tells which bytes before the last
    one are covered."""

    logs: list[HashArray]
    rest: list[HashArray]
    bytes_: np.ndarray
    parts: np.ndarray

    def score(self, code: np.ndarray) -> np.ndarray:
        """log2 probability of the last byte of each n-gram after its first ones."""
        out = np.zeros(len(code))
        todo: np.ndarray | None = None  # all
        for k in range(ORDER, 1, -1):
            own = _shorter(code if todo is None else code[todo], k)
            found, hit = self.logs[k - 2].find(own)
            if todo is None:
                out, todo = found, np.flatnonzero(~hit)
            else:
                out[todo] += found
                todo = todo[~hit]
            if not len(todo):
                return out
            out[todo] += self.rest[k - 2].find(own[~hit] >> np.uint64(8))[0]
        out[todo] += self.bytes_[_shorter(code[todo], 1).astype(np.int64)]
        return out


def _joined(rows: Iterable[bytes]) -> Tables:
    """Tables of several parts of one language as one."""
    parts = [pickle.loads(r) for r in rows]
    both = lambda i, k: np.concatenate([p[i][k] for p in parts])
    logs, rest = ([HashArray.of(both(i, k), both(i + 1, k)) for k in range(ORDER - 1)] for i in (0, 2))
    return Tables(logs, rest, parts[0][4], np.any([p[5] for p in parts], axis=0))


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of all n-grams of the distinct texts of each language, in parts by the byte before the last.

    Copies of a text are brought together in each task before the shuffle, and count once. A task sums what it
    reads and hands on a sorted array per language and part. N-grams of every order that end alike, and the
    contexts they have, are in one part, so that all counts of lower orders are made there, too.
    """
    texts = docs.groupBy(F.col(lang).alias("language"), text_digest(text)).agg(F.first(text).alias("_text"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(language: str | None, texts: list[bytes]) -> None:
            for codes, _ in grams(texts, AT_ONCE):
                runs = known.setdefault(language, [])
                runs.append(np.unique(codes, return_counts=True))
                # Runs of about equal sizes are merged, so a code is sorted a logarithmic number of times.
                while len(runs) > 1 and 2 * len(runs[-1][0]) >= len(runs[-2][0]):
                    b, a = runs.pop(), runs.pop()
                    runs.append(_counted(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])))

        waiting: dict[str | None, list[bytes]] = {}
        sizes: dict[str | None, int] = {}
        for batch in batches:
            for language, t in zip(batch["language"], batch["_text"]):
                data = (t or "").encode()
                waiting.setdefault(language, []).append(data)
                sizes[language] = sizes.get(language, 0) + len(data)
                if sizes[language] >= AT_ONCE:
                    add(language, waiting.pop(language))
                    del sizes[language]
        for language, own in waiting.items():
            add(language, own)
        for language, runs in known.items():
            codes, counts = _counted(*(np.concatenate(x) for x in zip(*runs)))
            parts = (codes >> np.uint64(8)) & np.uint64(255)
            order = np.argsort(parts, kind="stable")
            codes, counts, parts = codes[order], counts[order], parts[order]
            cuts = np.flatnonzero(np.diff(parts)) + 1
            rows = [
                (language, int(p[0]), _pack(c), n.astype("<u8").tobytes(), [], b"")
                for p, c, n in zip(np.split(parts, cuts), np.split(codes, cuts), np.split(counts, cuts))
                if len(p)
            ]
            yield pd.DataFrame(rows, columns=_names(PART))
        tidy()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([_unpack(c) for c in rows["codes"]])
        codes, counts = _counted(codes, np.concatenate([np.frombuffer(n, dtype="<u8") for n in rows["counts"]]))
        orders = by_order(codes, counts, 2)
        with_n = [int((n == i).sum()) for _, n in orders for i in range(1, 5)]
        heads = np.zeros(256, dtype="<i8")
        heads[_shorter(orders[0][0], 1).astype(np.int64)] = 1
        row = (rows["language"].iloc[0], int(key[1]), _pack(codes), counts.astype("<u8").tobytes(), with_n, heads.tobytes())
        return pd.DataFrame([row], columns=_names(PART))

    summed = texts.select("language", "_text").mapInPandas(run, PART)
    return summed.groupBy("language", "part").applyInPandas(merge, PART)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def text_digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text))).alias("_of_text")


def estimate(counts: DataFrame) -> DataFrame:
    """The model: a row per language and part, with sorted arrays for every order.

    Interpolated modified Kneser-Ney. The discounts of a language come from all its parts, of which there are
    256 at most; each part is then estimated by itself.
    """

    def of_language(rows: pd.DataFrame) -> pd.DataFrame:
        with_n = np.sum([np.array(x) for x in rows["with_n"]], axis=0).reshape(ORDER - 1, 4)
        heads = np.sum([np.frombuffer(x, dtype="<i8") for x in rows["heads"]], axis=0).astype(float)
        first = discounts(np.array([(heads == i).sum() for i in range(1, 5)], dtype=float))
        off = np.minimum(first[np.minimum(heads, 3).astype(int)], heads * 0.9)
        chance = (heads - off) / heads.sum() + off.sum() / heads.sum() / 256
        off_of = np.concatenate([discounts(x.astype(float)) for x in with_n])
        return pd.DataFrame(
            [(rows["language"].iloc[0], off_of.astype("<f8").tobytes(), chance.astype("<f8").tobytes())],
            columns=["of", "off_", "chance_"],
        )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                orders = by_order(_unpack(row.codes), np.frombuffer(row.counts, dtype="<u8"), 2)
                off = np.frombuffer(row.off_, dtype="<f8").reshape(ORDER - 1, 4)
                chance = np.frombuffer(row.chance_, dtype="<f8")
                tables: tuple = ([], [], [], [])
                for k, (codes, n) in enumerate(orders, 2):
                    if k == 2:
                        lower = chance[_shorter(codes, 1).astype(np.int64)]
                    else:
                        lower = np.exp2(tables[1][-1][np.searchsorted(tables[0][-1], _shorter(codes, k - 1))])
                    logs, contexts, rest = _estimated(codes, n, off[k - 2], lower)
                    for kept, x in zip(tables, (codes, logs, contexts, rest)):
                        kept.append(x)
                own = np.zeros(256, dtype=bool)
                own[row.part] = True
                data = pickle.dumps((*tables, np.log2(chance), own), protocol=5)
                yield pd.DataFrame([(row.language, row.part, len(orders[-1][0]), data)], columns=_names(MODEL))
        tidy()

    told = counts.select("language", "with_n", "heads")
    each = told.groupBy("language").applyInPandas(of_language, "of string, off_ binary, chance_ binary")
    joined = counts.select("language", "part", "codes", "counts").join(each, F.col("language").eqNullSafe(F.col("of")))
    return joined.mapInPandas(run, MODEL)


class Model:
    """A written model, handed to tasks in broadcasts of a bounded size each; a task opens one at a time."""

    def __init__(self, rows: DataFrame, most_bytes: int = 24 << 20):
        self.rows = rows
        sizes = rows.select("language", "part", F.octet_length("tables").alias("n")).collect()  # 256 a language
        groups: list[list[tuple]] = []
        room = 0
        for r in sorted(sizes, key=lambda r: (r["language"] is not None, r["language"] or "", r["part"])):
            if r["n"] > room:
                groups.append([])
                room = most_bytes
            groups[-1].append((r["language"], r["part"]))
            room -= r["n"]
        context = rows.sparkSession.sparkContext
        self.groups = []
        for group in groups:
            parts = {}
            for language, part in group:
                parts.setdefault(language, []).append(part)
            opened = {}
            for language, own in parts.items():
                mine = rows.where(F.col("language").eqNullSafe(F.lit(language)) & F.col("part").isin(own))
                opened[language] = _joined(bytes(r["tables"]) for r in mine.select("tables").collect())
            self.groups.append((set(parts), context.broadcast(opened)))
        #: Whether one broadcast has it all, so that tasks may keep it open.
        self.whole = len(self.groups) == 1


def log_chances(groups: list, texts: dict[str | None, list[bytes]], keep: bool) -> dict[str | None, np.ndarray]:
    """log2 probability of every text by the model of its language.

    Bytes after a byte that the language's model never saw have the chance of the byte alone, and all bytes are
    alike where there is no model of the language.
    """
    out = {language: np.zeros(len(own)) for language, own in texts.items()}
    left = {language: np.ones(256, dtype=bool) for language in texts}
    alone: dict[str | None, np.ndarray] = {language: np.full(256, -8.0) for language in texts}

    def add(language: str | None, parts: np.ndarray, score) -> None:
        for codes, owner in grams(texts[language], SCORED_AT_ONCE):
            if not parts.all():
                own = parts[((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64)]
                codes, owner = codes[own], owner[own]
            out[language] += np.bincount(owner, score(codes), len(out[language]))

    for languages, shared in groups:
        if languages.isdisjoint(texts):
            continue
        opened = shared.value
        for language in languages & texts.keys():
            tables = opened[language]
            parts = tables.parts
            alone[language] = tables.bytes_
            left[language] &= ~parts
            add(language, parts, tables.score)
        if not keep:
            del opened, tables
            shared.__dict__.pop("_value", None)  # the next one takes its place in memory
    for language in texts:
        if left[language].any():
            add(language, left[language], lambda codes, own=alone[language]: own[_shorter(codes, 1).astype(np.int64)])
    return out


def measure(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Replace the text by the counts of ``BASE`` and ``bits``, the mean bits of a word by its language's model.

    All bytes of a text are scored, and divided by its words, runs of letters: symbols and separators between
    words make them dear, however predictable they are. Six digits; null for a text without words. The
    perplexity of a word is 2 ** bits.
    """
    kept = [c for c in docs.columns if c not in (text, "bits", *BASE)]
    groups, keep = model.groups, model.whole

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with remembering():
            for batch in batches:
                out = [batch[kept].reset_index(drop=True)]
                out.append(pd.DataFrame([base_counts(x) for x in batch[text]], columns=list(BASE), dtype="int64"))
                texts: dict[str | None, list[bytes]] = {}
                places: dict[str | None, list[int]] = {}
                for i, (language, t) in enumerate(zip(batch[lang], batch[text])):
                    texts.setdefault(language, []).append((t or "").encode())
                    places.setdefault(language, []).append(i)
                found = log_chances(groups, texts, keep)
                bits = np.full(len(batch), np.nan)
                for language, own in texts.items():
                    words = words_in(own)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        bits[places[language]] = np.where(words > 0, -found[language] / words, np.nan)
                values = [None if np.isnan(x) else round(float(x), 6) for x in bits]
                out.append(pd.Series(values, name="bits", dtype=object))
                yield pd.concat(out, axis=1)

    schema = docs.select(*kept).schema
    for name in BASE:
        schema = schema.add(name, "long")
    return docs.select(*kept, text).mapInPandas(run, schema.add("bits", "double"))


def bands(measured: DataFrame, group: str, reach: float, least: float, step: float = 0.001) -> DataFrame:
    """Rows (_group, low, high): quartiles of ``bits`` widened by ``reach`` times their distance.

    Exact quartiles over the distinct texts (``_of_text``) of a group, of ``bits`` rounded to ``step``,
    from counts per group and step: no group is gathered in one task. The distance of the quartiles counts
    as ``least`` at least.
    """
    steps = F.round(F.col("bits") / step).cast("long").alias("_step")
    counted = (
        measured.where("bits is not null and not base_failed")
        .select(F.col(group).alias("_group"), "_of_text", steps)
        .distinct()
        .groupBy("_group", "_step")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # At most bits / step rows a group.
    upto = Window.partitionBy("_group").orderBy("_step")
    whole = Window.partitionBy("_group")
    ranked = counted.withColumns(
        {"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)}
    )
    at = lambda share: F.min(F.when(F.col("_upto") >= F.col("_total") * share, F.col("_step"))) * step
    ends = ranked.groupBy("_group").agg(at(0.25).alias("_q1"), at(0.75).alias("_q3"))
    wide = F.greatest(F.col("_q3") - F.col("_q1"), F.lit(least)) * reach
    return ends.select(
        "_group", (F.col("_q1") - wide).alias("low"), (F.col("_q3") + wide).alias("high")
    )


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most_bytes: int = 24 << 20) -> Model:
    """Model of the distinct texts of every language; it has as many n-grams as the texts have."""
    counts = written(count_grams(docs, text, lang))
    return Model(written(estimate(counts)), most_bytes)


def judge(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    fewest: int = 50,
    repeat_percent: int = 50,
    reach: float = 3.0,
    least: float = 0.1,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (id, lang, counts of BASE, bits, low, high, base_failed, kept), one per document.

    ``keep`` names further columns to return.

    ``bits`` are by the model of the distinct texts of the document's language (null is a language too), so
    that many copies of a text neither teach the model nor set the band. ``base_failed``: fewer than
    ``fewest`` words, or more than ``repeat_percent`` per cent of the words are repeated. ``kept``: the base
    rules hold and ``bits`` lie in the band of the language. The band is that of the distinct texts that pass the
    base rules. Null and empty texts, and texts without letters, are not kept. Copies and repeated rows
    are judged alike. No rows give no rows.
    """
    docs = docs.select(id_, lang, text, *keep)
    model = fit(docs, text, lang)
    measured = measure(docs.withColumn("_of_text", text_digest(text)), model, text, lang).withColumn(
        "base_failed",
        (F.col("n_words") < fewest)
        | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words")),
    )
    measured = written(measured)
    band = bands(measured, lang, reach, least)
    joined = measured.join(band, F.col(lang).eqNullSafe(F.col("_group")), "left").drop("_group", "_of_text")
    inside = F.col("bits").between(F.col("low"), F.col("high"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every document."""
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "bits", "low", "high")
