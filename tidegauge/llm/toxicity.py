"""Toxicity score learnt from confirmed toxic and unlabelled text, without any text known to be clean.

Non-negative positive-unlabelled learning: the risk on clean text is what the risk on unlabelled text has
over the share of toxic text, and is never taken below zero, where it would only reward overfitting.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import remembering, table

_WORD = re.compile(r"[^\W_]+")
#: Words whose weight a task remembers; beyond that it begins anew.
REMEMBERED = 1 << 19


class Model(NamedTuple):
    """Weights of word features and the offset: the logit of a text is the offset and its words' weights."""

    weights: dict[str, float]
    offset: float


def words(text: str | None) -> set[str]:
    """Distinct words in lower case: runs of letters and digits."""
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    """The word itself, its beginnings and its ends of three to six characters, marked apart."""
    n = len(word)
    out = ["=" + word]
    for k in range(3, min(6, n) + 1):
        out += ("<" + word[:k], word[n - k :] + ">")
    return out


class _Sparse:
    """Rows of column numbers, every entry one; products by counting."""

    def __init__(self, rows: Iterable[list[int]], columns: int):
        lengths, flat = [], []
        for r in rows:
            lengths.append(len(r))
            flat += r
        self.columns, self.rows = columns, len(lengths)
        self.column = np.array(flat, dtype=np.int32)
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x[self.column], self.rows)

    def back(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, x[self.row], self.columns)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the estimated risk under the logistic loss, and what to step against.

    The first part is that of toxic text, the second that of clean text, which is estimated from unlabelled text
    less the toxic share of it. While the second is not negative the steps are the gradient of their sum;
    else they undo the second part alone.
    """
    p_on, u_on = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (positive, unlabelled))
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    toxic = prior * np.logaddexp(0, -positive).sum() / n_p
    clean = np.logaddexp(0, unlabelled).sum() / n_u - prior * np.logaddexp(0, positive).sum() / n_p
    if clean >= 0:
        return toxic, clean, prior * (p_on - 1) / n_p - prior * p_on / n_p, u_on / n_u
    return toxic, clean, prior * p_on / n_p, -u_on / n_u


def train(
    positive: list[str | None],
    unlabelled: list[str | None],
    prior: float,
    steps: int = 400,
    rate: float = 0.05,
    sparse: float = 1e-4,
    least: int = 3,
    lift: float = 2.0,
) -> Model:
    """A linear model over word features, by proximal Adam on the corrected risk.

    Weights are not negative and ``sparse`` draws them to zero: a few toxic words are not made up for by a long
    text around them, and the many words of a long clean text add up to nothing. Only features that occur clearly more
    often in toxic text than ``lift`` times their share of unlabelled text, and ``least`` times at least, can get a
    weight. ``prior`` is the share of toxic text.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model({}, start)
    n = len(positive)
    number: dict[str, int] = {}
    docs = [
        np.array([number.setdefault(w, len(number)) for w in sorted(words(t))], dtype=np.int32)
        for t in (*positive, *unlabelled)
    ]
    held = [np.bincount(np.concatenate(part), minlength=len(number)) for part in (docs[:n], docs[n:])]
    often: Counter = Counter()
    for w, k in zip(number, held[0].tolist()):
        if k:
            for f in features(w):
                often[f] += k
    often = {f: k for f, k in often.items() if k >= least}
    usual = dict.fromkeys(often, 0)
    for w, k in zip(number, held[1].tolist()):
        if k:
            for f in features(w):
                if f in usual:
                    usual[f] += k
    share = n / len(unlabelled)  # times that is what toxic text would have of a feature that says nothing
    names = sorted(
        f for f, k in often.items() if k >= least + lift * usual[f] * share + 2 * (usual[f] * share) ** 0.5
    )
    if not names:
        return Model({}, start)
    column = {f: i for i, f in enumerate(names)}
    place, word_features = np.full(len(number), -1, dtype=np.int32), []
    for w, i in number.items():
        mine = [column[f] for f in features(w) if f in column]
        if mine:
            place[i] = len(word_features)
            word_features.append(mine)
    by_word = _Sparse(word_features, len(names))
    places = (place[own] for own in docs)
    by_doc = _Sparse((own[own >= 0].tolist() for own in places), len(word_features))
    theta, offset = np.zeros(len(names)), start
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        logit = by_doc.times(by_word.times(theta)) + offset
        _, _, on_p, on_u = risk(logit[:n], logit[n:], prior)
        r = np.concatenate([on_p, on_u])
        g = np.append(by_word.back(by_doc.back(r)), r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        size = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        move = size * m / (1 - 0.9**step)
        theta = np.maximum(theta - move[:-1] - size[:-1] * sparse, 0)
        offset -= move[-1]
    return Model({names[i]: float(theta[i]) for i in np.flatnonzero(theta)}, float(offset))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    learn: Column | None = None,
    prior: float | None = None,
    positive: int = 2500,
    unlabelled: int = 7500,
    most_bytes: int = 30_000,
    seed: int = 11,
    **how: float,
) -> Model:
    """Train on bounded samples: confirmed toxic documents and documents without regard to any label.

    About ``positive`` ids labelled 1 and about ``unlabelled`` ids of all documents are drawn by a hash of
    the id, one text per id, of 1 to ``most_bytes`` bytes; these parameters bound what reaches the driver.
    ``learn`` selects the rows, of labels and of unlabelled documents, that may be used. ``prior`` is the share of
    toxic documents; unless given, it is that of the labelled rows that may be used. Labels other than 1
    serve for that share only. Ids labelled twice count by their lowest label. Without toxic
    labels the score of every text is 0.0001.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_).alias("_id"), F.col(label).alias("_toxic"))
    texts = docs.select(F.col(id_).alias("_id"), F.col(text).alias("_text"))
    may = (lambda df: df) if learn is None else (lambda df: df.withColumnRenamed("_id", id_).where(learn).withColumnRenamed(id_, "_id"))
    known, texts = may(known), may(texts)
    known = known.groupBy("_id").agg(F.min("_toxic").alias("_toxic"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("_toxic")).first()
    toxic = int(toxic or 0)
    share = prior if prior is not None else (toxic / total if total else 0.0)
    if not toxic:
        return Model({}, float(np.log(1e-4 / (1 - 1e-4))))
    n = texts.count()
    place = F.xxhash64(F.lit(seed), "_id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    fit_to = F.octet_length("_text").between(1, most_bytes)

    def sample(df: DataFrame) -> list[str]:
        one = df.groupBy("_id").agg(F.min("_text").alias("_text")).toPandas()
        return sorted(one["_text"])

    drawn = known.where(F.col("_toxic") == 1).where(place < min(1.0, positive / toxic)).select("_id")
    bad = sample(texts.where(fit_to).join(F.broadcast(drawn), "_id"))  # bounded by the parameter
    rest = sample(texts.where(fit_to & (place < min(1.0, unlabelled / max(1, n)))))
    return train(bad, rest, share, **how)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace the text by ``score``, the estimated chance (0 to 1) that a document is toxic.

    Whole texts are read. Null and empty texts, and those without known features, have the offset's score.
    Rows keep their other columns; a column called score is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, offset = shared.value
        get = weights.get
        known: dict[str, float] = {}
        with remembering():
            for batch in batches:
                out = np.empty(len(batch))
                for i, t in enumerate(batch[text]):
                    z = offset
                    for w in words(t):
                        s = known.get(w)
                        if s is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            s = known[w] = sum(get(f, 0.0) for f in features(w))
                        z += s
                    out[i] = z
                yield batch[kept].assign(score=1 / (1 + np.exp(-np.clip(out, -40, 40))))
            known.clear()

    schema = docs.select(*kept).schema.add("score", "double")
    return docs.select(*kept, text).mapInPandas(run, schema)


def held_out(id_: str = "doc_id") -> Column:
    """One document of five: the crc32 of its id as text is divisible by 5. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
