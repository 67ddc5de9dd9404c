"""Quality score from compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table


class Classifier(NamedTuple):
    """Pairs of dictionaries (good, bad) and the calibration of the size difference."""

    good: list[bytes]
    bad: list[bytes]
    level: int
    limit: float
    slope: float
    offset: float


class _Sizes:
    """Compressors of a classifier in one worker."""

    def __init__(self, model: Classifier):
        import zstandard

        def compressor(content: bytes):
            if not content:
                return zstandard.ZstdCompressor(level=model.level)
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=model.level)
            return zstandard.ZstdCompressor(level=model.level, dict_data=d)

        self.pairs = [(compressor(g), compressor(b)) for g, b in zip(model.good, model.bad)]

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionaries save over the bad ones, by the root of the length."""
        data = (text or "").encode()
        saved = sum(len(b.compress(data)) - len(g.compress(data)) for g, b in self.pairs)
        return saved / max(1, len(self.pairs)) / (len(data) + 1) ** 0.5


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to choose from: take it as it is
        return b"".join(texts)[-size:]


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, the slope not negative."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    features = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = (features * (p * (1 - p))[:, None]).T @ features + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, features.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn: Column | None = None,
    per_class: int = 3600,
    calibrate: int = 4000,
    most_bytes: int = 30_000,
    pairs: int = 3,
    dictionary_bytes: int = 49_152,
    level: int = 3,
    seed: int = 7,
) -> Classifier:
    """Build dictionaries and a calibration from a bounded sample of labelled documents.

    The sample is drawn by a hash of the id: about ``per_class`` documents of each class for the
    dictionaries, in ``pairs`` disjoint parts, and about ``calibrate`` other ones for the logistic
    curve; texts of 1 to ``most_bytes`` bytes only, one per id. These parameters bound what reaches the driver.
    ``learn`` selects the labelled rows that may be used at all. Rows without label or text are not used.
    Without labels, or with one class, the score is the share of good documents (0.5 if none).
    """
    usable = labels.where(F.col(label).isin(0, 1)).select(F.col(id_), F.col(label).alias("_label"))
    if learn is not None:
        usable = usable.where(learn)
    usable = usable.groupBy(id_).agg(F.min("_label").alias("_label"))
    n = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    total = sum(n.values())
    if len(n) < 2:
        share = n.get(1, 0) / total if total else 0.5
        return Classifier([], [], level, 1.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    # A share of the hash range for the calibration, then one for each class's dictionaries.
    place = (F.xxhash64(F.lit(seed), id_).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    tuned = min(0.4, calibrate / total)
    own = F.lit(tuned)
    for value, count in n.items():
        own = F.when(F.col("_label") == value, tuned + min(1 - tuned, per_class / count)).otherwise(own)
    drawn = usable.withColumn("_place", place).where(F.col("_place") < own)
    bytes_ = F.octet_length(text)
    drawn = F.broadcast(drawn)  # bounded by the parameters
    sample = (
        docs.where(bytes_.between(1, most_bytes)).select(F.col(id_), F.col(text).alias("_text")).join(drawn, id_)
        .groupBy(id_, "_label", "_place")
        .agg(F.min("_text").alias("_text"))  # an id may stand in very many rows
        .toPandas()
        .sort_values(["_place", id_, "_text"])
    )
    tune = sample[sample["_place"] < tuned]
    rest = sample[sample["_place"] >= tuned]
    parts = {}
    for value in (0, 1):
        texts = [x.encode() for x in rest.loc[rest["_label"] == value, "_text"]]
        parts[value] = [_dictionary(texts[k::pairs], dictionary_bytes) for k in range(pairs)]
    model = Classifier(parts[1], parts[0], level, 1.0, 0.0, 0.0)
    sizes = _Sizes(model)
    x = np.array([sizes.difference(t) for t in tune["_text"]])
    y = tune["_label"].to_numpy(dtype=float)
    if not len(x) or y.min() == y.max():
        return model._replace(offset=float(np.log((n[1] + 1) / (n[0] + 1))))
    # Copies of dictionary text are far out; they say no more than other clear cases.
    limit = float(np.quantile(np.abs(x), 0.9)) or 1.0
    slope, offset = _platt(np.clip(x, -limit, limit) / limit, y)
    return model._replace(limit=limit, slope=slope, offset=offset)


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Replace the text by ``score``, the calibrated chance (0 to 1) that a document is good.

    Whole texts are compressed. Null and empty texts have no difference in size: their score is the
    curve's middle. Rows keep their other columns; a column called score is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        sizes = _Sizes(m)
        for batch in batches:
            x = np.array([sizes.difference(t) for t in batch[text]], dtype=float)
            z = m.slope * np.clip(x, -m.limit, m.limit) / m.limit + m.offset
            yield batch[kept].assign(score=1 / (1 + np.exp(-z)))

    schema = docs.select(*kept).schema.add("score", "double")
    return docs.select(*kept, text).mapInPandas(run, schema)


def held_out(id_: str = "doc_id") -> Column:
    """One document of five: the crc32 of its id as text is divisible by 5. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_compression_quality(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
