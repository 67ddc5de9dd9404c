"""Documents to token ids: rules, near-duplicates, repeated passages, source mix, encoding.

Every stage works on all that the one before kept, and returns the columns of ``documents`` but for the
last. Each is written as Parquet and read again before the next. Documents are told apart by their id
and their text, so nulls and repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.mixing import WEIGHTS, domain, mix
from tidegauge.llm.quality_rules import judge
from tidegauge.llm.sentencepiece_codec import default_model, encode_texts
from tidegauge.llm.shared import same, table, written
from tidegauge.llm.simhash import near_duplicates
from tidegauge.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = ["doc_id", "_print"]


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with further columns out of the way of the names that operators add."""
    more = [c for c in docs.columns if c not in COLUMNS]
    names = [F.col(f"`{c}`").alias(f"_further{i}") for i, c in enumerate(more)]
    return docs.select(*COLUMNS, *names, F.xxhash64("text").alias("_print"))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    more = [c for c in docs.columns if c not in COLUMNS]
    names = {c: f"_further{i}" for i, c in enumerate(more)}
    return rows.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word and repetition rules and the perplexity band of their language keep.

    Null, empty and short texts go. Repeated rows stay or go together.
    """
    keyed = _named(docs)
    good = judge(keyed, keep=("_print",)).where("kept").select(*KEY).distinct()
    return _back(keyed.join(good, same(keyed, good, KEY), "left_semi"), docs)


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Of repeated rows one stays. A null id only stays if its group has no other.
    """
    keyed = _named(docs)
    found = written(near_duplicates(keyed, keep=("_print",)))
    # Groups without an id are told apart by their fingerprint.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint"))]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *KEY)).alias("first")
    stay = found.groupBy(*group).agg(first).select("first.doc_id", "first._print")
    one = keyed.join(stay, same(keyed, stay, KEY), "left_semi").dropDuplicates(KEY)
    return _back(one, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller id has; ``n_chars`` follows.

    Documents stay, also when nothing is left of their texts. A null text becomes an empty one.
    """
    cut = remove_repeats(_named(docs), as_text=True).withColumn("text", F.col("kept"))
    return _back(cut.withColumn("n_chars", F.length("text").cast("long")), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their domains, languages and sources.

    As many tokens as there are, in up to two epochs: a document may stand twice or not at all.
    """
    tree = ["domain", "lang", "source"]
    return _back(mix(_named(docs).withColumn("domain", domain()), tree, WEIGHTS), docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, the end id last, and whether they decode to the text again.

    A null text counts as empty.
    """
    coded = encode_texts(docs.select(*COLUMNS), default_model())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("source mixing", source_mixing),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: SQL has no XXH64, no merge-type encoding and no such model: the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
