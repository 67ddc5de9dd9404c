"""Extra columns with any name that an operator uses inside: they come back unchanged, and results stay."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import mixing, quotation, shared, sharding, suffix_dedup
from tidegauge.llm.quotation import parse

#: Every quoted or backquoted word of these modules that may be a column.
NAMES = sorted(
    {
        x
        for module in (mixing, quotation, shared, sharding, suffix_dedup)
        for x in re.findall(r"[\"'`]([A-Za-z_][A-Za-z0-9_]*)[\"'`]", inspect.getsource(module))
    }
    | {"c", "t", "uc", "ut", "_c", "_t", "root", "_node", "_end", "_whole", "_rest", "_n", "_l0", "_l1", "_first", "_rows_before",
       "_part", "_row", "_tie", "_wide", "_before_here", "_text", "_further0", "_further1", "position", "before", "a`b", "a.b"}
)


def clashing(df, used):
    """``df`` with a column of every such name but ``used``, case apart, each with a value of its own per row."""
    taken, more = {c.lower() for c in (*df.columns, *used)}, {}
    for name in NAMES:
        if name.lower() not in taken:
            taken.add(name.lower())
            more[name] = F.concat(F.lit(name + ":"), F.coalesce(df[df.columns[0]].cast("string"), F.lit("")))
    return df.select("*", *[v.alias(k) for k, v in more.items()]), list(more)


def check(plain, full, df, names, added):
    """Same rows as without the further columns, and these have their row's values unless replaced."""
    kept = [c for c in names if c not in added]
    assert set(kept) <= set(full.columns)
    rows = [tuple(r) for r in full.select(*plain.columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in plain.collect())
    first = df.columns[0]
    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    for r in full.select(first, *quoted).collect():
        own = "" if r[0] is None else str(r[0])
        assert list(r)[1:] == [f"{c}:{own}" for c in kept]


@pytest.fixture
def docs(odd):
    return odd.select("doc_id", "text", "lang", "source").where("doc_id is not null")


def test_sharding(docs):
    sized = docs.select("doc_id", sharding.text_bytes(F.col("text")).alias("size"))
    more, names = clashing(sized, ())
    run = lambda df: sharding.shard_by_bytes(df, 3, ["doc_id", "size"])
    check(run(sized), run(more), sized, names, ("shard", "slot"))


def test_running(docs):
    sized = docs.select("doc_id", F.lit(2).alias("amount"), "lang")
    more, names = clashing(sized, ("total",))
    run = lambda df: shared.running(df, ["doc_id"], {"total": "amount"}, ["lang"])
    check(run(sized), run(more), sized, names, ("position", "total"))


def test_mixing(docs):
    tree = docs.withColumn("domain", mixing.domain())
    more, names = clashing(tree, ("epoch", "tokens"))
    run = lambda df: mixing.mix(df, ["domain", "lang", "source"], mixing.WEIGHTS)
    check(run(tree), run(more), tree, names, ("epoch", "tokens"))


def test_suffix_dedup(docs):
    more, names = clashing(docs, ())
    run = lambda df: suffix_dedup.remove_repeats(df, as_text=True)
    check(run(docs), run(more), docs, names, ("n_bytes", "kept", "spans"))


def test_quotation(spark):
    said = "the first words of a longer message here"
    rows = [(1, 0, "user", said), (1, 1, "bot", f"> {said}\nyes"), (2, 0, "user", f"> {said}\nno"), (3, 0, None, None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    more, names = clashing(messages, ())
    plain = quotation.link_quotations(messages)
    check(plain, quotation.link_quotations(more), messages, names, quotation.ADDED)
    assert plain.where("parent_conv = 1").count() == 2


def test_a_line_of_any_length_introduces_a_quotation():
    for line in ("On Monday A wrote:", "x" * 100_000 + " writes:  ", "é wrote:\r"):
        assert parse(f"before\n{line}\n> said") == ("before", [(1, ["said"])])
    for line in ("rewrote:", "wrote:", "On Monday A wrote", "A wrote: more"):
        assert parse(f"{line}\n> said") == (line, [(1, ["said"])])


def test_a_very_long_message(spark):
    words = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, 0, "u", words), (1, 1, "b", f"> {words}\nshort"), (1, 2, "u", "\n".join(f"> line {i}" for i in range(20_000)))]
    got = quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert [(r.turn, r.parent_turn, r.n_quotes) for r in sorted(got, key=lambda r: r.turn)] == [(0, None, 0), (1, 0, 1), (2, None, 1)]
