"""Conversations in reply order from messages that quote each other."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, components, running, table, written

_MARK = re.compile(r"[ \t]*>(?:[ \t]?>)*[ \t]?")
_WROTE = re.compile(r"(?<!\w)(?:wrote|writes):\s*\Z")


def normalised(passage: str) -> str:
    """Lower case, runs of white space as one space: quoting re-wraps lines."""
    return " ".join(passage.lower().split())


def digest(passage: str) -> bytes:
    return hashlib.blake2b(passage.encode(), digest_size=16).digest()


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """(what the message says itself, its quoted passages as (level, lines)).

    A quoted line starts with one ``>`` per level, spaces allowed between. A passage is a run of lines of
    one level. A line that ends in "wrote:" or "writes:" right before a quotation introduces it and is dropped.
    """
    lines = (text or "").split("\n")
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    last = 0
    for line in lines:
        mark = _MARK.match(line)
        level = mark.group().count(">") if mark else 0
        if not level:
            own.append(line)
        else:
            if not last:
                while own and not own[-1].strip():
                    own.pop()
                if own and (found := _WROTE.search(own[-1], max(0, len(own[-1].rstrip()) - 8))) and found.start():
                    own.pop()
            if level == last:
                quotes[-1][1].append(line[mark.end() :])
            else:
                quotes.append((level, [line[mark.end() :]]))
        last = level
    return "\n".join(own).strip(), quotes


def passages(body: str) -> set[str]:
    """What others may quote of a message: all of it, its paragraphs, its lines; normalised."""
    units = {body, *re.split(r"\n\s*\n", body), *body.split("\n")}
    return {n for u in units if (n := normalised(u))}


def _parsed(rows: DataFrame, text: str, conv: str, turn: str) -> DataFrame:
    """Per row: body, n_quotes, the digests of what it says and of what it quotes.

    Quotes: (kind, level, number, digest, characters), kind 0 for a whole passage, 1 for a paragraph of it
    (blank lines of its level part them), 2 for a line.
    """
    kept = [c for c in rows.columns if c not in ("body", "n_quotes", "_own", "_quoted")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies, counts, own, quoted = [], [], [], []
            for value in batch[text]:
                body, quotes = parse(value)
                found = []
                for number, (level, lines) in enumerate(quotes):
                    run_ = "\n".join(lines)
                    units = [(0, normalised(run_))]
                    if len(lines) > 1:
                        units += [(1, n) for x in re.split(r"\n\s*\n", run_) if (n := normalised(x)) != units[0][1]]
                        units += [(2, normalised(x)) for x in lines]
                    found += [
                        {"kind": k, "level": level, "number": number, "digest": digest(n), "chars": len(n)}
                        for k, n in units
                        if n
                    ]
                bodies.append(body)
                counts.append(len(quotes))
                own.append([digest(n) for n in passages(body)])
                quoted.append(found)
            yield batch[kept].assign(body=bodies, n_quotes=counts, _own=own, _quoted=quoted)

    schema = rows.select(*kept)._jdf.schema().toDDL()
    added = "body string, n_quotes int, _own array<binary>, _quoted array<struct<kind int, level int, number int, digest binary, chars int>>"
    return rows.select(*kept).mapInPandas(run, f"{schema}, {added}")


ADDED = ("body", "n_quotes", "parent_conv", "parent_turn", "depth", "root_conv", "root_turn", "thread_id", "position")


def link_quotations(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    least_chars: int = 20,
    rounds: int = 64,
) -> DataFrame:
    """Messages without their quotations, linked to what they quote and in reply order.

    Messages are ordered by (conversation, turn). The original of a quoted passage is the first
    message before the quoting one that says it itself (as its whole, a paragraph or a line; compared
    in lower case with white space as one space): of the same conversation if there is one, else of any
    conversation before, if the passage has ``least_chars`` characters or more. A message replies to
    the original of one of its passages: whole passages before paragraphs before lines, the same conversation
    before others, low levels before deep ones, the first passage first.

    Adds ``body`` (without quotations), ``n_quotes``, ``parent_conv`` and ``parent_turn`` (null if nothing
    is linked), ``depth`` (replies above it), ``root_conv`` and ``root_turn`` (where the replies above it
    start), ``thread_id`` (the smallest conversation that links connect to its own) and ``position`` in the
    thread from 0: threads are ordered by root, then message, so replies follow what they reply to.

    Null and empty texts say nothing. Rows with a null conversation or turn quote and are quoted by nothing,
    and their thread is their conversation. Repeated rows and rows of equal keys are one message in
    links, and come one after another. Columns with the names added are replaced. No rows give no rows.
    """
    return carried(
        messages, [conv, turn, text], ADDED, lambda rows: _linked(rows, conv, turn, text, least_chars, rounds)
    )


def _linked(messages: DataFrame, conv: str, turn: str, text: str, least_chars: int, rounds: int) -> DataFrame:
    kept = [c for c in messages.columns if c != text]
    parsed = written(_parsed(messages.select(*kept, text), text, conv, turn).drop(text))
    keyed = parsed.where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    key = F.struct(F.col(conv).alias("c"), F.col(turn).alias("t"))
    said = keyed.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.explode("_own").alias("digest"))
    quoted = keyed.select(key.alias("m"), F.explode("_quoted").alias("q")).select(
        "m", F.col("m.c").alias("c"), "q.*"
    )
    # One row per passage: the first message that has it, in each conversation and in all.
    in_conv = said.groupBy("c", "digest").agg(F.min("t").alias("near"))
    in_all = in_conv.groupBy("digest").agg(F.min(F.struct("c", F.col("near").alias("t"))).alias("far"))
    found = (
        quoted.join(in_conv, ["c", "digest"], "left")
        .join(in_all, "digest", "left")
        .withColumn("near", F.when(F.col("near") < F.col("m.t"), F.col("near")))
        .withColumn(
            "far",
            F.when((F.col("far.c") < F.col("c")) & (F.col("chars") >= least_chars), F.col("far")),
        )
        .withColumn(
            "original",
            F.when(F.col("near").isNotNull(), F.struct("c", F.col("near").alias("t"))).otherwise(F.col("far")),
        )
        .where("original is not null")
    )
    far_off = F.col("near").isNull().cast("int")
    best = F.min(F.struct("kind", far_off.alias("far_off"), "level", "number", "digest", "original"))
    links = written(found.groupBy("m").agg(best.alias("b")).select("m", F.col("b.original").alias("p")))

    # Where the replies above start: each round doubles the reach of every link.
    reach = links.select("m", F.col("p").alias("up"), F.lit(1).alias("depth"))
    for _ in range(rounds):
        above = reach.select(F.col("m").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = written(reach.join(above, "up", "left"))
        reach = joined.select(
            "m", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        if not joined.where("next is not null").limit(1).count():
            break
    else:
        raise RuntimeError(f"replies are deeper than 2 ** {rounds}")
    placed = links.join(reach, "m").select(
        F.col("m.c").alias("_c"), F.col("m.t").alias("_t"), "p.c", "p.t", F.col("up.c").alias("uc"),
        F.col("up.t").alias("ut"), "depth",
    )
    across = links.select(F.col("m.c").alias("a"), F.col("p.c").alias("b"))
    threads = components(across).select(F.col("node").alias("_node"), "root")
    rows = (
        parsed.drop("_own", "_quoted")
        .join(placed, (F.col(conv) == F.col("_c")) & (F.col(turn) == F.col("_t")), "left")
        .join(threads, F.col(conv) == F.col("_node"), "left")
        .select(
            *kept, "body", "n_quotes", F.col("c").alias("parent_conv"), F.col("t").alias("parent_turn"),
            F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("uc", conv).alias("root_conv"),
            F.coalesce("ut", turn).alias("root_turn"), F.coalesce("root", conv).alias("thread_id"),
        )
    )
    return running(rows, ["root_conv", "root_turn", conv, turn], {}, ["thread_id"])


def chat_line(role: str = "role", body: str = "body"):
    """A message in chat markup: its role, its text, an end mark."""
    return F.concat(
        F.lit("<|"), F.coalesce(F.col(role), F.lit("unknown")), F.lit("|>\n"), F.col(body), F.lit("<|end|>\n")
    )


def op10_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """All messages without quotations, in reply order in their threads, in chat markup."""
    linked = link_quotations(table(spark, sf_dir, "conversations"))
    return linked.withColumn("chat", chat_line()).drop("body")
