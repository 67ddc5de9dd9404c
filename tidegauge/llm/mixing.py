"""Token budgets down a tree of sources, and seeded epochs of documents (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import carried, table, written

WHITE = r"[\x20\x09-\x0D]+"
#: Hex digits of an order key by which a bucket is divided into smaller ones, of the 32 that a key has.
DIGITS = 3
#: Documents of a bucket that are looked at one by one.
FEW = 1 << 16


def words(text: Column) -> Column:
    """Number of words, runs without ASCII white space; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WHITE)
    return F.size(F.filter(parts, lambda x: x != "")).cast("long")


def order_key(seed: int, epoch: Column, id_: str) -> Column:
    """Hex string that puts the documents of an epoch into a seeded order; a function of the id."""
    return F.md5(
        F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_).cast("string"), F.lit("")))
    )


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def share_out(nodes: DataFrame, parent: list[str], name: list[str]) -> DataFrame:
    """Add ``budget``: the parents' ``given`` shared out among siblings by ``weight``, up to ``room``.

    A child with less room than its share keeps its room; what it lacks goes to its siblings by their
    weights, and so on. In order of room by weight, a child is full if its room is at most the share it
    has of what the fuller ones before it leave. Integer arithmetic; shares are rounded down.
    """
    by = Window.partitionBy(*parent).orderBy("_fill", *name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parent)
    ordered = nodes.withColumn("_fill", F.expr("cast(room as decimal(38,0)) * 1000000 div weight"))
    tested = ordered.withColumn(
        "_full",
        _wide("room") * F.sum("weight").over(rest)
        <= (F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0))) * _wide("weight"),
    )
    shared = tested.withColumns(
        {
            "_kept": F.coalesce(F.sum(F.when(F.col("_full"), F.col("room"))).over(all_), F.lit(0)),
            "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(all_),
        }
    )
    share = F.expr("cast(given - _kept as decimal(20,0)) * cast(weight as decimal(18,0)) div _open")
    return shared.withColumn(
        "budget", F.when(F.col("_full"), F.col("room")).otherwise(F.least(share, F.col("room"))).cast("long")
    ).drop("_fill", "_full", "_kept", "_open")


def budgets(
    leaves: DataFrame,
    levels: list[str],
    weights: Mapping[tuple, int],
    budget: int,
    epochs: int,
    default: int = 1,
) -> DataFrame:
    """Add ``budget`` to the leaves of a tree with ``available`` tokens each.

    ``weights`` maps a path of values from the top to a node's weight among its siblings, an integer
    from 0; other nodes have ``default``. A subtree has room for ``epochs`` times its tokens, none
    below a weight of 0. Shares go from the top down and never exceed a subtree's room: a shortage
    is made good by siblings first, by the ancestors' siblings when a whole subtree is short.
    """
    keys = [f"_k{i}" for i in range(len(levels))]
    # Null becomes a value of its own, so that plain equality joins nodes.
    path = lambda v: "" if v is None else f"={v}"
    tree = leaves.withColumns(
        {k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(keys, levels)}
    ).withColumn("room", F.col("available") * F.lit(epochs))
    for depth in range(1, len(levels) + 1):
        listed = [(*map(path, p), int(w)) for p, w in weights.items() if len(p) == depth]
        schema = ", ".join(f"{k} string" for k in keys[:depth]) + f", _w{depth} long"
        given = leaves.sparkSession.createDataFrame(listed, schema)
        tree = tree.join(F.broadcast(given), keys[:depth], "left")  # the caller's list
        tree = tree.withColumn(f"_w{depth}", F.coalesce(F.col(f"_w{depth}"), F.lit(default)))
        tree = tree.withColumn("room", F.when(F.col(f"_w{depth}") > 0, F.col("room")).otherwise(0))
    tree = written(tree)
    level, top = None, min(budget, tree.agg(F.sum("room")).first()[0] or 0)
    for depth in range(1, len(levels) + 1):
        own, parent = keys[:depth], keys[: depth - 1]
        nodes = tree.groupBy(*own).agg(
            F.sum("room").alias("room"), F.greatest(F.first(f"_w{depth}"), F.lit(1)).alias("weight")
        )
        if parent:
            nodes = nodes.join(level.select(*parent, F.col("budget").alias("given")), parent)
        else:
            nodes = nodes.withColumn("given", F.lit(top).cast("long"))
        level = share_out(nodes, parent, own).select(*own, "budget")
    return tree.join(level, keys).select(*leaves.columns, "budget")


def mix(
    docs: DataFrame,
    levels: list[str],
    weights: Mapping[tuple, int],
    budget: int | None = None,
    id_: str = "doc_id",
    tokens: Column | None = None,
    epochs: int = 2,
    seed: int = 1,
    default: int = 1,
) -> DataFrame:
    """Draw ``docs`` to a budget of tokens by target weights of a tree of sources.

    ``levels`` are columns from the top of the tree to its leaves, e.g. domain, language, source; null
    is a value of its own. ``budgets`` says how the budget (all tokens by default) gets to the leaves.
    A leaf is drawn in epochs, each in an order of its own that ``seed`` and the ids decide. The epochs that
    its budget pays for in full are taken whole; of the next one a prefix, of whole documents, that keeps the
    budget. Adds ``epoch`` (int, from 0) and ``tokens`` (long, words of ``text`` by default).

    Rows of one id go together (null ids are one id). Documents without tokens are drawn as others are.
    Columns with the names added are replaced. No rows give no rows.

    The prefix of a hot leaf is found without sorting it: tokens are summed per bucket of the order. The bucket
    in which the budget ends is divided again and again, until it has few documents, and then looked at by
    document.
    """
    tokens = words(F.col("text")) if tokens is None else tokens
    docs = docs.drop("epoch", "tokens").withColumn("tokens", tokens)
    return carried(
        docs,
        [*levels, id_, "tokens"],
        ["epoch"],
        lambda rows: _mixed(rows, levels, weights, budget, id_, epochs, seed, default),
    )


def _mixed(
    docs: DataFrame,
    levels: list[str],
    weights: Mapping[tuple, int],
    budget: int | None,
    id_: str,
    epochs: int,
    seed: int,
    default: int,
) -> DataFrame:
    narrow = written(docs.select(F.col(id_).alias("_id"), *levels, "tokens"))
    leaves = narrow.groupBy(*levels).agg(F.sum("tokens").alias("available"))
    if budget is None:
        budget = leaves.agg(F.sum("available")).first()[0] or 0
    planned = budgets(leaves, levels, weights, budget, epochs, default)
    keys = [f"_l{i}" for i in range(len(levels))]
    name = {k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(keys, levels)}
    plan = planned.withColumns(name).select(
        *keys,
        F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0).alias("_whole"),
        F.when(F.col("available") > 0, F.expr("budget % available")).otherwise(0).alias("_rest"),
    )
    # Written, so that Spark knows how small it is and does not shuffle texts to join it.
    plan = written(plan)
    keyed = narrow.withColumns(name).join(plan, keys).withColumn("_key", order_key(seed, F.col("_whole"), "_id"))
    keyed = keyed.select(*keys, "_rest", "tokens", "_key")
    upto = Window.partitionBy(*keys).orderBy("_bucket")  # 16 ** DIGITS buckets a leaf at most
    last, digits = None, 0
    while True:
        digits += DIGITS
        inside = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
        if last is None:
            inside = inside.withColumn("_begin", F.lit(0).cast("long"))
        else:
            above = last.select(*keys, F.col("_bucket").alias("_above"), F.col("_before").alias("_begin"))
            inside = inside.withColumn("_above", F.substring("_key", 1, digits - DIGITS)).join(above, [*keys, "_above"])
        sums = inside.groupBy(*keys, "_bucket").agg(
            F.sum("tokens").alias("_sum"),
            F.count(F.lit(1)).alias("_many"),
            F.first("_rest").alias("_rest"),
            F.first("_begin").alias("_begin"),
        )
        sums = sums.withColumn("_before", F.col("_begin") + F.sum("_sum").over(upto) - F.col("_sum"))
        # The first bucket that does not fit in whole.
        last = written(
            sums.where(F.col("_before") + F.col("_sum") > F.col("_rest"))
            .groupBy(*keys)
            .agg(F.min(F.struct("_bucket", "_before", "_many")).alias("_b"))
            .select(*keys, "_b.*")
        )
        if digits >= 30 or (last.agg(F.max("_many")).first()[0] or 0) <= FEW:
            break
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    one = keyed.join(last, [*keys, "_bucket"]).groupBy(*keys, "_key", "_rest", "_before").agg(F.sum("tokens").alias("_t"))
    by = Window.partitionBy(*keys).orderBy("_key")
    one = one.withColumn("_upto", F.col("_before") + F.sum("_t").over(by))
    fits = one.where(F.col("_upto") <= F.col("_rest")).groupBy(*keys).agg(F.max("_key").alias("_end"))
    ends = last.join(fits, keys, "left").select(*keys, F.coalesce("_end", "_bucket").alias("_end"))
    # A leaf without such a bucket fits in whole; "g" sorts behind all hex digits.
    ends = written(plan.join(ends, keys, "left").withColumn("_end", F.coalesce("_end", F.lit("g"))))
    in_prefix = (order_key(seed, F.col("_whole"), id_) <= F.col("_end")) & (
        (F.col("_rest") > 0) | (F.col("_whole") == 0)
    )
    drawn = docs.withColumns(name).join(ends, keys)
    drawn = drawn.withColumn("_n", F.col("_whole") + F.when(in_prefix, 1).otherwise(0)).where("_n > 0")
    return drawn.select(
        *[c for c in docs.columns if c != "tokens"],
        F.explode(F.expr("sequence(0, cast(_n as int) - 1)")).alias("epoch"),
        "tokens",
    )


def domain(source: str = "source") -> Column:
    """Domain of a source: the last digit of its name by four; sources without one are apart."""
    digit = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9])$", 1)
    return F.when(digit == "", "other").otherwise(
        F.concat(F.lit("domain"), (digit.try_cast("int") % 4).cast("string"))
    )


#: Target weights: domains, languages in any domain's list of its own, and one source.
DOMAINS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGES = {"en": 5, "de": 2, "fr": 2, "es": 1}
WEIGHTS: dict[tuple, int] = {
    **{(d,): w for d, w in DOMAINS.items()},
    **{(d, lang): w for d in DOMAINS for lang, w in LANGUAGES.items()},
    **{("domain0", lang, "src0"): 2 for lang in LANGUAGES},
}


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Documents drawn to as many tokens as there are, by the target weights, in up to two epochs."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain())
    drawn = mix(docs, ["domain", "lang", "source"], WEIGHTS)
    return drawn.select("doc_id", "domain", "lang", "source", "epoch", "tokens")


def _share_sql(name: str, nodes: str, parent: list[str], own: list[str]) -> str:
    """The SQL of ``share_out``."""
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    return f"""
{name}_t AS (
    SELECT *, room::HUGEINT * sum(weight) OVER (
            {part} ORDER BY room::HUGEINT * 1000000 // weight, {', '.join(own)}
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= (given - coalesce(sum(room) OVER (
            {part} ORDER BY room::HUGEINT * 1000000 // weight, {', '.join(own)}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight::HUGEINT AS is_full
    FROM ({nodes})
), {name} AS (
    SELECT {', '.join(own)}, CASE WHEN is_full THEN room ELSE least(room,
        (given - coalesce(sum(room) FILTER (is_full) OVER ({part}), 0)) * weight
        // sum(weight) FILTER (NOT is_full) OVER ({part})) END::BIGINT AS budget
    FROM {name}_t
)"""


def _case(column: str, weights: Mapping[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


OP7_SQL = f"""
WITH docs AS (
    SELECT doc_id, lang, source,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS tokens,
        CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]$')
            THEN 'domain' || (right(source, 1)::INT % 4) ELSE 'other' END AS domain
    FROM documents
), leaves AS (
    SELECT domain, lang, source, sum(tokens)::BIGINT AS available, 2 * sum(tokens)::BIGINT AS room
    FROM docs GROUP BY ALL
), root AS (
    SELECT least(sum(available), sum(room))::BIGINT AS given FROM leaves
),{_share_sql("a", f"SELECT domain, room, given, {_case('domain', DOMAINS)} AS weight FROM (SELECT domain, sum(room)::BIGINT AS room FROM leaves GROUP BY ALL), root", [], ["domain"])},
{_share_sql("b", f"SELECT n.domain, lang, room, a.budget AS given, CASE WHEN n.domain <> 'other' THEN {_case('lang', LANGUAGES)} ELSE 1 END AS weight FROM (SELECT domain, lang, sum(room)::BIGINT AS room FROM leaves GROUP BY ALL) n JOIN a ON n.domain = a.domain", ["domain"], ["domain", "lang"])},
{_share_sql("c", f"SELECT n.domain, n.lang, source, available, room, b.budget AS given, CASE WHEN source = 'src0' AND n.lang IN ({', '.join(repr(x) for x in LANGUAGES)}) THEN 2 ELSE 1 END AS weight FROM leaves n JOIN b ON n.domain = b.domain AND n.lang IS NOT DISTINCT FROM b.lang", ["domain", "lang"], ["domain", "lang", "source"])},
plan AS (
    SELECT l.domain, l.lang, l.source,
        CASE WHEN available > 0 THEN budget // available ELSE 0 END AS n_whole,
        CASE WHEN available > 0 THEN budget % available ELSE 0 END AS rest
    FROM leaves l JOIN c ON l.domain = c.domain AND l.lang IS NOT DISTINCT FROM c.lang
        AND l.source IS NOT DISTINCT FROM c.source
), keyed AS (
    SELECT d.*, n_whole, rest, md5('1:' || n_whole || ':' || coalesce(doc_id::VARCHAR, '')) AS k
    FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang
        AND d.source IS NOT DISTINCT FROM p.source
), summed AS (
    SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM keyed
), counted AS (
    SELECT *, n_whole + CASE WHEN upto <= rest AND (rest > 0 OR n_whole = 0) THEN 1 ELSE 0 END AS n FROM summed
)
SELECT doc_id, domain, lang, source, e::INT AS epoch, tokens
FROM counted, unnest(range(n::BIGINT)) AS t(e)
"""
