from pyspark.sql import functions as F

from tidegauge.llm.quotation import link_quotations, normalised, op10_quotation_linking, parse, passages

SCHEMA = "conv_id long, turn int, role string, text string"
LONG = "A sentence that is long enough to be known anywhere."
MESSAGES = [
    (1, 0, "user", "What is a tide gauge?\nPlease explain.\n\n" + LONG),
    (1, 1, "assistant", "On Monday someone wrote:\n> What is a  TIDE\n> gauge?\n\nIt measures the sea."),
    (1, 2, "user", "> > Please explain.\n>\n> It measures the sea.\n\nThanks!"),
    (1, 3, "user", ">>> nothing known\n> Thanks!\nok"),
    (2, 0, "user", "> " + LONG + "\nI agree."),
    (2, 1, "assistant", "> It measures the sea.\ntoo short to leave its conversation, and\n> I agree.\nfine"),
    (3, 0, "user", "> " + LONG + "\n> I agree.\nTwo lines of two messages"),
    (3, 1, "user", "> Two lines of two messages\n"),
    (4, 0, None, None),
    (4, 0, None, None),
    (4, 1, "user", ""),
    (5, 0, "user", "> quoted before it was said"),
    (5, 1, "user", "quoted before it was said"),
    (None, 0, "user", "> " + LONG),
    (6, None, "user", "What is a tide gauge?"),
]


def plain(messages, least_chars=20):
    """Links and order by looking through all earlier messages."""
    keyed = sorted({(c, t): x for c, t, _, x in messages if c is not None and t is not None}.items())
    said = {k: passages(parse(x)[0]) for k, x in keyed}
    parent = {}
    for k, x in keyed:
        options = []
        for number, (level, lines) in enumerate(parse(x)[1]):
            units = [(0, normalised("\n".join(lines)))]
            units += [(1, normalised(y)) for y in lines] if len(lines) > 1 else []
            for kind, unit in units:
                near = [m for m, _ in keyed if m < k and m[0] == k[0] and unit in said[m]]
                first = min((m for m, _ in keyed if unit in said[m]), default=None)
                if unit and near:
                    options.append((kind, 0, level, number, near[0]))
                elif unit and first and first[0] < k[0] and len(unit) >= least_chars:
                    options.append((kind, 1, level, number, first))
        if options:
            parent[k] = min(options)[-1]

    def up(k):
        return [k] if k not in parent else [k, *up(parent[k])]

    group = {k[0]: k[0] for k, _ in keyed}
    for _ in group:
        for k, p in parent.items():
            low = min(group[k[0]], group[p[0]])
            group[k[0]] = group[p[0]] = low
    return parent, {k: up(k) for k, _ in keyed}, group


def check(messages, rows):
    parent, paths, group = plain(messages)
    assert len(rows) == len(messages)
    for r in rows:
        k = (r.conv_id, r.turn)
        if None in k:
            assert r.parent_conv is None and r.depth == 0 and r.thread_id == r.conv_id
            continue
        assert (r.parent_conv, r.parent_turn) == parent.get(k, (None, None)), k
        assert r.depth == len(paths[k]) - 1 and (r.root_conv, r.root_turn) == paths[k][-1]
        assert r.thread_id == group[k[0]]
    for thread in {r.thread_id for r in rows if r.turn is not None and r.conv_id is not None}:
        own = sorted((r for r in rows if r.thread_id == thread and r.turn is not None), key=lambda r: r.position)
        order = [(*paths[r.conv_id, r.turn][-1], r.conv_id, r.turn) for r in own]
        assert order == sorted(order)
    return parent


def test_parse():
    assert parse(MESSAGES[1][3]) == ("It measures the sea.", [(1, ["What is a  TIDE", "gauge?"])])
    assert parse(MESSAGES[2][3]) == ("Thanks!", [(2, ["Please explain."]), (1, ["", "It measures the sea."])])
    assert parse(None) == ("", []) and parse("a > b") == ("a > b", [])
    assert parse("He wrote:\n\n\n>>x") == ("", [(2, ["x"])])


def test_links_and_order(spark):
    df = spark.createDataFrame(MESSAGES, SCHEMA).withColumn("position", F.lit("mine")).repartition(4)
    rows = link_quotations(df).collect()
    parent = check(MESSAGES, rows)
    assert parent[1, 1] == (1, 0) and parent[1, 2] == (1, 1) and parent[2, 0] == (1, 0)
    assert parent[2, 1] == (2, 0) and parent[3, 0] == (1, 0) and (5, 0) not in parent
    by = {(r.conv_id, r.turn): r for r in rows}
    assert by[1, 2].body == "Thanks!" and by[3, 1].body == "" and by[1, 3].n_quotes == 2
    assert [r.position for r in sorted(rows, key=lambda r: r.position) if r.thread_id == 1] == list(range(8))
    assert by[3, 0].thread_id == 1 and by[3, 1].depth == 2


def test_long_chain(spark):
    """Replies to replies: the depth is found in few rounds."""
    chain = [(i // 9, i % 9, "user", (f"> message number {i - 1} of the chain\n" if i else "") + f"message number {i} of the chain") for i in range(60)]
    rows = link_quotations(spark.createDataFrame(chain, SCHEMA)).collect()
    check(chain, rows)
    assert max(r.depth for r in rows) == 59 and {r.thread_id for r in rows} == {0}
    assert sorted(r.position for r in rows) == list(range(60))


def test_common_line_everywhere(spark):
    """One line that every message says and quotes links to its first message, without pairs."""
    many = [(i % 50, i // 50, "user", f"> {LONG}\n{LONG}") for i in range(1000)]
    rows = link_quotations(spark.createDataFrame(many, SCHEMA).repartition(6)).collect()
    check(many, rows)


def test_op10_keeps_all_messages(spark):
    folder = "/root/testdata/sf0.01"
    messages = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    rows = op10_quotation_linking(spark, folder).collect()
    check(messages, rows)
    text = {(c, t): (role, x) for c, t, role, x in messages}
    for r in rows:
        role, x = text[r.conv_id, r.turn]
        assert r.chat == f"<|{role}|>\n{parse(x)[0]}<|end|>\n"


def test_empty(spark):
    assert link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rewrapped_quotation_of_several_paragraphs(spark):
    """Two of three paragraphs, wrapped anew: neither the whole passage nor one of its lines was ever said."""
    said = "First of three.\n\nThe second paragraph stands on one line.\n\nSo does the third paragraph here."
    quote = "> The second paragraph\n> stands on one line.\n>\n> So does the third\n> paragraph here.\n\nI agree."
    rows = link_quotations(spark.createDataFrame([(1, 0, "user", said), (2, 0, "user", quote)], SCHEMA)).collect()
    by = {r.conv_id: r for r in rows}
    assert (by[2].parent_conv, by[2].parent_turn, by[2].depth) == (1, 0, 1)
    assert (by[2].root_conv, by[2].root_turn, by[2].thread_id) == (1, 0, 1)
