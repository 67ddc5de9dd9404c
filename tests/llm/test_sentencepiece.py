import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest

from tidegauge.llm import sentencepiece_codec
from tidegauge.llm.sentencepiece_codec import (
    Codec,
    default_model,
    encode_digests,
    encode_texts,
    op2_sentencepiece,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return Codec(default_model())


def test_equals_the_library_on_random_strings(codec):
    rnd = random.Random(5)
    pieces = list(codec.ids)
    signs = " ▁  ab\nthe.,1é漢😀\t\x00isin▁tion<0x0A></s><unk>ß"
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        assert codec.encode(text) == codec.processor.encode(text)
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 8))).replace("▁", " ")
        assert codec.encode(text) == codec.processor.encode(text)


@pytest.mark.parametrize("text", [" " * 3001, "a" * 5000, "ab" * 20000, "thethe" * 999, "x\n\n  \ny "])
def test_long_runs(codec, text):
    assert codec.encode(text) == codec.processor.encode(text)


def test_backtracks(codec):
    """The longest piece first is not always right: some run needs a shorter one."""
    rnd, went_back = random.Random(2), 0
    letters = "eationrsthl"
    for _ in range(3000):
        run = "".join(rnd.choice(letters) for _ in range(9))
        pieces = codec.pieces(run)
        longest = max((p for p in codec.ids if run.startswith(p)), key=len) if went_back < 1 else None
        went_back += longest is not None and pieces[0] != longest
        if went_back:
            break
    assert went_back


def test_a_task_leaves_nothing_it_remembered():
    model = default_model()
    for _ in range(2):
        with sentencepiece_codec.codec(model) as c:
            text = "the quick brown fox, and what the dog said"
            assert c.encode(text) == c.processor.encode(text) and c.agree and c.first
        assert not any((c.agree, c.runs, c.first, c.later, c.raw))


def some_words(n: int) -> list[str]:
    rnd = random.Random(3)
    return ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(4, 9))) + rnd.choice(["", ",", ".", ")"]) for _ in range(n)]


def test_all_words_together_are_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 60)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED_PAIRS", 60)
    c = Codec(default_model())
    for k in range(200):
        text = " ".join(some_words(400)[k : k + 40]) + "\n" + " x  y" * (k % 3)
        assert c.encode(text) == c.processor.encode(text)
        assert sum(map(len, (c.first, c.later, c.raw, c.runs))) <= 60 and len(c.agree) <= 60


def test_words_with_very_many_ids_are_not_kept():
    c = Codec(default_model())
    text = "\U0001f9ff" * 60
    assert c.encode(text) == c.processor.encode(text) and len(c.encode(text)) > 64
    assert not any((c.first, c.later, c.raw, c.runs))


def test_remembered_words_are_small():
    """What is kept of a word that stands alone and before a sign; the ids as tuples, kept once more for the sign, took 456 bytes."""
    c, words = Codec(default_model()), {x.strip(",.)") for x in some_words(30_000)}
    text = " ".join(f"{x} {x}," for x in sorted(words))
    c.encode(text)
    for known in (c.first, c.later, c.raw, c.runs):
        known.clear()  # pairs of pieces stay
    tracemalloc.start()
    try:
        c.encode(text)
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 350 * len(words)


def test_slices_have_every_row_once():
    texts = ["a" * 7, None, "", "b" * 30, "c", None, "äö" * 4]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for most in (1, 5, 8, 100):
        got = [x for rows in sentencepiece_codec.slices(batch, "text", most) for x in rows.column("text").to_pylist()]
        assert got == texts
    assert sum(r.num_rows for r in sentencepiece_codec.slices(batch.slice(0, 0), "text")) == 0


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_op2_equals_the_library(spark, codec):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op2_sentencepiece(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = codec.processor.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == digest(" ".join(map(str, ids)))
        assert r.decoded_sha256 == digest(codec.processor.decode(ids))


def test_odd_rows(odd, none, codec):
    model = default_model()
    rows = encode_texts(odd, model).collect()
    assert len(rows) == 13
    for r in rows:
        assert list(r.ids) == codec.processor.encode(r.text or "", add_eos=True)
        assert r.decoded == codec.processor.decode(list(r.ids)) and r.size == "mine"
    short = encode_digests(odd, model).collect()
    assert sorted(r.n_tokens for r in short) == sorted(len(r.ids) for r in rows)
    assert encode_texts(none, model).count() == 0 and encode_digests(none, model).count() == 0
