import hashlib
import random
import uuid

import numpy as np
import pandas as pd
import pytest

from tidegauge.llm import suffix_dedup
from tidegauge.llm.suffix_dedup import Sent, Stretches, op6_suffix_dedup, refined, remove_repeats

SF = "/root/testdata/sf0.001"


def plain(docs, match=50):
    """(kept, spans) per row from a dictionary of every string's smallest id."""
    least = {}
    for i, t in docs:
        t = (t or "").encode()
        for s in range(len(t) - match + 1) if i is not None else ():
            w = t[s : s + match]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in docs:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 2, dtype=bool)
        for s in range(len(t) - match + 1) if i is not None else ():
            if least[t[s : s + match]] < i:
                gone[s + 1 : s + match + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), kept, [(int(a), int(b - a)) for a, b in edges]))
    return out


def rows(df):
    return [(r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in df.collect()]


def test_op6_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {
        i: (n, sum(s[1] for s in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for i, n, kept, spans in plain(docs)
    }
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_suffix_dedup(spark, SF).collect()}
    assert got == want
    assert sum(n[1] for n in got.values()) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    """Few letters, shared passages at odd places, runs of one letter, many ids."""
    rnd = random.Random(seed)
    bank = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(30, 200))) for _ in range(8)]
    bank += ["a" * 120, "ab" * 70]
    docs = []
    for i in range(70):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            b = rnd.choice(bank)
            a = rnd.randint(0, len(b))
            parts.append(b[a : a + rnd.randint(20, 160)])
            parts.append("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9))))
        docs.append((rnd.randint(0, 60), "".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(rows(remove_repeats(df, part_bytes=900))) == sorted(plain(docs))
    assert sorted(rows(remove_repeats(df, match=31, q=7))) == sorted(plain(docs, 31))


def test_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    out = remove_repeats(odd)
    assert sorted(rows(out), key=str) == sorted(plain(docs), key=str)
    assert {r.ids for r in out.collect()} == {"mine"}
    assert remove_repeats(none).count() == 0


def test_refined_buckets_are_the_strings():
    rnd = random.Random(9)
    text = bytes(rnd.choice(b"ab") for _ in range(3000)) + b"a" * 200
    for match in (4, 5, 50, 63):
        ids = refined(text, match)
        strings = {}
        for i in range(len(text) - match + 1):
            assert strings.setdefault(text[i : i + match], ids[i]) == ids[i]
        assert len(set(strings.values())) == len(strings)


def test_pieces_of_a_long_text_hold_every_string_once():
    text = bytes(random.Random(4).choice(b"abcdefgh ") for _ in range(1_300_000))
    s = Stretches([text, b"x" * 49, text[:1000]], 50, 20)
    assert (s.first[s.doc == 0][1:] == s.last[s.doc == 0][:-1] + 1).all()
    assert s.last[s.doc == 0][-1] == len(text) - 50 and not (s.doc == 1).any()
    assert (s.last - s.first).max() <= 30
    # The same text gives the same stretches, but for the last one, which is cut off.
    n = (s.doc == 2).sum() - 1
    assert (s.print[s.doc == 2][:n] == s.print[:n]).all()


def test_a_passage_in_many_surroundings_is_not_one_tasks_work(spark, monkeypatch, tmp_path):
    """Every document has one passage, each between other bytes; strings at its edges are shared by some."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage, edges = noise(70), [noise(40) for _ in range(40)]
    docs = []
    for i in range(400):
        before, after = (rnd.choice(edges) if rnd.random() < 0.3 else noise(40) for _ in range(2))
        docs.append((rnd.randint(0, 300), noise(30) + before + passage + after + noise(30)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    decide = suffix_dedup._decide

    def counted(rows, match):
        n = sum(len(Sent(b).texts) for g, b in zip(rows["group"], rows["stretches"]) if g >= 0)
        (tmp_path / uuid.uuid4().hex).write_text(str(n))
        return decide(rows, match)

    monkeypatch.setattr(suffix_dedup, "_decide", counted)
    sizes = []
    for most in (1 << 15, 30):
        assert sorted(rows(remove_repeats(df, part_bytes=9000, most_alike=most))) == sorted(plain(docs))
        sizes.append([int(f.read_text()) for f in tmp_path.iterdir()])
        for f in tmp_path.iterdir():
            f.unlink()
    # Of eight groups: whole, one call has all surroundings of a q-gram; split, strings are spread evenly.
    shares = [max(x) / sum(x) for x in sizes]
    assert shares[0] > 0.2 > 0.16 > shares[1], shares


def test_short_phrases_and_whole_copies_send_nothing(spark, monkeypatch, tmp_path):
    """What cannot repeat over 50 bytes, and copies of whole texts, travel as digests only."""
    rnd = random.Random(7)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    phrase, texts = noise(30), [noise(300) for _ in range(5)]
    docs = [(i, noise(60) + phrase + noise(60)) for i in range(40)]
    docs += [(40 + i, texts[i % 5]) for i in range(20)]
    docs += [(-3, texts[1]), (41, texts[1]), (42, texts[1]), (None, texts[0]), (70, "short"), (71, "short"), (72, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    decide = suffix_dedup._decide

    def counted(rows, match):
        (tmp_path / uuid.uuid4().hex).write_text(str(sum(len(Sent(b).texts) for b in rows["stretches"])))
        return decide(rows, match)

    monkeypatch.setattr(suffix_dedup, "_decide", counted)
    for as_text in (False, True):
        got = remove_repeats(df, part_bytes=3000, as_text=as_text)
        got = [(r.doc_id, r.n_bytes, r.kept.encode() if as_text else bytes(r.kept), [tuple(x) for x in r.spans]) for r in got.collect()]
        assert sorted(got, key=str) == sorted(plain(docs), key=str)
    assert not list(tmp_path.iterdir())


def test_a_crowded_bucket_is_refined_a_little_at_a_time(monkeypatch):
    """A group's memory does not follow from how many different grams it holds."""
    rnd = random.Random(8)
    noise = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    passages = [noise(70) for _ in range(300)]
    groups = []
    for part in range(2):
        end = b"xy"[part : part + 1]
        texts = [noise(39) + end + x + end + noise(39) for x in passages]
        s = Stretches(texts, 50, 20)
        pieces = [texts[d][a : z + 50] for d, a, z in zip(s.doc, s.first, s.last)]
        groups.append((0, part, Sent.pack(20, s.place, s.doc + 1000 * part, pieces), s))
    rows_ = pd.DataFrame([g[:3] for g in groups], columns=["group", "_part", "stretches"])
    lengths, refine = [], suffix_dedup.refined
    monkeypatch.setattr(suffix_dedup, "refined", lambda t, match: lengths.append(len(t)) or refine(t, match))
    whole = suffix_dedup._decide(rows_, 50)
    monkeypatch.setattr(suffix_dedup, "_AT_ONCE", 2000, raising=False)
    del lengths[:]
    assert whole.equals(suffix_dedup._decide(rows_, 50))
    assert len(lengths) > 10 and max(lengths) <= 2000
    # Of the later part's texts, the strings in passages go; of the earlier part's, none.
    s = groups[1][3]
    inside = sum(max(0, min(z, 60) - max(a, 40) + 1) for a, z in zip(s.first.tolist(), s.last.tolist()))
    assert whole["_part"].tolist() == [1]
    assert sum(int(x).bit_count() for x in np.frombuffer(whole["masks"][0], "<i8")) == inside == 300 * 21
