import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and in river stone window paper quiet morning garden letter".split()


def prose(seed: int, n: int) -> str:
    """Deterministic text of n words."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x // 1000 % len(WORDS)] + ("s" if x // 77 % 5 == 0 else ""))
    return " ".join(out)


ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n", None, "a", 3),
    (4, "word", "de", None, 4),
    (5, prose(1, 300), "en", "b", 1),
    (6, prose(1, 300), "en", "b", 1),
    (6, prose(1, 300), "en", "b", 1),
    (7, prose(2, 30_000), "en", "b", 1),
    (8, prose(3, 200) + "\n" + prose(3, 200), None, "b", 1),
    (9, "äöü 漢字 😀\n\nx  y  ▁z " + prose(4, 90), "de", "c", 1),
    (10, "IN THE " * 70, "fr", "c", 1),
    (None, prose(5, 120), "fr", "c", 1),
    (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids and names that clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    clash = ("ids", "decoded", "fingerprint", "component_id", "bits", "size", "shard", "position")
    return df.withColumns({name: F.lit("mine") for name in clash}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
