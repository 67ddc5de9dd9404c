import zlib

import pytest
from pyspark.sql import functions as F

from tidegauge.llm.sharding import op1_shard_bytes, shard_by_bytes, text_bytes

SF = "/root/testdata/sf0.001"


def check(rows, shards):
    rows = sorted(rows, key=lambda r: (r.shard, r.slot))
    total, before = sum(r.size for r in rows), 0
    for s in range(shards):
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        assert r.shard == min((2 * before + r.size) * shards // (2 * total), shards - 1)
        before += r.size
    return rows


def test_op1_is_the_brute_force_cut(spark):
    rows = check(op1_shard_bytes(spark, SF).collect(), 8)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
        assert r.grown_shard is None
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


@pytest.mark.parametrize("shards", [1, 3, 50])
def test_odd_rows(odd, none, shards):
    sized = odd.withColumn("size", text_bytes(F.col("text")))
    out = shard_by_bytes(sized, shards, ["doc_id"])
    rows = check(out.collect(), shards)
    assert len(rows) == 13 and rows[0].doc_id is None and rows[0].ids == "mine"
    assert shard_by_bytes(none.withColumn("size", F.lit(1)), shards, ["doc_id"]).count() == 0


def test_one_order_value_is_spread(spark):
    """A third of all rows agrees in the order: they do not have to be in one range."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(2).alias("size"))
    got = check(shard_by_bytes(rows, 8, ["k"]).collect(), 8)
    assert [r.k for r in got] == sorted(r.k for r in got)
