import zlib
from collections import Counter

from pyspark.sql import functions as F

from corvine.llm import sharding as S
from corvine.session import table


def test_law_sizes_and_slots(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, "a"), (7, None), (7, None), (8, "日本")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd).withColumn("shard", F.lit("clash"))
    texts = Counter((r.doc_id, r.text) for r in both.collect())
    rows = S.shard(both, [1.0] * 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter({(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())): n for (i, t), n in texts.items()})
    assert all(r.grown_shard in (r.shard, 24) and r.law == "key" for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(24))
    again = {r.doc_id: r.shard for r in S.shard(both.filter("doc_id % 3 = 0"), [1.0] * 24).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows if r.doc_id in again)
    assert S.shard(both.limit(0), [1.0] * 24).collect() == []


def test_weights_and_growth(spark):
    keys = spark.range(40_000)
    w = [1.0, 2.0, 0.0, 1.0]
    r = keys.select(S.rendezvous(F.col("id"), w).alias("a"), S.rendezvous(F.col("id"), [*w, 1.0]).alias("b")).collect()
    n = Counter(x.a for x in r)
    assert n[2] == 0 and abs(n[1] / 40_000 - 0.5) < 0.02 and abs(n[0] / 40_000 - 0.25) < 0.02
    assert all(x.b in (x.a, 4) for x in r) and abs(sum(x.b == 4 for x in r) / 40_000 - 0.2) < 0.02


def test_parts_of_a_large_group_stay_gapless(spark, monkeypatch):
    from corvine.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 20)
    d = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 > 0, 1).when(F.col("id") < 500, 0))
    by = {}
    for r in common.gapless(d, "g", [F.col("id")], "n", {1: 666, 0: 167, None: 167}, F.col("id")).collect():
        by.setdefault(r.g, []).append(r.n)
    assert sorted(map(len, by.values())) == [167, 167, 666] and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shard_equals_a_plain_version(spark):
    """The best of -weight / ln(u), with u from the same hash, computed by hand."""
    import math

    weights = [1.0, 3.0, 0.5, 0.0, 2.0]
    keys = [*range(200), None, -5]
    d = spark.createDataFrame([(k,) for k in keys], "k long")
    hashes = d.select("k", *(F.xxhash64(F.lit("shard"), F.lit(i), "k").alias(f"h{i}") for i in range(5)), S.rendezvous(F.col("k"), weights).alias("s")).collect()
    for r in hashes:
        scores = [(-w / math.log((((r[f"h{i}"] % 2**64) >> 11) + 0.5) / 2**53), i) for i, w in enumerate(weights) if w]
        assert r.s == max(scores)[1]
