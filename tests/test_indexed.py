"""Stored indexes: pruning, batches, bounds."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import lexical
from corvine.session import scratch
from corvine.sources import postings

DOCS = "doc_id long, text string, title string, extra string"


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i // 5)}{chr(97 + i % 5)}x" for i in range(25)]
    out = [(i * 3, " ".join(r.choice(vocabulary[: r.randrange(2, 25)]) for _ in range(r.randrange(1, 40))), r.choice(vocabulary), "x") for i in range(n)]
    return [*out, (9001, None, None, "x"), (9002, "", "", "x"), (9003, "wabx " * 400, "wabx", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(1, 300), DOCS).repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    path = scratch(spark, "index")
    postings.create(spark, path, ("title",), block=8, buckets=16)
    postings.add(docs.filter("doc_id % 2 = 0"), path)
    postings.add(docs.filter("doc_id % 2 = 1"), path)
    return path


QUERIES = [(1, "wabx waax"), (2, "wecx"), (3, "wacx the wadx waex"), (4, "absent"), (5, ""), (6, "wabx wabx"), (7, None)]


def test_scores_are_those_of_the_scan(spark, docs, index):
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    got = postings.search(spark, index, queries, 5).collect()
    assert {r.query_id for r in got} == {1, 2, 3, 6}
    for number, text in QUERIES:
        want = [tuple(r) for r in lexical.match_query(docs, text, 5, ("title",)).collect()] if text else []
        assert [(r.doc_id, r.score, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.query_id == number] == sorted(want, key=lambda r: r[2])


def test_batches_are_one_index(spark, docs, index):
    whole = scratch(spark, "index")
    postings.create(spark, whole, ("title",), block=8, buckets=16)
    postings.create(spark, whole, ("other",))  # an index that is there stays
    assert postings.add(docs, whole) == 0 and postings.batches(spark, index) == [0, 1]
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    assert sorted(postings.search(spark, whole, queries, 7).collect()) == sorted(postings.search(spark, index, queries, 7).collect())


def test_bounds_hold_and_prune(spark, index):
    queries = spark.createDataFrame([(2, "wecx webx wabx")], "query_id int, text string")
    s = postings.Search(spark, index, queries)
    bounds = s.bounds()
    rows = bounds.collect()
    for r in rows:
        best = s.scores(spark.createDataFrame([r], bounds.schema)).agg(F.max("score")).first()[0]
        assert best <= r.bound + 1e-6
    least = postings.search(spark, index, queries, 3).agg(F.min("score")).first()[0]
    assert sum(r.bound + 1e-6 >= least for r in rows) < len(rows) / 2


def test_only_buckets_of_the_query_are_read(spark, index):
    queries = spark.createDataFrame([(2, "wecx")], "query_id int, text string")
    s = postings.Search(spark, index, queries)
    plan = s.bounds()._jdf.queryExecution().toString()
    assert len(s.wanted) == 1 and f"PartitionFilters: [isnotnull(bucket" in plan.replace("#", " #").replace(" #", "#") or "PartitionFilters: [(bucket" in plan
    assert "positions" not in plan.split("ReadSchema")[1].split(">")[0]


def test_an_unfinished_batch_does_not_show(spark, docs):
    path = scratch(spark, "index")
    postings.create(spark, path, block=8)
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    assert postings.search(spark, path, queries, 3).collect() == []
    postings.add(docs, path)
    before = postings.search(spark, path, queries, 3).collect()
    spark.range(1).selectExpr("0 field", "'wabx' term", "1L block").write.parquet(f"{path}/postings/batch=1/bucket=0")
    assert postings.batches(spark, path) == [0] and postings.search(spark, path, queries, 3).collect() == before
