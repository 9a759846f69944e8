"""Bucketed tables: what a write touches, what readers see."""

import os
import random

from pyspark.sql import functions as F

from corvine.sources import sinks


def rows_of(spark, path):
    return sorted((r.k, r.v) for r in sinks.read(spark, path).collect())


def files(path):
    return sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs)


def test_a_write_touches_its_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.ensure(spark, path, spark.createDataFrame([], "k string, v int").schema, "k", buckets=16)
    sinks.upsert(spark, path, spark.range(400).selectExpr("concat('k', id) k", "cast(id as int) v"), "k")
    before = sinks.state(spark, path)
    new = spark.createDataFrame([("k3", -1), ("new", 7)], "k string, v int")
    touched = sinks.upsert(spark, path, new, "k")
    after = sinks.state(spark, path)
    assert len(touched) <= 2 and len(before.folders) == 16
    assert {b for b in after.folders if after.folders[b] != before.folders.get(b)} == set(touched)
    rewritten = after.read(spark, touched).count()
    assert rewritten <= 400 / 16 * 2 * 2  # with the touched buckets, not with the table
    want = sorted([(f"k{i}", i) for i in range(400) if i != 3] + [("k3", -1), ("new", 7)])
    assert rows_of(spark, path) == want
    again = sinks.upsert(spark, path, new, "k")  # a batch delivered again
    assert again == touched and rows_of(spark, path) == want
    assert sinks.upsert(spark, path, new.limit(0), "k") == [] and sinks.versions(spark, path)[-1] == 3


def test_random_writes_are_those_of_a_dict(spark, tmp_path):
    path, r, want = f"file://{tmp_path}/t", random.Random(1), {}
    sinks.ensure(spark, path, spark.createDataFrame([], "k string, v int").schema, "k", buckets=4)
    for step in range(4):
        batch = [(f"k{r.randrange(30)}", step * 100 + i) for i in range(12)]
        df = spark.createDataFrame([(k, v, v) for k, v in batch], "k string, v int, s int")
        sinks.upsert(spark, path, df.drop("s") if step % 2 else df.select("k", "v"), "k", "v")
        want |= {k: max(v for x, v in batch if x == k) for k, _ in batch}
        gone = [(f"k{r.randrange(30)}",) for _ in range(3)]
        sinks.delete(spark, path, spark.createDataFrame(gone, "k string"), "k")
        want = {k: v for k, v in want.items() if (k,) not in gone}
        change = [(f"k{r.randrange(30)}", -step), ("k1", None)]
        sinks.update(spark, path, spark.createDataFrame(change, "k string, v int"), "k", ["v"])
        want |= {k: v for k, v in change if k in want and v is not None}
    assert rows_of(spark, path) == sorted(want.items())


def test_one_row_per_key_without_order(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 5), ("a", 7), (None, 9), (None, 9)], "k string, v int")
    for rows in (new, new.orderBy("v"), new.orderBy(F.desc("v"))):
        assert sorted(map(str, sinks.upserted(old, rows, "k").collect())) == sorted(map(str, [("a", 7), (None, 9)])) or sorted((str(r.k), r.v) for r in sinks.upserted(old, rows, "k").collect()) == [("None", 9), ("a", 7)]
    assert [r.v for r in sinks.updated(old.filter("k = 'a'"), new, "k", ["v"]).collect()] == [7]


def test_appends_are_files(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    event = lambda k, e: spark.createDataFrame([("r", k, e, None, False)], sinks.LOG)
    sinks.log_documents(spark, log, event("a", "x"))
    first = sinks.state(spark, log)
    sinks.log_documents(spark, log, event("a", "y"))
    sinks.log_documents(spark, log, event("b", "x"))
    now = sinks.state(spark, log)
    assert all(set(fs) <= set(now.folders[b]) for b, fs in first.folders.items()) and files(tmp_path / "log" / "data") == 3
    sinks.soft_delete(spark, log, event("a", "z").select("key"))
    assert sorted((r.key, r.event, r.deleted) for r in sinks.read(spark, log).collect()) == [("a", "x", True), ("a", "y", True), ("b", "x", False)]


def test_half_a_write_does_not_show(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k")
    held = sinks.read(spark, path)
    (tmp_path / "t" / "manifest" / "v=1").mkdir()
    assert sinks.versions(spark, path) == [0] and rows_of(spark, path) == [("a", 1)]
    sinks.upsert(spark, path, spark.createDataFrame([("a", 2)], "k string, v int"), "k")
    assert rows_of(spark, path) == [("a", 2)] and held.collect()[0].v == 1  # a reader keeps what it began with


def test_new_columns_and_a_late_key(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), path)
    sinks.upsert(spark, path, spark.createDataFrame([("a", 2, "n")], "k string, v int, w string"), "k")
    assert sorted((r.k, r.v, r.w) for r in sinks.read(spark, path).select("k", "v", F.coalesce("w", F.lit("-")).alias("w")).collect()) == [("a", 2, "n"), ("b", 1, "-")]
