import pandas as pd
from pyspark.sql import functions as F

from corvine.sources import objects, records, sinks
from corvine.streaming import incremental as I
from corvine.streaming import worker


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert not sinks.exists(spark, path)
    sinks.ensure(spark, path, a.schema)
    sinks.ensure(spark, path, a.schema)
    assert sinks.versions(spark, path) == [0]
    sinks.upsert(spark, path, a, "id")
    sinks.upsert(spark, path, spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "c", 1)], "id int, v string, s int"), "id", "s")
    assert sorted((r.id, r.v) for r in sinks.read(spark, path).collect()) == [(1, "a"), (2, "y"), (3, "c")]
    assert sinks.copied(a, sinks.read(spark, path), "id").count() == 0


def test_stream_upsert_equals_batch(spark, tmp_path):
    src, target = f"{tmp_path}/in", f"file://{tmp_path}/out"
    rows = [(i % 7, i, f"v{i}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "id int, seq int, v string").coalesce(1).write.mode("append").parquet(src)
    s = I.stream_of(spark, src, "id int, seq int, v string")
    I.upsert_batches(s, target, "id", "seq", f"{tmp_path}/cp")
    got = {r.id: r.v for r in sinks.read(spark, target).collect()}
    assert got == {i: f"v{max(j for j in range(40) if j % 7 == i)}" for i in range(7)}


def test_stream_ledger_equals_batch(spark, tmp_path):
    rows = [("t", "a", "retry", 1), ("t", "a", "ok", 2), ("t", "b", "bad_message", 3), *[("t", "c", "retry", 10 + i) for i in range(6)], ("t", "d", "retry", 20), ("t", "d", "ok", 21), ("t", "d", "retry", 22)]
    d = spark.createDataFrame(rows, "target string, record_id string, result string, seq long")
    batch = {r.record_id: (r.status, r.attempts) for r in I.ledger_batch(d).collect()}
    assert batch == {"a": ("done", 0), "b": ("dead", 0), "c": ("dead", 6), "d": ("failed", 1)}
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = I.ledger(I.stream_of(spark, f"{tmp_path}/in", d.schema)).writeStream.outputMode("update").format("memory").queryName("ledger").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.record_id: (r.status, r.attempts) for r in spark.table("ledger").collect()} == batch


def test_consumer(spark):
    def handle(body):
        if body == "bad":
            raise ValueError
        if body == "down":
            raise OSError
        return "ok"

    got = {r.body: (r.result, r.removed) for r in I.consume(spark.createDataFrame([("a",), ("bad",), ("down",)], "body string"), handle).collect()}
    assert got == {"a": ("ok", True), "bad": ("bad_message", True), "down": ("retry", False)}


def test_keys_written_feed_the_indexer(spark):
    def handle(body):
        if body == "down":
            raise OSError
        return [] if body == "same" else [f"{body}/1", "shared"]

    m = spark.createDataFrame([("a",), ("b",), ("same",), ("down",)], "body string")
    got = I.consume(m, handle)
    assert {r.key for r in worker.written(got).collect()} == {"a/1", "b/1", "shared"}
    end = worker.settled(got, spark.createDataFrame([("b/1",), ("b/1",), ("elsewhere",)], "key string"))
    assert sorted((r.body, r.result, r.removed) for r in end.collect()) == [("a", "ok", True), ("b", "retry", False), ("down", "retry", False), ("same", "ok", True)]


def work(body):
    """ok at the third delivery of a job, told by a file; bad messages and hopeless ones by name."""
    import os

    kind, name = body.split(":")
    if kind == "bad":
        raise ValueError(body)
    if kind == "never":
        raise OSError(body)
    n = len(os.listdir(name))
    open(f"{name}/{n}", "w").close()
    return "ok" if n == 2 else "retry"


def test_failed_jobs_come_again_and_dead_ones_expire(spark, tmp_path):
    import time

    (tmp_path / "tries").mkdir()
    rows = [("t", "a", f"third:{tmp_path}/tries", 1), ("t", "b", "bad:", 2), ("t", "c", "never:", 3), (None, None, "never:", 4)]
    d = spark.createDataFrame(rows, "target string, record_id string, body string, seq long")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    w = worker.worked(I.stream_of(spark, f"{tmp_path}/in", d.schema), work, again=200, keep=800)
    q = w.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    try:
        began = time.time()
        while time.time() - began < 90 and sum(r[2] == "expired" for r in seen) < 3:
            time.sleep(0.3)
    finally:
        q.stop()
    of = lambda k: [r[2:] for r in seen if r[1] == k]
    assert of("a") == [("failed", 1, False), ("failed", 2, False), ("done", 0, True)]
    assert of("b") == [("dead", 0, False), ("expired", 0, True)]
    tried = [*(("failed", i, False) for i in range(1, 5)), ("dead", 5, False), ("expired", 5, True)]
    assert of("c") == tried and of(None) == tried


def test_flush_closes_on_whole_documents(spark):
    d = spark.createDataFrame([(0, i, 3) for i in range(7)], "part int, doc int, n long")
    got = {r.doc: r.batch for r in I.flush_batches(d, "doc", "n", 5).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}


def test_object_scan(spark, tmp_path):
    for k, b in {"raw/t/1/c/a.txt": b"caf\xc3\xa9", "raw/t/1/c/b.txt": b"\xff\xfe", "raw/t/2/x.pdf": b"%PDF"}.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_bytes(b)
    got = {r.key: r.text for r in objects.text_of(objects.scan(spark, str(tmp_path), (".txt",))).collect()}
    assert got["raw/t/1/c/a.txt"] == "café" and set(got) == {"raw/t/1/c/a.txt", "raw/t/1/c/b.txt"}


def page(table, offset, size):
    return [{"id": i, "name": f"{table}{i}"} for i in range(offset, min(offset + size, 25))]


def test_paged_source(spark):
    spark.dataSource.register(records.PagedRecords)
    df = spark.read.format("paged_records").options(schema="id int, name string", table="t", total="25", page="10", module="tests.test_incremental", function="page").load()
    assert sorted(r.id for r in df.collect()) == list(range(25))


def test_schema_snapshot(spark):
    df = spark.range(1)
    assert records.validated(df, records.snapshot(df), ["id"]).names == ["id"]
    try:
        records.validated(df, records.snapshot(df), ["gone"])
    except ValueError:
        return
    raise AssertionError


def test_run_logs(spark, tmp_path):
    runs, log = f"file://{tmp_path}/runs", f"file://{tmp_path}/log"
    row = lambda status: spark.createDataFrame([("r1", status, None, None, {"n": 1})], sinks.RUNS)
    sinks.log_run(spark, runs, row("running"))
    sinks.log_run(spark, runs, row("done"))
    assert [r.status for r in sinks.read(spark, runs).collect()] == ["done"]
    event = lambda k: spark.createDataFrame([("r1", k, "indexed", None, False)], sinks.LOG)
    sinks.log_documents(spark, log, event("a"))
    sinks.log_documents(spark, log, event("b"))
    sinks.soft_delete(spark, log, event("a").select("key"))
    assert {r.key: r.deleted for r in sinks.read(spark, log).collect()} == {"a": True, "b": False}


STORE = "/tmp/corvine-test-store.json"


def stored(table):
    import json

    with open(f"{STORE}.{table}") as f:
        return json.load(f)


def latest(table):
    return max((r["changed"] for r in stored(table)), default=None)


def changes(table, after, upto, offset, size):
    rows = sorted((r["changed"], r["id"]) for r in stored(table) if (after is None or r["changed"] > after) and r["changed"] <= upto)
    return [{"id": i, "changed": c} for c, i in rows[offset : offset + size]]


def test_paged_source_without_a_total(spark):
    spark.dataSource.register(records.PagedRecords)
    for size in (5, 7, 25, 40):
        df = spark.read.format("paged_records").options(schema="id int, name string", table="t", page=str(size), module="tests.test_incremental", function="page").load()
        assert sorted(r.id for r in df.collect()) == list(range(25))


def test_polling_loses_and_repeats_nothing(spark, tmp_path):
    import json
    import uuid

    spark.dataSource.register(records.PagedRecords)
    name, queue, cp = uuid.uuid4().hex, f"{tmp_path}/queue", f"{tmp_path}/cp"

    def run(rows):
        with open(f"{STORE}.{name}", "w") as f:
            json.dump([{"id": i, "changed": c} for i, c in rows], f)
        stream = spark.readStream.format("paged_records").options(schema="id int, changed string", table=name, page="3", module="tests.test_incremental").load()
        I.poll(stream, "people", "id", queue, cp)

    def queued():
        return sorted((json.loads(r.body)["record_id"], r.poll) for r in spark.read.option("basePath", queue).parquet(f"{queue}/poll=*").collect())

    one = [(i, f"2024-01-{i:02d}") for i in range(1, 9)]
    run(one)
    first = queued()
    assert sorted(int(i) for i, _ in first) == list(range(1, 9))
    run(one)  # nothing new
    assert queued() == first
    run([(i, "2024-02-01" if i == 4 else c) for i, c in one] + [(20, "2024-02-02"), (20, "2024-02-02")])
    new = [x for x in queued() if x not in first]
    assert sorted(int(i) for i, _ in new) == [4, 20]
    # the last batch fails after its offsets were logged: it runs again and gives the same messages
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "cp" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    before = queued()
    for _ in range(2):  # the first may only run the old batch
        run([(i, "2024-02-01" if i == 4 else c) for i, c in one] + [(20, "2024-02-02"), (21, "2024-02-03")])
    assert [x for x in queued() if x[0] != "21"] == before and [int(i) for i, _ in queued()].count(21) == 1
    got = spark.read.option("basePath", queue).parquet(f"{queue}/poll=*")
    assert got.select("id").distinct().count() == got.count() - 1  # record 4 was changed twice
