"""Incremental processing: cursors, an idempotent upsert per micro-batch, and the attempt ledger as one fold (as state: worker.py)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import quality
from corvine.sources import sinks
from corvine.streaming.worker import MOST_ATTEMPTS, ledger

__all__ = ["consume", "flush_batches", "ledger", "ledger_batch", "messages_of", "next_cursor", "poll", "stream_of", "summaries_refreshed", "upsert_batches"]


def next_cursor(rows: DataFrame, ts: str) -> DataFrame:
    """The cursor to store: the largest time seen, not the time of the scan, so that no change is lost between them."""
    return rows.agg(F.date_format(F.date_trunc("second", F.max(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("cursor"))


def stream_of(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder as a stream; files per trigger bound a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_batches(stream: DataFrame, target: str, key: str, seq: str, checkpoint: str):
    """Run what is there through an upsert sink; a batch that is delivered again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sinks.ensure(spark, target, batch.schema)
        sinks.upsert(spark, target, batch, key, seq)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def messages_of(rows: DataFrame, target: str, key: str) -> DataFrame:
    """A queue's messages (id, body) for changed records: the body names target and record, equal ones have one id."""
    body = F.to_json(F.struct(F.lit(target).alias("target"), F.col(key).cast("string").alias("record_id")))
    return rows.filter(F.col(key).isNotNull()).select(body.alias("body")).distinct().select(F.sha2("body", 256).alias("id"), "body")


def poll(changes: DataFrame, target: str, key: str, queue: str, checkpoint: str):
    """Put a message into the queue folder for each record of a stream of changes, for what is there now.

    A batch's messages are a folder of its number, written whole or not at all, so one that runs again after a failure
    replaces what it had written: no message is lost and none is there twice. stream_of(queue) takes them up.
    """

    def write(batch: DataFrame, number: int) -> None:
        messages_of(batch, target, key).write.mode("overwrite").parquet(f"{queue}/poll={number}")

    q = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ledger_batch(deliveries: DataFrame) -> DataFrame:
    """The ledger after all deliveries, as one fold over each job's results in order."""
    g = deliveries.groupBy("target", "record_id").agg(F.array_sort(F.collect_list(F.struct("seq", "result"))).alias("x"))
    start = F.struct(F.lit("new").alias("status"), F.lit(0).alias("attempts"), F.lit(False).alias("deleted"))

    def step(a, x):
        n = a["attempts"] + 1
        ok, bad = x["result"] == "ok", x["result"] == "bad_message"
        status = F.when(ok, "done").when(bad, "dead").when(n >= MOST_ATTEMPTS, "dead").otherwise("failed")
        return F.struct(status.alias("status"), F.when(ok, 0).when(bad, a["attempts"]).otherwise(n).alias("attempts"), ok.alias("deleted"))

    return g.select("target", "record_id", F.aggregate("x", start, step).alias("s")).select("target", "record_id", "s.*")


def consume(messages: DataFrame, handle: Callable[[str], str | list[str]]) -> DataFrame:
    """messages (body) with a result, the keys written, and whether the message is removed: all but those to try again.

    handle gives a result, or the keys that its record step wrote, which is ok; none means that nothing had changed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, keys = [], []
            for body in f["body"]:
                wrote: list[str] = []
                try:
                    got = handle(body)
                    wrote = got if isinstance(got, list) else []
                    out.append("ok" if isinstance(got, list) else got)
                except ValueError:
                    out.append("bad_message")
                except Exception:  # noqa: BLE001  a record that fails is tried again
                    out.append("retry")
                keys.append(wrote)
            yield pd.DataFrame({"body": f["body"], "result": out, "keys": keys, "removed": [r != "retry" for r in out]})

    return messages.select("body").mapInPandas(run, "body string, result string, keys array<string>, removed boolean")


def summaries_refreshed(parts: DataFrame, changed: DataFrame, path: str, record: str, order: str, text: str, summarise=None) -> list[int]:
    """Make the summaries of changed records (record) anew from all their parts, in a bucketed table; others are not read.

    Of parts of one record and order one counts. Records left without any text keep the summary that they had. Returns
    the buckets written.
    """
    p = parts.select(record, order, text).filter(F.col(record).isNotNull()).join(changed.select(record).distinct(), record, "left_semi")
    p = p.groupBy(record, order).agg(F.max(text).alias(text))
    new = quality.record_summary(p, record, order, text, summarise)
    sinks.ensure(parts.sparkSession, path, new.schema, record)
    return sinks.upsert(parts.sparkSession, path, new, record)


def flush_batches(sizes: DataFrame, doc: str, n: str, least: int = 500) -> DataFrame:
    """doc, batch: whole documents in order, a batch being closed as soon as it holds `least` rows.

    The fold runs over the documents of one partition column `part` (a file or a shard), never over all.
    """
    g = sizes.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(doc, n))).alias("x"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        held = a["held"] + x[n]
        full = held >= least
        return F.struct((a["b"] + full.cast("int")).alias("b"), F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held"), F.concat(a["out"], F.array(a["b"])).alias("out"))

    d = g.withColumn("b", F.aggregate("x", start, step, lambda a: a["out"]))
    return d.select("part", F.explode(F.arrays_zip("x", "b")).alias("z")).select("part", F.col(f"z.x.{doc}").alias(doc), F.col("z.b").alias("batch"))
