"""Jobs as keyed state: attempts are counted, failed ones are tried again when their timer runs out, dead ones expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts after which a job is given up.
MOST_ATTEMPTS = 5
LEDGER = "target string, record_id string, status string, attempts int, deleted boolean"
COLUMNS = ["target", "record_id", "status", "attempts", "deleted"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(attempts: int, result: str) -> tuple[str, int, bool]:
    """(status, attempts, row deleted) after a delivery: ok deletes, failures count, the last makes the job dead."""
    if result == "ok":
        return "done", attempts + 1, True
    if result == "bad_message":
        return "dead", attempts, False
    return ("dead" if attempts + 1 >= MOST_ATTEMPTS else "failed"), attempts + 1, False


class Jobs(StatefulProcessor):
    """One job per key (target, record_id): its state is the attempts so far, the status and the last message.

    handle(body) gives the result of a delivery: ok, retry or bad_message; ValueError counts as bad_message, any other
    exception as retry. A failed job is handled again `again` milliseconds after its last delivery, until it succeeds or
    is dead; a dead one is forgotten after `keep` milliseconds, and a row of status expired says so. None: no timer. A
    job has one timer at most, and state of one row whatever the number of its deliveries.
    """

    def __init__(self, handle: Callable[[str], str], again: int | None = None, keep: int | None = None):
        self.handle, self.again, self.keep = handle, again, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        self.job = handle.getValueState("job", "attempts int, status string, body string")

    def timed(self) -> bool:
        return self.again is not None or self.keep is not None

    def result(self, body: str) -> str:
        try:
            return self.handle(body)
        except ValueError:
            return "bad_message"
        except Exception:  # noqa: BLE001  a job that fails is tried again
            return "retry"

    def settle(self, status: str, attempts: int, body: str, gone: bool, now: int) -> None:
        if self.timed():  # a query without timers has no list of them either
            for t in list(self.store.listTimers()):
                self.store.deleteTimer(t)
        if gone:
            self.job.clear()
            return
        self.job.update((attempts, status, body))
        wait = self.again if status == "failed" else self.keep
        if wait is not None:
            self.store.registerTimer(now + wait)

    def deliver(self, key: tuple, bodies: list[str], now: int) -> pd.DataFrame:
        attempts, status, gone = (self.job.get()[0] if self.job.exists() else 0), "failed", False
        for body in bodies:
            status, attempts, gone = outcome(attempts, self.result(body))
            attempts = 0 if gone else attempts
        self.settle(status, attempts, bodies[-1], gone, now)
        return pd.DataFrame([(*key, status, attempts, gone)], columns=COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seq", kind="stable")
        yield self.deliver(key, [None if pd.isna(b) else b for b in got["body"]], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        attempts, status, body = self.job.get()
        if status == "dead":
            self.job.clear()
            yield pd.DataFrame([(*key, "expired", attempts, True)], columns=COLUMNS)
        else:
            yield self.deliver(key, [body], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; queries that were started with another one keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def worked(messages: DataFrame, handle: Callable[[str], str], again: int | None = None, keep: int | None = None) -> DataFrame:
    """A stream of messages (target, record_id, body, seq) as ledger rows; deliveries of one batch count in order of seq.

    With timers the query runs by a processing-time trigger: those that have run out are looked at once per trigger.
    """
    keyed_state(messages.sparkSession)
    m = messages.select("target", "record_id", "body", "seq")
    jobs = Jobs(handle, again, keep)
    return m.groupBy("target", "record_id").transformWithStateInPandas(jobs, LEDGER, "Update", "processingTime" if jobs.timed() else "none")


def recorded(result: str) -> str:
    return result


def ledger(deliveries: DataFrame) -> DataFrame:
    """A stream of deliveries whose result is known (target, record_id, result, seq) as ledger rows."""
    return worked(deliveries.withColumnRenamed("result", "body"), recorded)


def written(results: DataFrame) -> DataFrame:
    """key: what the record steps of consume() wrote, each once; the feed of the indexer."""
    return results.select(F.explode("keys").alias("key")).distinct()


def settled(results: DataFrame, failed: DataFrame) -> DataFrame:
    """Results of consume() after indexing: a message with one of the failed keys (key) is to be tried again, and stays."""
    f = failed.select("key").distinct()
    again = results.select("body", F.explode("keys").alias("key")).join(f, "key").select(F.col("body").alias("_b")).distinct()
    out = results.join(again, F.col("body").eqNullSafe(F.col("_b")), "left").withColumn("_again", F.col("_b").isNotNull())
    return out.withColumn("result", F.when(F.col("_again"), "retry").otherwise(F.col("result"))).withColumn("removed", F.col("removed") & ~F.col("_again")).drop("_b", "_again")
