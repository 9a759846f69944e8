"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import gapless
from corvine.session import table


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (index into weights) with the best score -weight / ln(u) for the key.

    u in (0, 1) comes from a 64-bit hash of (key, shard), so a shard's score depends on the key and that shard alone:
    adding a shard moves rows only into it, removing one moves only its rows, and shares follow the weights.
    A null key hashes like any other value. Ties go to the higher shard number. Shards of weight 0 get nothing.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    if len(live) == 1:
        return F.lit(live[0][0]).cast("int")

    def scored(i: int, w: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("shard"), F.lit(i), key), 11).cast("double")
        return F.struct((F.lit(-float(w)) / F.log((bits + 0.5) / 2.0**53)).alias("s"), F.lit(i).alias("i"))

    return F.greatest(*(scored(i, w) for i, w in live)).getField("i").cast("int")


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs with its shard and a slot in it: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: the key and the shards alone decide. Null texts have size 8 and the crc32 of the empty text; a null key
    is a value of its own; repeated rows share a shard and have slots of their own; columns beside key and text are
    not read, so clashing names are harmless. An empty table gives an empty result.
    """
    grown = grown or [*weights, 1.0]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    counts = {r["shard"]: r["n"] for r in d.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    d = gapless(d, "shard", [F.col("doc_id"), F.col("text_crc32")], "slot", counts, F.struct("doc_id", "size", "text_crc32"))
    return d.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), [1.0] * 24)
