"""Fusion of ranked lists. Order is part of the meaning, so every list carries ranks from 1 and every tie is decided."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank over a list of bounded length (the k of a search); upstream limits keep it small."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))


def rrf(first: DataFrame, second: DataFrame, k: int, c: int = 60) -> DataFrame:
    """id, rrf, rank of the k best ids of two lists (id, rank): sums of 1 / (c + rank).

    Ties: ids of the first list by their rank there, then the others by theirs.
    """
    both = first.select("id", F.col("rank").alias("r1"), F.lit(None).cast("long").alias("r2")).union(second.select("id", F.lit(None).cast("long"), "rank"))
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    s = both.groupBy("id").agg(F.sum(part("r1") + part("r2")).alias("s"), F.min("r1").alias("r1"), F.min("r2").alias("r2"))
    s = s.select("id", F.round("s", 9).alias("rrf"), "r1", "r2")
    top = s.orderBy(F.desc("rrf"), F.col("r1").asc_nulls_last(), "r2").limit(k)
    return numbered(top, [F.desc("rrf"), F.col("r1").asc_nulls_last(), F.col("r2")]).select("id", "rrf", "rank")


def merge_passes(strict: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """The best rrf of each id in two fused lists (id, rrf, rank); ties by place, those of the strict list first."""
    u = strict.select("id", "rrf", F.col("rank").alias("ord")).union(wide.select("id", "rrf", F.col("rank") + 1_000_000))
    best = u.groupBy("id").agg(F.max("rrf").alias("rrf"), F.min("ord").alias("ord")).orderBy(F.desc("rrf"), "ord").limit(k)
    return numbered(best, [F.desc("rrf"), F.col("ord")]).select("id", "rrf", "rank")


def boost(hits: DataFrame, matched: Column, derived: int, c: int = 60) -> DataFrame:
    """hits (id, rrf, rank) with up to one first place's worth added by the share of derived facets they match."""
    b = hits.withColumn("boosted", F.round(F.col("rrf") + 1.0 / (c + 1) * matched / derived, 9)).withColumnRenamed("rank", "prev")
    return numbered(b, [F.desc("boosted"), F.col("prev")])


def cross_source(lists: list[DataFrame], k: int, c: int = 60, bonus: float = 0.001) -> DataFrame:
    """source, id, rank of several sources' lists (source, id, score, rank): 1 / (c + rank) plus bonus * score.

    Hits of different sources never share a key. Ties: order of the sources, then rank.
    """
    u = reduce(DataFrame.union, [x.select("source", "id", "score", "rank", F.lit(i).alias("src")) for i, x in enumerate(lists)])
    g = u.groupBy("source", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank")) + bonus * F.col("score")), 9).alias("fused"), F.min("src").alias("src"), F.min("rank").alias("src_rank"))
    order = [F.desc("fused"), F.col("src"), F.col("src_rank")]
    return numbered(g.orderBy(*order).limit(k), order).select("source", "id", "fused", "rank")


def fallback(strict: DataFrame, wide: DataFrame, least: int, k: int) -> DataFrame:
    """strict alone if it has enough hits, else both passes merged; one plan, the count is a row in it."""
    enough = strict.agg((F.count("*") >= least).alias("enough"))
    extra = wide.crossJoin(F.broadcast(enough)).filter("not enough").drop("enough")
    return merge_passes(strict, extra, k)


def group_by_source(hits: DataFrame) -> DataFrame:
    """source and its hits' ids in order of rank."""
    g = hits.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h"))
    return g.select("source", F.transform("h", lambda x: x["id"]).alias("ids"))
