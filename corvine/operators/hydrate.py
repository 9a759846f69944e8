"""What happens to fused hits: parents and summaries attached, entities deduplicated, metadata overlaid, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (group-wise top 1). Null keys are one key, as None equals None."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (chunk_id, parent_id, text, ord) with their parent's text, each parent once, by its first hit.

    Hits without a parent id are all kept with their own text, as are hits whose parent is missing.
    """
    once = first_per(hits.filter("parent_id is not null"), [F.col("parent_id")], [F.col("ord")]).unionByName(hits.filter("parent_id is null"))
    p = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return once.join(p, "parent_id", "left").withColumn("text", F.coalesce("parent_text", "text")).drop("parent_text")


def best_per_entity(hits: DataFrame, k: int, key: str = "pk") -> DataFrame:
    """The best hit of each entity (ties: the earlier), hits without one behind all others; k in all.

    Order: with entity first, score, then where the entity first appeared.
    """
    w = W.partitionBy(key)
    h = hits.withColumn("has", F.coalesce(F.col(key) != "", F.lit(False)))
    known = h.filter("has").withColumn("first_ord", F.min("ord").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "ord"))).filter("_n = 1").drop("_n")
    rest = h.filter("not has").withColumn("first_ord", F.col("ord"))
    return known.unionByName(rest).orderBy(F.desc("has"), F.desc("score"), "first_ord").limit(k)


def summaries(hits: DataFrame, found: DataFrame, key: str, to: str) -> DataFrame:
    """hits with the first summary text (by ord) of their key in found, or null."""
    s = found.groupBy(key).agg(F.min_by("text", "ord").alias(to))
    return hits.join(s, key, "left")


def overlay(*maps: Column) -> Column:
    """Maps laid over each other, later keys winning; null values are dropped first, and a null map holds nothing.

    A key stays in the last map that has it only, so that no key meets itself, whatever the session says of such keys.
    """
    own = [F.coalesce(F.map_filter(m, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>")) for m in maps]
    out = own[-1]
    for m in own[-2::-1]:
        out = F.map_concat(without_keys(m, out), out)
    return out


def without_keys(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))


def lexical_score(query: str, text: pd.Series) -> pd.Series:
    """The stand-in for a reranking model: share of the query's words in the text."""
    words = set(query.lower().split())
    return text.fillna("").str.lower().str.split().map(lambda t: len(words & set(t)) / max(1, len(words))).astype(float)


def rerank(hits: DataFrame, query: str, score: Callable[[str, pd.Series], pd.Series] = lexical_score, chars: int = 5000) -> DataFrame:
    """hits (.., text, ord) with rerank_score of the first `chars` characters, by a scorer called per Arrow batch.

    A scorer that fails leaves null scores, so that the order stays what it was.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                b["rerank_score"] = score(query, b["text"].str[:chars])
            except Exception:  # noqa: BLE001  a search goes on without its reranker
                b["rerank_score"] = None
            yield b

    from pyspark.sql.types import DoubleType, StructType

    return hits.mapInPandas(run, StructType([*hits.schema.fields]).add("rerank_score", DoubleType()))


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32, prefix: str = "passage: ") -> DataFrame:
    """child chunks with an embedding from a pluggable model, in batches; a batch that fails or has another length gets nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list = []
            for i in range(0, len(f), batch):
                part = [prefix + t for t in f["text"].iloc[i : i + batch].fillna("")]
                try:
                    got = model(part)
                    out += [list(map(float, e)) if len(e) == dim else None for e in got]
                except Exception:  # noqa: BLE001  one batch's failure is that batch's
                    out += [None] * len(part)
            f["embedding"] = out
            yield f

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    children = chunks.filter("chunk_type = 'child'")
    return children.mapInPandas(run, StructType([*children.schema.fields]).add("embedding", ArrayType(DoubleType())))


def hints(final: DataFrame) -> DataFrame:
    """One follow-up hint per final hit that has an entity."""
    return final.filter("pk is not null and pk <> ''").select(F.lit("lookup").alias("kind"), F.col("pk").alias("key"), "ord")


def truncation_hints(cut: DataFrame) -> DataFrame:
    """One hint per field of which values were cut (field, n), with how many."""
    return cut.filter("n > 0").select(F.lit("truncated").alias("kind"), F.col("field").alias("key"), F.lit(None).cast("long").alias("ord"), F.col("n").cast("long").alias("n"))
