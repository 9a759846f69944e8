"""Vector retrieval: exact filtered top-k, quantised top-k with rescoring, hashing to buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array<double> columns; null where one is zero or holds a null."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """vec_id and score of the k nearest of the vectors that pass the filter. query: one row with column q.

    The filter stands below the top-k, so it prunes the scan; the result is a TakeOrderedAndProject.
    """
    v = vectors if where is None else vectors.filter(where)
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    scored = v.crossJoin(F.broadcast(query.limit(1))).select("vec_id", F.round(cosine(F.col("e"), F.col("q")), 6).alias("score"))
    return scored.filter("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)


def quantised(e: Column, levels: int = 127) -> Column:
    """Components scaled by the largest and rounded to small integers."""
    top = F.array_max(F.transform(e, F.abs))
    return F.transform(e, lambda x: F.round(x / top * levels).cast("byte"))


def knn_quantised(vectors: DataFrame, query: DataFrame, k: int, factor: int = 8) -> DataFrame:
    """Top k by exact cosine among the k * factor best by the quantised vectors."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("c", quantised(F.col("e")).cast("array<double>"))
    q = query.limit(1).withColumn("qc", quantised(F.col("q")).cast("array<double>"))
    rough = v.crossJoin(F.broadcast(q)).withColumn("rough", cosine(F.col("c"), F.col("qc"))).orderBy(F.desc("rough"), "vec_id").limit(k * factor)
    return rough.select("vec_id", F.round(cosine(F.col("e"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def knn_hashed(vectors: DataFrame, query: DataFrame, k: int, planes: int = 5, tables: int = 24, seed: int = 3) -> DataFrame:
    """Approximate top k: only vectors that share a sign pattern with the query in one of several hash tables."""
    import random

    spark, rng = vectors.sparkSession, random.Random(seed)
    dim = len(query.first()["q"])
    normals = [[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(planes)] for _ in range(tables)]
    shared = query.limit(1).crossJoin(spark.createDataFrame([(normals,)], "normals array<array<array<double>>>"))

    def signs(e: Column) -> Column:
        side = lambda t: F.array_join(F.transform(t, lambda p: (dot(e, p) >= 0).cast("int").cast("string")), "")
        return F.transform("normals", lambda t, i: F.concat(i.cast("string"), F.lit(":"), side(t)))

    shared = shared.withColumn("qs", signs(F.col("q")))  # one row, so the planes travel as data and not as literals
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).crossJoin(F.broadcast(shared))
    near = v.filter(F.arrays_overlap(signs(F.col("e")), "qs"))
    return near.select("vec_id", F.round(cosine(F.col("e"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def hash_embedding(words: Column, dim: int = 16) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(h, F.lit(0.0), lambda s, x: s + F.when(F.pmod(x, F.lit(dim)) == i, F.when(F.pmod(F.shiftright(x, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
