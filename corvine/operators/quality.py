"""Audits and reports: counts by type, presence of fields, status roll-ups, parity, overlaps, merged reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, present, missing; one pass, one row per field."""
    s = df.agg(*(F.count(f).alias(f) for f in fields), F.count("*").alias("_all"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), (F.col("_all") - F.col(f)).alias("missing")) for f in fields))
    return s.select(F.explode(pairs).alias("x")).select("x.*")


def by_type(df: DataFrame, kind: str, has: Column) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(has).alias("n_has"))


def status(files: DataFrame, record: str, done: Column, summarised: Column) -> DataFrame:
    """Per record: files, done, and complete / partial / unprocessed."""
    g = files.groupBy(record).agg(F.count("*").alias("files"), F.count_if(done).alias("done"), F.bool_or(summarised).alias("summarised"))
    s = F.when((F.col("done") == F.col("files")) & F.col("summarised"), "complete").when((F.col("done") > 0) | F.col("summarised"), "partial").otherwise("unprocessed")
    return g.withColumn("status", s)


def parity(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts per key on both sides of a copy, and whether they agree; a key of one side counts 0 on the other."""
    a = old.groupBy(key).agg(F.count("*").alias("n_old"))
    b = new.groupBy(key).agg(F.count("*").alias("n_new"))
    both = a.join(b, key, "full").select(key, F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return both.withColumn("equal", F.col("n_old") == F.col("n_new"))


def overlap(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """How many ids two top-k lists share, and whether they are enough."""
    one = lambda d: d.agg(F.collect_set("id").alias("ids"))  # noqa: E731  lists of k ids
    x = one(a).crossJoin(one(b).withColumnRenamed("ids", "other"))
    n = F.size(F.array_intersect("ids", "other"))
    return x.select(n.cast("long").alias("shared"), (n >= least).alias("enough"))


def record_summary(parts: DataFrame, record: str, order: str, text: str, summarise=None) -> DataFrame:
    """Text per record: none without parts, the only part as it is, several joined in order (or summarised)."""
    p = parts.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    g = p.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))).alias("x"), F.count("*").alias("n"))
    joined = F.array_join(F.transform("x", lambda s: s[text]), "\n\n")
    return g.select(record, "n", F.when(F.col("n") == 1, F.element_at("x", 1)[text]).otherwise(summarise(joined) if summarise else joined).alias("summary"))


def merged_reports(reports: DataFrame, counters: list[str], errors: str) -> DataFrame:
    """One row: counters added, error lists one after the other."""
    return reports.agg(*(F.sum(c).cast("long").alias(c) for c in counters), F.array_sort(F.flatten(F.collect_list(errors))).alias(errors))


def isolation(df: DataFrame, identifier: str, record: str) -> DataFrame:
    """Identifiers that stand for more than one record."""
    g = df.groupBy(identifier).agg(F.countDistinct(record).alias("records"))
    return g.filter("records > 1")
