"""Citations: which hits get a link to which document, and how many of each outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.operators import rows
from corvine.sources.objects import NORMALISED, directory

# Roles of derived chunks, which are never cited.
DERIVED = ("record_summary", "deck_summary", "summary")


def originals(listing: DataFrame) -> DataFrame:
    """dir, original: the first file by name of each directory that is not a derived text or a hidden file."""
    d = listing.filter(~F.col("key").endswith(NORMALISED) & ~F.lower("key").endswith(".txt") & ~F.col("key").rlike(r"/\.[^/]*$"))
    return d.groupBy(directory(F.col("key")).alias("dir")).agg(F.min("key").alias("original"))


def resolved(hits: DataFrame, listing: DataFrame) -> DataFrame:
    """hits (.., role, key, original_key) with link and outcome: derived, skipped, missing or cited."""
    h = hits.withColumn("_c", F.coalesce("original_key", "key")).withColumn("dir", directory(F.col("_c")))
    h = h.join(originals(listing), "dir", "left").drop("dir")
    c = F.when(F.lower("_c").endswith(".txt"), F.col("original")).otherwise(F.col("_c"))
    link = rows.document_link(c)
    derived = F.col("role").isin(*DERIVED)
    outcome = F.when(derived, "derived").when(F.col("_c").isNull(), "skipped").when(link.isNull(), "missing").otherwise("cited")
    return h.withColumn("link", F.when(~F.coalesce(derived, F.lit(False)), link)).withColumn("outcome", outcome).drop("_c", "original")


def outcomes(resolved_hits: DataFrame) -> DataFrame:
    return resolved_hits.groupBy("outcome").agg(F.count("*").alias("n"))


def stripped(hits: DataFrame) -> DataFrame:
    """Structured hits never carry a citation."""
    return hits.withColumn("link", F.when(F.col("source_type") != "structured", F.col("link")))


def warning(diagnostics: DataFrame) -> DataFrame:
    """The first diagnostic that tells of failures, or none."""
    return diagnostics.filter("failed > 0").orderBy("ord").limit(1).select(F.concat(F.col("failed").cast("string"), F.lit(" links could not be made")).alias("warning"))


def base_url(url: str | None) -> str | None:
    """A usable base address: blank ones, placeholders in angle brackets and other schemes count as unset."""
    u = (url or "").strip().rstrip("/")
    return u if u.startswith(("http://", "https://")) and "<" not in u else None
