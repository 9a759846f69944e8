"""The corpus pipeline: stages of corvine.llm applied one after the other to documents, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import exact_dedup, jaccard_join, packing, pii, quality
from corvine.llm.common import NO_ID, cut, numbered, without


#: Numbers the rows of a stage's input: a doc_id may be null or repeated, so rows are dropped by this.
ROW = "_corvine_row"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier accepts, each judged by its text alone, whatever its doc_id.

    Null, empty and wordless texts are rejected; repeated rows are kept or dropped together; very long texts are judged
    whole; other columns, whatever their names, come along; an empty table gives an empty one.
    """
    docs = numbered(docs, ROW)
    rejected = quality.score_documents(docs, columns=[ROW]).filter(~F.col("quality_kept")).select(ROW)
    return without(docs, cut(rejected, "rejected")).drop(ROW)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id (null is the smallest), or one of those.

    Null counts as the empty text. Rows repeated with one doc_id are copies like others, and of ties the row with the
    largest number of its own stays; different texts under one doc_id all stay. Columns come along; empty gives empty.
    """
    docs = numbered(docs, ROW)
    copies = exact_dedup.exact_dedup(docs, row=ROW).filter(~F.col("kept")).select(ROW)
    return without(docs, cut(copies, "copies")).drop(ROW)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (null before all), or one of those.

    Rows are told apart by a number of their own, so null or repeated doc_ids neither join nor drop different texts, and
    of ties the smallest number stays. Null, empty and wordless texts link with nothing and stay. Columns come along.
    """
    docs = numbered(docs, ROW)
    found = jaccard_join.jaccard_join(docs.select(F.col(ROW).alias("doc_id"), "text")).filter("n_links > 0")
    linked = cut(found.select(F.col("doc_id").alias(ROW), "class_id"), "linked")
    ids = docs.select(ROW, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_corvine_id"))
    first = linked.join(ids, ROW).groupBy("class_id").agg(F.min(F.struct("_corvine_id", ROW))[ROW].alias(ROW))
    return without(docs, cut(linked.select(ROW).join(first.select(ROW), ROW, "left_anti"), "copies")).drop(ROW)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind; n_chars follows the text.

    Of spans that begin at one place the first kind in order names the mark, and overlapping spans become one. Null texts
    stay null, with a null n_chars; texts of any length and number of spans are masked whole; empty gives empty.
    """
    d = pii.annotate(docs, pii.fit(docs), to="_corvine_spans").withColumn("text", pii.redact(F.col("text"), F.col("_corvine_spans")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences, a row per piece; every row of docs is packed, also repeated ones and
    those without text (one token) or doc_id. Longer texts are cut into pieces; an empty table gives an empty one."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal),
    ("packing", pack),
]

#: No stage but the second can be told in SQL; tests/llm compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
