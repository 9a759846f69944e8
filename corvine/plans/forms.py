"""Queries of small forms: ids, facet values, headings in front of blocks, summaries as chunks, model replies, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as X
from corvine.operators import chunks, citations
from corvine.plans.catalog import query
from corvine.session import table
from corvine.sources import parsers


@query("SELECT doc_id, regexp_replace(coalesce(source || '/' || lang || ' é.' || doc_id, ''), '[^A-Za-z0-9_-]+', '_', 'g') AS part FROM documents")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.id_part(F.concat("source", F.lit("/"), "lang", F.lit(" é."), F.col("doc_id").cast("string"))).alias("part"))


@query("SELECT p_partkey, trim(p_brand || ' & 12 ' || p_type) AS value FROM part")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display values with full-width signs and digits folded, case and inner spaces kept."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.facet_value(F.concat(F.lit(" "), "p_brand", F.lit(" ＆ １２ "), "p_type", F.lit("  "))).alias("value"))


@query("SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), CASE WHEN turn % 3 > 0 THEN role END, text)) AS h FROM conversations")
def context_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What blocks are embedded with: their heading in front, where there is one."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(chunks.with_context(F.col("text"), F.when(F.col("turn") % 3 > 0, F.col("role")))).alias("h"))


@query("""SELECT conv_id AS doc_id, 0::BIGINT AS parent, 0::BIGINT AS child, md5(string_agg(concat_ws(chr(10) || chr(10), role, nullif(text, '')), chr(10) || chr(10) ORDER BY turn)) AS h, 'summary' AS kind
FROM conversations GROUP BY conv_id""")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the one chunk of a summary."""
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("heading"), F.col("text").alias("body"))
    return chunks.chunk(s, "summary").select("doc_id", "parent", "child", F.md5("text").alias("h"), "kind")


@query(r"""SELECT conv_id AS id, (turn + 1)::INT AS slide, role AS title, md5(regexp_replace(CASE WHEN turn % 2 = 0 THEN '> ' ELSE '' END || coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS body FROM conversations""")
def replies_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model, one for each conversation, taken apart by slide; every other slide is told twice, and the last counts."""
    c = table(spark, sf_dir, "conversations")
    told = lambda mark: F.concat(F.lit("=== SLIDE "), (F.col("turn") + 1).cast("string"), F.lit(" ===\nTITLE: "), "role", F.lit("\nTEXT: "), F.lit(mark), F.coalesce("text", F.lit("")), F.lit("\n"))
    both = c.select("conv_id", F.lit(0).alias("k"), "turn", told("").alias("part")).unionByName(c.filter("turn % 2 = 0").select("conv_id", F.lit(1).alias("k"), "turn", told("> ").alias("part")))
    replies = both.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "turn", "part"))), lambda x: x["part"]), "").alias("reply"))
    return parsers.reply_slides(replies).select("id", "slide", F.col("fields.title").alias("title"), F.md5("fields.text").alias("body"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'raw/' || doc_id END AS link FROM documents")
def citations_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of structured sources never carry a citation."""
    kind = F.when(F.col("lang").isin("en", "de"), "text").otherwise("structured")
    d = table(spark, sf_dir, "documents").select("doc_id", kind.alias("source_type"), F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("link"))
    return citations.stripped(d).select("doc_id", "link")


@query("""SELECT failed || ' links could not be made' AS warning FROM (SELECT source, min(doc_id) AS ord, count(*) FILTER (toxic = 1) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
WHERE failed > 0 ORDER BY ord LIMIT 1""")
def resolve_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warning of the first source with failures; no row where all went well."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return citations.warning(d.groupBy("source").agg(F.min("doc_id").alias("ord"), F.count_if(F.col("toxic") == 1).alias("failed")))
