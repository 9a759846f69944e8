"""Queries over decks, single objects and small checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as X
from corvine.operators import rows
from corvine.plans.catalog import query
from corvine.session import table
from corvine.sources import decks, objects, parsers


@query("SELECT doc_id, md5(text) AS etag FROM documents")
def etag_unquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.unquoted(F.concat(F.lit('"'), F.md5("text"), F.lit('"'))).alias("etag"))


@query("SELECT page_id, page_id % 3 = 1 AS linked FROM pages")
def record_id_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of ids: empty, all of records, one of them not, null."""
    p = table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 3)
    v = F.when(F.col("k") == 0, F.array().cast("array<string>")).when(F.col("k") == 1, F.array(F.lit("recA"), F.concat(F.lit("rec"), "url"))).when(F.col("page_id") % 2 == 0, F.array(F.lit("recA"), F.col("url")))
    return p.select("page_id", X.record_ids(v).alias("linked"))


@query("SELECT doc_id, lang FROM documents")
def attachment_columns_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.array(F.struct(F.lit("u").alias("url"), F.col("source").alias("filename"))).alias("files"))
    return rows.without_attachments(d)


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS \"exists\", (SELECT md5(c_name) FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS etag FROM orders")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether objects exist, and their tags, against a listing."""
    listing = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("raw/"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit('"'), F.md5("c_name"), F.lit('"')).alias("etag"))
    k = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("raw/"), F.col("o_custkey").cast("string")).alias("key"))
    return objects.looked_up(k, listing).select("o_orderkey", "exists", "etag")


@query("SELECT conv_id AS deck, count(DISTINCT turn) AS n, (conv_id % 4 + 2)::BIGINT AS expected, count(DISTINCT turn) >= conv_id % 4 + 2 AS done FROM conversations GROUP BY conv_id")
def deck_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    expected = c.select(F.col("conv_id").alias("deck"), (F.col("conv_id") % 4 + 2).alias("expected")).distinct()
    return decks.complete_decks(c.select(F.col("conv_id").alias("deck"), F.col("turn").alias("slide")), expected)


@query("""WITH c AS (SELECT conv_id AS deck, turn AS slide, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '- ' || role ELSE role END AS title, coalesce(text, '') AS body FROM conversations),
t AS (SELECT *, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS b FROM c), f AS (SELECT *, split_part(b, chr(10), 1) AS line FROM t),
g AS (SELECT *, trim(regexp_replace(trim(line), '^-\\s+', '')) AS own, title IS NULL AND trim(regexp_replace(trim(line), '^-\\s+', '')) <> '' AS borrowed FROM f),
h AS (SELECT deck, slide, CASE WHEN borrowed THEN own ELSE trim(regexp_replace(trim(coalesce(title, '')), '^-\\s+', '')) END AS title, CASE WHEN borrowed THEN regexp_replace(substring(b, length(line) + 1), '^\\s+|\\s+$', '', 'g') ELSE body END AS body FROM g),
i AS (SELECT *, trim('Slide ' || slide || ': ' || title) AS head, CASE WHEN trim(body) <> '' THEN body ELSE '' END AS full_ FROM h),
n AS (SELECT deck, count(*) AS n FROM i GROUP BY 1)
SELECT deck, any_value(n) AS n_slides, md5(string_agg(title, '|' ORDER BY slide)) AS titles, md5(regexp_replace(string_agg('## ' || head || chr(10) || full_, chr(10) || chr(10) ORDER BY slide), '\\n{3,}', chr(10) || chr(10), 'g')) AS markdown,
md5(left(string_agg(regexp_replace(head || chr(10) || left(full_, greatest(100, 600 // n)), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY slide), 600)) AS digest FROM i JOIN n USING (deck) GROUP BY deck""")
def deck_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as slides: titles taken from texts, list marks gone, an even share of the digest for each."""
    c = table(spark, sf_dir, "conversations")
    title = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("- "), "role")).when(F.col("turn") % 3 == 2, F.col("role"))
    s = c.select(F.col("conv_id").alias("deck"), F.col("turn").alias("slide"), title.alias("title"), F.col("text").alias("body"), F.lit("").alias("tables"), F.lit(None).cast("string").alias("visual"))
    d = decks.finalised(s, 600)
    return d.select("deck", "n_slides", F.md5(F.array_join("titles", "|")).alias("titles"), F.md5("markdown").alias("markdown"), F.md5("digest").alias("digest"))


STATS = """s AS (SELECT conv_id, turn, text, length(text) % 500 AS chars, turn % 4 AS shapes, conv_id % 5 = 0 AS tables, (conv_id + turn) % 6 = 0 AS charts, turn % 3 = 0 AS pictures, conv_id % 9 = 1 AS grouped,
  CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE regexp_replace(text, '[a-z]{3,}', '', 'g') END AS parsed, CASE WHEN turn % 2 = 0 THEN '  ' ELSE upper(role) END AS cells, CASE WHEN conv_id % 2 = 0 THEN text ELSE ' ' END AS seen FROM conversations),
k AS (SELECT *, CASE WHEN chars = 0 AND shapes = 0 THEN 'EMPTY' WHEN charts AND chars > 200 THEN 'MIXED' WHEN charts THEN 'DIAGRAM' WHEN grouped THEN 'FRAMEWORK' WHEN pictures AND chars < 120 THEN 'IMAGE' WHEN pictures THEN 'MIXED'
  WHEN tables AND chars < 80 THEN 'TABLE' ELSE 'TEXT' END AS kind, charts OR grouped OR (pictures AND chars < 200) AS visual, length(trim(parsed, E' \\t\\n\\r')) + length(trim(cells, E' \\t\\n\\r')) AS got, length(trim(parsed || ' ' || seen, E' \\t\\n\\r')) AS made FROM s),
n AS (SELECT *, (chars >= 40 AND got < greatest(20, chars // 2)) OR (shapes > 0 AND chars > 0 AND got = 0) AS missed FROM k)"""


@query(f"""WITH {STATS} SELECT conv_id, turn, kind, visual, missed, visual OR missed AS image,
kind IN ('FRAMEWORK', 'DIAGRAM', 'MIXED', 'IMAGE') AND (made < 40 OR (kind IN ('FRAMEWORK', 'DIAGRAM') AND trim(seen, E' \\t\\n\\r') = '')) AS again FROM n""")
def slide_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of slides and the four gates, with turns of conversations as slides whose shapes follow from their numbers."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    stats = F.struct(
        (F.length(text) % 500).alias("text_chars"), (turn % 4).alias("n_shapes"), (conv % 5 == 0).alias("has_table"),
        ((conv + turn) % 6 == 0).alias("has_chart"), (turn % 3 == 0).alias("has_picture"), (conv % 9 == 1).alias("has_group"),
    )
    d = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", stats.alias("s"),
        F.when(conv % 3 == 0, text).when(conv % 3 == 1, "").otherwise(F.regexp_replace(text, "[a-z]{3,}", "")).alias("parsed"),
        F.array(F.when(turn % 2 == 0, "  ").otherwise(F.upper("role"))).alias("cells"),
        F.when(conv % 2 == 0, text).otherwise(" ").alias("seen"),
    )
    d = d.withColumn("kind", parsers.slide_class(F.col("s")))
    gates = (F.col("s"), F.col("parsed"), F.col("cells"))
    return d.select(
        "conv_id", "turn", "kind", parsers.is_visual(F.col("s")).alias("visual"), parsers.needs_image(*gates).alias("missed"),
        parsers.attaches_image(*gates).alias("image"), parsers.needs_escalation(F.col("kind"), F.col("parsed"), F.col("seen")).alias("again"),
    )
