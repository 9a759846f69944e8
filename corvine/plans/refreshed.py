"""Queries of refreshes and copies that touch what changed: facets of keys, summaries, create-only copies, counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import facets
from corvine.plans.catalog import query
from corvine.session import scratch, table
from corvine.sources import objects, sinks
from corvine.streaming import incremental


@query("""SELECT doc_id, unnest(string_split(x, '|')) AS value FROM (SELECT doc_id, coalesce(nullif(trim(source), ''), '') || CASE WHEN trim(lang) <> '' THEN '|' || trim(lang) || ', x' ELSE '' END AS x FROM documents) WHERE x <> ''
EXCEPT SELECT doc_id, '' FROM documents""")
def facets_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of lists, cleaned element by element and not cut at commas; blank ones go."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.array("source", F.concat(F.trim("lang"), F.lit(", x ")), F.lit(" "), F.lit(None)).alias("Practice  Area"))
    d = d.withColumn("Practice  Area", F.transform("Practice  Area", lambda x: F.when(x != ", x ", x)))
    return d.select("doc_id", F.explode(facets.extracted(d, ["Practice  Area"])["practice_area"]).alias("value"))


@query("""WITH l AS (SELECT doc_id, source, lang, CASE WHEN quality > 0 THEN quality END AS grade FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT source, lang, grade FROM l WHERE trim(source) <> '' AND (trim(lang) <> '' OR grade IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1)
SELECT l.doc_id, coalesce(f.lang, l.lang) AS lang, coalesce(f.grade, l.grade)::INT AS grade FROM l LEFT JOIN f USING (source)""")
def facet_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facets of each source's first document that has some, set on all documents of the source, in place."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") > 0, F.col("quality")).cast("int").alias("grade"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(l, "doc_id", "left")
    path = scratch(spark, "facets")
    sinks.write(d, path, "source")
    sinks.update(spark, path, facets.first_per_key(d, "source", "doc_id", ["lang", "grade"]), "source", ["lang", "grade"])
    return sinks.read(spark, path).select("doc_id", "lang", "grade")


@query("""SELECT conv_id, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS summary FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id""")
def summaries_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of records after their later files came: only changed records are made anew."""
    parts = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    path = scratch(spark, "summaries")
    for now, changed in ((parts.filter("turn < 3"), parts), (parts, parts.filter("turn >= 3"))):
        incremental.summaries_refreshed(now, changed, path, "conv_id", "turn", "text")
    return sinks.read(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE o_totalprice::DOUBLE END AS o_totalprice FROM orders")
def reindex_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy in slices and its delta pass: what was there first stays, what came meanwhile is added, each key once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    path = scratch(spark, "copy")
    sinks.write(o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), path, "o_orderkey")
    for source in (o.filter("o_orderstatus <> 'P'"), o):
        sinks.copy(source.drop("o_orderstatus"), path, "o_orderkey")
    return sinks.read(spark, path)


@query("SELECT count(*) AS documents, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty, count(*) FILTER (lang IS NULL) AS unknown FROM documents")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run, observed while its rows are written."""
    d, seen = sinks.counted(table(spark, sf_dir, "documents"), documents=F.count("*"), empty=F.count_if(F.trim(F.coalesce("text", F.lit(""))) == ""), unknown=F.count_if(F.col("lang").isNull()))
    d.select("doc_id", F.sha2("text", 256).alias("digest")).write.parquet(scratch(spark, "run"))
    return spark.createDataFrame([seen.get], "documents long, empty long, unknown long")


@query("""SELECT page_id, 'raw/t/name_' || page_id || '/' || CASE WHEN page_id % 2 = 0 THEN 'cv' ELSE 'cv/name_' || page_id || '__normalized.txt' END AS new_key, 'Name ' || page_id AS identifier,
CASE WHEN page_id % 3 = 0 THEN 'raw/other/x.pdf' ELSE 'raw/t/name_' || page_id || '/cv.pdf' END AS original, page_id AS n, 'rec' || page_id AS was FROM pages""")
def sidecar_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of renamed records: keys and the places in their JSON move, other fields keep value and type."""
    i = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("rec"), i).alias("old"), F.concat(F.lit("name_"), i).alias("new"), F.concat(F.lit("Name "), i).alias("name"))
    key = F.concat(F.lit("raw/t/"), F.col("old"), F.lit("/"), F.when(F.col("page_id") % 2 == 0, "cv").otherwise(F.concat(F.lit("cv/"), F.col("old"), F.lit(objects.NORMALISED))))
    place = F.when(F.col("page_id") % 3 == 0, "raw/other/x.pdf").otherwise(F.concat(F.lit("raw/t/"), F.col("old"), F.lit("/cv.pdf")))
    s = p.select(key.alias("key"), F.to_json(F.struct(F.lit("?").alias("identifier"), place.alias("original_s3_key"), F.struct(F.col("page_id").alias("n")).alias("deep"))).alias("text"))
    f = F.from_json("text", "identifier string, original_s3_key string, deep struct<n: long>, migrated_from_s3_segment string").alias("j")
    out = objects.sidecars_migrated(s, p.select("old", "new", "name")).select("new_key", f)
    return out.select(F.col("j.deep.n").alias("page_id"), "new_key", "j.identifier", F.col("j.original_s3_key").alias("original"), F.col("j.deep.n").alias("n"), F.col("j.migrated_from_s3_segment").alias("was"))
