"""Queries over object keys, sinks, incremental scans and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as X
from corvine.operators import citations, rows
from corvine.plans.catalog import query
from corvine.session import scratch, table
from corvine.sources import objects, records, sinks
from corvine.streaming import incremental

KEYS = "k AS (SELECT page_id, 'raw/t' || (page_id % 3) || CASE WHEN page_id % 5 = 0 THEN '.x' ELSE '' END || '/' || page_id || '/' || CASE WHEN page_id % 4 = 0 THEN 'cv.pdf' WHEN page_id % 4 = 1 THEN 'cv/a.docx' ELSE 'cv/b__normalized.txt' END AS key FROM pages)"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    tail = F.when(F.col("page_id") % 4 == 0, "cv.pdf").when(F.col("page_id") % 4 == 1, "cv/a.docx").otherwise("cv/b__normalized.txt")
    dot = F.when(F.col("page_id") % 5 == 0, ".x").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("raw/t"), (F.col("page_id") % 3).cast("string"), dot, F.lit("/"), i, F.lit("/"), tail).alias("key"))


@query(f"WITH {KEYS} SELECT page_id, split_part(key, '/', 2) AS table_name, split_part(key, '/', 3) AS primary_key, 'cv' AS column_name, CASE WHEN page_id % 4 = 0 THEN 'cv.pdf' ELSE split_part(key, '/', 5) END AS filename FROM k")
def parse_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir).select("page_id", objects.parsed_key(F.col("key")).alias("p")).select("page_id", "p.*")


@query(f"WITH {KEYS} SELECT page_id, CASE WHEN key LIKE 'raw/t1.x/%' THEN 'one_dotted' WHEN key LIKE 'raw/t1%' THEN 'one' WHEN key LIKE 'raw/t2/2%' THEN 'twos' ELSE 'default' END AS route FROM k")
def prefix_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of several prefixes decides; keys without one go to the fallback."""
    tables = spark.createDataFrame([("raw/t2/2", "twos"), ("raw/t1", "one"), ("raw/t1.x/", "one_dotted")], "prefix string, name string")
    return objects.routed(keys(spark, sf_dir), tables, "default").select("page_id", "route")


@query("WITH f AS (SELECT page_id, 'raw/t/' || (page_id // 3) || '/c/f' || page_id || CASE WHEN page_id % 6 = 1 THEN '__normalized.txt' ELSE '.pdf' END AS key, page_id // 3 AS dir FROM pages) SELECT page_id FROM f WHERE key LIKE '%__normalized.txt' OR dir NOT IN (SELECT dir FROM f WHERE key LIKE '%__normalized.txt')")
def sibling_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    ext = F.when(F.col("page_id") % 6 == 1, "__normalized.txt").otherwise(".pdf")
    f = p.select("page_id", F.concat(F.lit("raw/t/"), F.floor(F.col("page_id") / 3).cast("string"), F.lit("/c/f"), F.col("page_id").cast("string"), ext).alias("key"))
    return objects.prefer_normalised(f).select("page_id")


@query(f"WITH {KEYS} SELECT page_id, key LIKE '%.pdf' AS kept FROM k")
def extension_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, skipped = objects.allowed(keys(spark, sf_dir), [".pdf"])
    return kept.select("page_id", F.lit(True).alias("kept")).union(skipped.select("page_id", F.lit(False)))


@query(f"WITH {KEYS} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'v' || page_id END AS owner FROM k")
def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a directory's sidecar; odd ones are broken JSON and give none."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("raw/t/"), F.col("page_id").cast("string"), F.lit("/f.pdf")).alias("key"))
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"owner": "v'), F.col("page_id").cast("string"), F.lit('"}'))).otherwise("{broken")
    s = p.select(F.replace("key", F.lit("f.pdf"), F.lit(objects.SIDECAR)).alias("key"), text.alias("text"))
    return objects.with_sidecar(p, s).select("page_id", F.col("meta")["owner"].alias("owner"))


@query("WITH k AS (SELECT page_id, 'raw/t/' || (page_id % 40) || '/f' || (page_id % 2) AS key FROM pages), r AS (SELECT DISTINCT key, replace(key, 'raw/t/' || split_part(key, '/', 3) || '/', 'raw/t/n' || (split_part(key, '/', 3)::INT % 10) || '/') AS new_key FROM k) SELECT min(key) AS key, new_key FROM r WHERE new_key <> 'raw/t/n3/f1' GROUP BY new_key")
def key_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed segments: existing targets skipped, the first of several sources wins."""
    k = table(spark, sf_dir, "pages").select(F.concat(F.lit("raw/t/"), (F.col("page_id") % 40).cast("string"), F.lit("/f"), (F.col("page_id") % 2).cast("string")).alias("key")).distinct()
    renames = spark.range(40).select(F.col("id").cast("string").alias("old"), F.concat(F.lit("n"), (F.col("id") % 10).cast("string")).alias("new"))
    return objects.migrated(k, renames, spark.createDataFrame([("raw/t/n3/f1",)], "key string"))


@query(f"WITH {KEYS} SELECT page_id, page_id % 4 >= 2 AS done FROM k")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keys(spark, sf_dir)
    want = F.regexp_replace("key", r"cv(\.pdf|/a\.docx)$", "cv/b__normalized.txt")
    e = k.select("page_id", "key", want.alias("normalised_key"), F.lit(True).alias("normalises"))
    return objects.complete(e, k.filter("page_id % 4 >= 2")).select("page_id", "done")


NEW = "n AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_orderstatus, 1 AS seq FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice * 3, o_orderstatus, 2 FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT -o_orderkey, 1.0, 'N', 1 FROM orders WHERE o_orderkey % 10 = 1), l AS (SELECT * EXCLUDE seq FROM n QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)"


@query(f"WITH {NEW} SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l) UNION ALL SELECT * FROM l")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("seq", F.lit(1))
    new = new.union(o.filter("o_orderkey % 6 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 3).withColumn("seq", F.lit(2)))
    new = new.union(o.filter("o_orderkey % 10 = 1").select(-F.col("o_orderkey"), F.lit(1.0), F.lit("N"), F.lit(1)))
    return sinks.upserted(o, new, "o_orderkey", "seq").drop("seq")


@query(f"WITH {NEW}, u AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l) UNION ALL SELECT * FROM l) SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 2 THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM u WHERE o_orderkey % 7 <> 1")
def upsert_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in a bucketed table, then an upsert, a delete and an update, each of which writes the buckets of its keys."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), scratch(spark, "orders")
    sinks.write(o, path, "o_orderkey")
    new = o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    new = new.filter("o_orderkey % 6 <> 0").union(o.filter("o_orderkey % 6 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 3))
    sinks.upsert(spark, path, new.union(o.filter("o_orderkey % 10 = 1").select(-F.col("o_orderkey"), F.lit(1.0), F.lit("N"))), "o_orderkey")
    sinks.delete(spark, path, o.filter("o_orderkey % 7 = 1").select("o_orderkey"), "o_orderkey")
    sinks.update(spark, path, o.filter("o_orderkey % 9 = 2").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), "o_orderkey", ["o_totalprice"])
    return sinks.read(spark, path)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sinks.deleted(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), k, "l_orderkey")


@query("SELECT c_custkey, c_name, CASE WHEN n_nationkey IS NOT NULL THEN upper(n_name) ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 2) ON n_nationkey = c_nationkey")
def update_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("c_mktsegment"))
    return sinks.updated(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), n, "c_nationkey", ["c_mktsegment"]).drop("c_nationkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) ORDER BY c_custkey LIMIT 100")
def reindex_create_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.copied(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), t, "c_custkey", 100)


@query("SELECT doc_id, l.quality FROM documents JOIN labels l USING (doc_id) WHERE doc_id % 2 = 0")
def scroll_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 1, 9).alias("quality"))
    return sinks.patched(d, "quality", table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT s.doc_id, s.lang, s.source, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'doc' END AS doc_role FROM documents s")
def hoisted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", F.col("source")).alias("source"), F.when(F.col("doc_id") % 2 == 0, "own").alias("chunk_role"), F.lit("doc").alias("doc_role"))
    return sinks.hoisted(c)


@query("""SELECT '{"doc_id":' || doc_id || coalesce(',"lang":"' || lang || '"', '') || ',"metadata":{"a":"x"}}' AS json FROM documents""")
def response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    m = rows.redacted(F.create_map(F.lit("a"), F.lit("x"), F.lit("secret"), F.lit("y"), F.lit("key"), F.lit("f.TXT")), ["secret"], ["key"])
    return sinks.envelope(d, m)


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.changed(table(spark, sf_dir, "events"), ["ts"], "2024-01-20 00:00:00").select("event_id", "ts")


@query("SELECT strftime(date_trunc('second', max(ts)), '%Y-%m-%dT%H:%M:%SZ') AS cursor FROM events")
def incremental_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.next_cursor(table(spark, sf_dir, "events"), "ts")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.point(table(spark, sf_dir, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


@query("SELECT doc_id, 0::BIGINT AS pos, source AS id, 'f.pdf' AS filename, n_chars::INT AS size FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, 'attachment_1', 'attachment_1', NULL FROM documents")
def attachment_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda i, f, u, n: F.struct(i.alias("id"), f.alias("filename"), u.alias("url"), n.alias("size"))
    none = F.lit(None).cast("string")
    first = s(F.col("source"), F.lit("f.pdf"), F.when(F.col("doc_id") % 3 == 0, "u"), F.col("n_chars").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(first, s(none, none, F.lit("u"), F.lit("big"))).alias("files"))
    return rows.attachments(d, "doc_id", "files").select("doc_id", F.col("pos").cast("long").alias("pos"), "id", "filename", "size")


@query("SELECT 'c_mktsegment' AS field, 'string' AS type, 5 AS n UNION ALL SELECT 'c_name', 'string', NULL UNION ALL SELECT 'c_custkey', 'bigint', NULL UNION ALL SELECT 'c_nationkey', 'int', NULL UNION ALL SELECT 'c_acctbal', 'double', NULL")
def schema_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = records.schema_digest(table(spark, sf_dir, "customer"))
    return d.select("field", "type", F.when(F.col("choices").isNotNull(), F.size("choices")).alias("n"))


LISTED = "hits AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'deck_summary' END AS role, 'raw/t/' || (page_id // 2) || '/c/' || CASE WHEN page_id % 2 = 0 THEN 'f.pdf' ELSE 'f__normalized.txt' END AS key FROM pages)"


def citation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    key = F.concat(F.lit("raw/t/"), F.floor(F.col("page_id") / 2).cast("string"), F.lit("/c/"), F.when(F.col("page_id") % 2 == 0, "f.pdf").otherwise("f__normalized.txt"))
    return p.select("page_id", F.when(F.col("page_id") % 7 == 0, "deck_summary").alias("role"), key.alias("key"), F.lit(None).cast("string").alias("original_key"))


@query(f"WITH {LISTED} SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'derived' WHEN page_id % 2 = 1 AND page_id NOT IN (SELECT page_id + 1 FROM pages) THEN 'missing' ELSE 'cited' END AS outcome, CASE WHEN page_id % 7 <> 0 AND (page_id % 2 = 0 OR page_id IN (SELECT page_id + 1 FROM pages)) THEN 'raw/t/' || (page_id // 2) || '/c/f.pdf' END AS link FROM hits")
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of hits: derived texts point to the original beside them."""
    h = citation_hits(spark, sf_dir)
    return citations.resolved(h, h.select("key")).select("page_id", "outcome", "link")


@query(f"WITH {LISTED} SELECT CASE WHEN page_id % 7 = 0 THEN 'derived' ELSE 'cited' END AS outcome, count(*) AS n FROM hits GROUP BY 1")
def citation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = citation_hits(spark, sf_dir)
    return citations.outcomes(citations.resolved(h, h.select("key")))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries of jobs: purchases succeed, others fail."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("t").alias("target"), F.col("user_id").cast("string").alias("record_id"), F.when(F.col("event_type") == "purchase", "ok").otherwise("retry").alias("result"), F.col("event_id").alias("seq"))


LEDGER = """WITH e AS (SELECT user_id::VARCHAR AS record_id, event_id, event_type = 'purchase' AS ok FROM events),
l AS (SELECT record_id, max(event_id) FILTER (ok) AS done FROM e GROUP BY record_id),
n AS (SELECT record_id, count(*) FILTER (event_id > coalesce(done, -1)) AS n FROM e JOIN l USING (record_id) GROUP BY record_id)
SELECT 't' AS target, record_id, CASE WHEN n = 0 THEN 'done' WHEN n >= 5 THEN 'dead' ELSE 'failed' END AS status, n::INT AS attempts, n = 0 AS deleted FROM n"""


@query(LEDGER)
def attempt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.ledger_batch(deliveries(spark, sf_dir))


@query(LEDGER)
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger, kept by a stream with state per job and upserted into a snapshot table."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a glob, as a stream takes no single file
    d = e.select(F.lit("t").alias("target"), F.col("user_id").cast("string").alias("record_id"), F.when(F.col("event_type") == "purchase", "ok").otherwise("retry").alias("result"), F.col("event_id").alias("seq"))
    target, state = scratch(spark, "ledger"), scratch(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        sinks.ensure(batch.sparkSession, target, batch.schema)
        sinks.upsert(batch.sparkSession, target, batch, "record_id")

    incremental.ledger(d).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sinks.read(spark, target)


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of orders into a snapshot table with the last order of each customer."""
    schema = table(spark, sf_dir, "orders").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/order[s].parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    target = scratch(spark, "last_orders")
    incremental.upsert_batches(s, target, "o_custkey", "o_orderkey", scratch(spark, "state"))
    return sinks.read(spark, target)


@query()
def flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in batches of 20 turns, per eighth of them."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("part", F.col("conv_id") % 8)
    return incremental.flush_batches(n, "conv_id", "n", 20)


@query("SELECT doc_id, CASE WHEN trim(lang) <> '' THEN lang END AS language FROM documents")
def facet_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of a record: slugged keys, blanks left out."""
    d = table(spark, sf_dir, "documents")
    m = F.create_map(X.slug(F.lit("Language "), "x", fold=False), F.col("lang"), F.lit("empty_field"), F.lit(" "))
    m = F.map_filter(m, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")
    return d.select("doc_id", m["language"].alias("language"))
