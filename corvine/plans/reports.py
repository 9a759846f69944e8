"""Audit, report, join, set and ordering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import fusion, ordered, quality
from corvine.plans.catalog import query
from corvine.session import table
from corvine.sources import records


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_has FROM events GROUP BY event_type")
def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.by_type(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50)


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


@query()
def cardinality_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id", 0.01).alias("users"))


@query("SELECT min(ts) AS first, max(ts) AS last FROM events")
def minmax_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("""SELECT 'quality' AS field, count(quality) AS present, count(*) - count(quality) AS missing FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic', count(toxic), count(*) - count(toxic) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count(lang), count(*) - count(lang) FROM documents""")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.presence(d, ["quality", "toxic", "lang"])


@query("SELECT 'p_name' AS field, count(p_name) AS present, count(*) - count(p_name) AS missing FROM part UNION ALL SELECT 'p_size', count(p_size), count(*) - count(p_size) FROM part")
def populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.presence(table(spark, sf_dir, "part"), ["p_name", "p_size"])


@query("SELECT DISTINCT coalesce(quality::VARCHAR, '__none__') AS bucket FROM documents LEFT JOIN labels USING (doc_id)")
def distinct_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(F.coalesce(F.col("quality").cast("string"), F.lit("__none__")).alias("bucket")).distinct()


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY n DESC, conv_id LIMIT 25")
def children_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "conv_id").limit(25)


STATUS = """s AS (SELECT source, count(*) AS files, count(quality) AS done, coalesce(bool_or(toxic = 1), false) AS summarised FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
t AS (SELECT *, CASE WHEN done = files AND summarised THEN 'complete' WHEN done > 0 OR summarised THEN 'partial' ELSE 'unprocessed' END AS status FROM s)"""


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.status(d, "source", F.col("quality").isNotNull(), F.coalesce(F.col("toxic") == 1, F.lit(False)))


@query(f"WITH {STATUS} SELECT source, files, done, status FROM t")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir).select("source", "files", "done", "status")


@query(f"WITH {STATUS} SELECT status, count(*) AS n FROM t GROUP BY status")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS summary, count(*) AS n FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id) SELECT conv_id, n, summary FROM p""")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.record_summary(table(spark, sf_dir, "conversations").filter("role = 'assistant'"), "conv_id", "turn", "text")


@query("SELECT sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic, string_agg(e, ',' ORDER BY e) AS errors FROM (SELECT quality, toxic, CASE WHEN toxic = 1 AND quality = 0 THEN 'e' || lpad(doc_id::VARCHAR, 9, '0') END AS e FROM labels)")
def merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").withColumn("errors", F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.array(F.concat(F.lit("e"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))).otherwise(F.array().cast("array<string>")))
    return quality.merged_reports(r, ["quality", "toxic"], "errors").withColumn("errors", F.array_join("errors", ","))


@query("""WITH a AS (SELECT o_orderstatus, count(*) AS n_old FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderstatus, count(*) AS n_new FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT o_orderstatus, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new, coalesce(n_old, 0) = coalesce(n_new, 0) AS equal FROM a FULL JOIN b USING (o_orderstatus)""")
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return quality.parity(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderstatus <> 'P'"), "o_orderstatus")


@query("""WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 10)
SELECT count(*) AS shared, count(*) >= 5 AS enough FROM a JOIN b USING (p_partkey)""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return quality.overlap(p.orderBy(F.desc("p_retailprice"), "id").limit(10), p.orderBy(F.desc("p_size"), F.desc("p_retailprice"), "id").limit(10), 5)


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT source, count(*) AS hits, count(*) FILTER (n_chars > 2000) AS hints, max(n_chars) AS slowest FROM documents GROUP BY source")
def source_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("hits"), F.count_if(F.col("n_chars") > 2000).alias("hints"), F.max("n_chars").alias("slowest"))


@query("SELECT left(p_name, 6) AS ident, count(DISTINCT p_brand) AS records FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def isolation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.isolation(table(spark, sf_dir, "part").withColumn("ident", F.left("p_name", F.lit(6))), "ident", "p_brand")


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id % 100 AS page_id FROM pages) GROUP BY page_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 100).alias("page_id")).groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0)")
def hash_skip_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content is not indexed yet, whatever their key (the indexed ones: every tenth)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.join(d.filter("doc_id % 10 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents")
def hash_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("keep"))
    return d.join(first, "h").select("doc_id", (F.col("doc_id") == F.col("keep")).alias("first"))


@query("SELECT conv_id, turn, conv_id || '::' || turn AS custom_id, l.quality FROM conversations JOIN labels l ON l.doc_id = conv_id")
def batch_results_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results back to jobs by an id whose suffix behind :: is cut."""
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("::", "conv_id", "turn").alias("custom_id"))
    r = r.withColumn("doc_id", F.split("custom_id", "::")[0].cast("long"))
    return r.join(table(spark, sf_dir, "labels"), "doc_id").select("conv_id", "turn", "custom_id", "quality")


@query("SELECT n_nationkey, n_name, s.name FROM nation LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS name FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s_nationkey = n_nationkey")
def first_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each directory its first file that is not derived, or none."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min_by("s_name", "s_suppkey").alias("name"))
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").select("n_nationkey", "n_name", "name")


@query("SELECT event_id, lower(trim('  USER' || user_id || '@X.org ')) AS email, c_name FROM events LEFT JOIN customer ON lower('user' || c_custkey || '@x.org') = lower(trim('  USER' || user_id || '@X.org '))")
def email_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.lower(F.trim(F.concat(F.lit("  USER"), "user_id", F.lit("@X.org ")))).alias("email"))
    c = table(spark, sf_dir, "customer").select(F.lower(F.concat(F.lit("user"), "c_custkey", F.lit("@x.org"))).alias("email"), "c_name")
    return e.join(c, "email", "left").select("event_id", "email", "c_name")


@query("SELECT l_orderkey, l_linenumber, coalesce(o_orderpriority, 'none') AS priority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON o_orderkey = l_orderkey")
def backfill_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return li.join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("o_orderpriority", F.lit("none")).alias("priority"))


@query("SELECT doc_id, lang, source, NULL::BIGINT AS turn, 0 AS source_ord FROM documents UNION ALL SELECT conv_id, NULL, role, turn, 1 FROM conversations")
def union_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("source"), "turn")
    return records.union_lists([a, b])


@query("""WITH x AS (SELECT n_regionkey, list_concat(['first', max(n_name)], list(n_name ORDER BY n_nationkey DESC)) AS l FROM nation GROUP BY 1)
SELECT n_regionkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS fields FROM x""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one list, then those of another that are new, in their order."""
    by = F.array_sort(F.collect_list(F.struct((-F.col("n_nationkey")).alias("k"), "n_name")))
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(by, lambda x: x["n_name"]).alias("x"), F.max("n_name").alias("m"))
    return g.select("n_regionkey", F.array_join(F.array_union(F.array(F.lit("first"), F.col("m")), "x"), ",").alias("fields"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").subtract(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT * FROM (SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def overfetch_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(max(50, 5 * 10))
    return wide.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY rank LIMIT 40")
def rerank_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return fusion.numbered(table(spark, sf_dir, "orders").orderBy(*order).limit(40), order).select("o_orderkey", "rank")


HEADED = "h AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN left(text, 12) END AS heading FROM conversations)"


@query(f"WITH {HEADED} SELECT conv_id, turn, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS heading FROM h")
def heading_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ordered.forward_fill(F.when(F.col("role") == "user", F.left("text", F.lit(12))), ["conv_id"], ["turn"]).alias("heading"))


@query("SELECT user_id, event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM events")
def running_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", ordered.island(F.col("event_type") == "click", ["user_id"], ["ts", "event_id"]).cast("long").alias("island"))


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def previous_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ordered.previous(F.col("text"), ["conv_id"], ["turn"]).alias("before"))


@query("SELECT doc_id, source || '::' || ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 35) AS grp FROM documents")
def slide_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("::", "source", ordered.groups_of(["source"], ["doc_id"], 35).cast("string")).alias("grp"))


@query()
def wave_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders packed whole, in order, into waves of at most 20 lines, per customer."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    g = table(spark, sf_dir, "orders").join(n, "o_orderkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "n"))).alias("x"))
    w = g.withColumn("w", ordered.waves(F.transform("x", lambda s: s["n"]), 20))
    return w.select("o_custkey", F.explode(F.arrays_zip("x", "w")).alias("z")).select("o_custkey", "z.x.o_orderkey", F.col("z.w").alias("wave"))


@query("""WITH g AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY source),
p AS (SELECT source, ids, len(ids) AS n FROM g)
SELECT source, CASE WHEN n <= 12 THEN list_aggregate(ids, 'string_agg', ',') ELSE list_aggregate(list_transform(list_sort(list_distinct(list_transform(range(12), lambda i: round_even(i * (n - 1) / 11.0::DOUBLE, 0)::INT))), lambda k: ids[k + 1]), 'string_agg', ',') END AS ids FROM p""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return g.select("source", F.array_join(F.transform(ordered.even_sample(F.col("ids")), lambda i: i.cast("string")), ",").alias("ids"))


@query()
def shard_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ordered.shard(F.col("source"), 4).alias("shard"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
n AS (SELECT *, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n)
SELECT doc_id, pos, line FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) <= 3""")
def dup_line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return ordered.limit_runs(d, ["doc_id"], "pos", "line").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ref FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 40)")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.numbered(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey").orderBy("o_orderkey").limit(40), [F.col("o_orderkey")], "ref")
