"""Queries over structured rows: formulas, tags, links, facets, hydration and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import render
from corvine.functions import text as X
from corvine.operators import facets, fusion, hydrate, rows
from corvine.plans.catalog import query
from corvine.session import table


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 5000 OR instr(lower(c_name), '00012') > 0)")
def lookup_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = "AND({c_mktsegment}='BUILDING', OR({c_acctbal}>5000, FIND('00012', LOWER({c_name}))))"
    return rows.select(table(spark, sf_dir, "customer"), f, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) IN (SELECT 'customer#' || lpad((7 * i)::VARCHAR, 9, '0') FROM range(1, 46) t(i))")
def lookup_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """45 keys in three formulas of at most 20, whatever the case."""
    from functools import reduce

    from corvine.functions import formula

    t = table(spark, sf_dir, "customer")
    parts = formula.any_of("c_name", [f"Customer#{7 * i:09d}" for i in range(1, 46)])
    return reduce(DataFrame.union, [rows.select(t, p, ["c_custkey", "c_name"]) for p in parts])


@query("SELECT e.event_id, e.ts FROM events e WHERE e.ts > TIMESTAMP '2024-01-15 00:00:00' AND e.event_type = 'click'")
def formula_is_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    from corvine.functions import formula

    c = formula.compile("AND(IS_AFTER(LAST_MODIFIED_TIME({value}), DATETIME_PARSE('2024-01-15 00:00:00')), {event_type}='click')", {c: F.col(c) for c in t.columns}, F.col("ts"))
    return t.filter(c).select("event_id", "ts")


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || '…[truncated]' ELSE text END AS text FROM documents")
def truncate_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.cut_long(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@query("SELECT 'text' AS field, count(*) FILTER (length(text) > 800) AS n FROM documents UNION ALL SELECT 'source', count(*) FILTER (length(source) > 800) FROM documents")
def truncated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.count_long(table(spark, sf_dir, "documents"), ["text", "source"])


@query("SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 50")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    return rows.select(t, "{c_nationkey}=3", ["c_custkey", "c_name"], 500, ["c_custkey"], ("c_mktsegment", "c_nationkey"))


@query("SELECT doc_id, lang, CASE WHEN source IS NULL THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, lang, NULL FROM documents WHERE doc_id % 2 = 0")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("key"), F.when(F.col("doc_id") % 2 == 0, "raw/a.TXT").otherwise(F.col("source")))
    m = rows.redacted(m, ["n_chars"], ["key"])
    return d.select("doc_id", m["lang"].alias("lang"), m["key"].alias("source"))


@query(f"""SELECT doc_id, CASE WHEN p AND c THEN '{rows.BOTH_TAG}' || ' ' || body WHEN p THEN '{rows.PROJECT_TAG}' || ' ' || body WHEN c THEN '{rows.CLIENT_TAG}' || ' ' || body ELSE body END AS text
FROM (SELECT d.doc_id, text AS body, l.toxic = 1 AND source <> 'src0' AS p, l.quality = 0 AND source <> 'src0' AS c FROM documents d JOIN labels l USING (doc_id))""")
def tag_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    flag = lambda c: rows.confidential(F.array(F.when(c, " confidential ").otherwise("open")))
    return d.select("doc_id", rows.tagged(F.col("text"), flag(F.col("toxic") == 1), flag(F.col("quality") == 0), F.col("source") != "src0").alias("text"))


@query("""SELECT DISTINCT c_custkey, c_name FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS k FROM customer) JOIN orders ON o_custkey = c_custkey
WHERE o_totalprice > 300000 AND k <> '' ORDER BY c_custkey LIMIT 50""")
def enrich_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the names that large orders carry in capitals; blank and missing names meet nothing."""
    blank = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_name"))
    c = table(spark, sf_dir, "customer").withColumn("k", blank)
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    hits = large.join(c, "c_custkey").select(F.upper("k").alias("pk"))
    own = c.select(F.col("k").alias("name"), "c_custkey", "c_name")
    return rows.enrich(own, hits, "name", limit=2**31 - 1).orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("""WITH x AS (SELECT o_orderkey, [o_custkey % 30, 999, o_custkey % 7] AS ids FROM orders),
e AS (SELECT o_orderkey, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM x),
g AS (SELECT o_orderkey, string_agg(n_name, ',' ORDER BY pos) FILTER (n_name IS NOT NULL) AS known, string_agg(id::VARCHAR, ',' ORDER BY pos) AS raw FROM e LEFT JOIN nation ON n_nationkey = id AND id >= 7 GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(known, raw) AS names FROM g""")
def linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 30, F.lit(999).cast("long"), F.col("o_custkey") % 7).alias("ids"))
    n = table(spark, sf_dir, "nation").filter("n_nationkey >= 7").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return rows.linked_names(o, "o_orderkey", "ids", n).select("o_orderkey", F.array_join("names", ",").alias("names"))


@query("""SELECT DISTINCT l_suppkey AS key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40
INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0""")
def cross_source_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("key")).join(table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("key")
    return a.intersect(table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("key")))


@query("""WITH v AS (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents),
n AS (SELECT facet, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL)
SELECT facet, value, n FROM n QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 10""")
def facet_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.vocabulary(table(spark, sf_dir, "documents"), ["lang", "source"], 10)


@query("""WITH v AS (SELECT 'nation' AS facet, n_name AS value FROM nation UNION SELECT 'region', r_name FROM region),
q AS (SELECT 0 AS query_id, 'orders from ' || lower(n_name) || ' and the x' || lower(r_name) AS q, n_nationkey + 100 AS k FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT k::BIGINT AS query_id, facet, value FROM q JOIN v ON regexp_matches(q, '(^|[^a-z0-9])' || lower(value) || '($|[^a-z0-9])')
UNION SELECT k::BIGINT, 'kind', 'Order' FROM q""")
def facet_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets named in queries, on word boundaries, and an alias."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    vocab = facets.vocabulary(n.withColumnRenamed("n_name", "nation"), ["nation"]).union(facets.vocabulary(r.withColumnRenamed("r_name", "region"), ["region"]))
    text = F.concat(F.lit("Orders  from "), F.lower("n_name"), F.lit(" and the x"), F.lower("r_name"))
    q = n.join(r, n.n_regionkey == r.r_regionkey).select((F.col("n_nationkey") + 100).cast("long").alias("query_id"), text.alias("query"))
    return facets.plan(q, vocab, {"orders": ("kind", "Order")})


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3'")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(facets.condition(d, {"lang": ["de", "fr"], "source": "src3", "unknown": "x", "n_chars": None})).select("doc_id")


HITS = "h AS (SELECT conv_id || ':' || turn AS chunk_id, CASE WHEN turn = 1 THEN NULL ELSE conv_id || ':0' END AS parent_id, text, length(text) AS score, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS ord, conv_id FROM conversations WHERE turn > 0 ORDER BY ord LIMIT 100)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    order = [F.desc("score"), F.col("conv_id"), F.col("turn")]
    h = c.filter("turn > 0").withColumn("score", F.length("text")).orderBy(*order).limit(100)
    h = fusion.numbered(h, order, "ord")
    ident = F.concat_ws(":", "conv_id", "turn")
    return h.select(ident.alias("chunk_id"), F.when(F.col("turn") != 1, F.concat(F.col("conv_id").cast("string"), F.lit(":0"))).alias("parent_id"), "text", "score", "ord", "conv_id")


@query(f"""WITH {HITS}, o AS (SELECT * FROM h WHERE parent_id IS NULL UNION ALL SELECT * FROM h WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY ord) = 1)
SELECT o.chunk_id, o.parent_id, coalesce(p.text, o.text) AS text, o.ord FROM o LEFT JOIN conversations p ON p.conv_id || ':' || p.turn = o.parent_id""")
def parent_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "text")
    return hydrate.parents(hits(spark, sf_dir), chunks).select("chunk_id", "parent_id", "text", "ord")


@query(f"WITH {HITS}, s AS (SELECT conv_id, arg_min(text, turn) AS summary FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT h.chunk_id, h.ord, s.summary FROM h LEFT JOIN s USING (conv_id)")
def summary_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "text", F.col("turn").alias("ord"))
    return hydrate.summaries(hits(spark, sf_dir), found, "conv_id", "summary").select("chunk_id", "ord", "summary")


ENTITY = """e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS pk, n_chars AS score, doc_id AS ord FROM documents),
b AS (SELECT *, min(ord) OVER (PARTITION BY pk) AS first_ord FROM e WHERE pk <> '' QUALIFY row_number() OVER (PARTITION BY pk ORDER BY score DESC, ord) = 1),
u AS (SELECT *, true AS has FROM b UNION ALL SELECT *, ord, false FROM e WHERE pk = '')"""


@query(f"WITH {ENTITY} SELECT doc_id, pk, score, has FROM u ORDER BY has DESC, score DESC, first_ord LIMIT 30")
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("pk"), F.col("n_chars").alias("score"), F.col("doc_id").alias("ord"))
    return hydrate.best_per_entity(d, 30).select("doc_id", "pk", "score", "has")


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role, left(text, 80) ORDER BY conv_id, turn) = 1")
def text_prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return hydrate.first_per(c, [F.col("role"), F.left("text", F.lit(80))], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS url FROM documents) QUALIFY row_number() OVER (PARTITION BY url, lang ORDER BY doc_id) = 1")
def ref_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("url", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    return hydrate.first_per(d, [F.col("url"), F.col("lang")], [F.col("doc_id")]).select("doc_id", "lang")


@query("SELECT coalesce('lang:' || lang || ',', '') || coalesce('n:' || n_chars || ',', '') || 'source:' || CASE WHEN doc_id % 3 > 0 THEN coalesce(source, 'a') ELSE 'a' END AS meta, doc_id FROM documents")
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later maps win but for their nulls; a null map holds nothing."""
    d = table(spark, sf_dir, "documents")
    last = F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("source"), F.col("source")))
    m = hydrate.overlay(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.lit("a")), F.create_map(F.lit("n"), F.col("n_chars").cast("string"), F.lit("gone"), F.lit(None).cast("string")), last)
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return d.select("doc_id", F.array_join(pairs, ",").alias("meta"))


@query("""WITH d AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN source END AS pk, text FROM documents)
SELECT 'lookup' AS kind, pk AS key, ord, NULL::BIGINT AS n FROM d WHERE pk <> '' UNION ALL SELECT 'truncated', 'text', NULL, count(*) FROM d WHERE length(text) > 800 HAVING count(*) > 0""")
def hint_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup for each hit with an entity, and one hint for each field that was cut, with how often."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("pk"), F.col("doc_id").alias("ord"), "text")
    cut = hydrate.truncation_hints(rows.count_long(d, ["text"]))
    return hydrate.hints(d).withColumn("n", F.lit(None).cast("long")).unionByName(cut)


@query()
def rerank_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in reranker over the hits; ties keep their order."""
    r = hydrate.rerank(hits(spark, sf_dir), "the of and to")
    return fusion.numbered(r.orderBy(F.desc_nulls_last("rerank_score"), "ord").limit(20), [F.desc_nulls_last("rerank_score"), F.col("ord")]).select("chunk_id", "rerank_score", "rank")


@query("SELECT doc_id, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY ord) AS rank FROM documents JOIN (SELECT unnest([7, 3, 99999999, 12]) AS id, generate_subscripts([7, 3, 99999999, 12], 1) AS ord) ON id = doc_id")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by id, found ones only, in the order asked for."""
    want = spark.createDataFrame([(7, 1), (3, 2), (99999999, 3), (12, 4)], "doc_id long, ord int")
    return fusion.numbered(table(spark, sf_dir, "documents").select("doc_id").join(want, "doc_id"), [F.col("ord")]).select("doc_id", F.lit(1.0).alias("score"), "rank")


@query("""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 's3://b/raw/t/' || source || '/f.pdf' ELSE 'raw/../x.pdf' END AS key FROM documents)
SELECT doc_id, CASE WHEN key LIKE 's3://%' THEN regexp_replace(key, '^s3://[^/]+/', '') END AS link FROM h""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s3://b/raw/t/"), F.col("source"), F.lit("/f.pdf"))).otherwise("raw/../x.pdf")
    return d.select("doc_id", rows.document_link(key).alias("link"))


@query("""WITH h AS (SELECT doc_id AS ord, source AS url, lang AS record FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1),
t AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM h ORDER BY ord LIMIT 40)
SELECT string_agg('[' || n || '] ' || record || ' ' || url, chr(10) ORDER BY ord) AS block, greatest((SELECT count(*) FROM h) - 40, 0) AS left_out FROM t""")
def reference_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("label"), F.col("source").alias("url"), F.col("lang").alias("record"))
    return render.references(d)


def _says(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + ")"


@query(f"SELECT conv_id, turn, CASE WHEN {_says(('how many', 'how much', 'count ', 'number of', 'total number', 'what is the total', 'size of'))} THEN 'count_only' WHEN {_says(('name',))} AND {_says(('list', 'all ', 'give me', 'show me', 'every'))} THEN 'column_subset' ELSE 'full_records' END AS shape FROM conversations")
def reply_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rows.reply_shape(F.col("text")).alias("shape"))


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN trim(c_name) END AS a, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN c_mktsegment || ', ' || c_custkey END AS b FROM customer)
SELECT c_custkey, CASE WHEN a IS NULL THEN '' ELSE '---' || chr(10) || 'Name: ' || a || chr(10) || CASE WHEN b IS NULL THEN '' ELSE 'Client: ' || b || chr(10) END || '---' || chr(10) || chr(10) END AS header FROM v""")
def metadata_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with a padded name, a list with blank items and a blank field; every third customer has none of them."""
    some = F.col("c_custkey") % 3 > 0
    items = F.array(F.col("c_mktsegment"), F.lit(""), F.lit(None), F.col("c_custkey").cast("string"))
    c = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(some, F.concat(F.lit(" "), "c_name", F.lit("\n "))).alias("Name"),
        F.lit(" ").alias("Language"),
        F.when(some & (F.col("c_custkey") % 2 == 0), items).otherwise(F.array().cast("array<string>")).alias("Client"),
    )
    return c.select("c_custkey", rows.header(c, ["Name", "Author", "Language"], ("Client", "Name")).alias("header"))


@query("SELECT item_id, regexp_replace(trim(regexp_replace(' ' || regexp_replace(lower(trim(text)), '\\s+', '  ', 'g') || ' ', ' (" + "|".join(X.STOP_WORDS) + ") ', '', 'g')), ' +', ' ', 'g') AS kept FROM benchmark")
def query_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.strip_stop_words(F.col("text")).alias("kept"))


@query("""WITH q AS (SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' RFP for M&E' ELSE ' rfps' END AS t FROM benchmark)
SELECT item_id, regexp_matches(lower(t), '(^|[^a-z0-9])rfp([^a-z0-9]|$)') AS rfp, regexp_matches(lower(t), '(^|[^a-z0-9])m&e([^a-z0-9]|$)') AS me FROM q""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("t", F.concat("text", F.when(F.col("item_id") % 2 == 0, " RFP for M&E").otherwise(" rfps")))
    e = X.expand(F.col("t"))
    return b.select("item_id", e.contains("request for proposal").alias("rfp"), e.contains("monitoring evaluation").alias("me"))
