"""Queries over stored indexes: lexical postings pruned by block maxima, vectors and codes in cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.plans.catalog import query
from corvine.plans.search import analyzed_sql
from corvine.session import scratch, table
from corvine.sources import postings, vectors

#: The documents' name fields and what they are in SQL.
NAMES = {"source": "source || ' erblest'", "lang": "CASE WHEN doc_id % 3 = 0 THEN lang || ' thereb inthe' END"}


def match_all_sql(names: dict[str, str], slop: int = 1, k: int = 10) -> str:
    """The k best documents of every benchmark text by the three clauses of lexical.match_query, without an index."""
    parts = [
        f"q0 AS (SELECT item_id AS query_id, {analyzed_sql('text')} AS w FROM benchmark)",
        "q AS (SELECT query_id, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM q0)",
        "qd AS (SELECT DISTINCT query_id, t FROM q)",
    ]
    for n, column in enumerate(["text", *names.values()]):
        parts.append(f"z{n} AS (SELECT doc_id, {analyzed_sql(column)} AS x FROM documents)")
        parts.append(f"n{n} AS (SELECT count(*) AS n, avg(len(x)) AS a FROM z{n} WHERE len(x) > 0)")
        parts.append(f"p{n} AS (SELECT doc_id, len(x) AS dl, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM z{n})")
        parts.append(f"f{n} AS (SELECT doc_id, dl, t, count(*) AS tf FROM p{n} WHERE t IN (SELECT t FROM qd) GROUP BY ALL)")
        parts.append(f"i{n} AS (SELECT t, ln(1 + (n - d + 0.5) / (d + 0.5)) AS idf FROM (SELECT t, count(*) AS d FROM f{n} GROUP BY 1), n{n})")
        parts.append(f"b{n} AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS b FROM qd JOIN f{n} USING (t) JOIN i{n} USING (t), n{n} GROUP BY ALL)")
    parts += [
        "every AS (SELECT query_id, doc_id, any_value(dl) AS dl FROM qd JOIN f0 USING (t) JOIN q0 USING (query_id) GROUP BY query_id, doc_id, w HAVING count(*) = len(list_distinct(w)))",
        "place AS (SELECT query_id, doc_id, k, i - k AS x FROM every JOIN q USING (query_id) JOIN p0 USING (doc_id, t))",
        "s AS (SELECT DISTINCT query_id, doc_id, x AS s FROM place)",
        f"m AS (SELECT query_id, doc_id, s, k, min(x - s) AS e FROM s JOIN place USING (query_id, doc_id) WHERE x BETWEEN s AND s + {slop} GROUP BY ALL)",
        "h AS (SELECT query_id, doc_id, s, max(e) AS e FROM m JOIN q0 USING (query_id) GROUP BY query_id, doc_id, s, w HAVING count(*) = len(w))",
        "whole AS (SELECT query_id, sum(idf) AS idf FROM q JOIN i0 USING (t) GROUP BY 1)",
        "pf AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (1 + e)) AS pf FROM h GROUP BY ALL)",
        "ph AS (SELECT query_id, doc_id, idf * pf * 2.2 / (pf + 1.2 * (0.25 + 0.75 * dl / a)) AS b FROM pf JOIN every USING (query_id, doc_id) JOIN whole USING (query_id), n0)",
        "hits AS (" + " UNION ".join(f"SELECT query_id, doc_id FROM b{n}" for n in range(1 + len(names))) + ")",
    ]
    best = ", ".join(f"coalesce(b{n}.b, 0)" for n in range(1, 1 + len(names))) or "0"
    joins = " ".join(f"LEFT JOIN {x} ON {x}.query_id = hits.query_id AND {x}.doc_id = hits.doc_id" for x in [*(f"b{n}" for n in range(1 + len(names))), "ph"])
    parts.append(f"sc AS (SELECT hits.query_id, hits.doc_id, round(2 * coalesce(b0.b, 0) + 4 * coalesce(ph.b, 0) + 2 * greatest({best}), 6) AS score FROM hits {joins})")
    return f"WITH {', '.join(parts)} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k}"


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {name: F.expr(sql).alias(name) for name, sql in NAMES.items()}
    return table(spark, sf_dir, "documents").select("doc_id", "text", *names.values())


@query(match_all_sql(NAMES))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark text by match, phrase and names, from an index written in two batches."""
    path, docs = scratch(spark, "index"), named_documents(spark, sf_dir)
    postings.create(spark, path, tuple(NAMES))
    postings.add(docs.filter("doc_id % 4 < 3"), path)
    postings.add(docs.filter("doc_id % 4 = 3"), path)
    return postings.search(spark, path, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


def vector_index(spark: SparkSession, sf_dir: str) -> tuple[vectors.Index, DataFrame]:
    """An index of all embeddings, written in two batches and measured on some, and as queries every vector whose id is divisible by 50."""
    path, e = scratch(spark, "vectors"), table(spark, sf_dir, "embeddings")
    dim, n = e.agg(F.max(F.size("embedding")), F.count("*")).first()
    vectors.create(e, path, cells=max(4, min(4096, int(n**0.5))))
    vectors.add(e.filter("vec_id % 4 < 3"), path)
    vectors.add(e.filter("vec_id % 4 = 3"), path)
    index = vectors.Index(spark, path)
    some = vectors.units(e.filter("vec_id % 50 = 1").orderBy(F.xxhash64("vec_id")).limit(200), dim)
    index.calibrate(some.select(F.col("vec_id").alias("query_id"), "vector"))
    return index, vectors.units(e.filter("vec_id % 50 = 0"), dim).select(F.col("vec_id").alias("query_id"), "vector")


@query()
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every query by the cells of a stored index."""
    index, queries = vector_index(spark, sf_dir)
    return index.search(queries, 10)


@query()
def knn_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every query by stored codes of 16 bytes, scored again by the vectors."""
    index, queries = vector_index(spark, sf_dir)
    return index.search_coded(queries, 10)


@query("SELECT form, count(*) AS queries, true AS recalled FROM embeddings, (SELECT unnest(['cells', 'codes']) AS form) WHERE vec_id % 50 = 0 AND embedding IS NOT NULL GROUP BY form")
def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both forms of the index find nine of ten of the true ten nearest, over all queries and all vectors."""
    index, queries = vector_index(spark, sf_dir)
    true = index.search_all(queries, 10).select("query_id", "vec_id")
    parts = []
    for form, found in (("cells", index.search(queries, 10)), ("codes", index.search_coded(queries, 10))):
        hit = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
        parts.append(hit.agg(F.lit(form).alias("form"), F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled")))
    return parts[0].unionByName(parts[1]).select("form", "queries", "recalled")
