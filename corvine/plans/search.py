"""Retrieval queries: lexical and vector top-k, fusion, facets, hydration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import fusion, lexical, vector
from corvine.plans.catalog import query
from corvine.session import table

QUERY = "the thing of ererea onthe was stupid for that nation"

BM25 = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)
"""
ONE = f"q AS (SELECT 0 AS query_id, unnest(list_distinct(regexp_extract_all('{QUERY}', '[a-z0-9]+'))) AS term)"
LEX = f"{ONE}, {BM25}, lex AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc ORDER BY score DESC, doc_id LIMIT 50)"
VEC = """qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
knn AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score, label FROM embeddings, qv),
vec AS (SELECT vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM knn ORDER BY score DESC, vec_id LIMIT 50)"""
FUSED = """u AS (SELECT id, rank AS r1, NULL AS r2 FROM vec UNION ALL SELECT id, NULL, rank FROM lex),
f AS (SELECT id, round(sum(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0)), 9) AS rrf, min(r1) AS r1, min(r2) AS r2 FROM u GROUP BY id),
fused AS (SELECT id, rrf, row_number() OVER (ORDER BY rrf DESC, r1 NULLS LAST, r2) AS rank FROM f)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", lexical.tokens(F.col("text")).alias("terms"))


def one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("query_id"), F.array_distinct(lexical.tokens(F.lit(QUERY))).alias("terms"))


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("q"))


def lexical_list(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return lexical.bm25(terms(spark, sf_dir), one_query(spark), k).select(F.col("doc_id").alias("id"), "score", "rank")


def vector_list(spark: SparkSession, sf_dir: str, k: int = 50, where=None) -> DataFrame:
    v = vector.knn(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), k, where)
    return fusion.numbered(v, [F.desc("score"), F.col("vec_id")]).select(F.col("vec_id").alias("id"), "score", "rank")


@query(f"WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark), {BM25} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark text."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(lexical.tokens(F.col("text"))).alias("terms"))
    return lexical.bm25(terms(spark, sf_dir), q, 10)


def step_sql(rules: list, other: str = "t") -> str:
    """A step of the stemmer as a CASE over t."""
    text = lambda x: "'" + x.replace(chr(0), "' || chr(0) || '") + "'"
    whens = []
    for suffix, to, shapes in rules:
        stem = f"left(t, length(t) - {len(suffix)})"
        fits = " AND ".join(f"regexp_matches({stem}, '{x}')" for x in shapes) or "true"
        whens.append(f"WHEN ends_with(t, {text(suffix)}) THEN CASE WHEN {fits} THEN {stem} || {text(to)} ELSE t END")
    return f"CASE {' '.join(whens)} ELSE {other} END"


def analyzed_sql(column: str) -> str:
    """The analyzer in SQL, from the same fixed values."""
    L = lexical
    words = f"regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+')"
    text = f"array_to_string(list_transform({words}, lambda w: ' ' || w || ' '), '')"
    for phrase, first in L.synonyms():
        text = f"replace({text}, '{phrase}', '{first}')"
    bare = "left(t, length(t) - 1)"
    short = f"regexp_matches({bare}, '{L.JUST_ONCE}') AND regexp_matches({bare}, '{L.SHORT}')"
    mended = f"CASE WHEN right({bare}, 1) = left(right({bare}, 2), 1) AND length({bare}) > 1 AND NOT contains('aeioulsz', right({bare}, 1)) THEN left(t, length(t) - 2) WHEN {short} THEN {bare} || 'e' ELSE {bare} END"
    mend = f"CASE WHEN ends_with(t, chr(0)) THEN {step_sql(L.MENDED, mended)} ELSE t END"
    silent = f"CASE WHEN ends_with(t, 'e') AND (regexp_matches({bare}, '{L.TWICE}') OR (regexp_matches({bare}, '{L.JUST_ONCE}') AND NOT regexp_matches({bare}, '{L.SHORT}'))) THEN {bare} ELSE t END"
    last = f"CASE WHEN ends_with(t, 'll') AND regexp_matches(t, '{L.TWICE}') THEN {bare} ELSE t END"
    steps = [step_sql(L.PLURALS), step_sql(L.PAST), mend, step_sql(L.FINAL_Y), *map(step_sql, L.STEPS)]
    out = f"list_filter(regexp_extract_all({text}, '[a-z0-9]+'), lambda t: NOT list_contains({L.ENGLISH_STOP}, t))"
    for step in steps:
        out = f"list_transform({out}, lambda t: CASE WHEN length(t) > 2 OR ends_with(t, chr(0)) THEN {step} ELSE t END)"
    return f"list_transform(list_transform({out}, lambda t: CASE WHEN length(t) > 2 THEN {silent} ELSE t END), lambda t: CASE WHEN length(t) > 2 THEN {last} ELSE t END)"


def phrase_sql(words: list[str], slop: int) -> str:
    """ph (doc_id, pf, matches) from p (doc_id, t, i): places of the words less their place, starts, least spread."""
    k = range(len(words))
    at = ", ".join(f"a{j} AS (SELECT doc_id, list(i - {j}) AS x FROM p WHERE t = '{w}' GROUP BY 1)" for j, w in enumerate(words))
    every = "a0 " + " ".join(f"JOIN a{j} USING (doc_id)" for j in k if j)
    lists = ", ".join(f"a{j}.x AS x{j}" for j in k)
    starts = " || ".join(f"x{j}" for j in k)
    within = lambda e: " AND ".join(f"len(list_filter(x{j}, lambda v: v >= s AND v <= s + {e})) > 0" for j in k)
    weight = " ".join(f"WHEN {within(e)} THEN {1.0 / (1 + e)}::DOUBLE" for e in range(slop + 1))
    return f"{at}, st0 AS (SELECT doc_id, {lists} FROM {every}), st1 AS (SELECT *, unnest(list_distinct({starts})) AS s FROM st0), ph AS (SELECT doc_id, sum(w) AS pf, count(*) AS matches FROM (SELECT doc_id, CASE {weight} END AS w FROM st1) WHERE w IS NOT NULL GROUP BY 1)"


def match_sql(words: list[str], fields: dict[str, str], slop: int = 1) -> str:
    """sc (doc_id, score): match_query in SQL. fields: the text's expression, then those of names."""
    one = sorted(set(words))
    parts = [f"p AS (SELECT doc_id, t, i FROM (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {analyzed_sql(fields['text'])} AS x FROM documents)))", phrase_sql(words, slop)]
    for n, (name, column) in enumerate(fields.items()):
        parts.append(f"z{n} AS (SELECT doc_id, {analyzed_sql(column)} AS x FROM documents), n{n} AS (SELECT count(*) AS n, avg(len(x)) AS a FROM z{n} WHERE len(x) > 0)")
        parts.append(f"w{n} AS (SELECT doc_id, len(x) AS dl, t, len(list_filter(x, lambda y: y = t)) AS tf FROM z{n}, (SELECT unnest({one}) AS t))")
        parts.append(f"i{n} AS (SELECT t, ln(1 + (n - d + 0.5) / (d + 0.5)) AS idf FROM (SELECT t, count(*) FILTER (tf > 0) AS d FROM w{n} GROUP BY 1), n{n})")
        parts.append(f"b{n} AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS b FROM w{n} JOIN i{n} USING (t), n{n} WHERE tf > 0 GROUP BY 1)")
    whole = " + ".join(f"(SELECT idf FROM i0 WHERE t = '{w}')" for w in words)
    parts.append(f"ps AS (SELECT doc_id, ({whole}) * pf * 2.2 / (pf + 1.2 * (0.25 + 0.75 * len(x) / a)) AS b FROM ph JOIN z0 USING (doc_id), n0)")
    best = ", ".join(f"coalesce(b{n}.b, 0)" for n in range(1, len(fields))) or "0"
    joins = " ".join(f"LEFT JOIN b{n} ON b{n}.doc_id = d.doc_id" for n in range(len(fields)))
    some = " OR ".join(f"b{n}.b IS NOT NULL" for n in range(len(fields)))
    parts.append(f"sc AS (SELECT d.doc_id, round(2 * coalesce(b0.b, 0) + 4 * coalesce(ps.b, 0) + 2 * greatest({best}), 6) AS score FROM documents d {joins} LEFT JOIN ps ON ps.doc_id = d.doc_id WHERE {some})")
    return ", ".join(parts)


@query("WITH p AS (SELECT doc_id, t, i FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM documents)), " + phrase_sql(["of", "the", "and"], 2) + " SELECT doc_id, matches FROM ph")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words in a row, out of place by two positions in all at most."""
    return lexical.phrase(lexical.spread(table(spark, sf_dir, "documents")).select("doc_id", lexical.tokens(F.col("text")).alias("terms")), ["of", "the", "and"], 2)


#: What LEXICAL becomes under the analyzer; a test holds it against query_terms.
LEXICAL, LEXICAL_TERMS = "the things of onthe inthe and wasther", ["thing", "onth", "inth", "wasther"]


@query("WITH " + match_sql(LEXICAL_TERMS, {"text": "text", "source": "source || ' inthe'", "lang": "CASE WHEN doc_id % 3 = 0 THEN lang || ' onthe things' END"}) + " SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 50")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match, sloppy phrase and best of two name fields over analysed terms, each with its boost."""
    d = lexical.spread(table(spark, sf_dir, "documents")).select("doc_id", "text", F.concat("source", F.lit(" inthe")).alias("source"), F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" onthe things"))).alias("lang"))
    return lexical.match_query(d, LEXICAL, 50, ("source", "lang"))


@query("""SELECT doc_id, greatest(coalesce(s1, 0), coalesce(s2, 0))::DOUBLE AS best FROM (
SELECT doc_id, len(list_filter(regexp_extract_all(lower(source), '[a-z0-9]+'), lambda t: t = 'src1')) * 2.0::DOUBLE AS s1, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t = 'the')) * 1.0::DOUBLE AS s2 FROM documents)""")
def best_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = lambda c, w: F.size(F.filter(lexical.tokens(F.col(c)), lambda t: t == w)).cast("double")
    return d.select("doc_id", lexical.best_fields([n("source", "src1") * 2, n("text", "the")]).alias("best"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({analyzed_sql('text')})) AS term FROM documents) GROUP BY term")
def analyzed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of analysed terms (synonyms, stop words, stems)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(lexical.analyzed(F.col("text")))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {VEC} SELECT id, score, rank FROM vec WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_list(spark, sf_dir, 10)


@query(f"WITH {VEC} SELECT vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM knn WHERE label IN (1, 3) ORDER BY rank LIMIT 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_list(spark, sf_dir, 10, F.col("label").isin(1, 3))


@query()
def knn_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn_quantised(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10)


@query()
def knn_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn_hashed(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10)


@query(f"WITH {LEX}, {VEC}, {FUSED} SELECT id, rrf, rank FROM fused WHERE rank <= 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vector top 50, fused by reciprocal rank, ten best."""
    return fusion.rrf(vector_list(spark, sf_dir), lexical_list(spark, sf_dir), 10)


@query(f"WITH {LEX}, {VEC}, {FUSED} SELECT id, rrf, rank FROM fused WHERE rank <= 80")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(vector_list(spark, sf_dir), lexical_list(spark, sf_dir), 80)


PASSES = """s AS (SELECT vec_id AS id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)), 9) AS rrf, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM knn WHERE label = 1 ORDER BY rank LIMIT {n}),
w AS (SELECT vec_id AS id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)), 9) AS rrf, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM knn ORDER BY rank LIMIT 20)"""
MERGED = "m AS (SELECT id, max(rrf) AS rrf, min(ord) AS ord FROM (SELECT id, rrf, rank AS ord FROM s UNION ALL SELECT id, rrf, rank + 1000000 FROM w {where}) GROUP BY id) SELECT id, rrf, row_number() OVER (ORDER BY rrf DESC, ord) AS rank FROM m ORDER BY rank LIMIT 15"


def passes(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, DataFrame]:
    one = lambda d: d.select("id", F.round(1.0 / (60 + F.col("rank")), 9).alias("rrf"), "rank")
    return one(vector_list(spark, sf_dir, n, F.col("label") == 1)), one(vector_list(spark, sf_dir, 20))


@query(f"WITH {VEC}, {PASSES.format(n=20)}, {MERGED.format(where='')}")
def merge_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge_passes(*passes(spark, sf_dir, 20), 15)


@query(f"WITH {VEC}, {PASSES.format(n=2)}, {MERGED.format(where='WHERE (SELECT count(*) FROM s) < 3')}")
def facet_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strict hits are fewer than three, so the widened pass joins in."""
    return fusion.fallback(*passes(spark, sf_dir, 2), 3, 15)


@query(f"""WITH {LEX}, {VEC}, {FUSED}, top AS (SELECT * FROM fused WHERE rank <= 30)
SELECT id, rrf, prev, boosted, row_number() OVER (ORDER BY boosted DESC, prev) AS rank FROM (
SELECT id, rrf, rank AS prev, round(rrf + 1.0::DOUBLE / 61 * ((lang = 'en')::INT + (source IN ('src1', 'src2'))::INT) / 2, 9) AS boosted FROM top JOIN documents ON doc_id = id)""")
def facet_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fusion.rrf(vector_list(spark, sf_dir), lexical_list(spark, sf_dir), 30)
    hits = hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id")
    n = (F.col("lang") == "en").cast("int") + F.col("source").isin("src1", "src2").cast("int")
    return fusion.boost(hits, n, 2).select("id", "rrf", "prev", "boosted", "rank")


SOURCES = """s0 AS (SELECT 'documents' AS source, doc_id AS id, n_chars / 100000.0::DOUBLE AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, 0 AS src FROM documents ORDER BY rank LIMIT 20),
s1 AS (SELECT 'conversations', conv_id, 1.0::DOUBLE, row_number() OVER (ORDER BY n DESC, conv_id) AS rank, 1 FROM (SELECT conv_id, sum(length(text)) AS n FROM conversations GROUP BY conv_id) ORDER BY rank LIMIT 20),
s2 AS (SELECT 'benchmark', item_id, 0.5::DOUBLE, row_number() OVER (ORDER BY item_id) AS rank, 2 FROM benchmark ORDER BY rank LIMIT 20),
u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
g AS (SELECT source, id, round(sum(1.0::DOUBLE / (60 + rank) + 0.001::DOUBLE * score), 9) AS fused, min(src) AS src, min(rank) AS sr FROM u GROUP BY ALL)"""


def source_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    def ranked(name: str, d: DataFrame, ident: str, score, order: list) -> DataFrame:
        top = d.orderBy(*order).limit(20)
        return fusion.numbered(top, order).select(F.lit(name).alias("source"), F.col(ident).alias("id"), score.alias("score"), "rank")

    d, c, b = (table(spark, sf_dir, x) for x in ("documents", "conversations", "benchmark"))
    return [
        ranked("documents", d, "doc_id", F.col("n_chars") / 100000.0, [F.desc("n_chars"), F.col("doc_id")]),
        ranked("conversations", c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")), "conv_id", F.lit(1.0), [F.desc("n"), F.col("conv_id")]),
        ranked("benchmark", b, "item_id", F.lit(0.5), [F.col("item_id")]),
    ]


@query(f"WITH {SOURCES} SELECT source, id, fused, row_number() OVER (ORDER BY fused DESC, src, sr) AS rank FROM g ORDER BY rank LIMIT 30")
def cross_source_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.cross_source(source_lists(spark, sf_dir), 30)


@query(f"WITH {SOURCES} SELECT source, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM u GROUP BY source")
def group_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.group_by_source(reduce(DataFrame.unionByName, source_lists(spark, sf_dir))).select("source", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
