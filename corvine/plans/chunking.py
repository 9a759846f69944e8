"""Parsing and chunking queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as X
from corvine.operators import chunks
from corvine.plans.catalog import query
from corvine.session import table
from corvine.sources import parsers

# words with the white space behind them; a window's text is the stretch of the document that it covers
TOKENS = "t AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*') AS tok FROM documents)"
WINDOWS = f"{TOKENS}, s AS (SELECT doc_id, tok, unnest(range(0, greatest(len(tok) - 50, 1), 150)) AS start FROM t WHERE len(tok) > 0), w AS (SELECT doc_id, start // 150 AS pos, tok[start + 1 : start + 200] AS win FROM s)"
STRETCH = "md5(regexp_replace(array_to_string({}, ''), '\\s+$', ''))"


@query(f"WITH {WINDOWS} SELECT doc_id, pos::BIGINT AS pos, len(win) AS tokens, {STRETCH.format('win')} AS h FROM w")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parsers.materialised(table(spark, sf_dir, "documents").select("doc_id", "text"), tok=chunks.pieces(F.col("text")))
    w = d.select("doc_id", F.posexplode(chunks.windows(F.col("tok"), 200, 50)).alias("pos", "win"))
    return w.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size("win").cast("long").alias("tokens"), F.md5(chunks.joined(F.col("win"))).alias("h"))


@query(f"WITH {TOKENS}, s AS (SELECT doc_id, tok, unnest(range(0, greatest(len(tok) - 100, 1), 700)) AS start FROM t WHERE len(tok) > 0), p AS (SELECT doc_id, start // 700 AS parent, tok[start + 1 : start + 800] AS tok FROM s), c0 AS (SELECT doc_id, parent, tok, unnest(range(0, greatest(len(tok) - 50, 1), 150)) AS start FROM p), c AS (SELECT doc_id, parent, start // 150 AS child, tok[start + 1 : start + 200] AS tok FROM c0) SELECT doc_id, parent::BIGINT AS parent, NULL::BIGINT AS child, len(tok) AS tokens, {STRETCH.format('tok')} AS h FROM p UNION ALL SELECT doc_id, parent, child, len(tok), {STRETCH.format('tok')} FROM c WHERE len(tok) >= 30 OR child = 0")
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("body"))
    return chunks.chunk(s, "parent_child").select("doc_id", "parent", "child", "tokens", F.md5("text").alias("h"))


@query("SELECT conv_id, turn, left(sha256(text), 16) || ':child:' || conv_id || ':' || turn AS chunk_id FROM conversations WHERE turn > 0 UNION ALL SELECT conv_id, turn, left(sha256(text), 16) || ':parent:' || conv_id FROM conversations WHERE turn = 0")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunks.chunk_id(F.col("text"), F.col("conv_id"), F.when(F.col("turn") > 0, F.col("turn"))).alias("chunk_id"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY left(sha256(text), 16) ORDER BY doc_id) = 1")
def chunk_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("chunk_id"))
    return chunks.first_wins(d, ["doc_id"]).select("doc_id")


@query("SELECT source, doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 1 GROUP BY source HAVING count(*) > 24)")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 1, F.col("doc_id")).alias("child"))
    return chunks.guarded(d, 24).select(F.col("doc_id").alias("source"), F.col("id").alias("doc_id"))


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with a Markdown heading for every turn."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("turn") % 2 == 0, "# ").otherwise("## "), F.element_at(F.array(*map(F.lit, ["Experience", "Skills", "Education", "Notes"])), (F.col("turn") % 4 + 1).cast("int")), F.lit("\n"), "text")
    g = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


SECTIONS = rf"""t AS (SELECT conv_id, turn, ['Experience', 'Skills', 'Education', 'Notes'][(turn % 4) + 1] AS h, text FROM conversations),
d AS (SELECT conv_id AS doc_id, string_agg((CASE WHEN turn % 2 = 0 THEN '# ' ELSE '## ' END) || h || chr(10) || text, chr(10) ORDER BY turn) AS text FROM t GROUP BY 1),
x AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM d),
v AS (SELECT *, trim(line) AS s FROM x),
w AS (SELECT *, CASE WHEN regexp_matches(s, '{parsers.MARKDOWN}') THEN length(regexp_extract(s, '{parsers.MARKDOWN}', 1)) WHEN length(s) BETWEEN 4 AND 100 AND regexp_matches(s, '{parsers.CAPITALS}') THEN 1
WHEN regexp_matches(s, '{parsers.TITLE}') AND len(string_split_regex(lower(s), '\s+')) <= 5 AND list_has_any(string_split_regex(lower(s), '\s+'), string_split('{' '.join(parsers.HEADING_WORDS)}', ' ')) THEN 1 ELSE 0 END AS level FROM v),
g AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM w),
b AS (SELECT doc_id, ord, max(level) AS level, max(trim(regexp_replace(s, '^#{{1,6}}\s+', ''))) FILTER (level > 0) AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS body FROM g GROUP BY 1, 2),
r AS (SELECT doc_id, ord, CASE WHEN level > 0 THEN [heading] ELSE []::VARCHAR[] END AS path FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1
UNION ALL SELECT b.doc_id, b.ord, list_concat(r.path[1 : b.level - 1], [b.heading]) FROM r JOIN b ON b.doc_id = r.doc_id AND b.ord = r.ord + 1)"""


@query(f"WITH RECURSIVE {SECTIONS} SELECT doc_id, ord::BIGINT AS ord, heading, level::BIGINT AS level, body, array_to_string(path, '/') AS path FROM r JOIN b USING (doc_id, ord) WHERE heading IS NOT NULL OR body <> ''")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and heading paths of conversations with whole turns; headings may stand inside a turn."""
    s = parsers.sections(sectioned(spark, sf_dir))
    return s.select("doc_id", F.col("ord").cast("long").alias("ord"), "heading", F.col("level").cast("long").alias("level"), "body", F.array_join("path", "/").alias("path"))


@query()
def section_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.tidy(parsers.sections(sectioned(spark, sf_dir)))


@query()
def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(parsers.sections(sectioned(spark, sf_dir)), "resume")


@query()
def chunk_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat(F.lit("Slide "), (F.col("turn") + 1).cast("string"), F.lit(": "), "role").alias("heading"), F.col("text").alias("body"))
    return chunks.chunk(s, "slides")


@query("""SELECT p_partkey, CASE WHEN h = '' THEN 'unknown' WHEN h IN ('skills', 'key skills') THEN 'skills' WHEN h = 'work experience' THEN 'experience' ELSE 'other' END AS section FROM (
SELECT p_partkey, trim(regexp_replace(lower(['  Key--Skills:', 'WORK experience', p_name, ' ... '][(p_partkey % 4) + 1]), '[^a-z0-9]+', ' ', 'g')) AS h FROM part)""")
def canonical_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    h = F.element_at(F.array(F.lit("  Key--Skills:"), F.lit("WORK experience"), F.col("p_name"), F.lit(" ... ")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", X.canonical_section(h).alias("section"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name || '  (' || c_mktsegment || ') ')), '\\s+', '_', 'g'), '[^a-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS slug FROM customer")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.slug(F.concat("c_name", F.lit("  ("), "c_mktsegment", F.lit(") ")), "unknown").alias("slug"))


@query("SELECT c_custkey, left(c_name, 2) || '…' AS masked, left(regexp_replace(regexp_replace(lower(trim(c_name || '@X.org')), '[^a-z0-9._@+-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 200) AS ident FROM customer")
def mask_and_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.mask(F.col("c_name")).alias("masked"), X.identifier(F.concat("c_name", F.lit("@X.org"))).alias("ident"))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(replace(p_name || ' ＆  ' || p_type, '＆', '&')), '\\s+', ' ', 'g')), '\\s*&\\s*', '&', 'g') AS m FROM part")
def match_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.match_form(F.concat("p_name", F.lit(" ＆  "), "p_type")).alias("m"))


@query("SELECT doc_id, trim(regexp_replace(left(CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') || ' of ' || coalesce(source, '') ELSE coalesce(text, '') END, 1800), '\\s+', ' ', 'g')) AS summary FROM documents")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document carries a summary ahead of its text; the others are their own."""
    d = table(spark, sf_dir, "documents")
    own = F.concat(F.lit("x\nDocument_Summary: "), F.coalesce("lang", F.lit("")), F.lit(" of "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return d.select("doc_id", X.summary_of(F.when(F.col("doc_id") % 2 == 0, own).otherwise(F.coalesce("text", F.lit("")))).alias("summary"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS cursor FROM events")
def cursor_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.cursor(F.col("ts")).alias("cursor"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, rtrim(translate(to_base64(encode(source || '?>' || text)), '+/', '-_'), '=') AS b64, regexp_replace(source || ' x', '[^A-Za-z0-9_-]+', '_', 'g') AS id FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), X.base64url(F.encode(F.concat("source", F.lit("?>"), "text"), "UTF-8")).alias("b64"), X.id_part(F.concat("source", F.lit(" x"))).alias("id"))


@query("SELECT doc_id, regexp_replace('12' || chr(10) || 'a' || chr(10) || ' 7 ' || chr(10) || source, '^12' || chr(10) || 'a' || chr(10) || ' 7 ' || chr(10), 'a' || chr(10)) AS t FROM documents")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.drop_page_numbers(F.concat(F.lit("12\na\n 7 \n"), "source")).alias("t"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN nullif((event_id % 50)::INT, 0) ELSE NULL END AS n FROM events")
def coerced_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 == 0, "all").when(F.col("event_id") % 3 == 1, (F.col("event_id") % 50).cast("string")).otherwise("-4")
    return e.select("event_id", X.positive_or_null(v).alias("n"))


@query("SELECT doc_id, lower(replace(source, 'src', 'file_')) || '.pdf' AS name, coalesce(lang, '') || ' — ' || 'Source Name' || ' (' || source || ')' AS label FROM documents")
def file_names_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("/dir/"), F.replace("source", F.lit("src"), F.lit("File ")), F.lit(".PDF"))
    return d.select("doc_id", X.filename(name).alias("name"), X.label(F.col("lang"), F.lit("source_name"), F.col("source")).alias("label"))


@query("SELECT event_id, props AS json FROM events")
def json_from_chatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.first_json(F.concat(F.lit("Sure! "), "props", F.lit(" done"))).alias("json"))
