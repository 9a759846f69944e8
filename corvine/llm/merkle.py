"""A Merkle manifest of a data set: concatenated child hashes are stored per parent and give every row its proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import cut, placed, small
from corvine.session import table

FAN, HEX = 8, 64


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the strings, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """The hash of a row: of each value its length in UTF-8 bytes, a colon and the value; `-` for null."""
    texts = [c.cast("string") for c in columns]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def depth(n: Column) -> Column:
    """Levels above n leaves: how many times eight nodes become one until one is left."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, FAN))).otherwise(0)


def preimages(leaves: DataFrame) -> list[DataFrame]:
    """The stored manifest, a written table for each level from 1: g, node, preimage (the child hashes, concatenated).

    leaves: g, idx, n, h, a written table. Every level is one aggregation of eight rows a group and an eighth of the
    one below; groups that have come to one node are in no later level.
    """
    levels: list[DataFrame] = []
    top = leaves.agg(F.max(depth(F.col("n")))).first()[0] or 0
    nodes = leaves.select("g", "idx", "n", "h")
    for level in range(1, top + 1):
        live = nodes.filter(depth(F.col("n")) >= level)
        hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x.h), "")
        made = live.groupBy("g", F.expr(f"idx div {FAN}").alias("node"), "n").agg(hashes.alias("preimage"))
        levels.append(cut(made, f"level{level}"))
        nodes = levels[-1].select("g", F.col("node").alias("idx"), "n", F.sha2("preimage", 256).alias("h"))
    return levels


def paths(levels: list[DataFrame]) -> DataFrame | None:
    """(g, node, path) for every parent of leaves: its preimage and those of all its ancestors, from below."""
    out = None
    for level in reversed(levels):
        own = level.select("g", "node", F.array("preimage").alias("own"))
        if out is not None:
            above = out.select("g", F.col("node").alias("_up"), F.col("path").alias("_path"))
            own = own.withColumn("_up", F.expr(f"node div {FAN}")).join(above, ["g", "_up"], "left")
            own = own.select("g", "node", F.concat("own", F.coalesce("_path", F.array().cast("array<string>"))).alias("own"))
        out = own.select("g", "node", F.col("own").alias("path"))
    return out


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, h): the last node of each group, which is the leaf itself where there is one only."""
    out = leaves.filter(depth(F.col("n")) == 0).select("g", "h")
    for k, level in enumerate(levels, 1):
        out = out.unionByName(level.filter(depth(F.col("n")) == k).select("g", F.sha2("preimage", 256).alias("h")))
    return out


def steps(path: Column, idx: Column) -> Column:
    """The preimages of a path with the place of the row's own slot in each."""
    return F.transform(path, lambda p, k: F.struct(p.alias("p"), F.call_function("shiftrightunsigned", idx, k * 3).bitwiseAND(FAN - 1).cast("int").alias("slot")))


def siblings(way: Column) -> Column:
    """Preimages without the row's own slots, level by level."""
    return F.transform(way, lambda x: F.concat(F.substring(x.p, F.lit(1), x.slot * HEX), F.substring(x.p, (x.slot + 1) * HEX + 1, F.length(x.p))))


def fold(way: Column, start: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way: the hash so far takes its slot, level by level."""
    return F.aggregate(way, start, lambda h, x: F.sha2(F.overlay(x.p, h, x.slot * HEX + 1, F.lit(HEX)), 256))


def manifest(rows: DataFrame) -> DataFrame:
    """Rows g (group), id, leaf, other (a leaf to be checked) with subroot, root, proof_sha256, folded_root, verified.

    In each group, leaves ascend by id and every eight consecutive nodes become one until one is left; the groups'
    last nodes, ordered by g, become one root alike. A row joins the preimages of its ancestors: cutting its own
    64 characters out of each gives the siblings, whose hash is the proof, and putting another hash there and going
    up gives the root that the other leaf leads to. The only join of all rows is with an eighth as many parents.
    """
    rows = cut(rows.select("g", "id", "leaf", "other", F.monotonically_increasing_id().alias("_tie")), "leaves")
    leaves = cut(placed(rows, ["id", "leaf", "_tie"]).select("g", "id", "leaf", "other", "idx", "n"), "placed")
    hashes = leaves.withColumn("h", F.col("leaf"))
    levels = preimages(hashes)
    groups = cut(roots(hashes, levels), "roots")
    tops = cut(placed(groups.select(F.lit("").alias("g"), F.col("g").alias("group"), "h"), ["group"]), "tops")
    top_levels = preimages(tops)
    root = roots(tops, top_levels).select("g", F.col("h").alias("root"))
    none = F.array().cast("array<string>")
    group_paths = paths(top_levels)
    if group_paths is None:
        tops = tops.withColumn("top_path", none)
    else:
        up = group_paths.select("node", F.col("path").alias("top_path"))
        tops = tops.withColumn("node", F.expr(f"idx div {FAN}")).join(up, "node")
    tops = tops.join(root, "g")
    tops = tops.select(F.col("group").alias("g"), F.col("h").alias("subroot"), F.col("idx").alias("top_idx"), "top_path", "root")
    out = leaves.withColumn("node", F.expr(f"idx div {FAN}"))
    own = paths(levels)
    out = out.withColumn("path", none) if own is None else out.join(own, ["g", "node"], "left").withColumn("path", F.coalesce("path", none))
    out = out.join(small(cut(tops, "tops")), "g")
    out = out.withColumn("way", F.concat(steps(F.col("path"), F.col("idx")), steps(F.col("top_path"), F.col("top_idx"))))
    out = out.withColumn("proof_sha256", F.sha2(F.array_join(siblings(F.col("way")), ""), 256)).withColumn("folded_root", fold(F.col("way"), F.col("other")))
    return out.select("g", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Groups are languages, null first. Documents whose crc32(doc_id) is divisible by three are folded from their text
    in lower case (A-Z only), so those with a capital don't verify. Nulls have a leaf mark of their own; a null doc_id
    comes first in its language and is not tampered with. Rows repeated with equal values have equal leaves and
    neighbouring places, rows with one doc_id and other values are ordered by leaf; a lone row is its subroot and, if
    there is no other language, the root, with the hash of the empty text as proof. Texts are hashed whole, whatever
    their length. Columns beside doc_id, source, lang, n_chars and text are not read; an empty table gives none.
    """
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    hit = F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 0, F.lit(False)) & text.rlike("[A-Z]")
    own = [key, F.col("source"), F.col("lang"), F.col("n_chars")]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("g"),
        key.alias("id"),
        leaf([*own, text]).alias("leaf"),
        F.when(hit, leaf([*own, F.translate(text, UPPER, LOWER)])).alias("_changed"),
    ).withColumn("other", F.coalesce("_changed", "leaf"))
    return manifest(rows).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


def _sql(most: int = 8) -> str:
    """DuckDB SQL for the same rows, for languages of up to 8**most rows."""

    def tree(name: str, leaves: str) -> str:
        out = [f"{name}0 AS (SELECT g, idx, n, h, h AS top FROM {leaves})"]
        for k in range(1, most + 1):
            out.append(f"{name}{k} AS (SELECT g, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, string_agg(h, '' ORDER BY idx) AS pre, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}{k - 1} WHERE n > 1 GROUP BY g, idx // 8)")
        out.append(f"{name}_top AS ({' UNION ALL '.join(f'SELECT g, h FROM {name}{k} WHERE n = 1' for k in range(most + 1))})")
        return ",\n".join(out)

    def way(name: str, g: str, idx: str, steps: list[tuple[str, str]]) -> list[str]:
        return [f"LEFT JOIN {name}{k} {name}_{k} ON {name}_{k}.g = {g} AND {name}_{k}.idx = {idx} // {8**k}" for k in range(1, most + 1)]

    slots = [(f"t_{k}.pre", f"d.idx // {8 ** (k - 1)} % 8") for k in range(1, most + 1)] + [(f"s_{k}.pre", f"l.idx // {8 ** (k - 1)} % 8") for k in range(1, most + 1)]
    cut_out = " || ".join(f"coalesce(left({p}, 64 * ({s})) || substr({p}, 64 * ({s}) + 65), '')" for p, s in slots)
    folded = "d.other"
    ctes = []
    for k, (p, s) in enumerate(slots):
        ctes.append(f"f{k} AS (SELECT * REPLACE (CASE WHEN p{k} IS NULL THEN cur ELSE sha256(left(p{k}, 64 * s{k}) || cur || substr(p{k}, 64 * s{k} + 65)) END AS cur) FROM {'way' if k == 0 else f'f{k - 1}'})")
    picked = ", ".join(f"{p} AS p{k}, {s} AS s{k}" for k, (p, s) in enumerate(slots))
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
docs AS (
  SELECT *, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 + 1 AS INTEGER)])) AS c FROM documents, crc_table),
leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({head} || {field('text')}) AS leaf,
    sha256({head} || CASE WHEN xor(c, 4294967295) % 3 = 0 THEN {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {field('text')} END) AS other FROM docs),
d AS (
  SELECT *, leaf AS h, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
{tree('t', 'd')},
l AS (SELECT 'all' AS a, g, h, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS idx FROM t_top),
l_in AS (SELECT a AS g, idx, n, h FROM l),
{tree('s', 'l_in')},
way AS (
  SELECT d.doc_id, d.leaf, l.h AS subroot, s_top.h AS root, sha256({cut_out}) AS proof_sha256, {folded} AS cur, {picked}
  FROM d JOIN l ON l.g = d.g, s_top {' '.join(way('t', 'd.g', 'd.idx', slots))} {' '.join(way('s', 'l.a', 'l.idx', slots))}),
{','.join(ctes)}
SELECT doc_id, leaf, subroot, root, proof_sha256, cur AS folded_root, cur = root AS verified FROM f{len(slots) - 1}
"""


OP13_SQL = _sql()
