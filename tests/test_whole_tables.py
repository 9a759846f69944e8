"""Queries take in every row of their tables, and whole texts."""

import re

from corvine.plans import catalog
from corvine.plans.load import load_all
from corvine.session import table

load_all()


def sections(text):
    """One line after the other: (ord, heading, level, body, path)."""
    out, path, k = [], [], 0
    heading, level, lines = None, 0, []
    for line in [*text.split("\n"), None]:
        m = line is not None and re.match(r"(#{1,6})\s+(.*)", line)
        if line is not None and not m:
            lines.append(line)
            continue
        body = "\n".join(lines).strip()
        if heading is not None or body:
            out.append((k, heading, level, body, "/".join(path)))
        k += 1
        if m:
            level, heading, lines = len(m[1]), m[2].strip(), []
            path = [*path[: level - 1], heading]
    return out


def test_sections_of_whole_turns(spark, tmp_path):
    turns = {(1, 0): "first line.\nsecond line.\n\n## Inner\nbelow it.", (1, 1): "one.\n### Deep\ntwo.\nthree.", (1, 2): "", (2, 0): "# Only\n", (2, 3): "end.\n# Last\nline."}
    spark.createDataFrame([(c, t, "user", x) for (c, t), x in turns.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for c in (1, 2):
        names = ["Experience", "Skills", "Education", "Notes"]
        text = "\n".join(("# " if t % 2 == 0 else "## ") + names[t % 4] + "\n" + x for (d, t), x in sorted(turns.items()) if d == c)
        want += [(c, *s) for s in sections(text)]
    got = catalog.QUERIES["section_split"](spark, str(tmp_path)).select("doc_id", "ord", "heading", "level", "body", "path").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any("second line." in r.body for r in got) and any(r.heading == "Deep" for r in got)


def test_all_orders_get_names(spark, sf):
    got = {r.o_orderkey for r in catalog.QUERIES["linked_names"](spark, sf).collect()}
    assert got == {r.o_orderkey for r in table(spark, sf, "orders").collect()}


def test_union_of_whole_tables(spark, sf):
    n = table(spark, sf, "documents").count() + table(spark, sf, "conversations").count()
    assert catalog.QUERIES["union_lists"](spark, sf).count() == n


def test_searches_reach_later_turns(spark, tmp_path):
    words = "theand thon ererea piano experience"
    spark.createDataFrame([(1, 0, "user", "nothing here"), (1, 3, "user", words), (2, 1, "user", words + " again")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("c", 1, "M")], "c_name string, c_nationkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "N")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    for name in ("search_all_sources", "search_fused"):
        assert {"1/3", "2/1"} == {r.id for r in catalog.QUERIES[name](spark, str(tmp_path)).filter("source = 'talks'").collect()} - {"1/0"}
