import hashlib
import zlib

import pytest

from corvine.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The last node, and for each leaf its levels of (siblings before, siblings behind)."""
    ways, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for i in owner[a + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            owners.append([i for k in range(len(run)) for i in owner[a + k]])
        nodes, owner = up, owners
    return nodes[0], ways


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
        trees[x] = tree([leaf(*r[:5]) for r in langs[x]])
    root, tops = tree([trees[x][0] for x in order])
    out = []
    for x, top in zip(order, tops, strict=True):
        for r, way in zip(langs[x], trees[x][1], strict=True):
            own = cur = leaf(*r[:5])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1]:
                cur = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:5])
            for before, behind in way + top:
                cur = h(before, cur, behind)
            out.append((r[0], own, trees[x][0], root, h(*(b + a for b, a in way + top)), cur, cur == root))
    return sorted(out, key=str)


def compared(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = merkle.document_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows)
    return got


def row(i, text, lang="en", source="web", n=1):
    return (i, text, lang, source, n, "x", "y", "z")


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_sizes_of_one_language(spark, n):
    compared(spark, [row(i * 7, f"Text {i}") for i in range(n)])


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [row(i, "Ä A" * (i % 5), ["en", "de", None, "", "ß"][i % 5], None if i % 3 else "s", None if i % 4 == 0 else i) for i in range(90)]
    rows += [row(None, "No Id"), row(None, None), row(3, None), row(3, "OTHER"), row(3, "OTHER"), row(500, "Long " * 60_000), row(501, "")]
    rows += [row(7, "Same", "fr")] * 70
    got = compared(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_many_groups(spark):
    compared(spark, [row(i, "Abc", f"l{i % 40}") for i in range(100)])


def test_empty(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tables(spark, sf):
    got = merkle.op13_merkle(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, got), key=str) == plain(docs)
