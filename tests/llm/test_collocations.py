import random
import re
from collections import Counter

import numpy as np
import pytest

from corvine.llm import collocations as col

SCHEMA = "lang string, text string, n string, word long, rank string, chunk string, f long"


def plain(rows, support, top=2000, covered=80):
    counts, n = {}, Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] = counts.get((lang, tuple(w[i : i + m])), 0) + 1
    often = {k: f for k, f in counts.items() if f >= support}
    out = []
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        inside = [f for (x, q), f in often.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * f >= covered * a for f in inside):
            continue
        score, k, left, right = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked, seen = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, n[lang], -score))
    return ranked


def compared(spark, rows, support=3, **more):
    got = col.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), support=support, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(plain(rows, support, more.get("top", 2000)))
    return got


def texts(seed, rows, vocabulary, langs):
    r = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"ä{i}" for i in range(vocabulary)]
    out = []
    for _ in range(rows):
        body = "".join(words[min(r.randrange(vocabulary), r.randrange(vocabulary))] + r.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(r.randrange(30)))
        out.append((r.choice(langs), body, "n", 1, "r", "c", 2))
    return out


def test_random_texts(spark):
    rows = texts(1, 150, 12, ["en", "de", None, ""]) + [("en", None, "n", 1, "r", "c", 2), (None, "", "n", 1, "r", "c", 2)]
    rows += [("en", "One and the same. One and the same", "n", 1, "r", "c", 2)] * 40 + [("xx", "a a a a a " * 3000, "n", 1, "r", "c", 2)]
    got = compared(spark, rows)
    assert any(g[0] == "und" for g in got)


def test_top_and_ties(spark):
    assert compared(spark, texts(2, 60, 6, ["en", "de"]), top=5)


def test_empty(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert col.collocations(spark.createDataFrame([("en", " .\n", "n", 1, "r", "c", 2)], SCHEMA), support=1).collect() == []


def test_parts_of_frequent_pivots(spark):
    """Pivots in several parts give partial counts, whose sums are those of one part."""
    docs = spark.createDataFrame(texts(3, 80, 8, ["en"]), SCHEMA).selectExpr("lang", "text")
    chunks = col.cut(col.chunked(docs.repartition(4), most=200), "chunks")
    words = {w: i for i, (w, _) in enumerate(Counter(w for r in chunks.collect() for i, w in enumerate(r.words) for _ in range(r.counts[i])).most_common(), 1)}
    f = Counter()
    for r in chunks.collect():
        f.update(dict(zip(r.words, r.counts, strict=True)))
    known = [(r.chunk, r.ids, [(k + 1, words[w], f[w]) for k, w in enumerate(r.words)]) for r in chunks.collect()]
    known = spark.createDataFrame(known, "chunk long, ids array<int>, known array<struct<k: int, id: int, f: long>>")
    result = {}
    for each in (20, 10**6):
        dealt = col.fragments(known, each).repartition(3, "pivot", "part").sortWithinPartitions("pivot")
        rows = col.mine(dealt, 3, most=50).collect()
        assert any(r.partial for r in rows) == (each == 20)
        total = Counter()
        for r in rows:
            total[r.w1, r.w2, r.w3, r.w4] += r.f
        result[each] = {k: v for k, v in total.items() if v >= 3}
    assert result[20] == result[10**6] and result[20]


@pytest.mark.parametrize("seed", range(5))
def test_phrases_of_fragments(seed):
    """Each phrase is counted once, with the pivot that owns it."""
    r = np.random.default_rng(seed)
    words = r.integers(0, 6, 400).astype(np.int32)
    rows = col.fragments_of(words)
    assert (rows[:, 0][:, None] >= rows[:, 1:7]).all()
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    got = dict(zip(map(tuple, col.mined(rows, np.zeros(len(rows), bool), 2)[0].tolist()), col.mined(rows, np.zeros(len(rows), bool), 2)[1].tolist(), strict=True))
    want = Counter(tuple(words[i : i + m].tolist()) + (0,) * (4 - m) for m in (2, 3, 4) for i in range(len(words) - m + 1) if (words[i : i + m] > 0).all())
    assert got == {k: v for k, v in want.items() if v >= 2}


def test_scores_in_ranges(spark):
    r = random.Random(7)
    rows = [(x, r.choice([5, 5000, r.randrange(10**6)])) for x in ["a"] * 300 + ["b"] * 3]
    for top in (1, 7, 120, 400):
        got = sorted(map(tuple, col.best_scores(spark.createDataFrame(rows, "lang string, score long"), top).collect()))
        least = {x: sorted((s for y, s in rows if y == x), reverse=True)[:top][-1] for x in "ab"}
        assert got == sorted(x for x in rows if x[1] >= least[x[0]])


def test_scans_of_chunks_hold_few_rows(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    written = {}
    monkeypatch.setattr(col, "cut", lambda df, name, f=col.cut, **how: written.setdefault(name, f(df, name, **how)))
    rng = np.random.default_rng(5)
    rows = [("en", " ".join(map(str, rng.integers(0, 90_000, 170_000)))) for _ in range(20)]
    col.phrases(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written["chunks"].inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 2
    assert max(g.num_rows for g in groups) == 1
