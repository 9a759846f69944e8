import random

from corvine.llm import line_dedup as L


def brute(rows, least):
    """Deleted lines by comparing all runs of all documents."""
    docs = []
    for i, t in rows:
        lines = (t or "").split("\n")
        docs.append((i, lines, [k for k, x in enumerate(lines) if x.strip()]))
    seen, out = {}, {}
    for d, (i, lines, full) in enumerate(docs):
        s = [lines[k].strip() for k in full]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                seen.setdefault(tuple(s[a:b]), (d, a))
    for d, (i, lines, full) in enumerate(docs):
        s = [lines[k].strip() for k in full]
        gone = set()
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(len(x.split()) for x in s[a:b]) >= least and seen[tuple(s[a:b])] < (d, a):
                    gone |= set(range(a, b))
        drop = {full[k] for k in gone}
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in drop), len(full), len(gone))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("a b c d e f g".split(), k=rng.choice([1, 1, 2, 3, 6]))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [rng.choice([*pool, ""]) for _ in range(rng.randrange(0, 14))]
        if rows and rng.random() < 0.6:
            lines += rng.choice(rows)[1].split("\n")[: rng.randrange(1, 12)]
        rows.append((i, "\n".join(lines)))
    rows.append((100, rows[5][1] + "\n" + rows[5][1]))
    for least in (4, 9, 20):
        docs = spark.createDataFrame([(i, t, 5, "q") for i, t in rows], "doc_id long, text string, idx int, rank string")
        got = {r.doc_id: (r.clean_text, r.n_lines, r.n_deleted) for r in L.line_dedup(docs, least).collect()}
        assert got == brute(rows, least)


def test_odd_rows(spark):
    t = "x " * 60
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None), (4, ""), (5, "word " * 50_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_deleted, r.clean_text is None) for r in L.line_dedup(docs).collect())
    assert got == [(0, 1, 0, False), (1, 1, 1, False), (1, 1, 1, False), (2, 1, 1, False), (3, 0, 0, True), (4, 0, 0, False), (5, 1, 0, False)]
    assert L.line_dedup(docs.limit(0)).collect() == []


def test_many_repeated_rows_and_a_very_long_line(spark, monkeypatch):
    body = "\n".join(" ".join(f"w{k}{j}" for j in range(8)) for k in range(20))
    rows = [(7, body)] * 2000 + [(8, body), (9, "y " * 400_000), (10, "y " * 400_000 + "\n" + body)]
    seen = []
    whole = L.repeated_runs
    monkeypatch.setattr(L, "repeated_runs", lambda lines: seen.append(lines.count()) or whole(lines))
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert seen == [20 + 20 + 1 + 21]  # repeated rows are one document
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_lines, r.n_deleted) for r in got} == {(7, 20, 0), (8, 20, 20), (9, 1, 0), (10, 21, 21)}
