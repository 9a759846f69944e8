import random
import re

from corvine.llm import jaccard_join as J


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {rows[i][0]: (label[i], sum(link[i])) for i in range(n)}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = (out[rng.randrange(len(out))] or "a b").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice([2, 4, 30, 80, 150]))))
    return list(enumerate(out))


def test_equals_brute_force(spark):
    rows = corpus(1) + [(900, ""), (901, None), (902, "..."), (903, "One two"), (904, "one TWO!"), (905, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, rep string, band int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()}
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in J.jaccard_join(docs).collect())


def test_blocks_give_the_same_links(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        w[i] = f"x{i}"
        rows.append((i, " ".join(w)))
    whole = J.deal
    monkeypatch.setattr(J, "deal", lambda m, g, k, w, most, much, tasks: whole(m, g, k, w, 16, 10**9, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    t = "a b c d e f g"
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id, r.class_id, r.n_links) for r in J.jaccard_join(docs).collect() if r.doc_id)
    assert got == [(True, 4, None, 2), (True, 4, None, 2)]  # the null id is the smallest of the group
    assert J.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_that_share_an_id(spark):
    text = lambda a, k=0: " ".join([f"t{i}" for i in range(k)] + [f"{a}{i}" for i in range(60 - k)])
    # sets of equal size under the null id, near copies of them under other ids, and near copies under one id
    rows = [(None, text(a)) for a in "abcdefgh"] + [(1, text("a", 1)), (2, text("b", 1)), (2, text("b", 1)), (3, text("x")), (3, text("y")), (4, text("y", 1)), (5, text("z")), (5, text("z", 1)), (None, text("h", 1)), (6, text("q"))]
    sets = [shingles(t) for _, t in rows]
    want = [(i or 0, sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1) for (i, _), a in zip(rows, sets, strict=True)]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == sorted(want)
    assert {r.doc_id: r.class_id for r in got if r.doc_id and r.doc_id > 3} == {4: 3, 5: 5, 6: 6}


def test_bands_reach_the_recall():
    b = J.bands_for(0.8, 0.999, 8)
    assert 1 - (1 - 0.8**8) ** b >= 0.999 > 1 - (1 - 0.8**8) ** (b - 1)
