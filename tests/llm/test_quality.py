import numpy as np

from corvine.llm import quality as Q
from corvine.session import table


def test_agrees_with_labels_it_never_saw(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = {r.doc_id: r.quality_kept for r in Q.score_documents(docs).collect()}
    good = [got[i] for i, q in labels.items() if q == 1]
    bad = [got[i] for i, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.15


def test_odd_rows_and_clashing_columns(spark):
    rows = [(i, f"This is a plain text number {i} with some ordinary words in it." * 3, 1.5, "v") for i in range(40)]
    rows += [(100, None, 0.0, "v"), (101, "", 0.0, "v"), (None, "A fine short line.", 0.0, "v"), (102, "word " * 40_000, 0.0, "v"), (103, "WHAT!! NOW!! " * 50, 0.0, "v"), (5, rows[5][1], 1.5, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality double, code string")
    got = Q.score_documents(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "code", "quality", "quality_kept"}
    by = {r.doc_id: r.quality_kept for r in got}
    assert not by[100] and not by[101] and not by[102] and not by[103] and all(by[i] for i in range(40))
    assert Q.score_documents(docs.limit(0)).collect() == []


def test_em_trusts_consistent_labellers():
    good, bad = [Q.SILENT] * 6 + [Q.GOOD] * 3, [Q.BAD, *[Q.SILENT] * 8]
    short = [Q.UNFIT] * 9
    p = Q.posteriors({Q.code(good): 900, Q.code(bad): 100, Q.code(short): 5})
    assert p[Q.code(good)] > 0.95 and p[Q.code(bad)] < 0.05 and p[Q.code(short)] > 0.5


def test_equals_a_plain_version(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()] + [(None, "A line without an id."), (5000, "")]
    got = {r.doc_id: r.quality for r in Q.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = [Q.measures(t or "", Q.Shapes()) for _, t in rows]
    votes = [Q.code(Q.votes(m)) for m, _, _ in seen]
    post = Q.posteriors({c: votes.count(c) for c in set(votes)})
    feats = [{k: float(np.float32(v)) for k, v in Q.features(*x).items()} for x in seen]
    w, bias = Q.fit_linear([(f, post[c]) for f, c in zip(feats, votes)])
    for (i, _), (m, _, _), f in zip(rows, seen, feats):
        z = bias + sum(w[k] * v for k, v in f.items())
        assert abs(got[i] - (1 / (1 + np.exp(-z)) if m["n"] else 0)) < 1e-6
