import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from corvine.session import table


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in C.STAGES[:-1]:
        new = C.cut(stage(spark, docs, sf), name)
        assert new.columns == columns
        kept[name] = {r.doc_id: r.text for r in new.collect()}
        docs = new
    first = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    good = {r.doc_id for r in table(spark, sf, "labels").collect() if r.quality == 1}
    bad = {r.doc_id for r in table(spark, sf, "labels").collect() if r.quality == 0}
    q = kept["quality"]
    assert len(good - q.keys()) <= 0.01 * len(good) and len(bad & q.keys()) <= 0.2 * len(bad)
    by_text = {}
    for i, t in q.items():
        by_text[t] = max(i, by_text.get(t, -1))
    assert kept["exact_dedup"].keys() == set(by_text.values())
    assert kept["near_dedup"].keys() <= kept["exact_dedup"].keys()
    assert kept["pii"].keys() == kept["near_dedup"].keys()
    for i, t in kept["pii"].items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
        if "[" not in t:
            assert t == first[i]
    out = C.run(spark, sf).collect()
    assert {r.doc_id for r in out} == kept["pii"].keys()
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_odd_tables(spark):
    rows = [(None, "a fine text of a few words", "en", "s", 26, 1), (1, None, "en", "s", None, 1), (2, "", None, "s", 0, 1), (3, "one two three " * 9, "en", None, 126, 1), (4, "one two three " * 9, "en", None, 126, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    for d in (docs, docs.limit(0)):
        for name, stage in C.STAGES[:-1]:
            d = C.cut(stage(spark, d, ""), name)
            assert d.columns == docs.columns
        C.STAGES[-1][1](spark, d, "").collect()


def test_rows_without_an_id_of_their_own(spark, sf):
    d = table(spark, sf, "documents")
    d = d.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("doc_id") / 2)))
    docs = C.cut(d.unionByName(d.filter("doc_id is null or doc_id < 100")), "odd")  # null ids, two texts under one id, repeated rows
    rows = lambda x: sorted(map(str, x.select(*docs.columns).collect()))
    good = C.cut(C.keep_good(spark, docs, sf), "good")
    assert rows(good) == rows(C.quality.score_documents(docs).filter("quality_kept"))
    largest = {}
    for r in good.collect():
        largest[r.text] = max(-1 if r.doc_id is None else r.doc_id, largest.get(r.text, -1))
    got = C.drop_copies(spark, good, sf).collect()
    assert sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in got) == sorted(largest.items())
    text = lambda a, k=0: " ".join([f"t{i}" for i in range(k)] + [f"{a}{i}" for i in range(60 - k)])
    near = [(None, text("a")), (None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (2, text("d", 1)), (4, text("e")), (3, text("e", 1)), (None, "?"), (5, text("f")), (None, text("f", 1))]
    got = C.drop_near_copies(spark, spark.createDataFrame(near, "doc_id long, text string"), sf).collect()
    want = [*near[1:5], *near[7:9], near[10]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
