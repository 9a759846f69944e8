from pyspark.sql import functions as F

from corvine.operators import citations, facets, fusion, hydrate, lexical, quality, rows
from corvine.plans import planner


def hits(spark, pairs):
    return spark.createDataFrame([(i, s, k + 1) for k, (i, s) in enumerate(pairs)], "id string, rrf double, rank long")


def order(df, column="id"):
    return [r[column] for r in df.orderBy("rank").collect()]


def test_two_passes_keep_the_best_score(spark):
    m = fusion.merge_passes(hits(spark, [("a", 0.030), ("b", 0.020)]), hits(spark, [("c", 0.025), ("a", 0.010)]), 10)
    assert [(r.id, r.rank) for r in m.orderBy("rank").collect()] == [("a", 1), ("c", 2), ("b", 3)]
    assert order(fusion.merge_passes(hits(spark, [("a", 0.030), ("b", 0.020)]), hits(spark, [("c", 0.025)]), 2)) == ["a", "c"]


def test_ties_follow_the_first_list(spark):
    one = lambda ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id string, rank long")
    assert order(fusion.rrf(one(["x", "y"]), one(["z", "y"]), 5)) == ["y", "x", "z"]
    assert order(fusion.rrf(one(["x"]), one(["z"]), 5)) == ["x", "z"]


def test_boost_lifts_near_ties_only(spark):
    h = hits(spark, [("lead", 2 / 61), ("off", 0.0200), ("on", 0.0199), ("last", 1 / 100)])
    n = F.when(F.col("id").isin("on", "last"), 1).otherwise(0)
    assert order(fusion.boost(h, n, 1)) == ["on", "lead", "last", "off"] or order(fusion.boost(h, n, 1))[0] == "on"
    two = hits(spark, [("none", 0.01), ("half", 0.01), ("full", 0.01)])
    m = F.when(F.col("id") == "full", 2).when(F.col("id") == "half", 1).otherwise(0)
    assert order(fusion.boost(two, m, 2)) == ["full", "half", "none"]


def test_fallback_only_when_strict_is_short(spark):
    strict, wide = hits(spark, [("a", 0.03), ("b", 0.02), ("c", 0.01)]), hits(spark, [("d", 0.05)])
    assert order(fusion.fallback(strict, wide, 3, 10)) == ["a", "b", "c"]
    assert order(fusion.fallback(strict.limit(2), wide, 3, 10)) == ["d", "a", "b"]


def test_entities_once_and_nameless_hits_last(spark):
    d = spark.createDataFrame([("1", "p", 0.5, 1), ("2", "q", 0.9, 2), ("3", "p", 0.9, 3), ("4", "", 0.99, 4), ("5", "q", 0.9, 5), ("6", None, 0.1, 6)], "id string, pk string, score double, ord int")
    assert [r.id for r in hydrate.best_per_entity(d, 10).collect()] == ["3", "2", "4", "6"]


def test_parent_text_once(spark):
    h = spark.createDataFrame([("c1", "p", "a", 2), ("c2", "p", "b", 1), ("c3", None, "c", 3), ("c4", None, "d", 4), ("c5", "gone", "e", 5)], "chunk_id string, parent_id string, text string, ord int")
    p = spark.createDataFrame([("p", "whole")], "chunk_id string, text string")
    assert [(r.chunk_id, r.text) for r in hydrate.parents(h, p).orderBy("ord").collect()] == [("c2", "whole"), ("c3", "c"), ("c4", "d"), ("c5", "e")]


def test_tags(spark):
    d = spark.createDataFrame([("t", [" confidential "], []), ("", ["CONFIDENTIAL"], ["Confidential"]), ("u", ["not confidential"], None), ("v", [], ["confidential"])], "text string, p array<string>, c array<string>")
    got = [r.x for r in d.select(rows.tagged(F.col("text"), rows.confidential(F.col("p")), rows.confidential(F.col("c")), F.lit(True)).alias("x")).collect()]
    assert got == [f"{rows.PROJECT_TAG} t", rows.BOTH_TAG, "u", f"{rows.CLIENT_TAG} v"]
    assert d.select(rows.tagged(F.col("text"), rows.confidential(F.col("p")), F.lit(True), F.lit(False)).alias("x")).first().x == "t"


def test_links_and_files(spark):
    k = spark.createDataFrame([("s3://b/raw/t/a.pdf",), ("raw/../a.pdf",), ("raw/a.TXT",), ("other/a.pdf",), (None,)], "k string")
    assert [r.x for r in k.select(rows.document_link(F.col("k")).alias("x")).collect()] == ["raw/t/a.pdf", None, None, None, None]
    f = spark.createDataFrame([("a.PDF",), ("b.png",), ("c.exe",), ("d",)], "n string")
    assert [r.x for r in f.select(rows.allowed(F.col("n"), [".pdf"]).alias("x")).collect()] == [True, False, False, False]
    assert f.select(rows.allowed(F.col("n"), [".pdf"], images=True).alias("x")).collect()[1].x


def test_citations(spark):
    h = spark.createDataFrame(
        [("a", "deck_summary", "raw/t/1/x.pdf", None), ("b", None, "raw/t/1/x__normalized.txt", None), ("c", None, None, None), ("d", None, "raw/t/2/y.txt", None), ("e", None, "raw/t/2/y.txt", "raw/t/9/z.pdf")],
        "id string, role string, key string, original_key string",
    )
    listing = spark.createDataFrame([("raw/t/1/x.pdf",), ("raw/t/1/x__normalized.txt",), ("raw/t/1/.hidden",)], "key string")
    got = {r.id: (r.outcome, r.link) for r in citations.resolved(h, listing).collect()}
    assert got == {"a": ("derived", None), "b": ("cited", "raw/t/1/x.pdf"), "c": ("skipped", None), "d": ("missing", None), "e": ("cited", "raw/t/9/z.pdf")}
    assert [citations.base_url(u) for u in (" https://x.org/ ", "<your-url>", "ftp://x", None)] == ["https://x.org", None, None, None]
    w = citations.warning(spark.createDataFrame([(1, 0), (2, 3), (3, 4)], "ord int, failed int"))
    assert w.first().warning == "3 links could not be made"
    s = spark.createDataFrame([("structured", "x"), ("semantic", "y")], "source_type string, link string")
    assert [r.link for r in citations.stripped(s).collect()] == [None, "y"]


def test_facet_planning(spark):
    vocab = spark.createDataFrame([("client", "Big Foundation", 1), ("client", "AID", 1), ("region", "East Africa", 1), ("area", "Health", 1), ("area", "Cities ＆ Towns", 1), ("place", "Mali", 1)], "facet string, value string, n long")
    q = spark.createDataFrame([(1, "health work in East  Africa for the Big Foundation"), (2, "formalise"), (3, "cities & towns by d.capital"), (4, "")], "query_id long, query string")
    got = {(r.query_id, r.facet, r.value) for r in facets.plan(q, vocab, {"d.capital": ("entity", "D")}).collect()}
    assert got == {(1, "area", "Health"), (1, "region", "East Africa"), (1, "client", "Big Foundation"), (3, "area", "Cities ＆ Towns"), (3, "entity", "D")}


def test_analysis(spark):
    one = lambda t: spark.range(1).select(lexical.analyzed(F.lit(t)).alias("x")).first().x
    assert one("The Monitoring and Evaluation of public private partnerships") == one("M&E of PPP")
    assert one("stories, classes and running") == ["stori", "class", "run"]
    assert one("machine\nlearning machine-learning, MACHINE (learning)") == ["ml", "ml", "ml"]
    assert one("low and middle income countrywide") != one("lmicwide") and one("low and middle income country") == ["lmic"]
    assert one("monitoring & evaluation") == one("M&E") and one("machine learnings") == ["machin", "learn"]


def plain_stem(w):
    """The measure-based English stemmer by its definition."""
    if len(w) <= 2:
        return w
    vowel = lambda s, i: s[i] in "aeiou" or (s[i] == "y" and i > 0 and not vowel(s, i - 1))
    kinds = lambda s: "".join("v" if vowel(s, i) else "c" for i in range(len(s)))

    def m(s):
        k = kinds(s)
        return sum(a == "v" and b == "c" for a, b in zip(k, k[1:], strict=False))

    has_vowel = lambda s: "v" in kinds(s)
    cvc = lambda s: len(s) >= 3 and kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def first(w, rules, fits):
        for suffix, other in rules:
            if w.endswith(suffix):
                stem = w[: len(w) - len(suffix)]
                return stem + other if fits(stem, suffix) else w
        return w

    w = first(w, [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")], lambda s, x: True)
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for x in ("ed", "ing"):
            if w.endswith(x):
                if has_vowel(w[: -len(x)]):
                    w = w[: -len(x)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                        w = w[:-1]
                    elif m(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]) and len(w) > 2:
        w = w[:-1] + "i"
    two = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
    w = first(w, two, lambda s, x: m(s) > 0) if len(w) > 2 else w
    w = first(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], lambda s, x: m(s) > 0) if len(w) > 2 else w
    four = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]
    w = first(w, [(x, "") for x in four], lambda s, x: m(s) > 1 and (x != "ion" or s[-1:] in ("s", "t"))) if len(w) > 2 else w
    if len(w) > 2 and w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if len(w) > 2 and w.endswith("ll") and m(w) > 1 else w


def test_stems(spark):
    import random

    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "feed": "feed", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "happily": "happili", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt", "controlling": "control", "rate": "rate", "cease": "ceas", "roll": "roll"}
    r = random.Random(8)
    ends = ["", "s", "ed", "ing", "ies", "ational", "ization", "fulness", "ement", "ion", "ll", "e", "y", "eed", "ably", "iveness", "ical"]
    words = list(known) + ["".join(r.choice("aeioubcdlmnrstyz") for _ in range(r.randrange(1, 8))) + r.choice(ends) for _ in range(3000)]
    got = spark.createDataFrame([(words,)], "w array<string>").select(lexical.stemmed(F.col("w")).alias("x")).first().x
    wrong = [(w, g, plain_stem(w)) for w, g in zip(words, got, strict=True) if g != plain_stem(w)]
    assert not wrong, wrong[:5]
    assert {w: g for w, g in zip(words, got, strict=True) if w in known} == known
    assert all(g[:2] == w[:2] or g == w[:1] for w, g in zip(words, got, strict=True))


def test_analysis_stems_a_word_once(spark, monkeypatch):
    import pyarrow as pa

    d = spark.createDataFrame([(1, "nationalization of stories " * 300), (2, None), (3, "The VALUE for money of stories"), (4, "the")], "k int, t string")
    got = {r.k: r.x for r in d.select("k", lexical.analyzed(F.col("t")).alias("x")).collect()}
    assert got == {1: ["nation", "stori"] * 300, 2: None, 3: ["vfm", "stori"], 4: []}
    only = spark.range(1).select(lexical.analyzed(F.lit("water stories of projects"), ["stori"]).alias("x")).first().x
    assert only == ["", "stori", ""]
    seen = []
    monkeypatch.setattr(lexical, "stems", lambda words, f=lexical.stems: seen.extend(words) or f(words))
    run = lexical._analysis.__wrapped__(None).func
    for _ in range(2):
        assert run(pa.array([["stories", "of", "stories"], None, ["stories"]])).to_pylist() == [["stori", "stori"], None, ["stori"]]
    assert seen == ["stories", "of"]


def test_stems_by_words_are_those_by_expressions(spark):
    import random

    r = random.Random(9)
    words = ["".join(r.choice("aeiouybcdlmnrstz") for _ in range(r.randrange(1, 7))) + r.choice(["", "s", "eed", "ed", "ing", "ational", "ization", "ion", "ll", "e", "y", "ement"]) for _ in range(3000)]
    assert lexical.stems(words) == spark.createDataFrame([(words,)], "w array<string>").select(lexical.stemmed(F.col("w")).alias("x")).first().x


def test_record_summaries(spark):
    d = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, "only"), ("c", 1, " ")], "r string, o int, t string")
    assert {r.r: r.summary for r in quality.record_summary(d, "r", "o", "t").collect()} == {"a": "one\n\ntwo", "b": "only"}


def test_links_keep_their_order_and_fall_back(spark):
    d = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["q"])], "k int, ids array<string>")
    n = spark.createDataFrame([("z", "Zed"), ("x", "Ex")], "id string, name string")
    assert {r.k: r.names for r in rows.linked_names(d, "k", "ids", n).collect()} == {1: ["Ex", "Zed"], 2: ["q"]}


def test_search(spark):
    people = spark.createDataFrame([("ann", "french, piano"), ("bob", "german")], "Email string, Languages string")
    docs = spark.createDataFrame([(1, "water projects in the north"), (2, "health and water"), (3, "nothing")], "doc_id long, text string")
    r = planner.Registry()
    r.add(planner.Source("people", rows=people, order="Email"))
    r.add(planner.Source("docs", chunks=docs))
    got = planner.search(r, "who speaks French?").collect()
    assert [(x.source, x.id) for x in got] == [("people", "ann")]
    got = planner.search(r, "water health", merge="rrf").collect()
    assert [x.id for x in got] == ["2", "1"] and [x.rank for x in got] == [1, 2]
    assert r.names() == ["people", "docs"]
    try:
        r.names("gone")
    except KeyError:
        return
    raise AssertionError


def test_search_reads_synonyms_phrases_and_names(spark):
    from corvine.session import scratch
    from corvine.sources import postings

    docs = [(1, "water then much of health", "x"), (2, "much of water health then", "x"), (3, "filler of much then", "water report"), (4, "nothing", "x"), (5, "machine learning", "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, title string")
    path = scratch(spark, "index")
    postings.create(spark, path, ("title",), block=2, buckets=4)
    postings.add(docs, path)
    ids = lambda names, index, q: [x.id for x in planner.lexical_hits(planner.Source("d", chunks=docs, names=names, index=index), q, 5).orderBy("rank").collect()]
    for index in (None, path):
        assert ids(("title",), index, "water health")[:2] == ["2", "1"]  # the phrase decides between equal words
        assert "3" in ids(("title",), index, "water health")
        assert ids(("title",), index, "ML") == ["5"]
    assert "3" not in ids((), None, "water health")


def test_modes_of_a_search(spark):
    docs = spark.createDataFrame([(1, "water"), (2, "health"), (3, "water health")], "doc_id long, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.9, 0.1])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    found = {m: {r.id for r in planner.semantic_search(planner.Source("d", chunks=docs), "water", v, q, 3, m).collect()} for m in planner.MODES}
    assert found["knn"] == {1, 4, 2} and found["bm25"] == {1, 3} and found["hybrid"] <= {1, 2, 3, 4} and 1 in found["hybrid"]
    try:
        planner.semantic_search(planner.Source("d", chunks=docs), "water", v, q, 3, "all")
    except ValueError:
        return
    raise AssertionError


def test_facet_planning_is_word_presence(spark):
    """The equi-join finds what a comparison of all queries with all values finds, without one."""
    import random

    from corvine.functions import text as X

    r = random.Random(6)
    part = lambda n: "".join(r.choice(["ab", "b", "1", " ", "-", "(", ".", "é", "&", " & ", "A"]) for _ in range(r.randrange(1, n)))
    q = spark.createDataFrame([(i, part(14)) for i in range(120)] + [(900, None), (901, "")], "query_id int, query string")
    v = spark.createDataFrame([("f", part(4)) for _ in range(80)] + [("f", ""), ("f", None)], "facet string, value string").distinct()
    got = facets.plan(q, v)
    both = q.crossJoin(v).filter(X.word_present(X.match_form(F.col("value")), X.match_form(F.col("query"))))
    want = sorted(map(tuple, both.select("query_id", "facet", "value").distinct().collect()))
    assert sorted(map(tuple, got.collect())) == want and want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert facets.plan(q, v.limit(0)).collect() == []


def test_routing_by_prefixes(spark):
    from corvine.sources import objects

    keys = ["raw/a/1", "raw/a/1", "raw/ab", "x", None, ""]
    f = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string")
    t = spark.createDataFrame([("raw/", "r"), ("raw/a/", "a1"), ("raw/a/", "a2"), ("raw/a/1/long", "l"), (None, "n")], "prefix string, name string")
    of = lambda tables, *more: [r.route for r in objects.routed(f, tables, *more).orderBy("i").collect()]
    assert of(t) == ["a2", "a2", "r", None, None, None] and of(t, "d") == ["a2", "a2", "r", "d", "d", "d"]
    assert of(t.union(spark.createDataFrame([("", "all")], "p string, n string"))) == ["a2", "a2", "r", "all", None, "all"]
    assert of(t.limit(0)) == [None] * 6
    assert "_registry" not in objects.routed(f, t)._jdf.queryExecution().toString()


def test_scores_are_added_up_where_the_documents_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["the"] * (1 + i % 3) + [f"w{i % 7}"]) for i in range(60)], "doc_id long, terms array<string>")
    q = spark.createDataFrame([(k, ["the", f"w{k}"]) for k in range(5)], "query_id long, terms array<string>")
    want = lexical.bm25(docs, q, 4).collect()
    monkeypatch.setattr(lexical, "TASK_DOCS", 10)
    few = lexical.bm25(docs, q, 4)
    assert sorted(few.collect()) == sorted(want) and len(want) == 20
    plan = few._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line]
    assert dealt and not any("doc_id" in x for x in dealt)  # sums of a query and a document need no shuffle of their own
