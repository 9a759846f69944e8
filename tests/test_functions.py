import pytest
from pyspark.sql import functions as F

from corvine.functions import formula, render
from corvine.functions import text as X
from corvine.plans import planner


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_slugs_masks_and_names(spark):
    assert one(spark, X.slug(F.lit("  Cafe & Bar. "), "u")) == "cafe___bar"
    assert one(spark, X.slug(F.lit("Café Ünter"), "u", fold=True)) == "cafe__u_nter"
    assert one(spark, X.slug(F.lit("Café Été"), "u")) == "cafe__e_te" and one(spark, X.slug(F.lit("Café"), "u", fold=False)) == "caf"
    assert one(spark, X.identifier(F.lit("José@x.org"))) == "jose_@x.org"
    assert one(spark, X.slug(F.lit(" .. "), "unknown_table")) == "unknown_table"
    assert one(spark, X.identifier(F.lit("A+B@x.org "))) == "a+b@x.org"
    assert [one(spark, X.mask(F.lit(v))) for v in ("", "ab", "abc")] == ["(empty)", "…", "ab…"]
    assert one(spark, X.filename(F.lit("dir/My File.PDF"))) == "my_file.pdf"
    assert one(spark, X.facet_value(F.lit(" Cities ＆ Towns "))) == "Cities & Towns"


def test_words_are_found_on_boundaries(spark):
    hit = lambda v, q: one(spark, X.word_present(X.match_form(F.lit(v)), X.match_form(F.lit(q))))
    assert not hit("Mali", "formalise the plan")
    assert hit("Cities ＆ Towns", "in cities &  towns")
    assert hit("D. Capital", "the d. capital team") and not hit("", "x")


def test_query_cleanup_and_expansion(spark):
    assert one(spark, X.strip_stop_words(F.lit("Find me the RFP for water"))) == "rfp water"
    assert one(spark, X.expand(F.lit("the RFP"))) == "rfp request for proposal"
    assert one(spark, X.expand(F.lit("show me the"))) == ""
    assert "monitoring evaluation" in one(spark, X.expand(F.lit("M&E lead")))


def test_sections(spark):
    assert [one(spark, X.canonical_section(F.lit(h).cast("string"))) for h in ("Work Experience:", "Nonsense", "", None)] == ["experience", "other", "unknown", "unknown"]


def test_formulas(spark):
    df = spark.createDataFrame([(1, "Ann's", "de, FR", "2024-01-02"), (2, "Bob", None, "2024-03-01")], "id int, name string, langs string, day string")
    cols = {c: F.col(c) for c in df.columns}
    ids = lambda f: [r.id for r in df.filter(formula.compile(f, cols)).orderBy("id").collect()]
    assert ids("LOWER({name})=" + formula.quote("ann's")) == [1]
    assert ids('FIND("fr", LOWER({langs}))') == [1] and ids("FIND('fr', {langs})") == []
    assert ids("OR({id}=2, AND({name}='x', {id}=1))") == [2]
    assert ids("IS_AFTER(DATETIME_PARSE({day}), DATETIME_PARSE('2024-02-01'))") == [2]
    assert ids("NOT({langs}='x')") == [1]
    assert formula.fields("AND({a}='{b}', {c})") == ["a", "c"]
    assert len(formula.any_of("n", [str(i) for i in range(45)])) == 3
    for bad in ("{nope}=1", "AND(", "FOO({id})", "{id} ="):
        with pytest.raises(formula.FormulaError):
            formula.compile(bad, cols)


def test_tokens():
    t = render.token({"k": "raw/a"}, b"s", 100)
    assert render.verified(t, b"s", 50) == {"k": "raw/a", "exp": 100}
    assert render.verified(t, b"s", 100) is None and render.verified(t, b"x", 50) is None and render.verified(t[:-2], b"s", 50) is None and render.verified("", b"s", 0) is None


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a|b\nc", ["x", "y"], None)], "id int, t string, l array<string>, n string")
    cols = render.columns_of(df, ["t"], ["zz", "id"])
    assert cols == ["t", "id", "l", "n"]
    assert render.markdown(df, cols).splitlines()[2] == "| a\\|b c | 1 | x, y |  |"


def test_planner():
    cols = ["Email", "Languages", "Skills", "Display Name"]
    p = planner.classify("Who speaks French?", cols)
    assert p.mode == "rows_only" and p.formula == "FIND('french', LOWER({Languages}))" and p.fields == ("Display Name", "Email", "Languages", "Skills")
    assert planner.classify("Who plays piano at the office with experience in water", cols).mode == "hybrid"
    assert planner.classify("water projects", cols) is None
    assert planner.plan_question("water projects", cols).mode == "semantic_only"
    assert planner.plan_question("x", cols, lambda q, c: planner.Plan("hybrid", "{Skills}='a'", q, 500, 99)).top_k == 50
    with pytest.raises(formula.FormulaError):
        planner.plan_question("x", cols, lambda q, c: planner.Plan("hybrid", "{Gone}='a'"))
    assert planner.plan_question("x", cols, lambda q, c: 1 / 0).mode == "semantic_only"


def test_query_embedder_and_steps(spark):
    calls = []
    e = planner.QueryEmbedder(lambda q: calls.append(q) or [1.0, 2.0], 2, most=2)
    assert [e(q) for q in ("a", "b", "a", "c", "a", "b")][0] == [1.0, 2.0] and calls == ["query: a", "query: b", "query: c", "query: b"]
    with pytest.raises(ValueError):
        planner.QueryEmbedder(lambda q: [1.0], 2)("a")
    got = planner.execute([planner.Step("both", lambda a, b: a.intersect(b), ("x", "y")), planner.Step("x", lambda: spark.range(5)), planner.Step("y", lambda: spark.range(3, 9))])
    assert sorted(r.id for r in got["both"].collect()) == [3, 4]
    with pytest.raises(ValueError):
        planner.execute([planner.Step("a", lambda b: b, ("b",)), planner.Step("b", lambda a: a, ("a",))])
    assert [c["call"] for c in planner.suggested_calls(planner.Plan("hybrid", "{a}='x'", "q"), "s")] == ["lookup", "semantic_search"]


def test_token_counts(spark):
    from corvine.functions import tokens

    df = spark.createDataFrame([("a b  c",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(tokens.words(F.col("t")).alias("n")).collect()] == [3, 0, 0]
    assert [r.n for r in df.select(tokens.counter(lambda: lambda b: [len(x) for x in b])(F.col("t")).alias("n")).collect()] == [6, 0, 0]
