import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corvine.operators import chunks, facets, hydrate, ordered
from corvine.sources import decks, objects, parsers

RESUME = """# Profile
Analyst of things.

# Experience
Senior Analyst | Acme | Jan 2020 - Present
Did much work over many long days in several places.

Analyst | Beta | 2015 - 2019
Did other work.

# Skills
python, spark
"""


def office(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def test_sections_and_paths(spark):
    text = "---\nowner: me\n---\nintro\n# A\nx\n### C\ny\n## B\nz\nALL CAPS HEADING\nw\nWork History\nq\nPeter Parker\n"
    d = spark.createDataFrame([(1, text), (2, "flat text"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.heading, r.level, r.path, r.body) for r in parsers.sections(d).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, None, 0, [], "owner: me\n\nintro"),
        (1, "A", 1, ["A"], "x"),
        (1, "C", 3, ["A", "C"], "y"),
        (1, "B", 2, ["A", "B"], "z"),
        (1, "ALL CAPS HEADING", 1, ["ALL CAPS HEADING"], "w"),
        (1, "Work History", 1, ["Work History"], "q\nPeter Parker"),
        (2, None, 0, [], "flat text"),
    ]
    assert d.filter("doc_id = 1").select(parsers.front_matter(F.col("text")).alias("m")).first().m == {"owner": "me"}


def test_tidy(spark):
    s = spark.createDataFrame([(1, 0, "Contents", 1, "1 2 3"), (1, 1, "A", 1, "x\n\n\n\n\n\ny"), (1, 2, "A", 1, "z")], "doc_id long, ord int, heading string, level int, body string")
    assert [(r.heading, r.body) for r in parsers.tidy(s).orderBy("ord").collect()] == [("A", "x\n\n\ny"), (None, "z")]


def test_office_files(spark):
    word = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Intro</a:t></a:r></a:p><a:p><a:r><a:t>point</a:t></a:r></a:p><p:pic/></p:sld>'
    sheet = '<x:worksheet xmlns:x="x"><x:sheetData><x:row><x:c t="s"><x:v>0</x:v></x:c><x:c><x:v>5</x:v></x:c></x:row><x:row/></x:sheetData></x:worksheet>'
    book = '<x:workbook xmlns:x="x"><x:sheets><x:sheet name="One"/></x:sheets></x:workbook>'
    files = [
        ("1", "a.docx", office({"word/document.xml": word})),
        ("2", "a.pptx", office({"ppt/slides/slide1.xml": slide})),
        ("3", "a.xlsx", office({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<x:sst xmlns:x="x"><x:si><x:t>k</x:t></x:si></x:sst>'})),
        ("4", "a.pdf", b"%PDF-1.4 stream\nBT (Hello \\(x\\)) Tj ET\nendstream"),
        ("5", "broken.docx", b"no zip"),
        ("6", "README", b"plain"),
    ]
    got = {r.doc_id: r.text for r in parsers.parse_files(spark.createDataFrame(files, "doc_id string, key string, content binary")).collect()}
    assert got == {"1": "# Title\nBody\na | b", "2": "## Slide 1: Intro\npoint\n[image]", "3": "## One\n| k | 5 |", "4": "Hello (x)", "5": None, "6": "plain"}


def test_password_gate(spark):
    b = [(b"%PDF-1.7 /Encrypt 5 0 R",), (b"%PDF-1.7",), (bytes.fromhex("d0cf11e0a1b11ae1") + "EncryptedPackage".encode("utf-16-le"),), (None,)]
    assert [r.x for r in spark.createDataFrame(b, "c binary").select(parsers.encrypted(F.col("c")).alias("x")).collect()] == [True, False, True, False]


def test_replies(spark):
    d = spark.createDataFrame([("a", "hi\n=== SLIDE 1 ===\nTITLE: T\nTEXT: one\ntwo\nVISUAL: v\n=== SLIDE 2 ===\nTEXT: x\n=== SLIDE 1 ===\nTITLE: U\n")], "id string, reply string")
    got = {r.slide: tuple(r.fields) for r in parsers.reply_slides(d).collect()}
    assert got == {1: ("U", "", "", ""), 2: ("", "x", "", "")}
    f = spark.range(1).select(parsers.reply_fields(F.lit("TITLE: T\nTEXT: one\ntwo\nVISUAL: v")).alias("f")).first().f
    assert tuple(f) == ("T", "one\ntwo", "", "v")


def test_slides(spark):
    s = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 10, 1), (1, "c", 1_000_000, 0), (1, "d", 450_000, 2)], "slide int, id string, left int, top int")
    assert [r.id for r in parsers.reading_order(s).orderBy("place").collect()] == ["b", "d", "a", "c"]
    d = spark.createDataFrame([("k", 2, None, "b2", "n"), ("k", 1, "T", "b1", None)], "deck string, slide int, title string, body string, notes string")
    assert parsers.deck(d).first().markdown == "## Slide 1: T\nb1\n[Page 1]\n\n## Slide 2\nb2\n[Notes:] n\n[Page 2]"


def test_entries(spark):
    of = lambda *bodies: [list(r.entries) for r in chunks.with_entries(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")).orderBy("i").collect()]
    got = of("pre\n\nA | B | 2019 - 2020\ntext\n\nmore\n\nC | D", "A | 2001 - 2002\nB | 2003 - now", "one\n\ntwo", "", None, "x\n\ny\n\nJan 2019 – March 2020 at Z\n\nrest", "a | b\nplain line", "a || b\n\nc")
    assert got == [["pre", "A | B | 2019 - 2020\ntext\n\nmore", "C | D"], ["A | 2001 - 2002", "B | 2003 - now"], ["one", "two"], [], [], ["x\n\ny", "Jan 2019 – March 2020 at Z\n\nrest"], ["a | b\nplain line"], ["a || b", "c"]]


def plain_resume(sections, c):
    """One document's rows (parent, child, text, kind, part), section after section."""
    out, parent = [], 0
    for heading, kind, body, entries in sections:
        text = "\n\n".join(x for x in (heading, body) if x)
        if not text.split():
            continue
        entries = entries if kind in chunks.LISTS or kind in ("unknown", "other") else []
        if kind in chunks.LISTS or len(entries) > 1:
            out.append((parent, None, text, kind, None))
            held = []
            for k, e in enumerate(entries):
                if held and len(e.split()) < c.least:
                    held[-1][0] += "\n\n" + e
                else:
                    held += [[t, k] for t in chunks.cut_words(f"{heading}:\n{e}" if heading else e, c.child, c.child_overlap)]
            out += [(parent, i, t, kind, k) for i, (t, k) in enumerate(held)]
            parent += 1
            continue
        for p in chunks.cut_words(text, c.parent, c.parent_overlap):
            out.append((parent, None, p, kind, None))
            out += [(parent, i, t, kind, None) for i, t in enumerate(chunks.cut_words(p, c.child, c.child_overlap)) if not i or len(t.split()) >= c.least]
            parent += 1
    return out


def test_resume_equals_a_plain_version(spark):
    rng = random.Random(7)
    heads = {"Experience": "experience", "Skills": "skills", "Education": "education", "Odd things": "other", None: "unknown"}
    lines = ["A | B | 2019 - 2020", "Jan 2001 to now", "word", "  several words on one line  ", "", "", "x y z " * 12]
    rows = []
    for doc in range(40):
        for ord_ in range(rng.randrange(1, 6)):
            heading = rng.choice(list(heads))
            rows.append((doc, ord_, heading, "\n".join(rng.choices(lines, k=rng.randrange(0, 9)))))
    s = spark.createDataFrame(rows, "doc_id long, ord int, heading string, body string")
    entries = {(r.doc_id, r.ord): list(r.entries) for r in chunks.with_entries(s).collect()}
    for c in (chunks.Config(parent=20, parent_overlap=3, child=7, child_overlap=2, least=3), chunks.Config()):
        want = []
        for doc in range(40):
            own = [(h, heads[h], b, entries[d, o]) for d, o, h, b in rows if d == doc]
            want += [(doc, *r) for r in plain_resume(own, c)]
        got = [tuple(r) for r in chunks.chunk(s, "resume", c).select("doc_id", "parent", "child", "text", "kind", "part").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_resume_chunks(spark):
    d = spark.createDataFrame([(1, RESUME)], "doc_id long, text string")
    c = chunks.chunk(parsers.sections(d), "resume", chunks.Config(least=3)).orderBy("parent", F.col("child").asc_nulls_first()).collect()
    assert [(r.kind, r.child) for r in c] == [("summary", None), ("summary", 0), ("experience", None), ("experience", 0), ("experience", 1), ("skills", None), ("skills", 0)]
    assert c[3].text.startswith("Experience:\nSenior Analyst") and [r.part for r in c[3:5]] == [0, 1]


def cut_words(text: str, size: int, overlap: int = 0) -> list[str]:
    """cut() of one text."""
    w = [m.span() for m in re.finditer(r"\S+", text)]
    starts = range(0, max(1, len(w) - overlap), size - overlap) if w else ()
    return [text[w[i][0] : w[min(i + size, len(w)) - 1][1]] for i in starts]


ATOMS = {"notes": re.compile(r"^(\[Notes:\]|Notes:)"), "table": re.compile(r"^\|"), "visual": re.compile(r"(?i)^(visual|insights):")}


def slide_blocks(body: str, c) -> list[str]:
    """The plain version of with_blocks()."""
    blocks: list[list[str]] = []
    kinds: list[str] = []
    room = 0
    for line in (x.strip() for x in body.split("\n") if x.strip()):
        kind = next((k for k, p in ATOMS.items() if p.match(line)), "plain")
        last = kinds[-1] if kinds else ""
        size = len(line.split())
        joins = kind == last == "table" or kind == "plain" and last == "visual" or kind == last == "plain" and room + size <= c.child
        if not joins:
            blocks.append([])
            kinds.append(kind)
            room = 0
        blocks[-1].append(line)
        room += size
    out = [(t, k) for b, k in zip(blocks, kinds, strict=True) for t in cut_words("\n".join(b), c.child)]
    return [t for i, (t, k) in enumerate(out) if not i or k == "notes" or len(t.split()) >= c.least]


def test_slide_chunks(spark):
    import random

    c = chunks.Config(child=20, child_overlap=0, least=2)
    body = "intro line here\n| a | b |\n| 1 | 2 |\nVISUAL: a bar chart\nrises fast\n[Notes:] say this\n" + "word " * 30
    blocks = slide_blocks(body, c)
    assert blocks[:4] == ["intro line here", "| a | b |\n| 1 | 2 |", "VISUAL: a bar chart\nrises fast", "[Notes:] say this"] and len(blocks) == 6
    r = random.Random(5)
    line = lambda: r.choice(["", "  ", "one", "a b c d e f g", "| x | y", "Notes: n", "notes: not", "Visual: v w", "insights: i", " spaced\tout  line ", "w " * 25])
    bodies = [None, "", "\n \n", body, *("\n".join(line() for _ in range(r.randrange(40))) for _ in range(60)), "\n".join(line() for _ in range(3000))]
    d = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {x.id: x.kids for x in chunks.with_blocks(d, c).collect()}
    assert got == {i: slide_blocks(b or "", c) for i, b in enumerate(bodies)}


def test_windows_and_config(spark):
    w = lambda n, size, lap: [list(x) for x in spark.range(1).select(chunks.windows(F.array(*[F.lit(str(i)) for i in range(n)]) if n else F.array().cast("array<string>"), size, lap).alias("w")).first().w]
    assert w(5, 10, 2) == [["0", "1", "2", "3", "4"]] and w(0, 3, 1) == []
    assert w(7, 3, 1) == [["0", "1", "2"], ["2", "3", "4"], ["4", "5", "6"]]
    for bad in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            chunks.Config(child=bad[0], child_overlap=bad[1])


def test_ordered_folds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = lambda v: F.array(*map(F.lit, v))
    assert one(ordered.waves(arr([3, 4, 4, 9, 1]), 8)) == [0, 0, 1, 2, 3]
    assert one(ordered.even_sample(arr(list(range(40))), 12)) == [round(i * 39 / 11) for i in range(12)]
    assert one(ordered.even_sample(arr([1, 2]), 12)) == [1, 2]


def test_facets(spark):
    df = spark.createDataFrame([(1, ["a", None], "x"), (2, None, "y")], "id int, tags array<string>, k string")
    ids = lambda w: [r.id for r in df.filter(facets.condition(df, w)).collect()]
    assert ids({"tags": ["a"]}) == [1] and ids({"tags": ["z"]}) == [] and ids({"nope": 1, "k": None}) == [1, 2] and ids({"k": ["x", "y"], "tags": "a"}) == [1]
    assert facets.split_soft({"a": ["1"], "b": ["2"]}, frozenset({"b"})) == ({"a": ["1"]}, {"b": ["2"]})


def test_rerank_and_embedding_isolate_failures(spark):
    h = spark.createDataFrame([("x of", 1), (None, 2)], "text string, ord int")
    assert [r.rerank_score for r in hydrate.rerank(h, "of").orderBy("ord").collect()] == [1.0, 0.0]

    def broken(q, t):
        raise OSError

    assert [r.rerank_score for r in hydrate.rerank(h, "of", broken).collect()] == [None, None]
    c = spark.createDataFrame([("child", "a"), ("parent", "b"), ("child", "bad")], "chunk_type string, text string")

    def model(texts):
        return [[1.0, 2.0] if "bad" not in t else [0.0] for t in texts]

    assert {r.text: r.embedding for r in hydrate.embed(c, model, 2).collect()} == {"a": [1.0, 2.0], "bad": None}


def test_approximate_search_finds_most_of_the_exact(spark, sf):
    from corvine.operators import vector
    from corvine.session import table

    v = table(spark, sf, "embeddings")
    found = {"hashed": 0, "quantised": 0}
    for i in range(0, 50, 10):
        q = v.filter(F.col("vec_id") == i).select(F.col("embedding").cast("array<double>").alias("q"))
        exact = {r.vec_id for r in vector.knn(v, q, 10).collect()}
        found["quantised"] += len(exact & {r.vec_id for r in vector.knn_quantised(v, q, 10).collect()})
        found["hashed"] += len(exact & {r.vec_id for r in vector.knn_hashed(v, q, 10).collect()})
    assert found["quantised"] >= 45 and found["hashed"] >= 35


def test_slides_described_one_by_one(spark):
    rows = [("a", 1, b"x"), ("a", 2, b"bad"), ("b", 1, b"y"), ("b", 2, b"")]
    d = spark.createDataFrame(rows, "deck string, slide int, content binary")

    def render():
        return lambda content, number: content + str(number).encode() if content else None

    def describe():
        def tell(image):
            if image.startswith(b"bad"):
                raise ValueError("no")
            return image.decode().upper()

        return tell

    got = {(r.deck, r.slide): (r.reply, r.error) for r in decks.described(d, render, describe, 2).collect()}
    assert got == {("a", 1): ("X1", None), ("a", 2): (None, "ValueError: no"), ("b", 1): ("Y1", None), ("b", 2): (None, None)}


def test_store(spark, tmp_path):
    s = objects.Store(spark, f"file://{tmp_path}/bucket")
    assert s.get("raw/t/1/a.txt") is None and not s.exists("raw/t/1/a.txt")
    s.put("raw/t/1/a.txt", "é\n".encode())
    s.put("raw/t/1/a.txt", b"new \xff")
    assert s.exists("raw/t/1/a.txt") and s.get("raw/t/1/a.txt") == b"new \xff" and s.text("raw/t/1/a.txt") == "new \ufffd"
    s.delete("raw/t/1/a.txt")
    assert s.text("raw/t/1/a.txt") is None


STATS = "s struct<text_chars:int,n_shapes:int,has_table:boolean,has_chart:boolean,has_picture:boolean,has_group:boolean>"


def stats(chars=0, shapes=0, table=None, chart=None, picture=None, group=None):
    return (chars, shapes, table, chart, picture, group)


def test_slide_classes(spark):
    want = [
        (stats(400, 3), "TEXT"), (stats(30, 2, chart=True), "DIAGRAM"), (stats(500, 5, chart=True), "MIXED"), (stats(60, 8, group=True), "FRAMEWORK"),
        (stats(10, 1, picture=True), "IMAGE"), (stats(120, 1, picture=True), "MIXED"), (stats(20, 1, table=True), "TABLE"), (stats(80, 1, table=True), "TEXT"), (stats(), "EMPTY"),
        (stats(200, 1, chart=True), "DIAGRAM"), ((None,) * 6, "EMPTY"),
    ]
    d = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(want)], f"i int, {STATS}")
    assert [r.k for r in d.select("i", parsers.slide_class(F.col("s")).alias("k")).orderBy("i").collect()] == [k for _, k in want]


def test_slide_gates(spark):
    one = lambda schema, row, c: spark.createDataFrame([row], schema).select(c.alias("x")).first().x
    visual = lambda **s: one(STATS, (stats(**s),), parsers.is_visual(F.col("s")))
    assert visual(group=True) and visual(chart=True, chars=5000) and visual(picture=True, chars=20)
    assert not visual(picture=True, chars=800) and not visual(chars=9) and not visual(picture=True, chars=200)
    schema = f"{STATS}, t string, c array<string>"
    missed = lambda s, t, c: one(schema, (s, t, c), parsers.needs_image(F.col("s"), F.col("t"), F.col("c")))
    assert missed(stats(200, 3), "tiny", []) and not missed(stats(200, 3), "x" * 150, []) and not missed(stats(), "", [])
    assert not missed(stats(200, 3), " x ", ["y" * 99, None]) and missed(stats(200, 3), " x ", ["y" * 98]) and missed(stats(9, 1), None, None) and not missed(stats(9, 0), None, None)
    again = lambda k, t, v: one("k string, t string, v string", (k, t, v), parsers.needs_escalation(F.col("k"), F.col("t"), F.col("v")))
    assert not again("TEXT", "", "") and again("DIAGRAM", "", "") and again("FRAMEWORK", "a few words here only", "") and again("FRAMEWORK", "x" * 99, " ")
    assert not again("DIAGRAM", "", "CHART: Revenue by region, X-axis: region, Y-axis: USD m") and not again("IMAGE", "x" * 40, None) and again("IMAGE", "x" * 39, None)
    both = lambda s, t: one(schema, (s, t, []), parsers.attaches_image(F.col("s"), F.col("t"), F.col("c")))
    assert both(stats(200, 3), "tiny") and both(stats(0, 1, group=True), "") and not both(stats(200, 3), "x" * 150)


def test_headers_of_metadata(spark):
    from corvine.operators import rows

    d = spark.createDataFrame([(1, " Ann ", ["a", "", None, "b"], 0), (2, None, [], None), (3, "  ", ["", None], None)], "k int, Name string, Client array<string>, Year int")
    got = {r.k: r.h for r in d.select("k", rows.header(d, ["Name", "Author", "Client"], ("Year", "Name")).alias("h")).collect()}
    assert got == {1: "---\nName: Ann\nClient: a, b\nYear: 0\n---\n\n", 2: "", 3: ""}


def test_shapes_of_replies(spark):
    from corvine.operators import rows

    want = {"how much is it": "count_only", "The size of that": "count_only", "list the offices": "full_records", "emails only": "full_records", "list all names": "column_subset", "names": "full_records", "Show me the NAME": "column_subset", None: "full_records"}
    d = spark.createDataFrame([(q,) for q in want], "q string")
    assert {r.q: r.s for r in d.select("q", rows.reply_shape(F.col("q")).alias("s")).collect()} == want


def test_enriching_drops_blank_keys(spark):
    from corvine.operators import rows

    d = spark.createDataFrame([(None, 1), ("", 2), ("A b", 3), ("a_b", 4), ("C", 5)], "k string, i int")
    hits = spark.createDataFrame([(None,), ("",), ("a B",), ("c",), ("C",)], "pk string")
    assert [r.i for r in rows.enrich(d, hits, "k").collect()] == [3, 5]


def test_singular_fields_are_found():
    from corvine.plans import planner

    assert planner.classify("who speaks French?", ["Email", "Language"]).formula == planner.classify("who speaks French?", ["Email", "language"]).formula.replace("{language}", "{Language}")
    assert "{Hobby}" in planner.classify("who is interested in chess?", ["Email", "Hobby"]).formula
    assert planner.classify("who knows chess?", ["Email", "Hobby"]) is None
