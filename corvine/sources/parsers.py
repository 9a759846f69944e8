"""Texts and binaries to ordered sections: headings, front matter, office files, model replies, password gate."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of which a short title-case heading holds at least one.
HEADING_WORDS = """
summary profile objective about overview skills competencies expertise proficiencies qualifications experience
employment work career history record professional education academic training projects portfolio certifications
certificates licenses credentials awards achievements honors recognition languages language publications research
volunteer volunteering community other additional interests activities references
""".split()
# Shapes of heading lines.
MARKDOWN = r"^(#{1,6})\s+(.+)$"
CAPITALS = r"^[A-Z][A-Z0-9 \-:&,/()]{3,}$"
TITLE = r"^[A-Z][a-zA-Z&\-\s]{1,59}$"
FRONT = r"(?s)\A---\n(.*?)\n---\n"


def level_of(line: Column) -> Column:
    """The heading level of a stripped line, 0 for none."""
    words = F.split(F.lower(line), r"\s+")
    title = line.rlike(TITLE) & (F.size(words) <= 5) & F.arrays_overlap(words, F.array(*map(F.lit, HEADING_WORDS)))
    marks = F.length(F.regexp_extract(line, MARKDOWN, 1))
    return F.when(marks > 0, marks).when(F.length(line).between(4, 100) & line.rlike(CAPITALS), 1).when(title, 1).otherwise(0)


def front_matter(text: Column) -> Column:
    """The `key: value` lines of a fenced block at the start, as a map."""
    lines = F.filter(F.split(F.regexp_extract(text, FRONT, 1), "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, also where many lambdas read them: a generator stands between."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, heading, level, path, body: a document's sections in order; no shuffle.

    Front matter loses its fences and stays in the text. A heading's path holds, for each level above its own, the last
    heading of that depth since a shallower one, then itself. Sections without heading and text go; a text without
    headings is one section. Lines are cut into sections before anything is multiplied, so rows hold their own text only.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), FRONT, "$1\n\n")
    d = materialised(docs.select("doc_id", body.alias("_body")), lines=F.split("_body", "\r?\n"))
    d = materialised(d.drop("_body"), levels=F.transform("lines", lambda x: level_of(F.trim(x))))
    at = F.filter(F.transform("levels", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    d = materialised(d, starts=F.concat(F.array(F.lit(-1)), at))
    name = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^#{1,6}\s+", ""))

    def part(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("lines"))
        text = F.array_join(F.slice("lines", i + 2, F.greatest(end - i - 1, F.lit(0))), "\n")
        return F.struct(F.coalesce(F.get("levels", i), F.lit(0)).alias("level"), F.when(i >= 0, name(F.get("lines", i))).alias("heading"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("body"))

    d = materialised(d, parts=F.transform("starts", part)).drop("lines", "levels", "starts")
    d = materialised(d, paths=heading_paths(F.col("parts")))
    both = F.zip_with("parts", "paths", lambda x, p: F.struct(x["heading"].alias("heading"), x["level"].alias("level"), p.alias("path"), x["body"].alias("body")))
    s = d.select("doc_id", F.posexplode(both).alias("ord", "s")).select("doc_id", "ord", "s.heading", "s.level", "s.path", "s.body")
    return s.filter("heading is not null or body <> ''")


def heading_paths(parts: Column) -> Column:
    """array<array<string>>: the path of each part (level, heading); a part of level 0 has none.

    One fold keeps the path so far, cut to its level less one before a heading is added; the paths of a stretch of parts
    are gathered apart from those before, so that no array grows over a whole document.
    """
    word = "array<string>"
    now = lambda path, x: F.when(x["level"] > 0, F.concat(F.slice(path, 1, F.greatest(x["level"] - 1, F.lit(0))), F.array(x["heading"]))).otherwise(path)

    def gathered(stretch: Column, path: Column) -> Column:
        start = F.struct(path.alias("now"), F.array().cast(f"array<{word}>").alias("out"))
        step = lambda a, x: F.struct(now(a["now"], x).alias("now"), F.concat(a["out"], F.array(now(a["now"], x))).alias("out"))
        return F.aggregate(stretch, start, step, lambda a: a["out"])

    def whole(stretches: Column) -> Column:
        ends = F.aggregate(stretches, F.array(F.array().cast(word)), lambda a, s: F.concat(a, F.array(F.aggregate(s, F.element_at(a, -1), now))))
        return F.flatten(F.zip_with(stretches, F.slice(ends, 1, F.size(stretches)), gathered))

    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    step = lambda a: F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
    return once(parts, lambda a: once(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), step(a)), lambda i: F.slice(a, i, step(a))), whole))


def tidy(s: DataFrame) -> DataFrame:
    """Sections without tables of contents; a level-1 heading said again loses it but keeps its text; gaps shrink."""
    from pyspark.sql import Window as W

    s = s.filter(~F.coalesce(F.lower("heading").rlike(r"^\s*(table of )?contents\s*$"), F.lit(False)))
    again = F.row_number().over(W.partitionBy("doc_id", "heading", "level").orderBy("ord")) > 1
    s = s.withColumn("_again", again & (F.col("level") == 1))
    return s.select("doc_id", "ord", F.when(~F.col("_again"), F.col("heading")).alias("heading"), "level", F.regexp_replace("body", r"\n{4,}", "\n\n\n").alias("body"))


def encrypted(content: Column) -> Column:
    """Whether a binary is surely password protected: an encrypted PDF, or a compound file with an encrypted package."""
    head = F.substring(content, 1, 8)
    has = lambda b: F.call_function("contains", content, F.lit(b))
    pdf = (F.substring(content, 1, 4) == F.lit(b"%PDF")) & has(b"/Encrypt")
    utf16 = "EncryptedPackage".encode("utf-16-le")
    cfb = (head == F.lit(bytes.fromhex("d0cf11e0a1b11ae1"))) & has(utf16)
    return F.coalesce(pdf | cfb, F.lit(False))


def xml_texts(data: bytes, name: str) -> ElementTree.Element | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def words(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if local(x) == "t")


def docx(data: bytes) -> str:
    """A Word file as Markdown: heading styles, paragraphs, table rows joined by bars, in document order."""
    root, out = xml_texts(data, "word/document.xml"), []

    def walk(e: ElementTree.Element) -> None:
        for x in e:
            if local(x) == "p":
                style = next((v for s in x.iter() if local(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
                m = re.match(r"(?i)heading\s*([1-6])", style)
                if t := words(x).strip():
                    out.append("#" * int(m[1]) + " " + t if m else t)
            elif local(x) == "tbl":
                for row in (r for r in x.iter() if local(r) == "tr"):
                    out.append(" | ".join(words(c).strip() for c in row.iter() if local(c) == "tc"))
            else:
                walk(x)

    if root is not None:
        walk(root)
    return "\n".join(out)


def pptx(data: bytes) -> str:
    """Slides as Markdown sections in order, tables as rows, notes behind their slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
    numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for k in numbers:
        root = xml_texts(data, f"ppt/slides/slide{k}.xml")
        paragraphs = [t for p in root.iter() if local(p) == "p" and (t := words(p).strip())]
        out.append(f"## Slide {k}: {paragraphs[0] if paragraphs else ''}".rstrip())
        out += paragraphs[1:]
        if any(local(p) == "pic" for p in root.iter()):
            out.append("[image]")
        if (notes := xml_texts(data, f"ppt/notesSlides/notesSlide{k}.xml")) is not None and (t := words(notes).strip()):
            out.append(f"[Notes:] {t}")
    return "\n".join(out)


def xlsx(data: bytes, most: int = 2000) -> str:
    """Sheets as Markdown tables, empty rows left out, at most so many rows each and a note if there are more."""
    shared = xml_texts(data, "xl/sharedStrings.xml")
    strings = [words(s) for s in shared if local(s) == "si"] if shared is not None else []
    book = xml_texts(data, "xl/workbook.xml")
    names = [s.attrib["name"] for s in book.iter() if local(s) == "sheet"]
    out = []
    for k, name in enumerate(names, 1):
        root = xml_texts(data, f"xl/worksheets/sheet{k}.xml")
        rows = []
        for r in (r for r in root.iter() if local(r) == "row"):
            cells = []
            for c in (c for c in r if local(c) == "c"):
                v = next((x.text or "" for x in c if local(x) == "v"), "") if c.attrib.get("t") != "inlineStr" else words(c)
                cells.append(strings[int(v)] if c.attrib.get("t") == "s" and v else v)
            if any(x.strip() for x in cells):
                rows.append("| " + " | ".join(cells) + " |")
        out += [f"## {name}", *rows[:most], *([f"({len(rows) - most} more rows)"] if len(rows) > most else [])]
    return "\n".join(out)


def pdf(data: bytes) -> str:
    """Text of a PDF's pages: what its uncompressed or deflated content streams show."""
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.DOTALL):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:[^\]\\]|\\.)*)\]\s*TJ", body)
        for one, many in shown:
            parts = [one] if one else re.findall(rb"\(((?:\\.|[^\\()])*)\)", many)
            out.append(re.sub(rb"\\(.)", rb"\1", b"".join(parts)).decode("latin-1"))
    return "\n".join(out)


def plain(data: bytes) -> str:
    return data.decode("utf-8", "replace")


#: A parser for each suffix; without one a file is text.
PARSERS = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx, ".pdf": pdf, ".txt": plain, ".md": plain, ".markdown": plain, "": plain}


def parse_files(files: DataFrame, parsers: dict = PARSERS) -> DataFrame:
    """doc_id, key, text of files (key, content) by the parser of their suffix; a file that cannot be read has null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for key, content in zip(f["key"], f["content"], strict=True):
                m = re.search(r"(\.[^./]+)$", key)
                try:
                    texts.append(parsers[m[1].lower() if m else ""](bytes(content)))
                except Exception:  # noqa: BLE001  one broken file must not end the scan
                    texts.append(None)
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": f["key"], "text": texts})

    return files.select("doc_id", "key", "content").mapInPandas(run, "doc_id string, key string, text string")


def reply_fields(reply: Column) -> Column:
    """struct<title, text, table, visual> of a model's labelled reply; a label runs to the next one."""
    part = lambda name: F.regexp_replace(F.regexp_extract(reply, rf"(?s)(?:^|\n){name}:\s*(.*?)(?=\n(?:TITLE|TEXT|TABLE|VISUAL):|\z)", 1), r"^\s+|\s+$", "")
    return F.struct(*(part(n).alias(n.lower()) for n in ("TITLE", "TEXT", "TABLE", "VISUAL")))


def reply_slides(replies: DataFrame) -> DataFrame:
    """id, slide, fields: replies split at `=== SLIDE n ===`; of a slide told twice the last counts."""
    parts = replies.select("id", F.posexplode(F.split("reply", r"(?m)^=== SLIDE ")).alias("pos", "part")).filter("pos > 0")
    p = parts.select("id", "pos", F.regexp_extract("part", r"^(\d+)", 1).cast("int").alias("slide"), F.regexp_replace("part", r"^\d+ ===\n?", "").alias("body"))
    return p.groupBy("id", "slide").agg(F.max_by("body", "pos").alias("body")).select("id", "slide", reply_fields(F.col("body")).alias("fields"))


# Classes of slides that a text parser can't read, and the bars of the gates, in characters.
VISUAL = ("FRAMEWORK", "DIAGRAM", "MIXED", "IMAGE")
CHART_TEXT, PICTURE_TEXT, TABLE_TEXT, DECORATED, JUDGED, LEAST_PARSED, LEAST_PRODUCED = 200, 120, 80, 200, 40, 20, 40


def _shapes(stats: Column) -> tuple[Column, ...]:
    """text_chars, n_shapes, and whether there is a table, chart, picture, group; missing counts as none."""
    number = lambda f: F.coalesce(stats[f].cast("int"), F.lit(0))
    flag = lambda f: F.coalesce(stats[f], F.lit(False))
    return number("text_chars"), number("n_shapes"), flag("has_table"), flag("has_chart"), flag("has_picture"), flag("has_group")


def slide_class(stats: Column) -> Column:
    """The class of a slide by its shapes: stats is a struct of text_chars, n_shapes, has_table, has_chart, has_picture, has_group."""
    chars, shapes, tables, charts, pictures, groups = _shapes(stats)
    return (
        F.when((chars == 0) & (shapes == 0), "EMPTY")
        .when(charts, F.when(chars > CHART_TEXT, "MIXED").otherwise("DIAGRAM"))
        .when(groups, "FRAMEWORK")
        .when(pictures, F.when(chars < PICTURE_TEXT, "IMAGE").otherwise("MIXED"))
        .when(tables & (chars < TABLE_TEXT), "TABLE")
        .otherwise("TEXT")
    )


def is_visual(stats: Column) -> Column:
    """Whether a slide holds what no text parser reads: charts, groups, and pictures where there is little text."""
    chars, _, _, charts, pictures, groups = _shapes(stats)
    return charts | groups | (pictures & (chars < DECORATED))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def needs_image(stats: Column, text: Column, tables: Column) -> Column:
    """Whether the parser has missed text: under half of what the shapes report, or nothing at all. tables: an array of texts."""
    chars, shapes, *_ = _shapes(stats)
    parsed = F.length(_stripped(text)) + F.aggregate(F.coalesce(tables, F.array().cast("array<string>")), F.lit(0), lambda n, t: n + F.length(_stripped(t)))
    thin = (chars >= JUDGED) & (parsed < F.greatest(F.lit(LEAST_PARSED), F.floor(chars / 2)))
    return thin | ((shapes > 0) & (chars > 0) & (parsed == 0))


def attaches_image(stats: Column, text: Column, tables: Column) -> Column:
    """Whether a slide's image goes to the model: it is visual, or the parser has missed text."""
    return is_visual(stats) | needs_image(stats, text, tables)


def needs_escalation(kind: Column, text: Column, visuals: Column) -> Column:
    """Whether what a local model made of a visual slide is too thin, or lacks the visual part of a framework or diagram."""
    produced = F.length(_stripped(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(visuals, F.lit("")))))
    return kind.isin(*VISUAL) & ((produced < LEAST_PRODUCED) | (kind.isin("FRAMEWORK", "DIAGRAM") & (_stripped(visuals) == "")))


def reading_order(shapes: DataFrame, gap: int = 457_000) -> DataFrame:
    """shapes (slide, id, left, top) with their place: columns split where the left edge jumps, each from the top down."""
    from pyspark.sql import Window as W

    w = W.partitionBy("slide").orderBy("left", "top", "id")
    s = shapes.withColumn("_jump", (F.col("left") - F.lag("left").over(w) > gap).cast("int"))
    s = s.withColumn("_column", F.coalesce(F.sum("_jump").over(w), F.lit(0)))
    return s.withColumn("place", F.row_number().over(W.partitionBy("slide").orderBy("_column", "top", "left", "id"))).drop("_jump", "_column")


def deck(slides: DataFrame) -> DataFrame:
    """deck, markdown, digest of slides (deck, slide, title, body, notes): whole text, and a digest of bounded length."""
    title = F.concat(F.lit("## Slide "), F.col("slide").cast("string"), F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.concat(F.lit(": "), "title")).otherwise(""))
    notes = F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.concat(F.lit("[Notes:] "), "notes"))
    whole = F.concat_ws("\n", title, F.when(F.trim("body") != "", F.col("body")), notes, F.concat(F.lit("[Page "), F.col("slide").cast("string"), F.lit("]")))
    g = slides.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("slide", whole.alias("whole"), F.left("body", F.lit(450)).alias("short")))).alias("x"))
    join = lambda f, by: F.array_join(F.transform("x", lambda s: s[f]), by)
    return g.select("deck", join("whole", "\n\n").alias("markdown"), F.left(join("short", "\n"), F.lit(14_000)).alias("digest"))


def enriched(parsed: DataFrame, told: DataFrame) -> DataFrame:
    """Slides by (deck, slide): title of the parser before the model's, text of the model before the parser's, tables of the parser first."""
    other = told.select("deck", "slide", *(F.col(c).alias(f"_{c}") for c in ("title", "body", "tables", "visual")))
    some = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), b)
    j = parsed.join(other, ["deck", "slide"], "left")
    return j.select("deck", "slide", some("title", F.col("_title")).alias("title"), some("_body", F.col("body")).alias("body"), some("tables", F.col("_tables")).alias("tables"), F.col("_visual").alias("visual"))
