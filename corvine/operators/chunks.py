"""Chunking: token windows, parents and children, entries of list sections, slide blocks, ids and guards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.text import canonical_section

# Section kinds whose body is a list of entries.
LISTS = ("experience", "education", "projects", "publications", "volunteer")
#: A range of years, the second perhaps behind a month or open.
YEARS = r"(?i)\b[0-9]{4}\s*(?:[-–—/]|to)\s*(?:\p{L}{3,9}\.?\s+)?(?:[0-9]{4}|present|current|now)\b"


@dataclass(frozen=True)
class Config:
    """Sizes in tokens. Sizes are positive and overlaps smaller than their windows."""

    parent: int = 800
    parent_overlap: int = 100
    child: int = 200
    child_overlap: int = 50
    least: int = 30
    most_children: int = 4000

    def __post_init__(self):
        for size, overlap in ((self.parent, self.parent_overlap), (self.child, self.child_overlap)):
            if size <= 0 or not 0 <= overlap < size:
                raise ValueError("a window is positive and longer than its overlap")


def words(text: Column) -> Column:
    """Tokens of the default tokenizer: runs of characters without white space."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """array<array<string>>: windows every size - overlap tokens, the last being the first that reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window is positive and longer than its overlap")
    n, step = F.size(tokens), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda s: F.slice(tokens, s + 1, size)))


def pieces(text: Column) -> Column:
    """The words of a text, each with the white space behind it, so that a slice joined is a slice of the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+\s*"), 0)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def joined(piece_list: Column) -> Column:
    """The stretch of text that consecutive pieces came from."""
    return trimmed(F.array_join(piece_list, ""))


def cut(text: Column, size: int, overlap: int = 0) -> Column:
    """array<string>: the stretches of a text that its windows of words cover."""
    return F.transform(windows(pieces(text), size, overlap), joined)


def parent_child(sections: DataFrame, c: Config = Config()) -> DataFrame:
    """doc_id, ord, parent, child, text, tokens of sections (doc_id, ord, heading, body); child null marks a parent.

    A section is its heading, a blank line and its text. Parents and children are stretches of it that token windows
    cover; later children below the least size go, the first child of a parent always stays. Numbers of parents run
    through a document.
    """
    from corvine.sources.parsers import materialised

    s = materialised(sections.select("doc_id", "ord", whole(F.col("heading"), F.col("body")).alias("_w")), tok=pieces(F.col("_w"))).drop("_w")
    p = s.select("doc_id", "ord", F.posexplode(windows(F.col("tok"), c.parent, c.parent_overlap)).alias("k", "tok"))
    p = p.withColumn("parent", (F.row_number().over(W.partitionBy("doc_id").orderBy("ord", "k")) - 1).cast("long"))
    ch = p.select("doc_id", "ord", "parent", F.posexplode(windows(F.col("tok"), c.child, c.child_overlap)).alias("child", "tok"))
    ch = ch.filter((F.size("tok") >= c.least) | (F.col("child") == 0))
    both = p.select("doc_id", "ord", "parent", F.lit(None).cast("long").alias("child"), "tok").unionByName(ch.withColumn("child", F.col("child").cast("long")))
    return both.select("doc_id", "ord", "parent", "child", joined(F.col("tok")).alias("text"), F.size("tok").cast("long").alias("tokens"))


def whole(heading: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", heading, F.when(body != "", body))


def chunk_id(content: Column, parent: Column, child: Column) -> Column:
    """Ids from content and place: the first 16 hex digits of its SHA-256, kind, and numbers."""
    return F.when(child.isNull(), F.concat_ws(":", F.left(F.sha2(content, 256), F.lit(16)), F.lit("parent"), parent.cast("string"))).otherwise(F.concat_ws(":", F.left(F.sha2(content, 256), F.lit(16)), F.lit("child"), parent.cast("string"), child.cast("string")))


def first_wins(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks with the first of each id only."""
    return chunks.withColumn("_n", F.row_number().over(W.partitionBy("chunk_id").orderBy(*order))).filter("_n = 1").drop("_n")


def guarded(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks of documents with at most `most` children; counted before anything is deleted or written."""
    n = chunks.filter("child is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return chunks.join(n.select("doc_id"), "doc_id", "left_anti")


def opens(unit: Column) -> Column:
    """Whether the first line of a paragraph starts an entry: a range of years, or two to five fields between bars."""
    line = F.trim(F.substring_index(unit, "\n", 1))
    parts = F.split(line, r"\|")
    return line.rlike(YEARS) | (F.size(parts).between(2, 5) & F.forall(parts, lambda x: F.trim(x) != ""))


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def runs(items: Column, starts: Column) -> Column:
    """array<array<string>>: items cut where starts (positions from 0, the first being 0) says."""
    return F.transform(starts, lambda at, k: F.slice(items, at + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - at))


def with_entries(sections: DataFrame, body: str = "body", to: str = "entries") -> DataFrame:
    """sections with the entries of each body, array<string>; every step stays in the row.

    Units are paragraphs, or the lines of a body's only paragraph where several of them open an entry. An entry is a
    unit that opens one with the units that follow; units ahead of all openings are one entry. Without any opening every
    unit is an entry.
    """
    from corvine.sources.parsers import materialised

    d = materialised(sections, _parts=non_blank(F.split(F.coalesce(F.col(body), F.lit("")), r"\n\s*\n")))
    d = materialised(d, _lines=F.when(F.size("_parts") == 1, non_blank(F.split(F.get("_parts", F.lit(0)), "\n"))).otherwise(F.array().cast("array<string>")))
    d = materialised(d, _units=F.when(F.size(F.filter("_lines", opens)) > 1, F.col("_lines")).otherwise(F.col("_parts")))
    d = materialised(d, _open=F.transform("_units", opens))
    alone = ~F.exists("_open", lambda x: x)
    d = materialised(d, _starts=F.filter(F.transform("_open", lambda x, i: F.when(x | (i == 0) | alone, i)), lambda i: i.isNotNull()))
    out = d.withColumn(to, F.transform(runs(F.col("_units"), F.col("_starts")), lambda x: F.array_join(x, "\n\n")))
    return out.drop("_parts", "_lines", "_units", "_open", "_starts")


def resume(sections: DataFrame, c: Config = Config()) -> DataFrame:
    """doc_id, parent, child, text, kind, part of sections (doc_id, ord, heading, body); kind is the section's, part the entry.

    List sections, and unknown ones that hold several entries, keep one parent; each entry is a child with the heading
    in front, one below the least size joins the child before, one above the child size is cut into windows of the same
    entry. Other sections are cut into parents and children by tokens. Sections without words go.
    """
    from corvine.sources.parsers import materialised

    s = sections.select("doc_id", "ord", "heading", canonical_section(F.coalesce("heading", F.lit(""))).alias("kind"), "body", whole(F.col("heading"), F.col("body")).alias("whole"))
    s = with_entries(s.filter(F.col("whole").rlike(r"\S")))
    lists, open_ = F.col("kind").isin(*LISTS), F.col("kind").isin("unknown", "other")
    s = s.withColumn("entries", F.when(lists | open_, F.col("entries")).otherwise(F.array().cast("array<string>"))).withColumn("listed", lists | (F.size("entries") > 1))
    s = materialised(s.drop("body"), heads=F.filter(F.transform("entries", lambda e, i: F.when((i == 0) | (F.size(pieces(e)) >= c.least), i)), lambda i: i.isNotNull()))
    s = materialised(s, groups=runs(F.col("entries"), F.col("heads")))

    def kids(group: Column, k: Column) -> Column:
        first = F.concat(F.when(F.col("heading") != "", F.concat("heading", F.lit(":\n"))).otherwise(F.lit("")), group[0])
        cuts = cut(first, c.child, c.child_overlap)
        more = F.array_join(F.slice(group, 2, F.size(group)), "\n\n")
        last = F.concat(F.element_at(cuts, -1), F.when(more != "", F.concat(F.lit("\n\n"), more)).otherwise(F.lit("")))
        texts = F.concat(F.slice(cuts, 1, F.size(cuts) - 1), F.array(last))
        return F.transform(texts, lambda t: F.struct(t.alias("text"), F.get("heads", k).cast("long").alias("part")))

    none = F.lit(None).cast("long")
    listed = F.transform(F.flatten(F.transform("groups", kids)), lambda x, i: F.struct(F.lit(0).cast("long").alias("k"), i.cast("long").alias("child"), x["text"].alias("text"), x["part"].alias("part")))
    listed = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("k"), none.alias("child"), F.col("whole").alias("text"), none.alias("part"))), listed)

    def family(parent: Column, k: Column) -> Column:
        one = lambda child, text: F.struct(k.cast("long").alias("k"), child.alias("child"), text.alias("text"), none.alias("part"))
        inside = F.filter(windows(parent, c.child, c.child_overlap), lambda w, i: (i == 0) | (F.size(w) >= c.least))
        return F.concat(F.array(one(none, joined(parent))), F.transform(inside, lambda w, i: one(i.cast("long"), joined(w))))

    s = materialised(s, parents=windows(pieces(F.col("whole")), c.parent, c.parent_overlap))
    s = s.withColumn("rows", F.when(F.col("listed"), listed).otherwise(F.flatten(F.transform("parents", family))))
    ahead = F.sum(F.when(F.col("listed"), 1).otherwise(F.size("parents"))).over(W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    s = s.select("doc_id", "kind", F.coalesce(ahead, F.lit(0)).alias("ahead"), "rows").select("doc_id", "kind", "ahead", F.inline("rows"))
    return s.select("doc_id", (F.col("ahead") + F.col("k")).cast("long").alias("parent"), "child", "text", "kind", "part")


ATOMS = {"notes": r"^(\[Notes:\]|Notes:)", "table": r"^\|", "visual": r"(?i)^(visual|insights):"}

#: Lines that are folded at once: what a fold has made is copied per line within them, and once per so many lines.
STEP = 256


def breaks(lines: Column, most: int) -> Column:
    """array<boolean>: whether each of lines (struct<kind, size>) begins a block, told from the lines before it by a fold.

    A table line goes on with a table, another line with a visual, and with other lines while they have `most` words.
    """
    state = lambda last, room, out: F.struct(last.alias("last"), room.alias("room"), out.alias("out"))

    def line(s: Column, x: Column) -> Column:
        kind, room = x["kind"], s["room"] + x["size"]
        joins = ((kind == "table") & (s["last"] == "table")) | ((kind == "plain") & ((s["last"] == "visual") | ((s["last"] == "plain") & (room <= most))))
        return state(F.when(joins, s["last"]).otherwise(kind), F.when(joins, room).otherwise(x["size"]), F.concat(s["out"], F.array(~joins)))

    def some(s: Column, part: Column) -> Column:
        got = F.aggregate(part, state(s["last"], s["room"], F.array().cast("array<boolean>")), line)
        return F.transform(F.array(got), lambda g: state(g["last"], g["room"], F.concat(s["out"], F.array(g["out"]))))[0]

    n = F.size(lines)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(lines, i + 1, STEP)))
    start = state(F.lit(""), F.lit(0), F.array().cast("array<array<boolean>>"))
    return F.flatten(F.coalesce(F.aggregate(parts, start, some, lambda s: s["out"]), F.array().cast("array<array<boolean>>")))


def with_blocks(sections: DataFrame, c: Config, body: str = "body", to: str = "kids") -> DataFrame:
    """sections with the blocks of each body, array<string>: a note line, a run of table lines, a visual's description whole; other lines packed in order.

    A block above the child size is cut into windows; one below the least size goes unless it is the first or notes.
    Every step stays in the row; an empty body has no blocks.
    """
    from corvine.sources.parsers import materialised

    kind = lambda x: reduce(lambda other, k: F.when(x.rlike(ATOMS[k]), k).otherwise(other), reversed(ATOMS), F.lit("plain"))
    d = materialised(sections, _lines=non_blank(F.split(F.coalesce(F.col(body), F.lit("")), "\n")))
    d = materialised(d, _kinds=F.transform("_lines", lambda x: F.struct(kind(x).alias("kind"), F.size(pieces(x)).alias("size"))))
    d = materialised(d, _flags=breaks(F.col("_kinds"), c.child))
    d = materialised(d, _starts=F.filter(F.transform("_flags", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    d = materialised(d, _runs=runs(F.col("_lines"), F.col("_starts")))
    cuts = F.transform("_runs", lambda x, k: F.transform(cut(F.array_join(x, "\n"), c.child), lambda t: F.struct(t.alias("text"), F.get("_kinds", F.get("_starts", k))["kind"].alias("kind"))))
    d = materialised(d, _cuts=F.flatten(cuts))
    kept = F.filter("_cuts", lambda x, i: (i == 0) | (x["kind"] == "notes") | (F.size(pieces(x["text"])) >= c.least))
    return d.withColumn(to, F.transform(kept, lambda x: x["text"])).drop("_lines", "_kinds", "_flags", "_starts", "_runs", "_cuts")


def slides(sections: DataFrame, c: Config = Config()) -> DataFrame:
    """doc_id, parent, child, text, kind, part: one parent for each section; kind slide or text, part the slide's number.

    A slide's children are its blocks. Other sections have windows of tokens. A section without children has its heading as one.
    """
    number = F.regexp_extract(F.coalesce("heading", F.lit("")), r"(?i)^slide\s+([0-9]+)", 1).try_cast("long")
    s = sections.select("doc_id", "ord", "heading", "body", whole(F.col("heading"), F.col("body")).alias("whole"), number.alias("part"))
    s = s.withColumn("parent", (F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1).cast("long"))
    shown = with_blocks(s.filter("part is not null"), c)
    plain = s.filter("part is null").withColumn("kids", cut(F.col("whole"), c.child, c.child_overlap))
    s = shown.unionByName(plain).withColumn("kids", F.when(F.size("kids") > 0, F.col("kids")).otherwise(F.array(F.coalesce("heading", F.lit("")))))
    s = s.withColumn("kind", F.when(F.col("part").isNotNull(), "slide").otherwise("text"))
    none = F.lit(None).cast("long")
    rows = F.concat(F.array(F.struct(none.alias("child"), F.col("whole").alias("text"))), F.transform("kids", lambda t, i: F.struct(i.cast("long").alias("child"), t.alias("text"))))
    return s.select("doc_id", "parent", F.inline(rows), "kind", "part")


def summary(sections: DataFrame, c: Config = Config()) -> DataFrame:
    """A summary is one child without a parent: all sections of a document, in order."""
    parts = F.array_sort(F.collect_list(F.struct("ord", whole(F.col("heading"), F.col("body")).alias("t"))))
    g = sections.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))
    return g.select("doc_id", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("child"), "text", F.lit("summary").alias("kind"), F.lit(None).cast("long").alias("part"))


STRATEGIES: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"parent_child": parent_child, "resume": resume, "slides": slides, "summary": summary}


def chunk(sections: DataFrame, strategy: str, c: Config = Config()) -> DataFrame:
    """Chunks of sections (doc_id, ord, heading, body) by a named strategy."""
    if strategy not in STRATEGIES:
        raise KeyError(f"no chunking strategy {strategy!r}")
    return STRATEGIES[strategy](sections, c)


def with_context(text: Column, heading: Column) -> Column:
    """What a slide's block is embedded with: its heading in front; the stored text stays as it is."""
    return F.concat_ws("\n\n", heading, text)

