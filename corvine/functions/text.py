"""Scalar text functions as column expressions: slugs, masks, normal forms, previews, identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in a lexical query.
STOP_WORDS = """
a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will
would could should may might must can shall i me my we our you your he she it they them their this that these those
all any both each more most other some such no not only own same so than too very just also about find show list get
give tell search looking want need please who what which where when how like
""".split()

# Abbreviations and what a lexical query adds for each.
EXPANSIONS = {
    "pa": "practice area",
    "pm": "project manager",
    "quals": "qualifications credentials",
    "qual": "qualification credential",
    "rfp": "request for proposal",
    "skilling": "education to employment skills training",
    "agri": "agriculture food systems",
    "imm": "monitoring evaluation learning",
    "m&e": "monitoring evaluation",
    "psd": "private sector development",
    "wash": "water sanitation hygiene",
    "dfi": "development finance institution",
}

# Headings of a section, by the section's name.
SECTIONS = {
    "summary": ["profile", "summary", "professional summary", "personal summary", "objective", "career objective", "about", "about me"],
    "skills": ["skills", "technical skills", "core competencies", "competencies", "areas of expertise", "key skills"],
    "experience": ["experience", "work experience", "professional experience", "employment", "employment history", "employment record", "work history", "career history", "professional background", "consulting experience"],
    "education": ["education", "academic background", "qualifications", "academic qualifications", "academic credentials"],
    "projects": ["projects", "selected projects", "key projects", "personal projects"],
    "certifications": ["certifications", "certificates", "licenses", "licences"],
    "awards": ["awards", "achievements", "honors", "honours", "recognition"],
    "languages": ["languages", "language proficiency"],
    "publications": ["publications", "papers", "research"],
    "volunteer": ["volunteer", "volunteering", "community involvement", "community service"],
}


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _normal(form: str):
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return fold


def unicode_normal(c: Column, form: str) -> Column:
    """Unicode normal form. Spark has no such built-in, so strings pass an Arrow function; callers ask for it by `fold`."""
    return _normal(form)(c)


def strip_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"^[._]+|[._]+$", "")


def slug(c: Column, fallback: str, fold: bool = True, spaces: bool = True) -> Column:
    """Lower case; white space and other characters become underscores; dots and underscores at the ends go.

    Letters with accents become the letter and an underscore; without fold, which needs no Python, an underscore alone.
    """
    s = F.lower(F.trim(text(c)))
    s = unicode_normal(s, "NFKD") if fold else s
    s = F.regexp_replace(s, r"\s+", "_") if spaces else s
    s = strip_dots(F.regexp_replace(s, r"[^a-z0-9._-]+", "_"))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def identifier(c: Column, fallback: str = "unknown_identifier", fold: bool = True) -> Column:
    """A path segment of an identifier: as slug, but @ and + stay, 200 characters at most."""
    s = F.lower(F.trim(text(c)))
    s = unicode_normal(s, "NFKD") if fold else s
    s = strip_dots(F.regexp_replace(s, r"[^a-z0-9._@+-]+", "_"))
    return F.left(F.when(s == "", F.lit(fallback)).otherwise(s), F.lit(200))


def mask(c: Column) -> Column:
    s = F.trim(text(c))
    return F.when(s == "", "(empty)").when(F.length(s) <= 2, "…").otherwise(F.concat(F.left(s, F.lit(2)), F.lit("…")))


def facet_value(c: Column, fold: bool = True) -> Column:
    """A display value of a facet: compatibility variants folded, case kept."""
    return F.trim(unicode_normal(text(c), "NFKC") if fold else text(c))


def match_form(c: Column, fold: bool = False) -> Column:
    """The form in which facet values and queries are compared: lower case, single spaces, none around &."""
    s = unicode_normal(text(c), "NFKC") if fold else F.translate(text(c), "＆", "&")
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")), r"\s*&\s*", "&")


def word_present(value: Column, query: Column) -> Column:
    """Whether value stands in query on word boundaries; both in match_form. An empty value never does."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return (value != "") & F.rlike(query, quoted)


def filename(c: Column, fallback: str = "attachment", fold: bool = False) -> Column:
    """A safe file name: base name, slug of the stem, and the extension if it has 16 characters at most."""
    name = F.regexp_replace(F.trim(F.coalesce(c, F.lit(fallback))), "/+$", "")
    name = unicode_normal(name, "NFKD") if fold else name
    name = F.element_at(F.split(name, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    stem = F.when(ext != "", F.call_function("left", name, F.length(name) - F.length(ext))).otherwise(name)
    stem = F.left(strip_dots(F.regexp_replace(F.lower(stem), r"[^a-z0-9._-]+", "_")), F.lit(200))
    stem = F.when(stem == "", F.lit(fallback)).otherwise(stem)
    return F.when((ext != "") & (F.length(ext) <= 16), F.concat(stem, ext)).otherwise(stem)


def strip_stop_words(c: Column) -> Column:
    """A lexical query without its stop words; empty if it has no others."""
    words = F.split(F.lower(F.trim(text(c))), r"\s+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_join(F.filter(words, lambda t: (t != "") & ~F.array_contains(stop, t)), " ")


def expand(c: Column) -> Column:
    """strip_stop_words(c), and behind it the expansions of all abbreviations in c; nothing if all were stop words."""
    kept, q = strip_stop_words(c), F.lower(text(c))
    more = F.array_compact(F.array(*(F.when(F.regexp_like(q, F.lit(rf"(?<![a-z0-9])\Q{t}\E(?![a-z0-9])")), F.lit(x)) for t, x in EXPANSIONS.items())))
    return F.when(kept == "", kept).otherwise(F.array_join(F.concat(F.array(kept), more), " "))


def canonical_section(heading: Column) -> Column:
    """The section that a heading names: unknown if there is none, other if no alias fits."""
    h = F.trim(F.regexp_replace(F.lower(text(heading)), "[^a-z0-9]+", " "))
    out = F.when(h == "", "unknown")
    for name, aliases in SECTIONS.items():
        out = out.when(h.isin(aliases), name)
    return out.otherwise("other")


def preview(c: Column, n: int = 800, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def summary_of(c: Column, start: str = "DOCUMENT_SUMMARY:", limit: int = 1800) -> Column:
    """What follows the summary mark up to a blank line, else the first characters; white space collapsed."""
    marked = F.regexp_extract(text(c), rf"(?is){start}\s*(.*?)(?:\n\s*\n|$)", 1)
    return F.trim(F.regexp_replace(F.when(marked != "", marked).otherwise(F.left(text(c), F.lit(limit))), r"\s+", " "))


def id_part(c: Column) -> Column:
    return F.regexp_replace(text(c), "[^A-Za-z0-9_-]+", "_")


def label(person: Column, column: Column, section: Column) -> Column:
    """A citation's label: person — column (section), parts that are missing left out."""
    column = F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))
    head = F.concat_ws(" — ", F.when(F.trim(person) != "", person), F.when(F.trim(column) != "", column))
    return F.when(F.trim(F.coalesce(section, F.lit(""))) != "", F.concat(head, F.lit(" ("), section, F.lit(")"))).otherwise(head)


def cursor(ts: Column) -> Column:
    """A cursor's canonical text: UTC, whole seconds."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def positive_or_null(c: Column) -> Column:
    """An integer, or null for all, none and anything below 1."""
    n = F.trim(c.cast("string")).try_cast("int")
    return F.when(n > 0, n)


def base64url(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(c), "+/\n\r", "-_"), "=+$", "")


def drop_page_numbers(c: Column) -> Column:
    """Text without lines that are only a number of one to three digits."""
    return F.regexp_replace(c, r"(?m)^[ \t]*[0-9]{1,3}[ \t]*$\n?", "")


def first_json(c: Column) -> Column:
    """The outermost braces of a reply with chatter around them, if they hold valid JSON."""
    body = F.regexp_extract(text(c), r"(?s)(\{.*\})", 1)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def unquoted(tag: Column) -> Column:
    """An entity tag without the quotes around it."""
    return F.btrim(tag, F.lit('"'))


def record_ids(values: Column) -> Column:
    """Whether an array holds record ids and nothing else; false for an empty or null one."""
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(v.startswith("rec"), F.lit(False))), F.lit(False))
