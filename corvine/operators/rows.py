"""Structured rows: select by formula, long-text cuts, redaction, confidentiality tags, enrichment and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions import formula as FO
from corvine.functions import text as X

# What a tagged text begins with.
PROJECT_TAG = "**[CONFIDENTIAL PROJECT]**"
CLIENT_TAG = "**[CONFIDENTIAL CLIENT]**"
BOTH_TAG = "**[CONFIDENTIAL PROJECT & CLIENT]**"


def select(df: DataFrame, formula: str | None = None, fields: list[str] | None = None, limit: int | None = None, order: list[str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Filter by a formula, keep the fields (with the required ones; none: all), and at most limit rows."""
    if formula:
        df = df.filter(FO.compile(formula, {c: F.col(c) for c in df.columns}))
    if fields:
        df = df.select(*required_fields(fields, required))
    if order:
        df = df.orderBy(*order)
    return df.limit(max(1, min(50, limit))) if limit is not None else df


def required_fields(fields: list[str], required: tuple[str, ...]) -> list[str]:
    """A narrowed list with the required fields behind it; an empty one means all and stays empty."""
    return [*fields, *(f for f in required if f not in fields)] if fields else fields


def cut_long(df: DataFrame, fields: list[str], n: int = 800, mark: str = "…[truncated]") -> DataFrame:
    return df.withColumns({f: X.preview(F.col(f), n, mark) for f in fields})


def count_long(df: DataFrame, fields: list[str], n: int = 800) -> DataFrame:
    """field, n: how many values of each field cut_long would cut."""
    s = df.agg(*(F.count_if(F.length(f) > n).alias(f) for f in fields))
    return s.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields))).alias("x")).select("x.*")


def redacted(m: Column, keys: list[str], locators: list[str]) -> Column:
    """A metadata map without the given keys, null values, and locators that end in .txt."""
    return F.map_filter(m, lambda k, v: ~k.isin(keys) & v.isNotNull() & ~(k.isin(locators) & F.lower(v).endswith(".txt")))


def confidential(values: Column) -> Column:
    """Whether any value of an array is exactly the mark, but for case and white space."""
    return F.coalesce(F.exists(values, lambda v: F.upper(F.trim(v)) == "CONFIDENTIAL"), F.lit(False))


def tagged(text: Column, project: Column, client: Column, own: Column) -> Column:
    """text with its tag in front, where the row's source (own) has such flags; nothing is dropped."""
    tag = F.when(project & client, BOTH_TAG).when(project, PROJECT_TAG).when(client, CLIENT_TAG)
    body = F.when(F.coalesce(text, F.lit("")) == "", tag).otherwise(F.concat(tag, F.lit(" "), text))
    return F.when(own & (project | client), body).otherwise(text)


def enrich(rows: DataFrame, hits: DataFrame, key: str, hit_key: str = "pk", limit: int = 50) -> DataFrame:
    """Rows whose key is one of the hits' keys but for case: a semi-join, limited. Null and empty keys meet nothing."""
    low = lambda c: F.nullif(F.lower(F.col(c).cast("string")), F.lit(""))
    keys = hits.select(low(hit_key).alias("_k")).filter("_k IS NOT NULL").distinct()
    return rows.withColumn("_k", low(key)).join(keys, "_k", "left_semi").drop("_k").orderBy(key).limit(limit)


def linked_names(df: DataFrame, key: str, links: str, names: DataFrame) -> DataFrame:
    """key, names: display names of linked ids in order; ids without a name go, unless none has one: then the ids stay.

    names: id, name.
    """
    one = df.select(key, F.posexplode(links).alias("pos", "id")).withColumn("id", F.col("id").cast("string"))
    got = one.join(names.select(F.col("id").cast("string").alias("id"), "name"), "id", "left")
    g = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name"))).alias("x"))
    known = F.transform(F.filter("x", lambda s: s["name"].isNotNull()), lambda s: s["name"])
    return g.select(key, F.when(F.size(known) > 0, known).otherwise(F.transform("x", lambda s: s["id"])).alias("names"))


def attachments(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row per attachment with an url: id and file name have defaults, sizes that aren't integers are null."""
    a = df.select(key, F.posexplode(field).alias("pos", "a")).filter("a.url is not null and a.url <> ''")
    ident = F.coalesce("a.id", F.concat(F.lit("attachment_"), F.col("pos").cast("string")))
    return a.select(key, "pos", ident.alias("id"), F.coalesce("a.filename", ident).alias("filename"), F.col("a.url").alias("url"), F.col("a.size").try_cast("int").alias("size"))


def without_attachments(df: DataFrame) -> DataFrame:
    """df without its columns of attachments: arrays of structs that have a url. They are never returned."""
    from pyspark.sql.types import ArrayType, StructType

    def attached(kind) -> bool:
        return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "url" in kind.elementType.names

    return df.select(*(F.col(f"`{f.name}`") for f in df.schema.fields if not attached(f.dataType)))


def allowed(name: Column, suffixes: list[str], images: bool = False) -> Column:
    """Whether a file's suffix is allowed; images need to be asked for."""
    s = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    image = s.isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".tif", ".tiff", ".bmp")
    return F.when(image, F.lit(images)).otherwise(s.isin(suffixes))


def header(df: DataFrame, fields: list[str], extra: tuple[str, ...] = ()) -> Column:
    """A fenced block of `Field: value` lines of df's columns in order, or nothing where all are blank.

    extra fields follow, each field once; columns that df lacks are left out. Lists are joined by a comma, their empty items
    left out; other values lose the white space around them.
    """
    kinds = dict(df.dtypes)
    lines = []
    for f in dict.fromkeys((*fields, *extra)):
        if f not in kinds:
            continue
        c = F.col(f"`{f}`")
        if kinds[f].startswith("array"):
            text = F.array_join(F.filter(c.cast("array<string>"), lambda x: x.isNotNull() & (x != "")), ", ")
        else:
            text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
        lines.append(F.when(text != "", F.concat(F.lit(f"{f}: "), text)))
    found = F.array_compact(F.array(*lines).cast("array<string>"))
    return F.when(F.size(found) > 0, F.concat(F.lit("---\n"), F.array_join(found, "\n"), F.lit("\n---\n\n"))).otherwise("")


def document_link(key: Column) -> Column:
    """The object key of a citable document, or null: below raw/, without .., not a .txt; an s3:// head is cut."""
    k = F.regexp_replace(key, "^s3://[^/]+/", "")
    return F.when(k.startswith("raw/") & ~k.contains("..") & ~F.lower(k).endswith(".txt"), k)


# Phrasings that ask for a number, and those that, with a name, ask for a list.
COUNTING = ("how many", "how much", "count ", "number of", "total number", "what is the total", "size of")
LISTING = ("list", "all ", "give me", "show me", "every")


def reply_shape(question: Column) -> Column:
    """What a reply should hold, by the question's words: a number, one column, or whole records."""
    q = F.lower(F.coalesce(question, F.lit("")))
    some = lambda words: reduce(lambda x, y: x | y, (q.contains(w) for w in words))
    return F.when(some(COUNTING), "count_only").when(q.contains("name") & some(LISTING), "column_subset").otherwise("full_records")
