"""Facets: their vocabulary, filters on them, and which of them a query names."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions import text as X


def vocabulary(df: DataFrame, fields: list[str], most: int = 1000) -> DataFrame:
    """facet, value, n: the most frequent values of each field, from one pass over the table."""
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields))
    one = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null and value <> ''")
    n = one.groupBy("facet", "value").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= most).drop("r")


#: A text as runs of letters and digits, and single other characters between them.
ATOM = "([a-z0-9]+|[^a-z0-9])"


def atoms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ATOM), F.lit(1))


def stretches(text: Column, lengths: list[int]) -> tuple[Column, Column]:
    """The atoms of a text (to be named _a), and all its stretches, the text being in match_form, that have as many atoms as one of lengths and stand on word boundaries.

    A stretch begins and ends with whole atoms, so a letter or digit never goes on before or behind one that begins or
    ends with a letter or digit; where it begins or ends with another character, no letter or digit may stand there.
    """
    a = atoms(text)
    word = lambda i: F.coalesce(F.get("_a", i), F.lit("")).rlike("[a-z0-9]")

    def of(n: int) -> Column:
        starts = F.when(F.size("_a") >= n, F.sequence(F.lit(0), F.size("_a") - n)).otherwise(F.array().cast("array<int>"))
        open_ = F.filter(starts, lambda i: ~(word(i - 1) & ~word(i)) & ~(word(i + n) & ~word(i + n - 1)))
        return F.transform(open_, lambda i: F.array_join(F.slice("_a", i + 1, n), ""))

    return a, F.array_distinct(F.flatten(F.array(*map(of, lengths))))


def plan(queries: DataFrame, vocab: DataFrame, aliases: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """query_id, facet, value: values of the vocabulary, or of aliases, whose words stand in the query.

    Queries become their stretches of as many atoms as values have, and these meet the values by an equi-join: no query
    is compared with a value that it does not hold. What comes to the driver is how many atoms values have.
    """
    v = vocab.select("facet", "value", X.match_form(F.col("value")).alias("v"))
    for term, (facet, value) in (aliases or {}).items():
        v = v.union(queries.sparkSession.range(1).select(F.lit(facet), F.lit(value), X.match_form(F.lit(term))))
    v = v.filter("v <> ''")
    lengths = sorted(r[0] for r in v.select(F.size(atoms(F.col("v")))).distinct().collect())
    own, found = stretches(F.col("q"), lengths)
    q = queries.select("query_id", X.match_form(F.col("query")).alias("q")).withColumn("_a", own)
    q = q.select("query_id", F.explode(found if lengths else F.array().cast("array<string>")).alias("v"))
    return q.join(v, "v").select("query_id", "facet", "value").distinct()


def extracted(df: DataFrame, columns: list[str]) -> Column:
    """map<string, array<string>> of a row's non-empty columns by the slug of their names.

    Elements of lists are cleaned one by one, never cut at commas, and blank ones go; a single value is a list of one.
    Of columns whose names have one slug the last that is not empty counts.
    """
    kinds = dict(df.dtypes)

    def pair(c: str) -> Column:
        v = F.col(f"`{c}`")
        many = v.cast("array<string>") if kinds[c].startswith("array") else F.array(v.cast("string"))
        # elements pass the normal form as one text: a NUL composes with nothing
        clean = F.transform(F.split(X.facet_value(F.array_join(many, "\0")), "\0"), lambda x: F.trim(x))
        name = X.slug(F.lit(unicodedata.normalize("NFKD", c.lower())), "column", fold=False)
        return F.struct(name.alias("key"), F.filter(clean, lambda x: x != "").alias("value"))

    full = F.filter(F.array(*map(pair, columns)), lambda p: F.size(p["value"]) > 0)
    none = F.create_map().cast("map<string, array<string>>")
    return F.aggregate(full, none, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def first_per_key(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key and fields of each key's first row that has any of them; rows without a key have no say. sinks.update applies them."""
    has = [F.coalesce(F.trim(F.col(f).cast("string")) != "", F.lit(False)) for f in fields]
    some = rows.filter((F.trim(F.col(key).cast("string")) != "") & reduce(or_, has))
    return some.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_f")).select(key, "_f.*")


def condition(df: DataFrame, wanted: dict[str, object]) -> Column:
    """Equality for one value, membership for several, all of them; unknown fields and nulls are left out."""
    out = F.lit(True)
    for field, value in wanted.items():
        if field not in df.columns or value is None:
            continue
        many = list(value) if isinstance(value, (list, tuple, set)) else [value]
        c = F.col(field)
        is_array = dict(df.dtypes)[field].startswith("array")
        hit = F.arrays_overlap(c, F.array(*map(F.lit, many))) if is_array else c.isin(many)
        out = out & F.coalesce(hit, F.lit(False))
    return out


def split_soft(wanted: dict[str, list[str]], soft: frozenset[str]) -> tuple[dict, dict]:
    """Facets as (hard, soft): those that filter, and those that only could."""
    return {k: v for k, v in wanted.items() if k not in soft}, {k: v for k, v in wanted.items() if k in soft}
