"""Lexical retrieval: analysis, BM25 over exploded postings, phrases with slop, best of fields."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Terms that count as one another, one group a line.
SYNONYMS = """
esg, environmental social governance, environmental social and governance
ml, machine learning
nlp, natural language processing
ai, artificial intelligence
m&e, monitoring and evaluation, monitoring evaluation
wash, water sanitation hygiene, water sanitation and hygiene
fcas, fragile conflict affected states, fragile and conflict affected states
dfi, development finance institution, development finance institutions
ppp, public private partnership, public private partnerships
ict, information communication technology, information and communication technology
ngo, non-governmental organization, non governmental organization
oda, official development assistance
sdg, sustainable development goals, sustainable development goal
vfm, value for money
rct, randomized controlled trial, randomized controlled trials
lmic, low and middle income country, low and middle income countries
ssa, sub-saharan africa, sub saharan africa
mena, middle east north africa, middle east and north africa
dei, diversity equity inclusion, diversity equity and inclusion
gbv, gender based violence, gender-based violence
srh, sexual reproductive health, sexual and reproductive health
sme, small medium enterprise, small and medium enterprise
"""

# Words the analyzer leaves out.
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# The measure-based English stemmer. Shapes of a stem: a vowel group and consonants behind it, twice, a vowel,
# and one short syllable that ends in a consonant but w, x or y.
# A leading y is a consonant, one behind a consonant a vowel.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_HEAD = f"^(?:{_C}{_V}|[aeiou]+)"
ONCE, TWICE, VOWEL = f"{_HEAD}{_C}", f"{_HEAD}{_C}{_V}{_C}", f"^(?:{_C}[aeiouy]|[aeiou])"
JUST_ONCE, SHORT = f"{_HEAD}{_C}(?:{_V})?$", f"^{_C}[aeiouy][^aeiouwxy]$"
# Each step: suffix, what replaces it, and the shapes its stem must have. The first suffix that fits decides.
PLURALS = [("sses", "ss", ()), ("ies", "i", ()), ("ss", "ss", ()), ("s", "", ())]
PAST = [("eed", "ee", (ONCE,)), ("ed", "\0", (VOWEL,)), ("ing", "\0", (VOWEL,))]  # \0 marks stems that MENDED looks at
MENDED = [("at\0", "ate", ()), ("bl\0", "ble", ()), ("iz\0", "ize", ())]
FINAL_Y = [("y", "i", (VOWEL,))]
DOUBLE = """ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate,
ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"""
ENDINGS = "icate ic, ative, alize al, iciti ic, ical ic, ful, ness"
LAST = "al, ance, ence, er, ic, able, ible, ant, ement, ment, ent, ion, ou, ism, ate, iti, ous, ive, ize"
STEPS = [
    [(s, r, (ONCE,)) for s, r in (x.split() for x in DOUBLE.split(","))],
    [(x.split()[0], "".join(x.split()[1:]), (ONCE,)) for x in ENDINGS.split(",")],
    sorted(((s.strip(), "", (TWICE, "[st]$") if s.strip() == "ion" else (TWICE,)) for s in LAST.split(",")), key=lambda x: -len(x[0])),
]


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def synonyms() -> list[tuple[str, str]]:
    """(phrase, what it counts as), both as words between marks: each word has a blank before and behind it. Long ones first."""
    marked = lambda x: "".join(f" {w} " for w in re.findall("[a-z0-9]+", x))
    out = []
    for line in SYNONYMS.strip().splitlines():
        first, *others = (x.strip() for x in line.split(","))
        out += [(marked(x), marked(first)) for x in others]
    return sorted(dict.fromkeys(out), key=lambda x: (-x[0].count("  "), x))


def folded(words: Column) -> Column:
    """Arrays of words with every synonym of a group, told by whole words, as the group's first term.

    What stands between the words of the text does not count, and nothing matches inside a word. No phrase of the table ends
    with the words that another begins with, so taking long ones first is the leftmost longest match.
    """
    out = F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    for phrase_, first in synonyms():
        out = F.replace(out, F.lit(phrase_), F.lit(first))
    return F.filter(F.split(out, " +"), lambda w: w != "")


def _step(t: Column, rules: list) -> Column:
    out = None
    for suffix, other, shapes in rules:
        stem_ = F.call_function("left", t, F.length(t) - len(suffix))
        made = F.concat(stem_, F.lit(other))
        made = reduce(lambda ok, s: F.when(stem_.rlike(s), ok).otherwise(t), shapes, made)
        out = F.when(t.endswith(suffix), made) if out is None else out.when(t.endswith(suffix), made)
    return out.otherwise(t)


def _mend(t: Column) -> Column:
    """A stem that lost -ed or -ing (it ends in the mark): -e comes back, or a doubled consonant becomes one."""
    bare = F.call_function("left", t, F.length(t) - 1)
    end = F.call_function("right", bare, F.lit(1))
    doubled = (end == F.substring(bare, -2, 1)) & (F.length(bare) > 1) & ~end.isin(*"aeioulsz")
    short = bare.rlike(JUST_ONCE) & bare.rlike(SHORT)
    one = F.when(doubled, F.call_function("left", bare, F.length(bare) - 1)).when(short, F.concat(bare, F.lit("e"))).otherwise(bare)
    out = None
    for suffix, other, _ in MENDED:
        made = F.concat(F.call_function("left", t, F.length(t) - len(suffix)), F.lit(other))
        out = F.when(t.endswith(suffix), made) if out is None else out.when(t.endswith(suffix), made)
    return F.when(t.endswith("\0"), out.otherwise(one)).otherwise(t)


def _close(t: Column) -> Column:
    """The last step: a final -e goes behind long stems, and -ll becomes -l."""
    bare = F.call_function("left", t, F.length(t) - 1)
    silent = t.endswith("e") & (bare.rlike(TWICE) | (bare.rlike(JUST_ONCE) & ~bare.rlike(SHORT)))
    t = F.when(silent, bare).otherwise(t)
    return F.when(t.endswith("ll") & t.rlike(TWICE), F.call_function("left", t, F.length(t) - 1)).otherwise(t)


def stemmed(words: Column) -> Column:
    """Arrays of lower-case words, each reduced to its stem by the measure-based steps; words of two letters stay."""
    steps = [lambda t: _step(t, PLURALS), lambda t: _step(t, PAST), _mend, lambda t: _step(t, FINAL_Y), *((lambda t, r=r: _step(t, r)) for r in STEPS), _close]
    each = lambda step: lambda t: F.when((F.length(t) > 2) | t.endswith("\0"), step(t)).otherwise(t)
    return reduce(lambda done, step: F.transform(done, each(step)), steps, words)


def stems(words: list[str]) -> list[str]:
    """stemmed() for the distinct words of a batch, by the same rules."""

    def step(rules: list, t: str) -> str:
        for suffix, other, shapes in rules:
            if t.endswith(suffix):
                bare = t[: len(t) - len(suffix)]
                return bare + other if all(re.search(x, bare) for x in shapes) else t
        return t

    def mend(t: str) -> str:
        if not t.endswith("\0"):
            return t
        if (done := step(MENDED, t)) != t:
            return done
        bare = t[:-1]
        if len(bare) > 1 and bare[-1] == bare[-2] and bare[-1] not in "aeioulsz":
            return bare[:-1]
        return bare + "e" if re.search(JUST_ONCE, bare) and re.search(SHORT, bare) else bare

    def close(t: str) -> str:
        bare = t[:-1]
        if t.endswith("e") and (re.search(TWICE, bare) or (re.search(JUST_ONCE, bare) and not re.search(SHORT, bare))):
            t = bare
        return t[:-1] if t.endswith("ll") and re.search(TWICE, t) else t

    steps = [*(lambda t, r=r: step(r, t) for r in (PLURALS, PAST)), mend, *(lambda t, r=r: step(r, t) for r in (FINAL_Y, *STEPS)), close]
    return [reduce(lambda t, f: f(t) if len(t) > 2 or t.endswith("\0") else t, steps, w) for w in words]


#: Stems that a worker remembers; beyond, all are forgotten.
REMEMBERED = 500_000


@cache
def _analysis(only: tuple[str, ...] | None) -> Callable[[Column], Column]:
    """An Arrow function from arrays of words to arrays of terms: every distinct word of a batch is looked at once."""
    known: dict[str, str | None] = {}
    groups, heads, stop = synonyms(), {x.split()[0] for x, _ in synonyms()}, set(ENGLISH_STOP)
    wanted = None if only is None else set(only)

    def fold(words: list[str]) -> list[str]:
        text = "".join(f" {w} " for w in words)
        for phrase_, first in groups:
            text = text.replace(phrase_, first)
        return text.split()

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        found = np.flatnonzero(pc.is_in(flat, pa.array(sorted(heads), flat.type)).to_numpy(zero_copy_only=False))
        if len(found):  # rows with a word that begins a synonym
            pieces, at = [], 0
            for i in np.unique(np.searchsorted(ends, found, "right")):
                begin = int(ends[i] - sizes[i])
                new = fold(flat.slice(begin, int(sizes[i])).to_pylist())
                pieces += [flat.slice(at, begin - at), pa.array(new, flat.type)]
                at, sizes[i] = int(ends[i]), len(new)
            flat = pa.concat_arrays([*pieces, flat.slice(at)])
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in words if w not in known]
        known.update(zip(new, (None if w in stop else s for w, s in zip(new, stems(new), strict=True)), strict=True))
        terms = [known[w] for w in words]
        keep = np.array([t is not None for t in terms], bool)
        if wanted is not None:
            terms = [t if t in wanted else "" for t in terms]
        which = coded.indices.to_numpy(zero_copy_only=False)
        kept = keep[which] if len(words) else np.zeros(0, bool)
        offsets = np.append(0, np.cumsum(kept))[np.append(0, np.cumsum(sizes))]
        out = pa.array(["" if t is None else t for t in terms], flat.type).take(pa.array(which[kept]))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), out, mask=lists.is_null() if lists.null_count else None)

    return run


def analyzed(c: Column, only: list[str] | None = None) -> Column:
    """Analysis of a text: words, synonyms folded, stop words out, stems.

    Spark has no stemmer, and the expressions of stemmed() work on every occurrence of a word; so arrays of words pass
    an Arrow function that stems each word once. only: terms that are asked for; all others stand as empty texts in
    their places.
    """
    return _analysis(None if only is None else tuple(only))(tokens(c))


#: Documents in a task that adds up scores, and terms of all queries up to which they are broadcast.
TASK_DOCS, BROADCAST = 2000, 100_000


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best docs of each query: query_id, doc_id, score, rank.

    docs: doc_id, terms (array). queries: query_id, terms (distinct). Postings are cut to the queries' terms before
    anything is shuffled. An empty term for every document carries its length, so term frequencies, document
    frequencies and length statistics all read one and the same exchange: every text is analysed once. All keys are
    non-null, or the joins would infer filters that tell the three uses apart. Terms of queries come to the documents, so
    a common term is not one group, and a task adds up scores of some TASK_DOCS documents whatever their number (but for more
    than BROADCAST terms of queries, which are joined by a shuffle). Ranks per query are limited before the
    shuffle by the window's group limit.
    """
    term = F.coalesce("t", F.lit("")).alias("term")
    q = queries.select("query_id", F.explode_outer("terms").alias("t")).select("query_id", term).distinct().filter("term <> ''")
    wanted = q.select("term").union(q.sparkSession.range(1).select(F.lit(""))).distinct()
    one = docs.select("doc_id", F.size("terms").alias("dl"), F.explode_outer(F.concat("terms", F.array(F.lit("")))).alias("t"))
    tf = one.select("doc_id", "dl", term).join(wanted, "term").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    tf = tf.repartition(1 + docs.count() // TASK_DOCS, "doc_id")
    once = F.least("tf", F.lit(1))
    df = tf.groupBy("term").agg(F.sum(once).alias("df"))
    own = F.col("term") == ""
    stats = tf.agg(F.sum(F.when(own, once)).alias("n_docs"), F.avg(F.when(own, F.col("dl"))).alias("avgdl"))
    weights = df.join(q, "term")
    if q.limit(BROADCAST + 1).count() <= BROADCAST:
        weights = F.broadcast(weights)
    hits = tf.join(weights, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def places(terms: Column, words: list[str]) -> Column:
    """array<array<int>>: for each word where it stands, less its own place in the phrase, so that exact hits agree."""
    found = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(words))

    def of(f: Column, k: int) -> Column:
        return F.transform(F.filter(f, lambda x: x["t"] == words[k]), lambda x: x["i"] - k)

    return F.element_at(F.transform(F.array(found), lambda f: F.array(*(of(f, k) for k in range(len(words))))), 1)


def counts(terms: Column, words: list[str]) -> Column:
    """array<int>: how often each word stands in an array of terms."""

    def of(found: Column, word: str) -> Column:
        return F.size(F.filter(found, lambda t: t == word))

    return F.element_at(F.transform(F.array(F.filter(terms, lambda t: t.isin(words))), lambda f: F.array(*(of(f, w) for w in words))), 1)


def phrase_hits(at: Column, slop: int) -> Column:
    """array<double>: the weight of each match of a phrase, from places(). A match may be out of place by `slop` in all:

    all words within s .. s + e for an e up to slop, with one at s; the least e counts as 1 / (1 + e).
    """
    within = lambda s, e: F.forall(at, lambda p: F.exists(p, lambda x: (x >= s) & (x <= s + e)))
    weight = lambda s: F.coalesce(*(F.when(within(s, e), F.lit(1.0 / (1 + e))) for e in range(slop + 1)))
    every = F.forall(at, lambda p: F.size(p) > 0)
    hits = F.filter(F.transform(F.array_distinct(F.flatten(at)), weight), lambda w: w.isNotNull())
    return F.when(every, hits).otherwise(F.array().cast("array<double>"))


def phrase(docs: DataFrame, words: list[str], slop: int = 1) -> DataFrame:
    """doc_id, matches: places where the words follow each other, out of place by `slop` positions in all at most."""
    from corvine.sources.parsers import materialised

    d = materialised(docs.select("doc_id", "terms"), _at=places(F.col("terms"), words))
    d = d.select("doc_id", F.size(phrase_hits(F.col("_at"), slop)).cast("long").alias("matches"))
    return d.filter("matches > 0")


def query_terms(query: str) -> list[str]:
    """The analysed terms of a query, in order. One row of literals and expressions alone: no job runs."""
    words = F.filter(folded(tokens(F.col("q"))), lambda t: ~t.isin(ENGLISH_STOP))
    return SparkSession.active().createDataFrame([(query,)], "q string").select(stemmed(words)).first()[0]


def spread(docs: DataFrame) -> DataFrame:
    """docs over as many tasks as there are cores where a scan gives fewer, as with a small file of one row group."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def match_query(docs: DataFrame, query: str, k: int, names: tuple[str, ...] = (), slop: int = 1, boosts: tuple[float, float, float] = (2.0, 4.0, 2.0), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best of docs (doc_id, text, and columns `names`) for one query: doc_id, score, rank.

    Three clauses over analysed terms add up, and one must match: BM25 of the text, BM25 of the whole query as a sloppy
    phrase in it, and the best BM25 among the fields `names`, each with its boost. Lengths and counts are those of rows
    that have the field. A row is cut to its length, the counts of the query's terms and its phrase weight before anything
    is shuffled; both the statistics and the scores read that exchange.
    """
    from corvine.sources.parsers import materialised

    words = query_terms(query)
    terms = list(dict.fromkeys(words))
    fields = ("text", *names)
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rank")).limit(0)
    d = materialised(docs.select("doc_id", *fields), **{f"_t{i}": analyzed(F.coalesce(F.col(f), F.lit("")), terms) for i, f in enumerate(fields)})
    d = materialised(d, at=places(F.col("_t0"), words))
    d = d.select("doc_id", "at", *(x for i in range(len(fields)) for x in (F.size(f"_t{i}").alias(f"dl{i}"), counts(F.col(f"_t{i}"), terms).alias(f"tf{i}"))))
    d = d.withColumn("pf", F.aggregate(phrase_hits(F.col("at"), slop), F.lit(0.0), lambda x, y: x + y)).drop("at").repartition("doc_id")
    have = [F.when(F.col(f"dl{i}") > 0, F.col(f"dl{i}")) for i in range(len(fields))]
    seen = [F.count(F.when(F.get(f"tf{i}", F.lit(j)) > 0, 1)).alias(f"df{i}_{j}") for i in range(len(fields)) for j in range(len(terms))]
    stats = d.agg(*(F.count(h).alias(f"n{i}") for i, h in enumerate(have)), *(F.avg(h).alias(f"avg{i}") for i, h in enumerate(have)), *seen)

    def idf(i: int, w: str) -> Column:
        df = F.col(f"df{i}_{terms.index(w)}")
        return F.log(1 + (F.col(f"n{i}") - df + 0.5) / (df + 0.5))

    def part(i: int, tf: Column) -> Column:
        return F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"dl{i}") / F.col(f"avg{i}")))).otherwise(0.0)

    def bm25_of(i: int) -> Column:
        return reduce(lambda x, y: x + y, (idf(i, w) * part(i, F.get(f"tf{i}", F.lit(j))) for j, w in enumerate(terms)))

    whole = reduce(lambda x, y: x + y, (idf(0, w) for w in words))
    score = boosts[0] * bm25_of(0) + boosts[1] * whole * part(0, F.col("pf"))
    if names:
        score = score + boosts[2] * best_fields([bm25_of(i) for i in range(1, len(fields))])
    # every clause that matches scores above 0; a filter on counts would be pushed below the exchange and tell its uses apart
    scored = d.crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score")).filter("score > 0").withColumn("score", F.round("score", 6))
    top = scored.orderBy(F.desc("score"), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).cast("long"))


def best_fields(scores: list[Column]) -> Column:
    """The best of several fields' scores; a missing one counts as 0."""
    s = [F.coalesce(x, F.lit(0.0)) for x in scores]
    return F.greatest(*s) if len(s) > 1 else s[0]
