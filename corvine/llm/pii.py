"""Personal data in texts: fixed patterns, and further spans by weak supervision. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import cut, hashed_sample
from corvine.session import table

# The kinds of the base spans in their order, and their patterns. Each pattern finds what its plain form
# finds. Possessive repeats keep the matcher from recursing on long texts, and a match may only begin where a run of
# its first class begins, or right behind the last match, so that no position of a run is tried in vain.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3, "secret": 4, "local_phone": 5, "person": 6}
# Shapes of further candidates.
EXTRA = {
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,128}+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+()-])(?<![0-9)] )\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?+",
}
# Words that announce a value of each kind.
GAZETTEER = {
    "secret": "token|secret|key|apikey|password|passwd|pwd|bearer|auth|credential",
    "local_phone": "phone|tel|telephone|call|fax|mobile|cell",
    "person": "name|signed|dear|contact|by|from|regards",
}
# How access keys of well-known issuers begin.
ISSUED = "^(?:AKIA|ASIA|AIza|ghp|gho|xoxb|xoxp)"
LABELLERS = ("shape", "gazetteer", "context", "letters")
#: Characters before a candidate that the labellers see.
BEFORE = 32
#: A vote is 0 no, 1 yes or 2 nothing.
VOTES = 3
#: Features of a span for the final classifier, and how many values each has; and the weights of one kind.
FEATURES = {"length": 9, "digits": 6, "capitals": 6, "variety": 6, "begin": 64, "word before": 64, "before": 4, "after": 4}
WEIGHTS = 1 + sum(FEATURES.values())
#: Different (votes, features) that the classifier is fitted to at most.
SAMPLE = 20_000
SPAN = "struct<start:int,ord:int,end:int,kind:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts_of(items: Column) -> Column:
    """items cut into about as many parts as each has items, so that work per part and per item stays small."""
    step = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), step), lambda i: F.slice(items, i, step))


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def earlier(a: Column, b: Column) -> Column:
    return F.least(a, b)


def running(items: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of an array of ints what `join` makes of all before it; `zero` for the first.

    Each part of the array is folded on its own, from what the parts before make together: growing an array copies it,
    so one fold over n items would copy n * n / 2 of them; this copies n to the power of 1.5.
    """

    def fold(part: Column, head: Column) -> Column:
        start = F.struct(head.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def whole(parts: Column) -> Column:
        heads = fold(F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), join)), F.lit(zero))
        return F.flatten(F.zip_with(parts, heads, fold))

    return let(items, lambda a: let(parts_of(a), whole))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text, before, after>> of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches come from the same matcher, so their lengths add up to positions.
    """

    def placed(gaps: Column) -> Column:
        own = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("n"), m.alias("text"), F.substring(g, -BEFORE, BEFORE).alias("before")))
        return let(F.zip_with(own, F.slice(gaps, 2, 2147483647), lambda x, h: F.struct(x["n"].alias("n"), x["text"].alias("text"), x["before"].alias("before"), F.substring(h, 1, 2).alias("after"))), counted)

    def counted(items: Column) -> Column:
        at = running(F.transform(items, lambda x: x["n"] + F.length(x["text"])), lambda a, b: a + b, 0)
        return F.zip_with(items, at, lambda x, a: F.struct((a + x["n"]).alias("start"), (a + x["n"] + F.length(x["text"])).alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after")))

    return let(F.split(text, pattern, -1), placed)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right doubled, digits summed."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(F.coalesce(v, F.lit(0)))) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits(x)).between(12, 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


#: A cheap necessary condition for any match, so that most texts are scanned once only.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": BASE["card"], "phone": r"\+[0-9]", "secret": EXTRA["secret"], "local_phone": r"[0-9]{3}-[0-9]{4}", "person": EXTRA["person"]}


def spans_of(kind: str, text: Column) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda m: valid(kind, m["text"]))
    out = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(ORDER[kind]).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(HINTS[kind]), out).otherwise(F.array().cast(f"array<{SPAN}>"))


def votes(kind: str, m: Column) -> dict[str, Column]:
    """What each labeller says of a candidate: 1 personal, 0 not, 2 nothing."""
    text, before, after = m["text"], m["before"], m["after"]
    n = F.length(text)
    share = F.length(digits(text)) / n
    said = F.lower(before).rlike(rf"(?:{GAZETTEER[kind]})[^\p{{L}}\p{{N}}]*$")
    near = F.lower(before).rlike(rf"(?:{GAZETTEER[kind]})")
    marked = before.rlike("[=:\"'(]\\s*$")
    plain = before.rlike(r"(?:^|\s)\p{Ll}+\s$")
    if kind == "secret":
        hexed = text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & n.isin(32, 40, 48, 64, 128)
        shape = F.when(hexed | text.rlike(ISSUED), 1).when(share == 0, 0).otherwise(2)
        letters = F.when(share.between(0.04, 0.9), 1).when(text.rlike("^[A-Z]+$"), 2).otherwise(0)
    elif kind == "local_phone":
        shape = F.when(text.rlike(r"^\("), 1).otherwise(2)
        letters = F.when(F.size(F.array_distinct(F.split(digits(text), ""))) <= 2, 0).otherwise(2)
    else:
        shape = F.when(text.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"), 1).otherwise(2)
        letters = F.when(n > 8, 1).otherwise(2)
    return {
        "shape": shape,
        "gazetteer": F.when(said, 1).when(near, 2).otherwise(0),
        "context": F.when(marked, 1).when(plain, 0).otherwise(2),
        "letters": letters,
    }


def code(kind: str, m: Column) -> Column:
    """Kind and votes as one number."""
    v = votes(kind, m)
    out = F.lit(list(EXTRA).index(kind))
    for name in LABELLERS:
        out = out * VOTES + v[name]
    return out.cast("int")


def features(kind: str, m: Column) -> Column:
    """What the span classifier sees of a candidate, one number of a weight for each of FEATURES, and the kind's own."""
    text, n = m["text"], F.length(m["text"])

    def fifths(count: Column) -> Column:
        return F.floor(5 * count / n)

    word = F.regexp_extract(F.lower(m["before"]), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    values = {
        "length": F.least(F.floor(F.log2(n)), F.lit(8)),
        "digits": fifths(F.length(digits(text))),
        "capitals": fifths(F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))),
        "variety": fifths(F.size(F.array_distinct(F.split(text, "")))),
        "begin": F.pmod(F.xxhash64(F.left(text, F.lit(4))), F.lit(FEATURES["begin"])),
        "word before": F.pmod(F.xxhash64(word), F.lit(FEATURES["word before"])),
        "before": F.when(m["before"] == "", 0).when(m["before"].rlike(r"\s$"), 1).when(m["before"].rlike("[=:]$"), 2).otherwise(3),
        "after": F.when(m["after"] == "", 0).when(m["after"].rlike(r"^\s"), 1).when(m["after"].rlike(r"^[.,;]"), 2).otherwise(3),
    }
    base = list(EXTRA).index(kind) * WEIGHTS
    out = [F.lit(base)]
    at = base + 1
    for name, size in FEATURES.items():
        out.append(F.least(values[name] + at, F.lit(at + size - 1)).cast("int"))
        at += size
    return F.array(*out)


def candidates(text: Column) -> Column:
    """array<struct<start, ord, end, kind, code, features>>: what the labellers vote on and the classifier judges."""
    kind_type = "array<struct<start:int,ord:int,end:int,kind:string,code:int,features:array<int>>>"

    def of(kind: str) -> Column:
        each = F.transform(matches(text, EXTRA[kind]), lambda m: F.struct(m["start"].alias("start"), F.lit(ORDER[kind]).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"), code(kind, m).alias("code"), features(kind, m).alias("features")))
        return F.when(text.rlike(HINTS[kind]), each).otherwise(F.array().cast(kind_type))

    return F.concat(*(of(kind) for kind in EXTRA))


def unpack(c: int) -> tuple[int, list[int]]:
    """The kind's number and the votes in a code."""
    v = []
    for _ in LABELLERS:
        c, x = divmod(c, VOTES)
        v.append(x)
    return c, v[::-1]


def estimate(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Posterior that a candidate is personal, per code, by expectation-maximisation over the labellers' votes.

    For each kind, every labeller has rates of voting yes, no and nothing for either class, and there is a prior. One
    count of each kind of vote is added, so no rate is 0. Starts from the majority of votes.
    """
    post = {}
    for c in counts:
        _, v = unpack(c)
        post[c] = (1 + v.count(1)) / (2 + v.count(1) + v.count(0))
    for _ in range(rounds):
        prior = [[1.0, 1.0] for _ in EXTRA]
        rate = [[[[1.0] * VOTES for _ in range(2)] for _ in LABELLERS] for _ in EXTRA]
        for c, n in counts.items():
            kind, v = unpack(c)
            for z, p in ((1, post[c]), (0, 1 - post[c])):
                prior[kind][z] += n * p
                for j, x in enumerate(v):
                    rate[kind][j][z][x] += n * p
        for c in counts:
            kind, v = unpack(c)
            logs = [math.log(prior[kind][z]) + sum(math.log(rate[kind][j][z][x] / sum(rate[kind][j][z])) for j, x in enumerate(v)) for z in (0, 1)]
            post[c] = 1 / (1 + math.exp(max(-700, min(700, logs[0] - logs[1]))))
    return post


def train(rows: list[tuple[list[int], float, int]], rounds: int = 500) -> list[float]:
    """The weights of the span classifier, a logistic regression: rows of (features, posterior, how many such spans)."""
    w = np.zeros(len(EXTRA) * WEIGHTS)
    if not rows:
        return w.tolist()
    x, y = np.array([f for f, _, _ in rows]), np.array([p for _, p, _ in rows])
    n = np.array([k for _, _, k in rows], float)
    n /= np.bincount(x[:, 0], n)[x[:, 0]]  # kinds share no weight; each has its own mean
    seen = np.full_like(w, 1e-12)
    for _ in range(rounds):  # each weight has a rate of its own, so that rare features are learnt too
        d = n * (1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30))) - y)
        g = np.bincount(x.ravel(), np.repeat(d, x.shape[1]), len(w)) + 1e-6 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w.tolist()


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[float]:
    """The classifier's weights, learnt from all texts: EM from the counts of all votes (3 * 81 at most), the weights
    from at most `sample` different (votes, features), in the order of a hash, with the number of spans that have them."""
    c = docs.select(F.explode(candidates(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("c"))
    seen = cut(c.groupBy(F.col("c.code").alias("code"), F.col("c.features").alias("features")).agg(F.count("*").alias("n")), "candidates")
    counts = seen.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()
    post = estimate({r["code"]: r["n"] for r in counts})
    rows = hashed_sample(seen, F.struct("code", "features"), sample, sum(r["different"] for r in counts)).collect()
    return train([(r["features"], post[r["code"]], r["n"]) for r in rows])


def annotate(docs: DataFrame, weights: list[float], text: str = "text", to: str = "spans") -> DataFrame:
    """docs with a column of all spans, array<struct<start, ord, end, kind>> by start and kind.

    Base spans always stay; a further one is added when the classifier says so and no base span overlaps it.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(*(spans_of(k, body) for k in BASE))
    table_ = F.lit(list(map(float, weights)) or [-1.0] * len(EXTRA) * WEIGHTS)  # without weights: base spans alone
    personal = F.filter(candidates(body), lambda c: F.aggregate(c["features"], F.lit(0.0), lambda a, i: a + F.element_at(table_, i + 1)) >= 0)
    more = F.transform(personal, lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["kind"].alias("kind")))
    return docs.withColumn(to, let(base, lambda b: let(more, lambda m: F.when(F.size(m) == 0, F.array_sort(b)).when(F.size(b) == 0, F.array_sort(m)).otherwise(apart(F.array_sort(F.concat(b, m)))))))


def apart(spans: Column) -> Column:
    """Sorted spans without those further ones that overlap a base span."""

    def judged(s: Column) -> Column:
        based = lambda x: x["ord"] < len(BASE)
        ended = running(F.transform(s, lambda x: F.when(based(x), x["end"]).otherwise(0)), later, 0)
        ahead = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(based(x), x["start"]).otherwise(2147483647))), earlier, 2147483647))
        both = F.zip_with(ended, ahead, lambda e, a: F.struct(e.alias("ended"), a.alias("ahead")))
        flagged = F.zip_with(s, both, lambda x, y: F.struct(x.alias("span"), (based(x) | ((y["ended"] <= x["start"]) & (y["ahead"] >= x["end"]))).alias("free")))
        return F.transform(F.filter(flagged, lambda x: x["free"]), lambda x: x["span"])

    return let(spans, judged)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    The text is first cut into one stretch for each part of the spans, as finding a place in a text means reading it
    from its begin.
    """
    piece = lambda t, a, b: F.call_function("substring", t, a + 1, b - a)

    def stretch(p: Column) -> Column:
        first, last = F.element_at(p, 1)["from"], F.element_at(p, -1)["start"]
        return let(piece(text, first, last), lambda t: F.transform(p, lambda x: F.concat(piece(t, x["from"] - first, x["start"] - first), F.lit("["), F.upper(x["kind"]), F.lit("]"))))

    def marked(s: Column) -> Column:
        reached = running(F.transform(s, lambda x: x["end"]), later, 0)
        heads = F.filter(F.zip_with(s, reached, lambda x, r: F.struct(r.alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"])
        rest = F.call_function("substring", text, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.lit(2147483647))
        return F.concat(F.array_join(let(heads, lambda h: F.flatten(F.transform(parts_of(h), stretch))), ""), rest)

    return F.when(F.size(spans) > 0, let(spans, marked)).otherwise(text)


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more.

    Null texts count as empty: no spans. Offsets are code points. Spans of one begin stand in the order of their kinds, then
    by their end. Texts of any length and number of matches are searched whole. Repeated rows give repeated results, a
    null doc_id is carried along; columns beside doc_id and text are not read; an empty table gives an empty result.
    """
    d = annotate(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_more"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))
