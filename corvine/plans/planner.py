"""Query understanding and the search interface: rule-based plans, source registry, search over tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import formula
from corvine.operators import fusion, hydrate, lexical, rows, vector
from corvine.sources import postings

# Words that ask for experience rather than for a literal value.
EXPERTISE = re.compile(
    r"\b(worked\s+on|work\s+on|experience\s+(?:in|with)|experienced\s+in|expert(?:ise)?\s+(?:in|on|with)|background\s+in|"
    r"project\s+experience|sector\s+experience|consulting\s+experience|years?\s+of\s+experience|private\s+sector|"
    r"public\s+sector|find\s+(?:an?\s+)?(?:expert|consultant|someone\s+with))\b",
    re.IGNORECASE,
)
# Phrasings that ask for a literal value, and the kinds of fields that hold it.
LITERAL = [
    (r"\bplays?\s+(?:the\s+)?(.+?)(?:\?|$)", ["skills"]),
    (r"\bspeaks?\s+(?:fluent\s+)?(.+?)(?:\?|$)", ["languages"]),
    (r"\bdoes\s+(.+?)(?:\?|$)", ["skills", "interests", "hobbies"]),
    (r"\bknows?\s+(?:how\s+to\s+)?(.+?)(?:\?|$)", ["skills", "languages"]),
    (r"\binterested\s+in\s+(.+?)(?:\?|$)", ["interests", "hobbies"]),
    (r"\bhobbies?\s+(?:include|is|are)\s+(.+?)(?:\?|$)", ["hobbies", "interests"]),
    (r"\bwith\s+(?:skill|skills)\s+in\s+(.+?)(?:\?|$)", ["skills"]),
]
# Names that the fields of a kind go by, the first that exists counts.
KINDS = {"skills": ("skills", "skill"), "interests": ("interests", "interest"), "languages": ("languages", "language"), "hobbies": ("hobbies", "hobby")}
# Words that end the value in a question.
TAIL = r"\b(?:who|and|with|that|at|in|for|from|within|across)\b"
# Fields that a lookup shows, and fields that it adds where there is room.
DISPLAY = ("Display Name", "Job Title", "Office Location", "Email")
PRIORITY = ("Skills", "Interests", "Languages")


@dataclass(frozen=True)
class Plan:
    """What a question asks for: rows by formula, text by meaning, or both."""

    mode: str
    formula: str = ""
    semantic: str = ""
    top_k: int = 10
    limit: int | None = None
    fields: tuple[str, ...] = ()


def lookup_fields(columns: list[str], matched: list[str], most: int = 20) -> tuple[str, ...]:
    """Fields a lookup returns: those for display, those that matched, those of priority; only existing ones."""
    place: dict[str, int] = {}
    for name in (*DISPLAY, *matched, *PRIORITY):
        place.setdefault(name, len(place))
    return tuple(sorted(place.keys() & set(columns), key=place.__getitem__))[:most]


def needle(question: Column, pattern: str) -> Column:
    """What a phrasing asks for: its group up to a word that ends the value, without marks around it; '' if none."""
    value = F.regexp_extract(F.regexp_extract(question, f"(?i){pattern}", 1), f"(?is)^(.*?)(?:{TAIL}|$)", 1)
    return F.regexp_replace(value, r"""^[\s?.!,"']+|[\s?.!,"']+$""", "")


def classified(questions: DataFrame, columns: list[str], question: str = "question") -> DataFrame:
    """questions with word, targets (fields of `columns` to find it in) and mixed (it also asks for experience).

    The first phrasing that yields a word of two letters or more counts. word and targets are null where none does, and
    where none of its kinds is a field. One projection; the phrasings are the fixed ones.
    """
    q = F.trim(F.col(question))
    own = {c.lower(): c for c in columns}
    named = {k: next((own[n] for n in names if n in own), None) for k, names in KINDS.items()}
    kind = "struct<word:string,targets:array<string>>"
    asked = []
    for pattern, kinds in LITERAL:
        word, fields_ = needle(q, pattern), [named[k] for k in kinds if named[k]]
        targets = F.array(*map(F.lit, fields_)) if fields_ else F.lit(None).cast("array<string>")
        asked.append(F.when(F.length(word) >= 2, F.struct(F.lower(word).alias("word"), targets.alias("targets")).cast(kind)))
    d = questions.withColumn("_asked", F.coalesce(*asked)).withColumn("targets", F.col("_asked.targets"))
    d = d.withColumn("word", F.when(F.col("targets").isNotNull(), F.col("_asked.word"))).drop("_asked")
    return d.withColumn("mixed", q.rlike(f"(?i){EXPERTISE.pattern}"))


def classify(question: str, columns: list[str]) -> Plan | None:
    """A plan for a literal or mixed question by rules; none where the rules do not apply. A one-row plan runs no job."""
    spark = SparkSession.active()
    r = classified(spark.createDataFrame([(question,)], "question string"), columns).first()
    if r.word is None:
        return None
    f = formula.found_in(r.targets, r.word)
    return Plan("hybrid" if r.mixed else "rows_only", f, question.strip() if r.mixed else "", fields=lookup_fields(columns, r.targets))


def validated(plan: Plan, columns: list[str]) -> Plan:
    """An error if the formula names a field that does not exist; limits brought into range."""
    if gone := [f for f in formula.fields(plan.formula) if f not in columns]:
        raise formula.FormulaError(f"unknown fields: {gone}")
    limit = None if plan.limit is None or plan.limit <= 0 else min(50, plan.limit)
    return Plan(plan.mode, plan.formula, plan.semantic, max(1, min(50, plan.top_k)), limit, plan.fields)


def plan_question(question: str, columns: list[str], model: Callable[[str, list[str]], Plan] | None = None) -> Plan:
    """Rules first, then a pluggable planner; a planner that fails leaves a search by meaning. Any formula makes it hybrid."""
    p = classify(question, columns)
    if p is None and model:
        try:
            p = model(question, columns)
        except Exception:  # noqa: BLE001  a question is still answered without its planner
            p = None
    p = p or Plan("semantic_only", "", question.strip())
    return validated(p, columns)


@dataclass
class Source:
    """A source of the registry: rows, text chunks, or both, as DataFrames."""

    name: str
    rows: DataFrame | None = None
    chunks: DataFrame | None = None  # doc_id, text, pk
    order: str = "id"
    required: tuple[str, ...] = ()
    names: tuple[str, ...] = ()  # columns of chunks that name the text
    index: str | None = None  # folder of a stored index over chunks (sources.postings), made with these names


@dataclass
class Registry:
    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, s: Source) -> None:
        self.sources[s.name] = s

    def names(self, wanted: list[str] | str = "*") -> list[str]:
        """Names of sources; * means all, an unknown one is an error."""
        if wanted in ("*", ["*"]):
            return list(self.sources)
        wanted = [wanted] if isinstance(wanted, str) else wanted
        if gone := [w for w in wanted if w not in self.sources]:
            raise KeyError(f"unknown sources: {gone}")
        return wanted

    def schema(self, name: str) -> list[str]:
        s = self.sources[name]
        return list(s.rows.columns) if s.rows is not None else []


HIT = ("source", "source_type", "id", "text", "score", "rank")


def lexical_hits(s: Source, query: str, k: int) -> DataFrame:
    """Hits of a source's chunks by match, phrase and names of the expanded query, from the stored index if there is one."""
    spark = s.chunks.sparkSession
    from corvine.functions import text as X

    asked = spark.range(1).select(F.lit(0).alias("query_id"), X.expand(F.lit(query)).alias("text"))
    if s.index:
        found = postings.search(spark, s.index, asked, k).drop("query_id")
    else:
        found = lexical.match_query(s.chunks, asked.first()["text"], k, s.names)
    return found.join(s.chunks, "doc_id").select(F.lit(s.name).alias("source"), F.lit("semantic").alias("source_type"), F.col("doc_id").cast("string").alias("id"), "text", "score", "rank")


def row_hits(s: Source, p: Plan) -> DataFrame:
    """Hits of a source's rows by formula, all with score 1, ranked by the source's key."""
    got = rows.select(s.rows, p.formula or None, list(p.fields) or None, p.limit or 50, [s.order] if s.order in (p.fields or s.rows.columns) else None, s.required)
    got = got.limit(50).withColumn("id", F.xxhash64(*got.columns).cast("string") if s.order not in got.columns else F.col(s.order).cast("string"))
    ranked = fusion.numbered(got, [F.col("id")])
    return ranked.select(F.lit(s.name).alias("source"), F.lit("structured").alias("source_type"), "id", F.to_json(F.struct(*[c for c in got.columns if c != "id"])).alias("text"), F.lit(1.0).alias("score"), "rank")


def search(registry: Registry, question: str, sources: list[str] | str = "*", top_k: int = 10, merge: str = "concat", model=None) -> DataFrame:
    """Hits over sources: rows before text within a source; sources one behind the other, or fused by rank.

    Hits that repeat a source, kind and first 80 characters of text are left out, and ranks are given anew. The
    caller's top_k counts. A source that fails is left out of the answer.
    """
    lists = []
    for i, name in enumerate(registry.names(sources)):
        s = registry.sources[name]
        try:
            p = plan_question(question, registry.schema(name), model)
            part = [row_hits(s, p)] if s.rows is not None and p.formula else []
            if s.chunks is not None and p.mode != "rows_only":
                part.append(lexical_hits(s, p.semantic or question, max(1, min(50, top_k))))
        except (formula.FormulaError, KeyError):
            continue
        lists += [h.withColumn("ord", F.lit(i * 10 + k) * 1000 + F.col("rank")) for k, h in enumerate(part)]
    if not lists:
        raise ValueError("no source could answer")
    hits = lists[0]
    for h in lists[1:]:
        hits = hits.unionByName(h)
    hits = hydrate.first_per(hits, [F.col("source"), F.col("source_type"), F.left("text", F.lit(80))], [F.col("ord")])
    if merge == "rrf":
        hits = hits.withColumn("fused", 1.0 / (60 + F.col("rank")) + 0.001 * F.col("score"))
        order = [F.desc("fused"), F.col("ord")]
    else:
        order = [F.col("ord")]
    top = hits.orderBy(*order).limit(max(1, min(50, top_k)) * len(lists)).drop("rank")
    return fusion.numbered(top, order).select(*HIT)


MODES = ("hybrid", "knn", "bm25")


def semantic_search(s: Source, query: str, embedded: DataFrame, q: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
    """Hits of one source by vectors, by words, or by both lists fused. embedded: vec_id, embedding; q: one row with column q."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    none = s.chunks.sparkSession.createDataFrame([], "id long, rank long")
    v = lex = none
    if mode != "bm25":
        v = fusion.numbered(vector.knn(embedded, q, max(50, 5 * k)), [F.desc("score"), F.col("vec_id")]).select(F.col("vec_id").alias("id"), "rank")
    if mode != "knn":
        lex = lexical_hits(s, query, max(50, 5 * k)).select(F.col("id").cast("long").alias("id"), "rank")
    return fusion.rrf(v, lex, k)


class QueryEmbedder:
    """A model's vectors of queries, remembered for the last 256; a vector of another length is an error."""

    def __init__(self, model: Callable[[str], list[float]], dim: int, most: int = 256):
        self.model, self.dim, self.most = model, dim, most
        self.seen: dict[str, list[float]] = {}

    def __call__(self, query: str) -> list[float]:
        if query in self.seen:
            self.seen[query] = self.seen.pop(query)  # now the latest
            return self.seen[query]
        v = list(map(float, self.model(f"query: {query}")))
        if len(v) != self.dim:
            raise ValueError(f"the model gave {len(v)} components, not {self.dim}")
        self.seen[query] = v
        if len(self.seen) > self.most:
            del self.seen[next(iter(self.seen))]
        return v


@dataclass(frozen=True)
class Step:
    """A step of a plan over several sources: a function of the results it depends on."""

    name: str
    run: Callable[..., DataFrame]
    after: tuple[str, ...] = ()


def execute(steps: list[Step]) -> dict[str, DataFrame]:
    """Results of all steps as lazy DataFrames, each step once, after those it depends on; a cycle is an error."""
    done: dict[str, DataFrame] = {}
    left = {s.name: s for s in steps}
    while left:
        ready = [s for s in left.values() if all(a in done for a in s.after)]
        if not ready:
            raise ValueError(f"steps wait for each other or for unknown ones: {sorted(left)}")
        for s in ready:
            done[s.name] = s.run(*(done[a] for a in s.after))
            del left[s.name]
    return done


def suggested_calls(plan: Plan, source: str) -> list[dict]:
    """The calls that a client can make to follow a plan."""
    out = []
    if plan.formula:
        out.append({"call": "lookup", "source": source, "formula": plan.formula, "fields": list(plan.fields), "limit": plan.limit or 50})
    if plan.semantic or plan.mode != "rows_only":
        out.append({"call": "semantic_search", "source": source, "query": plan.semantic, "top_k": plan.top_k})
    return out
