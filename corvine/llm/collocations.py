"""Collocations: frequent phrases mined by pivot words, scored by their cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.llm.common import cut, lean, placed, small, small_batches
from corvine.session import table

LONGEST, SUPPORT, TOP, COVERED = 4, 30, 2000, 80
#: The bytes between pieces and those between words (fixed values), and a byte that no UTF-8 text holds.
PIECE_ENDS, WORD_ENDS, MARK = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09", b"\xff"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
CHUNKS = "chunk long, lang string, words array<string>, counts array<int>, ids array<int>"
FRAGMENTS = "pivot int, part int, partial boolean, fragments array<int>"
MINED = "w1 int, w2 int, w3 int, w4 int, f long, partial boolean"
KEY = ["w1", "w2", "w3", "w4"]
#: Occurrences in a part of a pivot, at most, and chunks that a task gets on average: both are held in memory.
PART, TASK_CHUNKS = 200_000, 8
#: Chunks are long rows, and a scan holds as many as a row group has: it ends as soon as it has this size.
FEW_ROWS = {"parquet.block.size": 8_000_000, "parquet.page.size.row.check.min": 1}


def chunked(docs: DataFrame, most: int = 8_000_000) -> DataFrame:
    """Texts (lang, body) as chunks: the distinct words of some texts of a language, their counts, and the texts as
    places in that list from 1, with 0 between pieces. A chunk ends with the text that takes it beyond `most` bytes."""
    folded = bytes.maketrans(UPPER + PIECE_ENDS + WORD_ENDS, LOWER + MARK * len(PIECE_ENDS) + b" " * len(WORD_ENDS))

    def flush(lang: str, texts: list[bytes], number: int) -> pa.RecordBatch | None:
        order: dict[bytes, int] = {MARK: 0}
        found = (b" " + MARK + b" ").join(texts).replace(MARK, b" " + MARK + b" ").split()
        ids = np.fromiter((order.setdefault(w, len(order)) for w in found), np.int32, len(found))
        counts = np.bincount(ids, minlength=len(order))[1:].astype(np.int32)
        words = pa.array(list(order)[1:], pa.binary()).cast(pa.string())
        if not len(words):
            return None
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(counts), pa.array(ids))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), *lists], names=["chunk", "lang", "words", "counts", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = text.as_py().encode().translate(folded)
                held.setdefault(lang, []).append(body)
                sizes[lang] = sizes.get(lang, 0) + len(body)
                full = [lang] if sizes[lang] >= most else list(held) if sum(sizes.values()) >= 4 * most else []
                for x in full:
                    if (out := flush(x, held.pop(x), number)) is not None:
                        yield out
                    del sizes[x]
                    number += 1
        for x, texts in held.items():
            if (out := flush(x, texts, number)) is not None:
                yield out
            number += 1

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), CHUNKS)


def fragments_of(words: np.ndarray) -> np.ndarray:
    """Rows (pivot, l1, l2, l3, r1, r2, r3, count) of a text of word numbers: 0 is a gap, larger numbers are rarer.

    Around each word as pivot stand those words that phrases owned by it can reach: on the left up to three more
    frequent ones, on the right up to three that aren't rarer. So a phrase belongs to its rarest word, at the
    first place where it has it, and to one fragment only. Fragments of one pivot word stand together, equal ones
    once with their count.
    """
    padded = np.concatenate([np.zeros(3, np.int32), words.astype(np.int32), np.zeros(3, np.int32)])
    n = len(words)
    pivot = padded[3 : 3 + n]
    sides = []
    for step in (-1, 1):
        fits = pivot > 0
        for k in (1, 2, 3):
            near = padded[3 + step * k : 3 + step * k + n]
            fits = fits & (near > 0) & (near < pivot if step < 0 else near <= pivot)
            sides.append(np.where(fits, near, 0))
    keep = (sides[0] > 0) | (sides[3] > 0)
    rows = np.stack([pivot, *sides], 1)[keep]
    mixed = np.zeros(len(rows), np.uint64)
    for column in rows.T[1:]:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    # equal rows stand together; should others come between by an equal hash, they just stay apart
    rows = rows[np.argsort((rows[:, 0].astype(np.uint64) << np.uint64(32)) | (mixed >> np.uint64(32)), kind="stable")]
    heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1))) if len(rows) else np.empty(0, int)
    return np.concatenate([rows[heads], np.diff(np.append(heads, len(rows)))[:, None].astype(np.int32)], 1)


def fragments(chunks: DataFrame, each: int) -> DataFrame:
    """The fragments of chunks that carry, beside ids, the numbers `known` of their words (k, id, f): a row per pivot
    word of a chunk. Words with more than `each` occurrences have several parts, of which a chunk goes to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                known = b.column(2)[i].values
                k, ids, f = (known.field(x).to_numpy() for x in range(3))
                local = b.column(1)[i].values.to_numpy()
                numbers = np.zeros(int(local.max(initial=0)) + 1, np.int32)
                numbers[k] = ids
                rows = fragments_of(numbers[local])
                if not len(rows):
                    continue
                heads = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
                pivots = rows[heads, 0]
                parts = np.zeros(len(numbers) and int(ids.max()) + 1, np.int64)
                parts[ids] = 1 + f // each
                own = parts[pivots]
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(rows)) * 7, pa.int32()), pa.array(rows[:, 1:].ravel()))
                chunk = b.column(0)[i].as_py() * 2654435761 % 2**32
                columns = [pa.array(pivots), pa.array((chunk % own).astype(np.int32)), pa.array(own > 1), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["pivot", "part", "partial", "fragments"])

    return chunks.select("chunk", "ids", "known").mapInArrow(lean(run), FRAGMENTS)


def grown(parent: np.ndarray, word: np.ndarray, weight: np.ndarray, partial: np.ndarray, support: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One word more for phrases: for each fragment the number of the longer phrase (-1: none or too rare), and of
    all kept ones a fragment that holds it and its count. Partial counts are kept whatever they are."""
    ids = np.full(len(parent), -1, np.int64)
    at = np.flatnonzero((parent >= 0) & (word > 0))
    if not len(at):
        return ids, at, at
    _, first, which = np.unique((parent[at] << 31) | word[at], return_index=True, return_inverse=True)
    count = np.bincount(which, weight[at]).astype(np.int64)
    keep = (count >= support) | partial[at[first]]
    number = np.where(keep, np.cumsum(keep) - 1, -1)
    ids[at] = number[which]
    return ids, at[first[keep]], count[keep]


def mined(rows: np.ndarray, partial: np.ndarray, support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases owned by the pivots of whole groups of fragments, level by level: words (four columns), counts, partial.

    rows: pivot, l1, l2, l3, r1, r2, r3, count. A phrase can be frequent only if its parts with the pivot are.
    """
    p, l1, l2, l3, r1, r2, r3, weight = rows.astype(np.int64).T
    words, counts, flags = [], [], []

    def level(parent: np.ndarray, word: np.ndarray, *columns: np.ndarray, beside: np.ndarray | None = None) -> np.ndarray:
        if beside is not None:
            parent = np.where(beside >= 0, parent, -1)
        ids, at, count = grown(parent, word, weight, partial, support)
        out = np.zeros((len(at), LONGEST), np.int32)
        for k, c in enumerate(columns):
            out[:, k] = c[at]
        words.append(out)
        counts.append(count)
        flags.append(partial[at])
        return ids

    lp = level(p, l1, l1, p)
    pr = level(p, r1, p, r1)
    llp = level(lp, l2, l2, l1, p)
    lpr = level(lp, r1, l1, p, r1, beside=pr)
    prr = level(pr, r2, p, r1, r2)
    level(llp, l3, l3, l2, l1, p)
    level(llp, r1, l2, l1, p, r1, beside=lpr)
    level(lpr, r2, l1, p, r1, r2, beside=prr)
    level(prr, r3, p, r1, r2, r3)
    return np.concatenate(words), np.concatenate(counts), np.concatenate(flags)


def mine(dealt: DataFrame, support: int, most: int = 400_000) -> DataFrame:
    """Phrases of fragments that are dealt by (pivot, part) and sorted by pivot in each partition: whole pivots together,
    about `most` fragments at a time."""
    schema = pa.schema([*((k, pa.int32()) for k in KEY), ("f", pa.int64()), ("partial", pa.bool_())])

    def found(rows: np.ndarray, partial: np.ndarray) -> pa.RecordBatch:
        words, counts, flags = mined(rows, partial, support)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(words[:, k])) for k in range(LONGEST)), pa.array(counts), pa.array(flags)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy().reshape(-1, 7)
            sizes = np.diff(lists.offsets.to_numpy()) // 7
            held.append((np.concatenate([np.repeat(b.column(0).to_numpy(), sizes)[:, None], flat], 1), np.repeat(b.column(1).to_numpy(zero_copy_only=False), sizes)))
            n += len(flat)
            if n >= most:
                rows, partial = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if whole:
                    yield found(rows[:whole], partial[:whole])
                held, n = [(rows[whole:], partial[whole:])], len(rows) - whole
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.select("pivot", "partial", "fragments").mapInArrow(lean(run), MINED)


def gram(words: list[Column]) -> list[Column]:
    """Words as the four columns of a phrase."""
    return [(words[k] if k < len(words) else F.lit(0)).cast("int").alias(KEY[k]) for k in range(LONGEST)]


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: words (id, lang, word, f) and grams (w1 .. w4, f), both of all that occur `support` times, and
    sizes (lang, n): all word occurrences of each language.

    Words are numbered by frequency, the most frequent first. Every text is cut into fragments around its words, these
    go to the partition of their pivot word, the rarest of every phrase it owns, and phrases are mined there.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chunks = cut(chunked(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), body)), "chunks", **FEW_ROWS)
    sizes = cut(chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    own = chunks.select("chunk", "lang", F.explode(F.transform("words", lambda w, k: F.struct((k + 1).alias("k"), w.alias("word"), F.get("counts", k).alias("c")))).alias("x")).select("chunk", "lang", "x.*")
    totals = own.groupBy("lang", "word").agg(F.sum("c").alias("f")).filter(F.col("f") >= support)
    frequent = placed(totals.select(F.lit("").alias("g"), (-F.col("f")).alias("_order"), "lang", "word", "f"), ["_order", "lang", "word"])
    words = cut(frequent.select((F.col("idx") + 1).cast("int").alias("id"), "lang", "word", "f"), "words")
    if words.count() >= 2**31 - 1:
        raise ValueError("more frequent words than numbers")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    # a part of a pivot has a thousandth of all occurrences, but so many that mining is worth it and so few that they fit
    each = min(PART, max(20_000, n // 1000))
    # lists are built on the heap, some 10 MB a chunk: tasks get few chunks, whatever the session's size of a partition is
    tasks = max(spark.sparkContext.defaultParallelism, -(-chunks.count() // TASK_CHUNKS))
    known = own.join(words, ["lang", "word"]).repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("k", "id", "f")).alias("known"))
    dealt = fragments(chunks.repartition(tasks, "chunk").join(known, "chunk"), each).repartition("pivot", "part").sortWithinPartitions("pivot")
    found = cut(mine(dealt, support), "mined")
    # counts of one phrase come from different tasks, so combining before the shuffle would hold much and save little
    merged = found.filter("partial").repartition(*KEY).groupBy(*KEY).agg(F.sum("f").alias("f")).filter(F.col("f") >= support)
    grams = cut(found.filter(~F.col("partial")).select(*KEY, "f").unionByName(merged), "grams")
    return words, grams, sizes


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The best phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase with count a, cut into parts with counts l and r, has score floor(2000000 * a / (l + r)) at its worst cut (of
    equal ones the first). Phrases that lie in a longer one with `covered` percent of their count are left out. Null texts
    are empty, null languages `und`; repeated rows count each; equal scores are ordered by count, then by phrase in
    bytes; texts of any length are read whole; other columns are not read; an empty table gives an empty result.
    """
    words, grams, sizes = phrases(docs, lang, text, support)
    w = [F.col(k) for k in KEY]
    length = sum((F.when(c > 0, 1).otherwise(0) for c in w), F.lit(0))
    cand = grams.withColumn("m", length)
    parts = grams.select(*KEY, "f").unionByName(words.select(*gram([F.col("id")]), "f"))
    cuts = F.array(*(F.when(F.col("m") > k, F.struct(F.lit(k).alias("k"), F.struct(*gram(w[:k])).alias("left"), F.struct(*gram(w[k:])).alias("right"))) for k in range(1, LONGEST)))
    each = cand.select(*KEY, "f", F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias("x")).select(*KEY, "f", "x.k", "x.left", "x.right")
    key = F.struct(*KEY)
    each = each.join(parts.select(key.alias("left"), F.col("f").alias("l")), "left").join(parts.select(key.alias("right"), F.col("f").alias("r")), "right")
    wide = lambda c: c.cast("decimal(20,0)")
    score = F.call_function("div", wide(F.col("f")) * F.lit(2_000_000).cast("decimal(8,0)"), wide(F.col("l") + F.col("r")))
    scored = each.withColumn("score", score).groupBy(*KEY, "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select(*KEY, "f", "x.*")
    inner = [(a, b) for n in range(2, LONGEST) for a in range(LONGEST - n + 1) for b in [a + n]]
    holds = F.array(*(F.when((F.col("m") >= b) & (F.col("m") > b - a), F.struct(*gram(w[a:b]))) for a, b in inner))
    longer = cand.filter("m > 2").select("f", F.explode(F.filter(holds, lambda x: x.isNotNull())).alias("x")).groupBy("x").agg(F.max("f").alias("_longer")).select("x.*", "_longer")
    kept = scored.join(longer, KEY, "left").filter(F.coalesce(wide(F.col("_longer")) * 100 < wide(F.col("f")) * covered, F.lit(True)))
    named = best_scores(kept.join(words.select(F.col("id").alias("w1"), "lang"), "w1"), top)
    for k, c in enumerate(KEY):
        names = words.select(F.col("id").alias(c), F.col("word").alias(f"_{c}"))
        named = named.join(names, c, "inner" if k < 2 else "left")
    named = named.withColumn("phrase", F.concat_ws(" ", *(f"_{c}" for c in KEY)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(small(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("long").alias("score"))


def best_scores(rows: DataFrame, top: int, step: int = 2048) -> DataFrame:
    """The rows of each lang whose score is among the `top` best, all rows of the last such score included.

    Rows are counted by ranges of `step` scores, with map-side combine, then by score in the range where the last one
    falls. Scores go up to a million, so a few hundred and then `step` counts at most meet per language.
    """
    rows = cut(rows.withColumn("_range", F.floor(F.col("score") / step)), "scored")

    def last(counted: DataFrame, by: str, before: Column) -> DataFrame:
        """(lang, by, _above) of the last value of `by` that has less than `top` rows above it."""
        counts = counted.groupBy("lang", by).agg(F.count("*").alias("_n"), F.max(before).alias("_before"))
        above = F.sum("_n").over(W.partitionBy("lang").orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, -1))
        counts = counts.withColumn("_above", F.coalesce(above, F.lit(0)) + F.col("_before")).filter(F.col("_above") < top)
        return counts.groupBy("lang").agg(F.min(F.struct(by, "_above")).alias("x")).select("lang", f"x.{by}", "x._above")

    ranges = small(cut(last(rows, "_range", F.lit(0)), "ranges"))
    least = last(rows.join(ranges, ["lang", "_range"]), "score", F.col("_above")).select("lang", F.col("score").alias("_least"))
    return rows.join(small(cut(least, "least")), "lang").filter(F.col("score") >= F.col("_least")).drop("_least", "_range")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS n FROM f WHERE m > 2),
inside AS (SELECT lang, a, unnest(list_transform(range(1, m - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase FROM spans),
longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY lang, phrase),
kept AS (
  SELECT s.* FROM worst s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase
  WHERE x.a IS NULL OR CAST(x.a AS HUGEINT) * 100 < CAST(s.a AS HUGEINT) * 80)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes ON sizes.lang = kept.lang QUALIFY rank <= 2000
"""
