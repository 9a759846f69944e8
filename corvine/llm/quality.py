"""Quality: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from corvine.llm.common import NO_ID, cut, hashed_sample, lean, small_batches
from corvine.session import table

#: Rows the scorer is fitted to, taken in the order of a hash of doc_id and text. Labels come from the labellers alone.
SAMPLE = 8_000
BUCKETS = 4096
MARKS = re.compile(r"[^\w\s]{2,}")
#: Votes. UNFIT: the text is too short for the labeller to look at, which says nothing about it.
GOOD, BAD, SILENT, UNFIT = 1, 0, 2, 3
DEFECTS = ("marks", "capitals", "variety", "runs", "lines", "letters")
HEALTH = ("prose", "plain", "even")
LABELLERS = (*DEFECTS, *HEALTH)


class Shapes(dict):
    """Of a word: the bucket of its shape (marks, case pattern, class of length), plus BUCKETS if it has odd marks."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        core = word.strip(".,;:!?*&%$#|\"'()[]")
        case = "U" if core.isupper() and len(core) > 1 else "T" if core.istitle() else "l" if core.islower() else "x" if core else "-"
        marked = word == "|" or MARKS.search(word) is not None
        name = f"{case}{min(len(core), 24) // 4}{''.join(sorted(set(word) - set(core)))}{marked:d}"
        b = self[word] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS + BUCKETS * marked
        return b


def measures(text: str, shapes: Shapes) -> tuple[dict[str, float], Counter, dict[int, float]]:
    """What the labellers look at, the words' counts, and the shares of word shapes.

    Letters are counted in the UTF-8 bytes: of ASCII, and every character beyond it; capitals of ASCII and Latin-1.
    """
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by = np.bincount(raw, minlength=256)
    beyond = int(by[192:].sum())
    wide = int(((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)).sum()) if by[0xC3] else 0
    letters = int(by[65:91].sum() + by[97:123].sum()) + beyond
    visible = len(text) - int(by[48:58].sum() + by[9:14].sum() + by[32])
    out: dict[int, float] = {}
    marks = 0
    for w, c in counts.items():
        b = shapes[w]
        if b >= BUCKETS:
            marks += c
            b -= BUCKETS
        out[b] = out.get(b, 0) + c / n
    return (
        {
            "n": len(words),
            "marks": marks / n,
            "capitals": (int(by[65:91].sum()) + wide) / max(1, letters),
            "variety": len(counts) / n,
            "runs": sum(map(str.__eq__, words, words[1:])) / n,
            "lines": 1 - len(set(lines)) / max(1, len(lines)),
            "letters": letters / max(1, visible),
            "words": sum(map(len, words)) / n,
        },
        counts,
        out,
    )


def votes(m: dict[str, float]) -> list[int]:
    """A vote of each labeller. Labellers of defects say bad or are silent, those of health say good or are silent."""
    n = m["n"]

    def bad(there: bool, least: int) -> int:
        return UNFIT if n < least else BAD if there else SILENT

    def good(there: bool, least: int) -> int:
        return UNFIT if n < least else GOOD if there else SILENT

    return [
        bad(m["marks"] > 0.2, 3),
        bad(m["capitals"] > 0.35, 5),
        bad(m["variety"] < 0.3, 40),
        bad(m["runs"] > 0.3, 8),
        bad(m["lines"] > 0.5, 20),
        bad(m["letters"] < 0.7, 3),
        good(m["marks"] < 0.03 and m["capitals"] < 0.2 and m["runs"] < 0.15, 3),
        good(m["letters"] > 0.75 and m["marks"] < 0.03 and (n < 40 or m["variety"] > 0.4), 3),
        good(m["runs"] < 0.15 and m["lines"] < 0.35 and m["marks"] < 0.1 and m["capitals"] < 0.2, 8),
    ]


def code(v: list[int]) -> int:
    out = 0
    for x in v:
        out = out * 4 + x
    return out


def unpack(c: int) -> list[int]:
    v = []
    for _ in LABELLERS:
        c, x = divmod(c, 4)
        v.append(x)
    return v[::-1]


def posteriors(counts: dict[int, int], rounds: int = 80) -> dict[int, float]:
    """P(good) for each combination of votes, by expectation-maximisation from a majority of votes.

    Every labeller has, for either class, a rate of speaking where it can look. Twenty counts of a fair labeller are
    added to each, so that classes keep their meaning and no rate is 0.
    """
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    v = np.array([unpack(c) for c in codes]).reshape(-1, len(LABELLERS))
    p = (1 + (v == GOOD).sum(1)) / (2 + (v == GOOD).sum(1) + 3 * (v == BAD).sum(1))
    outcome = np.stack([v < SILENT, v == SILENT], 2).astype(float)
    fair = {1: [[0.2, 19.8]] * len(DEFECTS) + [[16, 4]] * len(HEALTH), 0: [[6, 14]] * len(DEFECTS) + [[4, 16]] * len(HEALTH)}
    for _ in range(rounds):
        logs = []
        for z, q in ((0, 1 - p), (1, p)):
            rate = np.einsum("c,cjk->jk", n * q, outcome) + np.array(fair[z], float)
            rate /= rate.sum(1, keepdims=True)
            logs.append(math.log((n * q).sum() + 1) + np.einsum("cjk,jk->c", outcome, np.log(rate)))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def features(m: dict[str, float], counts: Counter, shares: dict[int, float]) -> dict[int, float]:
    """Hashed features: shares of word shapes, of words by how often they recur, and the measures in classes."""
    n = max(1, m["n"])
    out = dict(shares)
    for name in (*DEFECTS, "words"):
        b = zlib.crc32(f"{name}:{int(min(20, m[name] * (20 if name != 'words' else 1)))}".encode()) % BUCKETS
        out[b] = out.get(b, 0) + 0.5
    for c, k in Counter(counts.values()).items():
        if n >= 20:
            b = zlib.crc32(f"recurs:{int(math.log2(1 + 20 * c / n))}".encode()) % BUCKETS
            out[b] = out.get(b, 0) + c * k / n
    return out


def fit_linear(rows: list[tuple[dict[int, float], float]], rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by full-batch gradient descent with momentum."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    at = np.concatenate([np.fromiter(f, np.int64, len(f)) for f, _ in rows])
    x = np.concatenate([np.fromiter(f.values(), float, len(f)) for f, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    y = np.array([p for _, p in rows])
    speed, speed_b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, len(rows)) + bias, -30, 30))) - y
        speed = 0.9 * speed + np.bincount(at, d[row] * x, BUCKETS) / len(rows) + decay * w / 10
        speed_b = 0.9 * speed_b + d.mean()
        w, bias = w - 1.0 * speed, bias - 1.0 * speed_b
    return w, float(bias)


MEASURED = {"_corvine_pick": "long", "_corvine_words": "long", "_corvine_code": "int", "_corvine_at": "array<int>", "_corvine_values": "array<float>"}


def measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """Columns `names` of docs with the votes and features of each text: the only pass over the texts, written."""
    small_batches(docs.sparkSession)
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*names, F.xxhash64(doc_id, body).alias("_corvine_pick"), body.alias("_corvine_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            n, codes, at, values = [], [], [], []
            for text in b.column("_corvine_text"):
                m, counts, shares = measures(text.as_py(), shapes)
                f = features(m, counts, shares)
                n.append(m["n"])
                codes.append(code(votes(m)))
                at.append(list(f))
                values.append(list(f.values()))
            own = [b.column(c) for c in (*names, "_corvine_pick")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(codes, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=[*names, *MEASURED])

    own = StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in MEASURED.items()))
    return cut(d.mapInArrow(lean(run), StructType([*d.select(*names).schema.fields, *own.fields])), "measured")


def learn(seen: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer of a corpus from measured(). Votes are counted over all rows (at most 4**9 counts); of the sample, the
    features come to the driver."""
    counts = {r[0]: r["n"] for r in seen.groupBy("_corvine_code").agg(F.count("*").alias("n")).collect()}
    post = posteriors(counts)
    rows = hashed_sample(seen.select(*MEASURED), F.col("_corvine_pick"), sample, sum(counts.values())).collect()
    return fit_linear([(dict(zip(r["_corvine_at"], r["_corvine_values"], strict=True)), post[r["_corvine_code"]]) for r in rows])


def score_documents(docs: DataFrame, sample: int = SAMPLE, to: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """docs with two more columns: `to` (P(good), double) and `to`_kept (boolean, P >= 0.5); columns of that name go.

    columns: those of docs to carry along (all, if not given); the others, say texts, are not written again.

    The labellers vote on whole texts, EM over all rows turns votes into labels, and a linear scorer fitted to a bounded
    sample (`sample` rows in the order of a hash of doc_id and text) scores every row; no given labels are used. Null texts count
    as empty; texts without words score 0 and are rejected. A null doc_id is one value; repeated rows and equal texts get
    equal scores. Very long texts are measured whole. An empty table gives an empty result.
    """
    names = [c for c in columns or docs.columns if c not in (to, f"{to}_kept")]
    seen = measured(docs, names)
    weights = docs.sparkSession.sparkContext.broadcast(learn(seen, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = weights.value
        for b in batches:
            at, values = b.column("_corvine_at"), b.column("_corvine_values")
            row = np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy())
            z = bias + np.bincount(row, w[at.flatten().to_numpy()] * values.flatten().to_numpy(), b.num_rows)
            p = np.where(b.column("_corvine_words").to_numpy() > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p), pa.array(p >= 0.5)], names=[*names, to, f"{to}_kept"])

    schema = StructType(seen.select(*names).schema.fields).add(to, DoubleType()).add(f"{to}_kept", BooleanType())
    return seen.drop("_corvine_pick", "_corvine_code").mapInArrow(lean(run), schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = score_documents(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return d.select("doc_id", F.col("quality").alias("score"), F.col("quality_kept").alias("kept"))
