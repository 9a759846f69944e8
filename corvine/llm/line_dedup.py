"""Deletion of later copies of repeated line runs, found by distributed prefix doubling over line ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.llm.common import NO_ID, bitmap_filter, cut, discard, lean, small_batches, union_all
from corvine.session import table

MIN_WORDS = 50
LINES = "doc_id long, body long, idx int, h1 long, h2 long, lens array<int>"


def windows(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line the lengths (in lines) of the shortest runs with `least` words that start or end at some line.

    A line lies in a repeated run of `least` words or more exactly when it lies in one of these that is repeated: from
    the run's line, either the run up to it, or on from it, or on from the run's start has a shortest such run.
    """
    n = len(words)
    out: list[set[int]] = [set() for _ in range(n)]
    ends = np.append(0, np.cumsum(words))
    forward = np.searchsorted(ends, ends[:-1] + least)
    backward = np.searchsorted(ends, ends[1:] - least, side="right") - 1
    for i, e in enumerate(forward.tolist()):
        if e <= n:
            out[i].add(e - i)
    for p, s in enumerate(backward.tolist()):
        if s >= 0:
            out[s].add(p + 1 - s)
    return [sorted(x) for x in out]


def split_lines(docs: DataFrame, least: int) -> DataFrame:
    """The lines with any word of every document: position, a 128-bit id of the stripped line, runs that start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, body, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                lines = [(i, s) for i, line in enumerate((text.as_py() or "").split("\n")) if (s := line.strip())]
                words = np.array([len(s.split()) for _, s in lines], np.int64)
                if words.sum() < least:
                    continue
                for (i, s), lens in zip(lines, windows(words, least), strict=True):
                    h = xxhash.xxh3_128_intdigest(s.encode("utf-8", "surrogatepass"))
                    for column, value in zip(out, (doc_id, body, len(out[0]), h >> 64, h & (2**64 - 1), lens), strict=True):
                        column.append(value)
                first = len(out[0]) - len(lines)
                out[2][first:] = range(len(lines))
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[3:5]), pa.array(out[5], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "body", "idx", "h1", "h2", "lens"])

    return docs.select("doc_id", "body", "text").mapInArrow(lean(run), LINES)


def ranked(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """(one, two, name) for pairs that occur more than once; names are ranks in the order of the pairs.

    Distinct pairs are sorted by range over all partitions; the number of partition and row keeps that order.
    """
    many = cut(pairs.groupBy(one, two).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "names")
    return many.repartitionByRange(one, two).sortWithinPartitions(one, two).withColumn("name", F.monotonically_increasing_id())


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, body, idx, len): runs of lines that also stand further ahead (in an earlier document, or line).

    Prefix doubling: ranks of single lines, then of 2, 4, 8 ... lines from pairs of ranks, a suffix leaving as soon as
    no other shares its prefix. Runs of one length and equal ranks at both ends of it are an interval of the suffix
    array with that common prefix; all but its first run are later copies. Doubling ends at the longest run asked for.
    """
    at = ["doc_id", "body", "idx"]
    names = ranked(lines, "h1", "h2")
    level = cut(lines.join(names, ["h1", "h2"]).select(*at, F.col("name").alias("rank"), "lens"), "level")
    step, found = 1, []
    while True:
        wanted = level.select(*at, "rank", F.explode(F.filter("lens", lambda x: (x >= step) & (x < 2 * step))).alias("len"))
        ends = level.select("doc_id", "body", (F.col("idx") + step).alias("_end"), F.col("rank").alias("rank2"))
        if step == 1:
            runs = wanted.withColumn("rank2", F.col("rank"))
        else:
            runs = wanted.withColumn("_end", F.col("idx") + F.col("len")).join(ends, ["doc_id", "body", "_end"]).drop("_end")
        first = runs.groupBy("len", "rank", "rank2").agg(F.min(F.struct("doc_id", "body", "idx")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        first = cut(first, "first")  # written, so that the join deals out anew and adaptive execution can split a frequent run
        later = runs.join(first, ["len", "rank", "rank2"]).filter(F.struct("doc_id", "body", "idx") != F.col("first"))
        found.append(cut(later.select(*at, "len"), "runs"))
        longest = level.agg(F.max(F.array_max("lens"))).first()[0] or 0
        if longest < 2 * step:
            discard(level)
            return union_all(found)
        by = W.partitionBy("doc_id", "body").orderBy("idx").rangeBetween(step, step)
        pairs = level.withColumn("rank2", F.first("rank").over(by)).filter("rank2 is not null")
        pairs = cut(pairs, "pairs")
        names = ranked(pairs, "rank", "rank2")
        new = pairs.join(names, ["rank", "rank2"])
        new = cut(new.select(*at, F.col("name").alias("rank"), "lens"), "level")
        discard(level)
        discard(pairs)
        level, step = new, 2 * step


def line_dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, clean_text, n_lines, n_deleted.

    Lines are split at line feeds and compared without surrounding white space; blank lines are left out of runs and
    never deleted. A line goes when it lies in a run of lines with `least` words or more in all that also begins at an
    earlier place: in a document with a smaller doc_id (null first, then by content), or earlier in the same one. So
    the first copy of every line stays. Null texts stay null and have no lines. Rows with the same doc_id and text
    are the same document and get the same result. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col("text")).alias("body"), F.col("text").cast("string").alias("text"))
    lines = cut(split_lines(d, least), "lines")
    twice = cut(d.groupBy("doc_id", "body").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "body"), "twice")
    if not twice.isEmpty():  # lines of repeated rows count once
        key = F.xxhash64("doc_id", "body")
        keys = twice.select(key.alias("key"))
        lines = cut(bitmap_filter(lines, key, keys, absent=True).unionByName(bitmap_filter(lines, key, keys).dropDuplicates(["doc_id", "body", "idx"])), "lines")
    runs = repeated_runs(lines)
    gone = cut(runs.distinct().groupBy("doc_id", "body").agg(F.collect_list(F.struct("idx", "len")).alias("runs")), "gone")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, deleted = [], [], []
            for text, runs in zip(b.column("text"), b.column("runs"), strict=True):
                lines = t.split("\n") if (t := text.as_py()) is not None else []
                full = [i for i, line in enumerate(lines) if line.strip()]
                drop = {full[k] for r in runs.as_py() or () for k in range(r["idx"], r["idx"] + r["len"])}
                texts.append("\n".join([line for i, line in enumerate(lines) if i not in drop]) if drop else t)
                n.append(len(full))
                deleted.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(deleted, pa.int64())], names=["doc_id", "clean_text", "n_lines", "n_deleted"])

    ids = gone.select("doc_id")
    touched = bitmap_filter(d, F.col("doc_id"), ids).join(gone, ["doc_id", "body"], "left")
    whole = bitmap_filter(d, F.col("doc_id"), ids, absent=True).withColumn("runs", F.lit(None).cast(gone.schema["runs"].dataType))
    out = touched.unionByName(whole).mapInArrow(lean(clean), "doc_id long, clean_text string, n_lines long, n_deleted long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_text as a checksum and a length, so that the result stays small beside the corpus."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    body = F.coalesce("clean_text", F.lit(""))
    return out.select("doc_id", F.length(body).cast("long").alias("n_chars"), F.crc32(F.encode(body, "UTF-8")).cast("long").alias("clean_crc32"), "n_lines", "n_deleted")
