"""Best-fit packing of token sequences: large pieces matched in pairs, small ones best-fit into the gaps."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import cut, gapless, lean, small_batches
from corvine.session import table

#: salt: a number that tells repeated rows apart when they are dealt.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"
CAPACITY = 2048


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, by a faster library over the same vocabulary.

    The ranks are the ids in the file. Texts that hold an added token, or that the fast library refuses, go through
    tokenizers itself, so ids are always those of Tokenizer.encode(text, add_special_tokens=False).
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        # the printable stand-in of each byte, read off the library's own pre-tokenizer alphabet: in code point order, printable bytes stand for themselves
        alphabet = set(ByteLevel.alphabet())
        own = [b for b in range(256) if chr(b) in alphabet]
        byte_of = {chr(b): b for b in own} | dict(zip(sorted(c for c in alphabet if ord(c) > 255), (b for b in range(256) if b not in own), strict=True))
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.added}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not any(a in text for a in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit, else whole capacities behind a first remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Every document as pieces of at most capacity tokens; null texts are empty and become the end token alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or Encoder(tokenizer)
            out: list[list] = [[], [], [], [], [], []]
            for salt, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), salt), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (1, 5) else pa.int64()) for i, c in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go, from how many there are of each length: (length, rank, pieces, sequence, offset).

    Pieces of that length with ranks rank .. rank + pieces - 1 go to sequences sequence, sequence + 1, ... at offset.
    Lengths above a third of capacity are matched first, from the longest down, each with the longest other that
    fits: no sequence can hold three of them. Smaller ones, from the longest down, go to the tightest gap; where none
    fits, new sequences open. Runs of equal lengths and equal gaps are handled as one, so the work and the plan
    depend on capacity and not on the number of documents.
    """
    left = dict(counts)
    taken = dict.fromkeys(counts, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (sequence, sequences)
    order: list[int] = []  # the gaps that have runs
    opened = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        out.append((length, taken[length], n, sequence, offset))
        taken[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((sequence, n))

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    for x in large:
        for y in large:
            if y > x or x + y > capacity or not left[y] or not left[x]:
                continue
            n = left[x] // 2 if x == y else min(left[x], left[y])
            if n:
                put(x, n, opened, 0)
                put(y, n, opened, x)
                leave(capacity - x - y, opened, n)
                opened += n
        if n := left[x]:
            put(x, n, opened, 0)
            leave(capacity - x, opened, n)
            opened += n

    def fill(x: int, gap: int, sequence: int, n: int) -> None:
        """Pieces of length x into n sequences with that gap, as many in each as fit, while there are any."""
        each = gap // x
        whole = min(n, left[x] // each)
        for k in range(each if whole else 0):
            put(x, whole, sequence, capacity - gap + k * x)
        leave(gap - each * x, sequence, whole)
        if whole < n and (rest := left[x]):
            for k in range(rest):
                put(x, 1, sequence + whole, capacity - gap + k * x)
            leave(gap - rest * x, sequence + whole, 1)
            whole += 1
        leave(gap, sequence + whole, n - whole)

    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[x]:
            at = bisect.bisect_left(order, x)
            if at < len(order):
                gap = order[at]
                sequence, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, sequence, n = capacity, opened, -(-left[x] // (capacity // x))
                opened += n
            fill(x, gap, sequence, n)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces() with sequence_id and offset. The driver sees one count per length (at most capacity rows).

    parts is read twice and must be a written table. A piece's place follows from its rank among the pieces of its
    length, and the ranks come from gapless(), so no length, however frequent, meets in one task.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = [(length, rank, rank + n, sequence - rank, offset) for length, rank, n, sequence, offset in plan(counts, capacity)]
    places = spark.createDataFrame(rows, "l long, lo long, hi long, shift long, offset long")
    ranked = gapless(parts, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank", counts, F.struct("doc_id", "piece", "salt"))
    on = (ranked.length == places.l) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    out = ranked.join(F.broadcast(places), on).withColumn("sequence_id", F.col("rank") + F.col("shift"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents packed into sequences of at most capacity tokens: one row per piece.

    Null texts count as empty (one token); repeated rows and equal ids are packed each on its own; a null doc_id is
    carried along; columns beside doc_id and text are not read; an empty table gives an empty result.
    """
    return pack(cut(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
