"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import bitmap_filter, cut, lean
from corvine.session import table

FILTER_SCHEMA = "block long, quotient_bits int, remainder_bits int, slots binary, occupied binary, run_ends binary, counters binary"


class QuotientFilter:
    """A counting quotient filter over keys of `quotient_bits + remainder_bits` bits. It loses nothing.

    A key's quotient is its home slot; its remainder stands there or, where that is taken, behind, in sorted order, all
    remainders of a quotient in one run. occupied marks quotients that have a run, run_ends the last slot of each, so the
    k-th occupied quotient has the k-th run. A count above one stands in the slots behind the remainder, marked in
    counters: the count less one, lowest digit first, a digit of remainder_bits in each. Slots run over behind the last
    home. In memory there is one number a slot; packed() takes as few bytes a slot as remainders need.
    """

    def __init__(self, quotient_bits: int, remainder_bits: int, slots: np.ndarray, occupied: np.ndarray, run_ends: np.ndarray, counters: np.ndarray):
        self.quotient_bits, self.remainder_bits = quotient_bits, remainder_bits
        self.slots, self.occupied, self.run_ends, self.counters = slots, occupied, run_ends, counters

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, bits: int, load: float = 0.9) -> QuotientFilter:
        """The filter of sorted distinct keys (unsigned, below 2**bits, at least one) and their counts."""
        widths, rest = np.ones(len(keys), np.int64), counts - 1
        quotient_bits = min(bits - 8, max(1, int(np.ceil(np.log2((len(keys) + (counts > 1).sum()) / load)))))
        r = bits - quotient_bits
        while (more := rest > 0).any():
            widths += more
            rest = rest >> r
        quotients = (keys >> np.uint64(r)).astype(np.int64)
        heads = np.flatnonzero(np.diff(quotients, prepend=-1))
        home, sizes = quotients[heads], np.add.reduceat(widths, heads)
        before = np.cumsum(sizes) - sizes
        begins = before + np.maximum.accumulate(home - before)  # at home, or right behind the run before
        at = np.repeat(begins - before, np.diff(np.append(heads, len(keys)))) + np.cumsum(widths) - widths
        n = max(1 << quotient_bits, int(begins[-1] + sizes[-1]))
        out = cls(quotient_bits, r, np.zeros(n, np.uint64), np.zeros(1 << quotient_bits, bool), np.zeros(n, bool), np.zeros(n, bool))
        out.slots[at] = keys & np.uint64((1 << r) - 1)
        out.occupied[home] = True
        out.run_ends[begins + sizes - 1] = True
        rest = counts - 1
        for digit in range(1, int(widths.max())):
            who = np.flatnonzero(widths > digit)
            out.slots[at[who] + digit] = (rest[who] & ((1 << r) - 1)).astype(np.uint64)
            out.counters[at[who] + digit] = True
            rest = rest >> r
        return out

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, sorted, and their counts."""
        home, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        sizes = ends - np.maximum(home, np.append(-1, ends[:-1]) + 1) + 1
        used = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends + 1 - sizes, sizes)
        quotients = np.repeat(home, sizes)
        key = np.flatnonzero(~self.counters[used])
        keys = (quotients[key].astype(np.uint64) << np.uint64(self.remainder_bits)) | self.slots[used[key]]
        counts = np.ones(len(key), np.int64)
        widths = np.diff(np.append(key, len(used)))
        for digit in range(1, int(widths.max(initial=1))):
            who = np.flatnonzero(widths > digit)
            counts[who] += self.slots[used[key[who] + digit]].astype(np.int64) << (self.remainder_bits * (digit - 1))
        return keys, counts

    def packed(self) -> dict:
        width = -(-self.remainder_bits // 8)
        own = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return {"quotient_bits": self.quotient_bits, "remainder_bits": self.remainder_bits, "slots": own.tobytes()} | {k: np.packbits(getattr(self, k)).tobytes() for k in ("occupied", "run_ends", "counters")}

    @classmethod
    def unpacked(cls, x: dict) -> QuotientFilter:
        width = -(-x["remainder_bits"] // 8)
        own = np.frombuffer(x["slots"], np.uint8).reshape(-1, width)
        slots = np.zeros((len(own), 8), np.uint8)
        slots[:, :width] = own
        bits = lambda name, n: np.unpackbits(np.frombuffer(x[name], np.uint8), count=n).astype(bool)
        return cls(x["quotient_bits"], x["remainder_bits"], slots.view("<u8").ravel(), bits("occupied", 1 << x["quotient_bits"]), bits("run_ends", len(own)), bits("counters", len(own)))

    @classmethod
    def merged(cls, filters: Iterable[QuotientFilter]) -> QuotientFilter:
        """One filter of the keys of all, counts of equal keys added: their sorted remainders are merged, so nothing is lost."""
        filters = list(filters)
        keys, counts = (np.concatenate(x) for x in zip(*(f.items() for f in filters), strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return cls.of(keys[heads], np.add.reduceat(counts, heads), filters[0].quotient_bits + filters[0].remainder_bits)


def filters_of(fingerprints: np.ndarray, block_bits: int) -> Iterator[tuple[int, QuotientFilter]]:
    """(block, filter) of unsigned 64-bit fingerprints: the high block_bits are the block, the others the filter's keys."""
    values, counts = np.unique(fingerprints, return_counts=True)
    blocks = (values >> np.uint64(64 - block_bits)).astype(np.int64)
    heads = np.flatnonzero(np.diff(blocks, prepend=-1)) if len(values) else np.empty(0, int)
    for i, j in zip(heads, np.append(heads[1:], len(values)), strict=True):
        yield int(blocks[i]), QuotientFilter.of(values[i:j] & np.uint64((1 << (64 - block_bits)) - 1), counts[i:j].astype(np.int64), 64 - block_bits)


def repeated_fingerprints(fps: DataFrame, block_bits: int) -> DataFrame:
    """(fp) with count above one among the bigint column fp of fps, by filters per partition merged per block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [{"block": b} | f.packed() for b, f in filters_of(np.concatenate(held).view(np.uint64), block_bits)] if held else []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=FILTER_ARROW)

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += b.num_rows
            if n >= 4_000_000:  # a filter of bounded size; several from one partition merge like those of several
                yield from flush()
                held, n = [], 0
        yield from flush()

    def merge(t: pa.Table) -> pa.Table:
        keys, counts = QuotientFilter.merged(map(QuotientFilter.unpacked, t.to_pylist())).items()
        high = np.uint64(t["block"][0].as_py()) << np.uint64(64 - block_bits)
        return pa.table({"fp": (keys[counts > 1] | high).view(np.int64)})

    return fps.mapInArrow(lean(build), FILTER_SCHEMA).groupBy("block").applyInArrow(merge, "fp long")


FILTER_ARROW = pa.schema([("block", pa.int64()), ("quotient_bits", pa.int32()), ("remainder_bits", pa.int32()), *((k, pa.binary()) for k in ("slots", "occupied", "run_ends", "counters"))])


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", per_block: int = 50_000, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and row if given.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest doc_id stays; a null doc_id
    is the smallest. Rows repeated with the same doc_id are copies of each other and all carry kept = true for the
    largest id; where `row` names a column that no two rows share, only the one with the largest number carries it.
    Other columns are not read; an empty table gives an empty result. Very long texts are hashed and compared whole.
    Blocks of the filters grow in number with the rows, so each stays at about per_block fingerprints. Texts are read
    once to be hashed; then only those whose digest occurs twice are shuffled and compared byte for byte.
    """
    extra = [row] if row else []
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("fp"), *extra)
    hashed = cut(d.select("doc_id", "fp", F.sha2("body", 256).alias("text_sha256"), *extra), "hashed")
    block_bits = max(4, min(40, (max(hashed.count(), 1) // per_block).bit_length()))
    dup = cut(repeated_fingerprints(hashed.select("fp"), block_bits), "fingerprints")
    same = bitmap_filter(hashed, F.col("fp"), dup).groupBy("fp", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1")
    same = cut(same.select("fp").distinct(), "same")
    suspects = bitmap_filter(d, F.col("fp"), same)
    last = [F.max(F.struct("doc_id", row))[row].alias("_keep_row")] if row else []  # in a struct too, null is the smallest
    groups = suspects.groupBy("fp", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), *last).filter("group_size > 1")
    groups = groups.select(F.col("fp").alias("_fp"), F.sha2("body", 256).alias("_sha"), "keep_id", "group_size", *(["_keep_row"] if row else []))
    out = hashed.join(groups, (hashed.fp == groups._fp) & (hashed.text_sha256 == groups._sha), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.coalesce(F.col(row) == F.col("_keep_row"), F.lit(True)) if row else F.col("doc_id").eqNullSafe(keep)
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *extra)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
