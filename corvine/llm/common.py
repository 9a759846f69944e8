"""Shared pieces of the corpus operators: scratch tables, bounded bitmaps, scalable numbering, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.session import shared_root

#: Stands for a null doc_id inside an operator; results carry the null again.
NO_ID = -(2**63)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a local one in local mode and else an error."""
    return shared_root(spark)


def cut(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/corvine/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by cut(); only for tables that no later plan reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that cut() made below the session's shared folder; only when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/corvine")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap_filter(big: DataFrame, key: Column, keys: DataFrame, bits: int | None = None, absent: bool = False) -> DataFrame:
    """Rows of big whose key may be in keys (one bigint column): no misses, few extras, no shuffle of big.

    absent: the other rows, those whose key is certainly not in keys.

    The bitmap has 16 bits for a key, but 2**16 at least and 2**26 at most (a million words, some 16 MB as rows), so
    the broadcast is bounded whatever the size of keys. When keys outgrow it, more rows pass; an exact join must
    follow, and becomes the way that does the work. keys must be a written table: it is counted first.
    """
    (col,) = keys.columns
    bits = bits or 1 << min(26, max(16, (16 * keys.count()).bit_length()))
    h = F.pmod(F.xxhash64(F.col(col)), F.lit(bits))
    words = keys.select(F.shiftright(h, 6).alias("_corvine_word"), shift_left(F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")).alias("_corvine_bit"))
    words = words.groupBy("_corvine_word").agg(F.expr("bit_or(_corvine_bit)").alias("_corvine_bits"))
    g = F.pmod(F.xxhash64(key), F.lit(bits))
    out = big.withColumn("_corvine_h", g).withColumn("_corvine_word", F.shiftright("_corvine_h", 6)).join(F.broadcast(words), "_corvine_word", "left" if absent else "inner")
    hit = F.call_function("shiftrightunsigned", F.col("_corvine_bits"), F.pmod("_corvine_h", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return out.filter(~F.coalesce(hit, F.lit(False)) if absent else hit).drop("_corvine_h", "_corvine_word", "_corvine_bits")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs, written, with a bigint column `name` that no two rows share; it doesn't change when rows are read again."""
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the rows whose number is in dropped, a written table of one column; docs has it under the same name.

    Texts are not shuffled but for the few that the bitmap of dropped numbers cannot clear.
    """
    (col,) = dropped.columns
    key = F.col(col)
    gone = dropped.select(F.col(col).alias("_corvine_gone"))
    doubtful = bitmap_filter(docs, key, dropped)
    return bitmap_filter(docs, key, dropped, absent=True).unionByName(doubtful.join(gone, key == F.col("_corvine_gone"), "left_anti"))


def hashed_sample(df: DataFrame, by: Column, rows: int, of: int) -> DataFrame:
    """About the `rows` rows of df with the smallest hash of `by`, never more; df has `of` rows.

    Hashes beyond a bound that leaves some more than enough go before the rest is ordered, so that what tasks send grows
    with `rows` and not with the number of tasks. Only where many rows share one hash can it be fewer than `rows`.
    """
    share = min(1.0, (rows + 6 * rows**0.5 + 20) / max(1, of))
    bound = min(2**63 - 1, int(share * 2.0**64) - 2**63)
    return df.withColumn("_corvine_hash", F.xxhash64(by)).filter(F.col("_corvine_hash") <= bound).orderBy("_corvine_hash").limit(rows)


def shift_left(one: Column, n: Column) -> Column:
    """1 << n with a column as shift, which the Python function doesn't take."""
    return F.call_function("shiftleft", one, n)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): the smallest id reachable from each endpoint of edges (both bigint, undirected).

    Contraction: every node goes to its smallest neighbour, and along such steps to a node without a smaller one; then
    both ends of every edge are replaced, loops and repeats go, and what is left is contracted again. A node that has
    moved is in no later edge, so edges only shrink and the loop ends. Every step is an aggregation with map-side
    combine or an equi-join that adaptive execution can split; each is written.
    """
    e = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "edges")
    moves: list[DataFrame] = []
    while not e.isEmpty():
        up = cut(e.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("label")), "moves")
        while True:  # every step doubles the way
            ends = up.select(F.col("id").alias("label"), F.col("label").alias("next"))
            far = cut(up.join(ends, "label", "left").select("id", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "moves")
            discard(up)
            up = far.select("id", "label")
            up.scratch_path = far.scratch_path
            if far.filter("moved").isEmpty():
                break
        x, y = up.select(F.col("id").alias("hi"), F.col("label").alias("a")), up.select(F.col("id").alias("lo"), F.col("label").alias("b"))
        left = e.join(x, "hi").select("a", "lo").distinct().join(y, "lo", "left").select("a", F.coalesce("b", "lo").alias("b")).filter("a <> b")
        new = cut(left.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
        discard(e)
        e = new
        moves.append(up)
    if not moves:
        return e.select(F.col("hi").alias("id"), F.col("lo").alias("label"))
    found = moves.pop()
    while moves:  # where earlier moves ended, later ones go on
        later = found.select(F.col("id").alias("label"), F.col("label").alias("next"))
        earlier = moves.pop().join(later, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
        found = cut(earlier.unionByName(found), "labels")
    return found.unionByName(found.select(F.col("label").alias("id"), "label").distinct())


#: gapless(): rows of a part where the table is small, and parts beside one for each group where it is large.
PART_ROWS, PARTS = 512, 500_000


def gapless(df: DataFrame, group: str, order: list[Column], name: str, counts: dict, by: Column) -> DataFrame:
    """df with a bigint column `name` that numbers the rows of each group from 0 without gaps.

    counts: rows of each group, of which there must be few. A hash of `by` splits every group into parts, the more the
    larger it is, each numbered on its own, and the parts' counts give the offsets. So one group with a third of all rows
    is many tasks; the offsets, a broadcast, are PARTS rows beside one for each group at most. df is read twice and
    must give the same rows both times.
    """
    spark = df.sparkSession
    if not counts:
        return df.withColumn(name, F.lit(0).cast("long"))
    each = max(PART_ROWS, sum(counts.values()) // PARTS)
    split = spark.createDataFrame([(g, 1 + n // each) for g, n in counts.items()], f"_g {df.schema[group].dataType.simpleString()}, _parts long")
    d = df.join(F.broadcast(split), df[group].eqNullSafe(split._g)).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_g", "_parts")
    sizes = d.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    d = d.withColumn("_own", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)) - 1)
    on = d[group].eqNullSafe(offsets._g) & (d._part == offsets._p)
    return d.join(F.broadcast(offsets), on).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_p", "_g", "_own", "_before")


#: small(): tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, a written table, marked for a broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, the place among the rows of equal g by `order` from 0 without gaps, and n, the rows of that g.

    One range sort over all groups; `order` must tell all rows apart but for exchangeable ones. Places come from each
    row's number in its sorted partition and the sizes of the partitions before, so no group meets in one task.
    """
    mid = F.monotonically_increasing_id()
    ordered = cut(rows.orderBy("g", *order).withColumn("_part", F.shiftright(mid, 33)).withColumn("_row", mid.bitwiseAND((1 << 33) - 1)), "ordered")
    sizes = ordered.groupBy("g", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("g", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy("g")).alias("n"))
    out = ordered.join(small(cut(offsets, "offsets")), ["g", "_part"])
    return out.withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16_000_000) -> None:
    """Texts are long: unless the session says otherwise, Arrow batches have at most so many rows, on both sides, and end
    with the row that brings them to `size` bytes. A batch is held whole by the JVM, beside its heap, and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, str(size))


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that hands freed memory back to the system when its task ends.

    Python workers are reused, and what one task held at its peak would otherwise stay with the executor.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, so that working arrays stay small; none is ever cut."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
