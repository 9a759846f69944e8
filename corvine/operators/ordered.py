"""Order-sensitive operators: islands, forward fill, greedy packing, even samples, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def island(flag: Column, part: list[str], order: list[str]) -> Column:
    """A running number that grows where flag is true (sessions, sections, entries)."""
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(W.partitionBy(*part).orderBy(*order))


def forward_fill(value: Column, part: list[str], order: list[str], first: str = "") -> Column:
    """The last value so far that is not null, this row's own included."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(first))


def limit_runs(df: DataFrame, part: list[str], order: str, value: str, most: int = 3) -> DataFrame:
    """Rows but for those beyond the first `most` of a run of equal values."""
    w = W.partitionBy(*part).orderBy(order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    d = df.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy(*part, "_run").orderBy(order)))
    return d.filter(F.col("_n") <= most).drop("_new", "_run", "_n")


def waves(sizes: Column, most: int) -> Column:
    """Bin numbers for an array of sizes in order: a bin takes whole items until the next would exceed `most`."""
    state = "struct<bin:int,room:int,out:array<int>>"

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["room"] >= n) | (acc["room"] == most)
        number = F.when(fits, acc["bin"]).otherwise(acc["bin"] + 1)
        room = F.when(fits, acc["room"] - n).otherwise(F.lit(most) - n)
        return F.struct(number.alias("bin"), room.cast("int").alias("room"), F.concat(acc["out"], F.array(number)).alias("out"))

    start = F.struct(F.lit(0).alias("bin"), F.lit(most).alias("room"), F.array().cast("array<int>").alias("out")).cast(state)
    return F.aggregate(sizes.cast("array<int>"), start, step, lambda a: a["out"])


def groups_of(part: list[str], order: list[str], n: int) -> Column:
    """Group numbers of n rows each."""
    return F.floor((F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1) / n)


def even_sample(items: Column, most: int = 12) -> Column:
    """At most `most` items spread evenly over an array, first and last among them; halves round to even."""
    n = F.size(items)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / (most - 1)).cast("int"))
    return F.when(n <= most, items).otherwise(F.transform(F.array_distinct(at), lambda i: F.get(items, i)))


def previous(value: Column, part: list[str], order: list[str]) -> Column:
    """The value of the batch before (running context), null for the first."""
    return F.lag(value).over(W.partitionBy(*part).orderBy(*order))


def shard(c: Column, n: int) -> Column:
    """A worker number from an identifier, so that a record is never split."""
    return F.pmod(F.crc32(F.encode(c, "UTF-8")), F.lit(n)).cast("int")
