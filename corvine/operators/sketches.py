"""Mergeable sketches of fields: how many distinct values, and which are frequent, stored per batch and merged on reading.

Both are rows made by aggregations, and a stored batch is never read again but for its rows. Distinct counts keep the
highest rank in each of 4,096 registers (HyperLogLog); merging is a maximum, so merged sketches equal that of one pass.
Frequent values keep `most` counters per field, the next count being taken off all of them (mergeable summaries of the
Misra-Gries kind): a counter is too low by the field's error at most, and errors add up on merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Registers have numbers of three hex digits; the standard error is 1.04 / sqrt(4096), about 1.6 %.
REGISTERS = 4096
#: Counters per field.
MOST = 4096


def values(df: DataFrame, fields: list[str]) -> DataFrame:
    """facet, value of all fields in one pass; null and empty ones go, lists give their elements."""
    kinds = dict(df.dtypes)

    def of(f: str) -> Column:
        c = F.col(f"`{f}`")
        many = c.cast("array<string>") if kinds[f].startswith("array") else F.array(c.cast("string"))
        return F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda v: F.struct(F.lit(f).alias("facet"), v.alias("value")))

    return df.select(F.inline(F.flatten(F.array(*map(of, fields))))).filter("value <> ''")


def registers(v: DataFrame) -> DataFrame:
    """facet, register, rank of facet, value: the register is three hex digits of a value's MD5, the rank the place of the first bit set in the 52 after them."""
    h = v.select("facet", F.md5("value").alias("h"))
    low = F.conv(F.substring("h", 4, 13), 16, 10).cast("long")
    rank = F.when(low == 0, F.lit(53)).otherwise(53 - F.length(F.bin(low)))
    return h.groupBy("facet", F.substring("h", 1, 3).alias("register")).agg(F.max(rank).cast("int").alias("rank"))


def distinct(regs: DataFrame) -> DataFrame:
    """facet, estimate of registers of any number of batches; nearly empty sketches count their empty registers."""
    m = float(REGISTERS)
    r = regs.groupBy("facet", "register").agg(F.max("rank").alias("rank"))
    g = r.groupBy("facet").agg(F.count("*").alias("full"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    empty = m - F.col("full")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + empty)
    small = (raw <= 2.5 * m) & (empty > 0)
    return g.select("facet", F.round(F.when(small, m * F.log(m / F.greatest(empty, F.lit(1.0)))).otherwise(raw)).cast("long").alias("estimate"))


def reduced(counts: DataFrame, most: int = MOST) -> DataFrame:
    """facet, value, n, error of counters (facet, value, n) and errors (value null, error) of any number of summaries.

    The count of rank most + 1 goes from all counters of its field and into the error; counters at zero go. A field's
    error is a row of its own, with value null. Ranking keeps most + 1 rows per field and task ahead of its shuffle.
    """
    c = counts.groupBy("facet", "value").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    own, err = c.filter("value is not null"), c.filter("value is null").select("facet", F.col("error").alias("had"))
    top = own.withColumn("r", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= most + 1)
    over = F.coalesce(F.max(F.when(F.col("r") == most + 1, F.col("n"))).over(W.partitionBy("facet")), F.lit(0))
    left = top.withColumn("_off", over)
    errors = left.groupBy("facet").agg(F.max("_off").alias("off")).join(err, "facet", "full")
    errors = errors.select("facet", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"), (F.coalesce("off", F.lit(0)) + F.coalesce("had", F.lit(0))).cast("long").alias("error"))
    kept = left.filter((F.col("r") <= most) & (F.col("n") > F.col("_off")))
    return kept.select("facet", "value", (F.col("n") - F.col("_off")).cast("long").alias("n"), F.lit(0).cast("long").alias("error")).unionByName(errors)


def counted(v: DataFrame, most: int = MOST) -> DataFrame:
    """The summary of facet, value rows, counted before they are ranked."""
    return reduced(v.groupBy("facet", "value").agg(F.count("*").alias("n")).withColumn("error", F.lit(0).cast("long")), most)


def frequent(summary: DataFrame, k: int) -> DataFrame:
    """facet, value, least, greatest, certain: the first k by counter; a true count lies between least and greatest.

    certain: no value outside the list can have more rows than this one.
    """
    s = reduced(summary) if "error" in summary.columns else summary
    e = s.filter("value is null").select("facet", F.col("error").alias("e"))
    own = s.filter("value is not null").select("facet", "value", "n")
    w = W.partitionBy("facet").orderBy(F.desc("n"), "value")
    top = own.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).join(e, "facet")
    beyond = F.coalesce(F.max(F.when(F.col("r") == k + 1, F.col("n"))).over(W.partitionBy("facet")), F.lit(0)) + F.col("e")
    out = top.withColumn("_beyond", beyond).filter(F.col("r") <= k)
    return out.select("facet", "value", F.col("n").alias("least"), (F.col("n") + F.col("e")).alias("greatest"), (F.col("n") >= F.col("_beyond")).alias("certain"))


def add(df: DataFrame, path: str, batch: int, fields: list[str], most: int = MOST) -> None:
    """Store the sketches of a batch; a batch that is added again replaces what it had, others are not read."""
    v = values(df, fields)
    registers(v).write.mode("overwrite").parquet(f"{path}/registers/batch={batch}")
    counted(v, most).write.mode("overwrite").parquet(f"{path}/counters/batch={batch}")


def stored(spark: SparkSession, path: str, what: str) -> DataFrame:
    """Sketches of all batches: registers or counters."""
    return spark.read.option("basePath", f"{path}/{what}").parquet(f"{path}/{what}/batch=*").drop("batch")


def vocabulary(spark: SparkSession, path: str, k: int = 1000) -> DataFrame:
    """frequent() over all batches."""
    return frequent(stored(spark, path, "counters"), k)


def cardinality(spark: SparkSession, path: str) -> DataFrame:
    """distinct() over all batches."""
    return distinct(stored(spark, path, "registers"))


def recounted(summary: DataFrame, df: DataFrame, fields: list[str], k: int) -> DataFrame:
    """facet, value, n: the exact first k, ties by value, where the summary has at least k counters above its error.

    Every value that could be among them is counted in a second pass: those whose greatest count reaches the k-th least
    one. Values without a counter have the error's count at most; where that reaches the k-th least count, the field is
    counted whole.
    """
    s = reduced(summary)
    e = s.filter("value is null").select("facet", F.col("error").alias("e"))
    own = s.filter("value is not null").select("facet", "value", "n")
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= k)
    bar = ranked.groupBy("facet").agg(F.min("n").alias("bar"), F.count("*").alias("had")).join(e, "facet", "right")
    whole = bar.filter((F.col("e") > 0) & ((F.coalesce("had", F.lit(0)) < k) | (F.col("e") >= F.col("bar")))).select("facet")
    near = own.join(bar, "facet").filter(F.col("n") + F.col("e") >= F.col("bar")).select("facet", "value")
    v = values(df, fields)
    some = v.join(F.broadcast(near.join(whole, "facet", "left_anti")), ["facet", "value"], "left_semi")  # MOST rows a field at most
    n = some.unionByName(v.join(F.broadcast(whole), "facet", "left_semi")).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= k).drop("r")
