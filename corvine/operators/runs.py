"""Greedy packing of one ordered list of any length: prefix sums, successors by one sort, starts by blocks and pointer doubling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.session import scratch

#: Items, one after the other, of which the way is followed in one call.
BLOCK = 65_536


def written(df: DataFrame, name: str) -> DataFrame:
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with a bigint column for each of values: its sum over all rows up to this one in the order, itself included.

    Rows are range-sorted and written; each partition is summed on its own, and the sums of the partitions, a row
    each, give what comes before. So the list is never in one task. Rows that the order does not tell apart keep one
    order for all sums.
    """
    row = F.monotonically_increasing_id()
    d = df.select("*", *(v.cast("long").alias(f"_v_{k}") for k, v in values.items())).orderBy(*order)
    d = written(d.withColumn("_row", row).withColumn("_part", F.shiftright("_row", 33)), "ordered")
    parts = d.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_v_{k}") for k in values))
    up = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_v_{k}").over(up), F.lit(0)).alias(f"_b_{k}") for k in values))
    own = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    d = d.join(F.broadcast(parts), "_part")  # as many rows as the sort has partitions
    return d.select(*df.columns, *((F.sum(f"_v_{k}").over(own) + F.col(f"_b_{k}")).alias(k) for k in values))


def _exits(at: np.ndarray, to: np.ndarray, entries: np.ndarray) -> list[np.ndarray]:
    """Each entry of a block, and the first item behind the block on its way."""
    here = np.append(np.minimum(to - at[0], len(at)), len(at))
    end = np.append(np.where(here[:-1] < len(at), -1, to), -1)
    while (open_ := np.flatnonzero(end[:-1] < 0)).size:  # the way doubles
        end[open_] = end[here[open_]]
        here[open_] = here[here[open_]]
    return [entries, end[entries - at[0]]]


def _walked(at: np.ndarray, to: np.ndarray, entries: np.ndarray) -> list[np.ndarray]:
    """The items of a block on the way of one of the entries."""
    on = np.zeros(len(at), bool)
    on[entries - at[0]] = True
    for i, j in enumerate((to - at[0]).tolist()):
        if on[i] and j < len(on):
            on[j] = True
    return [at[on]]


def _along(step: DataFrame, entries: DataFrame, schema: str, follow: Callable) -> DataFrame:
    """What follow() makes of each block that has entries: its items, where their steps lead, and the entries."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, own: pa.Table, met: pa.Table) -> pa.Table:
        if not own.num_rows or not met.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        at, to = own["_i"].to_numpy(), own["to"].to_numpy()
        by = np.argsort(at, kind="stable")
        return pa.table(dict(zip(names, map(pa.array, follow(at[by], to[by], met["_i"].to_numpy())), strict=True)))

    return step.groupBy("_block").cogroup(entries.select("_i", "_block").groupBy("_block")).applyInArrow(run, schema)


def packed(items: DataFrame, order: list[str], size: str, most: int, close: bool = False) -> DataFrame:
    """items with `bin`, from 0: whole items in order, packed greedily as one list.

    A bin takes items until the next would bring it above `most`; an item above it stands alone. With close, a bin takes
    items until it holds `most` or more, the last one included. A null size counts as 0; `order` should tell rows apart.

    Where a bin that starts at an item would end follows from prefix sums and a sort of the ends together with the limits.
    Which items do start one is followed inside blocks of BLOCK items, from each item where a step enters the block to where
    it leaves it. Which entries are taken is found by doubling: after k rounds the first 2^k are known, and the pointers
    skip as many; a round is two equi-joins of entries with entries, and there are as many as their number has bits.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    d = running(items, [F.col(c) for c in order], _i=F.lit(1), _end=n).withColumn("_i", F.col("_i") - 1)
    d = written(d.withColumn("_from", F.col("_end") - n), "sums")
    total = d.count()
    # behind how many ends does the limit of a bin that starts here lie? equal ends: inside the bin, or closing it
    limit = d.select((F.col("_from") + most).alias("x"), F.lit(0 if close else 1).alias("kind"), "_i")
    ends = d.select(F.col("_end").alias("x"), F.lit(1 if close else 0).alias("kind"), F.lit(None).cast("long").alias("_i"))
    found = running(limit.unionByName(ends), [F.col("x"), F.col("kind"), F.col("_i")], ends=F.col("_i").isNull().cast("int")).filter("_i IS NOT NULL")
    after = F.col("ends") + 1 if close else F.greatest(F.col("ends"), F.col("_i") + 1)
    step = found.select("_i", F.least(after, F.lit(total)).alias("to"), F.floor(F.col("_i") / BLOCK).alias("_block"))
    step = written(step.repartition("_block").sortWithinPartitions("_i"), "steps")
    # blocks are entered where a step from another block ends: these items alone take part in the doubling
    entries = step.filter(F.floor(F.col("to") / BLOCK) > F.col("_block")).select(F.col("to").alias("_i")).unionByName(step.filter("_i = 0").select("_i")).distinct()
    entries = written(entries.filter(F.col("_i") < total).withColumn("_block", F.floor(F.col("_i") / BLOCK)), "entries")
    jump = written(_along(step, entries, "_i long, to long", _exits), "jumps")
    starts = written(entries.filter("_i = 0").select("_i"), "starts")
    known = starts.count()
    while known:
        reached = starts.join(jump, "_i").filter(F.col("to") < total).select(F.col("to").alias("_i"))
        starts = written(starts.unionByName(reached).distinct(), "starts")
        if (now := starts.count()) == known:
            break
        known = now
        far = jump.select(F.col("_i").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(far, "to", "left").select("_i", F.coalesce("far", F.lit(total)).alias("to")), "jumps")
    starts = _along(step, starts.withColumn("_block", F.floor(F.col("_i") / BLOCK)), "_i long", _walked)
    marked = d.join(starts.withColumn("_start", F.lit(1)), "_i", "left")
    out = running(marked, [F.col("_i")], bin=F.coalesce(F.col("_start"), F.lit(0)))
    return out.select(*items.columns, (F.col("bin") - 1).alias("bin"))
