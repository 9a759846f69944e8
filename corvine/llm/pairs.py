"""All pairs inside groups of any size: groups are dealt as blocks, and each task compares two blocks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import cut

LINKS = "rep long, root long, links long"


#: Split groups whose number of blocks is broadcast; where there are more, it is joined.
BROADCAST = 100_000


def deal(members: DataFrame, group: list[str], key: str, weight: str, most: int, most_weight: int, tasks: int) -> DataFrame:
    """members with columns task, lo, hi, blk: rows of one (task, lo, hi) meet in one Python call.

    A group of more than `most` rows, or more than `most_weight` in weight, is split by a hash of key into blocks, and
    each block is sent to a call for every pair of blocks. Smaller groups share `tasks` calls. Sizes come from an
    aggregation with map-side combine, and only split groups meet their number of blocks, by a broadcast of checked
    size: no group is ever gathered. members is read twice and should rest on a written table.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    blocks = F.greatest(F.ceil(F.col("_n") / most), F.ceil(F.col("_w") / most_weight), F.lit(1)).cast("int")
    split = cut(sizes.select(*group, blocks.alias("_blocks")).filter("_blocks > 1"), "split")
    few = split.limit(BROADCAST + 1).count() <= BROADCAST
    m = members.join(F.broadcast(split) if few else split, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    m = m.withColumn("blk", F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.col("_blocks")).cast("int"))
    alone = F.col("_blocks") == 1
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    code = F.xxhash64(*group)
    return (
        m.withColumn("task", F.when(alone, F.pmod(code, F.lit(tasks))).otherwise(code))
        .withColumn("lo", F.when(alone, -1).otherwise(F.least("blk", "_other")))
        .withColumn("hi", F.when(alone, -1).otherwise(F.greatest("blk", "_other")))
        .drop("_other", "_blocks")
    )


def comparable(blk: np.ndarray, lo: int, hi: int) -> np.ndarray | None:
    """Which pairs a call has to judge: all of one block, or those across its two blocks. None: all."""
    return None if lo == hi else blk[:, None] != blk[None, :]


def forest(linked: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, root, links) from a symmetric matrix of links without diagonal, for the ids that have any.

    root is the smallest id connected inside the matrix; links counts linked rows, each with its size.
    """
    keep = np.flatnonzero(linked.any(1))
    keep = keep[np.argsort(ids[keep], kind="stable")]
    a, n = linked[np.ix_(keep, keep)], len(keep)
    label = np.arange(n)
    while n:
        heard = np.minimum(label, np.where(a, label[None, :], n).min(1))
        heard = heard[heard]
        if (heard == label).all():
            break
        label = heard
    return ids[keep], ids[keep][label] if n else ids[keep], (a @ sizes[keep]).astype(np.int64)
