"""Queries that pack one ordered list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import runs
from corvine.plans.catalog import query
from corvine.session import table


def packed_sql(items: str, key: str, most: int, close: bool = False) -> str:
    """Greedy packing by a recursive walk from start to start; items: SQL with the key and n."""
    after = "ends + 1" if close else "greatest(ends, i + 1)"
    return f"""WITH RECURSIVE it AS ({items}),
t AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS i, sum(n) OVER (ORDER BY {key}) - n AS s, sum(n) OVER (ORDER BY {key}) AS e FROM it),
u AS (SELECT s + {most} AS x, {int(not close)} AS kind, i FROM t UNION ALL SELECT e, {int(close)}, NULL FROM t),
c AS (SELECT i, count(*) FILTER (i IS NULL) OVER (ORDER BY x, kind) AS ends FROM u),
nxt AS (SELECT i, {after} AS j FROM c WHERE i IS NOT NULL),
r AS (SELECT 0::BIGINT AS i UNION ALL SELECT nxt.j FROM r JOIN nxt ON nxt.i = r.i WHERE nxt.j < (SELECT count(*) FROM t))
SELECT t.{key}, CAST(count(r.i) OVER (ORDER BY t.i) - 1 AS BIGINT) AS bin FROM t LEFT JOIN r ON r.i = t.i"""


LINES = "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
TURNS = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id"


@query(packed_sql(LINES, "o_orderkey", 20))
def waves_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, in order, packed whole into waves of at most 20 lines."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    items = table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey")
    return runs.packed(items, ["o_orderkey"], "n", 20).select("o_orderkey", "bin")


@query(packed_sql(TURNS, "conv_id", 20, close=True))
def batches_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, in order, whole in batches that close as soon as they hold 20 turns."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return runs.packed(n, ["conv_id"], "n", 20, close=True).select("conv_id", "bin")
