"""Queries over sketches that are stored per batch and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import sketches
from corvine.plans.catalog import query
from corvine.session import scratch, table

#: Batches that the queries split their tables into.
BATCHES = 3


def stored(spark: SparkSession, df: DataFrame, key: str, fields: list[str], most: int = sketches.MOST) -> str:
    """The whole table's sketches, added batch by batch; one batch is added twice, which changes nothing."""
    path = scratch(spark, "sketches")
    for b in [*range(BATCHES), 0]:
        sketches.add(df.filter(F.pmod(F.col(key), F.lit(BATCHES)) == b), path, b, fields, most)
    return path


REGISTERS = """r AS (SELECT facet, substr(md5(value), 1, 3) AS register, max(CASE WHEN low = 0 THEN 53 ELSE 53 - length(ltrim(bin(low), '0')) END) AS rank
FROM (SELECT *, ('0x' || substr(md5(value), 4, 13))::BIGINT AS low FROM v) GROUP BY 1, 2)"""


@query(f"""WITH v AS (SELECT 'user_id' AS facet, user_id::VARCHAR AS value FROM events UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'event_id', event_id::VARCHAR FROM events), {REGISTERS},
g AS (SELECT facet, count(*) AS nfull, sum(pow(2.0, -rank)) AS s FROM r GROUP BY facet), e AS (SELECT *, {0.7213 / (1 + 1.079 / 4096) * 4096 * 4096}::DOUBLE / (s + 4096 - nfull) AS raw FROM g)
SELECT facet, round(CASE WHEN raw <= 10240 AND nfull < 4096 THEN 4096 * ln(4096.0::DOUBLE / (4096 - nfull)) ELSE raw END)::BIGINT AS estimate FROM e""")
def cardinality_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts merged from the registers of batches: those of one pass."""
    path = stored(spark, table(spark, sf_dir, "events"), "event_id", ["user_id", "event_type", "event_id"])
    return sketches.cardinality(spark, path)


@query("""WITH v AS (SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part),
n AS (SELECT facet, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL)
SELECT facet, value, n AS least, n AS greatest, true AS certain FROM n QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 1000""")
def vocabulary_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facet vocabulary merged from the counters of batches; while these suffice for all values, it is exact."""
    return sketches.vocabulary(spark, stored(spark, table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type", "p_size"]))


@query("""WITH n AS (SELECT l_suppkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'l_suppkey' AS facet, value, n FROM n ORDER BY n DESC, value LIMIT 5""")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent suppliers: candidates from few counters per batch, counted exactly in a second pass."""
    l = table(spark, sf_dir, "lineitem")
    path = stored(spark, l, "l_orderkey", ["l_suppkey"], 64)
    return sketches.recounted(sketches.stored(spark, path, "counters"), l, ["l_suppkey"], 5)
