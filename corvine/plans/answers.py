"""Queries through the planner and the search interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.plans import planner
from corvine.plans.catalog import query
from corvine.session import table


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a staff directory."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select(F.col("c_name").alias("Email"), F.col("n_name").alias("Office Location"), F.concat(F.initcap("c_mktsegment"), F.lit(" and Piano")).alias("Skills"), F.lower("n_name").alias("Languages"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a text of its own, under conversation/turn."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")


@query("SELECT c_name AS \"Email\", n_name AS \"Office Location\", lower(n_name) AS \"Languages\" FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE instr(lower(n_name), 'nation_3') > 0 ORDER BY c_name LIMIT 50")
def literal_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir)
    plan = planner.plan_question("Who speaks fluent NATION_3 at the office?", p.columns)
    from corvine.operators import rows

    return rows.select(p, plan.formula, ["Email", "Office Location", "Languages"], 50, ["Email"])


@query()
def search_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = planner.Registry()
    r.add(planner.Source("people", rows=people(spark, sf_dir), order="Email"))
    r.add(planner.Source("documents", chunks=table(spark, sf_dir, "documents").select("doc_id", "text")))
    r.add(planner.Source("talks", chunks=turns(spark, sf_dir)))
    return planner.search(r, "who knows piano with experience in theand thon", top_k=10)


@query()
def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = planner.Registry()
    r.add(planner.Source("documents", chunks=table(spark, sf_dir, "documents").select("doc_id", "text")))
    r.add(planner.Source("talks", chunks=turns(spark, sf_dir)))
    return planner.search(r, "theand thon ererea", top_k=10, merge="rrf")
