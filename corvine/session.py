"""Session defaults used by tests, the benchmark and applications."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session with the engine's defaults; conf adds or overrides settings."""
    b = SparkSession.builder.master(master).appName("corvine")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": "8"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset: a local folder in local mode, else an error, as
    every executor would write to a disk of its own.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/corvine-scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_root(spark)}/corvine/{name}-{uuid.uuid4().hex}"
