"""Records of a row store: full, incremental and point scans; schemas; a live source through the data source API."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def scan(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return df.select(*fields) if fields else df


def changed(df: DataFrame, watch: list[str], since: str | None) -> DataFrame:
    """Rows of which a watched time lies after the cursor; without a cursor all (bootstrap)."""
    if since is None:
        return df
    return df.filter(F.greatest(*map(F.col, watch)) > F.to_timestamp(F.lit(since))) if len(watch) > 1 else df.filter(F.col(watch[0]) > F.to_timestamp(F.lit(since)))


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def snapshot(df: DataFrame) -> str:
    """A schema as text, to be frozen beside a source."""
    return df.schema.json()


def validated(df: DataFrame, frozen: str, needed: list[str]) -> StructType:
    """The frozen schema; an error if a needed column is missing from it or from the table."""
    schema = StructType.fromJson(json.loads(frozen))
    if gone := [c for c in needed if c not in schema.names or c not in df.columns]:
        raise ValueError(f"missing columns: {gone}")
    return schema


def schema_digest(df: DataFrame, fields: int = 60, choices: int = 30) -> DataFrame:
    """field, type, choices: columns with their kind, and the values of texts that have few; one pass."""
    names = df.columns[:fields]
    texts = [c for c in names if dict(df.dtypes)[c] == "string"]
    kinds = df.sparkSession.createDataFrame([(c, dict(df.dtypes)[c]) for c in names], "field string, type string")
    if not texts:
        return kinds.withColumn("choices", F.array().cast("array<string>"))
    one = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in texts))).alias("x")).select("x.*").distinct()
    few = one.groupBy("field").agg(F.count("*").alias("n")).filter(F.col("n") <= choices).select("field")
    got = one.join(few, "field").groupBy("field").agg(F.array_sort(F.collect_list("v")).alias("choices"))
    return kinds.join(got, "field", "left")


class PagedRecords(DataSource):
    """A row store behind functions of a module, as a batch and a streaming source: format("paged_records").

    Options name the module and its functions, so any service fits. spark.read: function(table, offset, size) -> list of
    dicts; with the option total, offsets are dealt to partitions, else one reads page after page until a short one.
    spark.readStream: latest(table) -> the newest cursor, or None, and changes(table, after, upto, offset, size) -> dicts
    whose cursor lies behind `after` (None: from the start) and not behind `upto`, in one order; cursors are texts.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ChangesReader(schema, self.options)


def _function(options: dict, name: str):
    import importlib

    return getattr(importlib.import_module(options["module"]), options.get(name, name))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.size = int(self.options.get("page", 100))

    def partitions(self) -> list[InputPartition]:
        if "total" not in self.options:
            return [InputPartition(None)]
        return [InputPartition(i) for i in range(0, int(self.options["total"]), self.size)]

    def read(self, partition: InputPartition):
        f, at = _function(self.options, "function"), partition.value or 0
        while True:
            rows = f(self.options["table"], at, self.size)
            for r in rows:
                yield tuple(r.get(c) for c in self.schema.names)
            at += self.size
            if partition.value is not None or len(rows) < self.size:
                return


class ChangesReader(DataSourceStreamReader):
    """Changed records as a stream whose offset is the cursor.

    A batch is what lies between two cursors that the checkpoint holds, and both go to the service, so a batch that is run again
    after a failure reads the same rows, and the next one goes on behind them. Where the service has no newer
    cursor, there is no batch.
    """

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.size = int(self.options.get("page", 100))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.options.get("since")}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"cursor": _function(self.options, "latest")(self.options["table"]) or self.options.get("since")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [] if start == end else [InputPartition((start["cursor"], end["cursor"]))]

    def read(self, partition: InputPartition):
        after, upto = partition.value
        f, at = _function(self.options, "changes"), 0
        while True:
            rows = f(self.options["table"], after, upto, at, self.size)
            for r in rows:
                yield tuple(r.get(c) for c in self.schema.names)
            at += self.size
            if len(rows) < self.size:
                return


def union_lists(lists: list[DataFrame]) -> DataFrame:
    """Lists of several sources one behind the other, with the source's place."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("source_ord", F.lit(i)) for i, d in enumerate(lists)])
