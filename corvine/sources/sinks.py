"""Sinks on plain Parquet: bucketed tables with upsert, delete, update, append and copy; run logs; response envelopes.

A table is a folder with data, written once and never changed, and manifests, manifest/v=0, v=1, ..., each a list of the
live data folders by bucket of the key's hash. A write reads and rewrites the buckets that its keys fall in, or only adds
files, and then writes the next manifest, in which all other buckets keep their folders. Readers take the last manifest
that is complete (has _SUCCESS), so a failed or repeated write never shows, and no reader sees half of one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table.
BUCKETS = 32
MANIFEST = "bucket int, folder string, key string, buckets int, schema string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@dataclass(frozen=True)
class State:
    """A version of a table: its live folders by bucket, the key that buckets are made of (none yet: ""), the schema."""

    folders: dict[int, tuple[str, ...]]
    key: str
    buckets: int
    schema: StructType

    def read(self, spark: SparkSession, wanted: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; nothing else is read."""
        paths = [f for b, fs in sorted(self.folders.items()) for f in fs if wanted is None or b in wanted]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    done = [f for f in found if f.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName()[2:]) for f in done)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def state(spark: SparkSession, path: str) -> State:
    rows = spark.read.parquet(f"{path}/manifest/v={versions(spark, path)[-1]}").collect()
    folders: dict[int, tuple[str, ...]] = {}
    for r in sorted((r for r in rows if r["folder"] is not None), key=lambda r: r["folder"]):
        folders[r["bucket"]] = (*folders.get(r["bucket"], ()), r["folder"])
    return State(folders, rows[0]["key"], rows[0]["buckets"], StructType.fromJson(json.loads(rows[0]["schema"])))


def read(spark: SparkSession, path: str) -> DataFrame:
    return state(spark, path).read(spark)


def _commit(spark: SparkSession, path: str, s: State) -> None:
    rest = (s.key, s.buckets, s.schema.json())
    rows = [(b, f, *rest) for b, fs in s.folders.items() for f in fs] or [(None, None, *rest)]
    number = max(versions(spark, path), default=-1) + 1
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _add(df: DataFrame, path: str, s: State) -> dict[int, str]:
    """Write df as new data folders, one for each of its buckets."""
    spark, at = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    b = bucket(F.col(s.key), s.buckets) if s.key else F.lit(0)
    d = df.withColumn("_bucket", b)
    # rows of a bucket come together, but a bucket larger than a task should have, say of a hot key, is divided
    (d.hint("rebalance", F.col("_bucket")) if s.key else d).write.partitionBy("_bucket").parquet(at)
    fs, p = _fs(spark, at)
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return {int(n.split("=")[1]): f"{at}/{n}" for n in names if n.startswith("_bucket=")}


def ensure(spark: SparkSession, path: str, schema: StructType, key: str = "", buckets: int = BUCKETS) -> None:
    """Create an empty table once; again it does nothing."""
    if not exists(spark, path):
        _commit(spark, path, State({}, key, buckets, schema))


def write(df: DataFrame, path: str, key: str = "", buckets: int = BUCKETS) -> None:
    """Replace the whole table, or make it."""
    s = State({}, key, buckets, df.schema)
    _commit(df.sparkSession, path, replace(s, folders={b: (f,) for b, f in _add(df, path, s).items()}))


def append(df: DataFrame, path: str) -> None:
    """Add rows as new files; nothing that is there is read or written."""
    s = state(df.sparkSession, path)
    added = _add(df.select(*s.schema.names), path, s)
    _commit(df.sparkSession, path, replace(s, folders=s.folders | {b: (*s.folders.get(b, ()), f) for b, f in added.items()}))


def _keyed(spark: SparkSession, path: str, key: str) -> State:
    """The table's state, bucketed by key: a table that isn't yet is written anew, once."""
    s = state(spark, path)
    if s.key != key:
        if s.folders:
            write(s.read(spark), path, key, s.buckets)
            return state(spark, path)
        s = replace(s, key=key)
    return s


def _rewrite(spark: SparkSession, path: str, s: State, keys: DataFrame, made) -> list[int]:
    """Write the buckets of keys anew as made(their rows) says; the others stay. Returns the buckets."""
    touched = [r[0] for r in keys.select(bucket(F.col(s.key), s.buckets)).distinct().collect()]  # as many as there are buckets at most
    if touched:
        df = made(s.read(spark, touched))
        added = _add(df, path, s)
        left = {b: fs for b, fs in s.folders.items() if b not in touched}
        _commit(spark, path, replace(s, folders=left | {b: (f,) for b, f in added.items()}, schema=df.schema))
    return sorted(touched)


def one_per(rows: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """One row of each key: the last by seq, of equal ones (or without seq) that whose JSON text is the last."""
    order = [*([F.desc(seq)] if seq else []), F.desc(F.to_json(F.struct(*(F.col(c) for c in rows.columns))))]
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """old with new rows in place of those with their key, null being a key too; of new rows with one key one counts (one_per)."""
    new = one_per(new, key, seq)
    keys = new.select(F.col(key).alias("_key"))
    return old.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, seq: str | None = None) -> list[int]:
    """upserted() on a table, in the buckets of the new keys alone, which are returned. A repeated batch changes no row."""
    s = _keyed(spark, path, key)
    return _rewrite(spark, path, s, new, lambda old: upserted(old, new, key, seq))


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str) -> list[int]:
    """Rows with one of the keys go; only their buckets are written."""
    return _rewrite(spark, path, _keyed(spark, path, key), keys, lambda old: deleted(old, keys, key))


def update(spark: SparkSession, path: str, changes: DataFrame, key: str, fields: list[str]) -> list[int]:
    """updated() on a table; only the buckets of the changes are written."""
    return _rewrite(spark, path, _keyed(spark, path, key), changes, lambda old: updated(old, changes, key, fields))


def deleted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def updated(df: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with the fields of its row in changes where that is not null; of changes of one key one counts (one_per)."""
    c = one_per(changes.select(key, *fields), key).select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    out = df.join(c, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns))


def patched(df: DataFrame, missing: str, values: DataFrame, key: str) -> DataFrame:
    """Only rows that lack the field, with its value from values (key, field)."""
    return df.filter(F.col(missing).isNull()).drop(missing).join(values.select(key, missing), key)


def copied(source: DataFrame, target: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows that a create-only copy adds to target: those whose key is not there yet. Run again, it adds none."""
    new = source.join(target.select(key), key, "left_anti")
    return new.orderBy(key).limit(most) if most else new


def copy(source: DataFrame, path: str, key: str, slices: int = 4) -> list[int]:
    """Create-only copy into a table, slice by slice; returns the rows created in each.

    A slice is a share of the buckets: only its keys are read, and it is committed on its own, so a copy that failed
    goes on where it stopped, and running it again is the delta pass over rows that came meanwhile. Rows that are there
    stay as they are; of source rows with one key one counts (one_per); rows without a key are not copied.
    """
    spark, made = source.sparkSession, []
    for i in range(slices):
        s = _keyed(spark, path, key)
        mine = [b for b in range(s.buckets) if b % slices == i]
        part = source.filter(F.col(key).isNotNull() & (bucket(F.col(key), s.buckets) % slices == i))
        added = _add(copied(one_per(part, key), s.read(spark, mine), key).select(*s.schema.names), path, s)
        _commit(spark, path, replace(s, folders=s.folders | {b: (*s.folders.get(b, ()), f) for b, f in added.items()}))
        made.append(spark.read.schema(s.schema).parquet(*added.values()).count() if added else 0)  # the files' own counts
    return made


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and what will hold the counters of its rows once they have been written: no pass of their own."""
    seen = Observation()
    return df.observe(seen, *(c.alias(k) for k, c in counters.items())), seen


def hoisted(chunks: DataFrame) -> DataFrame:
    """Index documents of chunks: provenance and facets at the top level, the chunk's role before the document's."""
    out = chunks.select(*(c for c in chunks.columns if c != "source"), "source.*")
    return out.withColumn("doc_role", F.coalesce("chunk_role", "doc_role")).drop("chunk_role")


def envelope(df: DataFrame, keys: Column) -> DataFrame:
    """One JSON text per row, nulls left out, with a redacted metadata map."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "metadata"], keys.alias("metadata"))).alias("json"))


RUNS = "run_id string, status string, started timestamp, finished timestamp, counters map<string,long>"
LOG = "run_id string, key string, event string, at timestamp, deleted boolean"


def log_run(spark: SparkSession, path: str, run: DataFrame) -> None:
    """Insert or replace a run's row by run_id."""
    ensure(spark, path, StructType.fromDDL(RUNS), "run_id")
    upsert(spark, path, run, "run_id")


def log_documents(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append document events as new files; nothing that is there is read."""
    ensure(spark, path, StructType.fromDDL(LOG), "key")
    append(rows, path)


def soft_delete(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Mark all events of the keys as deleted, in their buckets."""
    ensure(spark, path, StructType.fromDDL(LOG), "key")
    update(spark, path, keys.select("key").distinct().withColumn("deleted", F.lit(True)), "key", ["deleted"])
