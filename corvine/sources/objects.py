"""Object-store layouts: scans, key parsing, sibling preference, sidecars, routing by prefix, key migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes read as text.
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".csv", ".json", ".html", ".htm", ".xml", ".yaml", ".yml", ".log")
NORMALISED = "__normalized.txt"
# Fixed value: the name of a directory's sidecar.
SIDECAR = ".airtable_meta.json"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """key, content, length, modified of all files below root (with one of the suffixes, if any are given)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    key = F.regexp_replace("path", "^.*?/(?=raw/)", "")
    d = files.select(key.alias("key"), "content", "length", F.col("modificationTime").alias("modified"))
    return d.filter(F.lower(suffix(F.col("key"))).isin(*suffixes)) if suffixes else d


def suffix(key: Column) -> Column:
    return F.regexp_extract(key, r"(\.[^./]+)$", 1)


def directory(key: Column) -> Column:
    return F.regexp_replace(key, "/[^/]*$", "")


def base_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def text_of(files: DataFrame) -> DataFrame:
    """files with text: UTF-8 of text suffixes, empty for others and for bytes that are not UTF-8."""
    t = F.when(F.lower(suffix(F.col("key"))).isin(*TEXT_SUFFIXES), F.try_validate_utf8(F.col("content").cast("string")))
    return files.withColumn("text", F.coalesce(t, F.lit("")))


def prefer_normalised(files: DataFrame) -> DataFrame:
    """Files but for those in a directory that holds a normalised text and that are not one."""
    d = files.withColumn("_dir", directory(F.col("key")))
    own = d.filter(F.col("key").endswith(NORMALISED))
    return own.unionByName(d.filter(~F.col("key").endswith(NORMALISED)).join(own.select("_dir").distinct(), "_dir", "left_anti")).drop("_dir")


def parsed_key(key: Column) -> Column:
    """struct<table, pk, column, file> of raw/table/pk/column.ext or raw/table/pk/column/../file; others: table only null."""
    p = F.split(key, "/")
    n = F.size(p)
    raw = (F.get(p, F.lit(0)) == "raw") & (n >= 4)
    stem = F.regexp_replace(F.get(p, F.lit(3)), r"\.[^.]+$", "")
    column = F.when(n == 4, stem).otherwise(F.get(p, F.lit(3)))
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(raw, F.get(p, F.lit(1))).otherwise(none).alias("table_name"),
        F.when(raw, F.get(p, F.lit(2))).otherwise(F.regexp_replace(base_name(key), r"\.[^.]+$", "")).alias("primary_key"),
        F.when(raw, column).otherwise(none).alias("column_name"),
        base_name(key).alias("filename"),
    )


def with_sidecar(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files with meta, the map in the sidecar of their directory; missing or invalid ones give an empty map."""
    s = sidecars.select(directory(F.col("key")).alias("_dir"), F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"}).alias("meta"))
    s = s.groupBy("_dir").agg(F.first("meta", ignorenulls=True).alias("meta"))
    return files.withColumn("_dir", directory(F.col("key"))).join(s, "_dir", "left").drop("_dir").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def routed(files: DataFrame, tables: DataFrame, fallback: str | None = None) -> DataFrame:
    """files with route, the table whose prefix is the longest that begins their key, or fallback.

    tables: prefix, name. A key is looked up by its own prefixes of the lengths that the registry has, in one hash join, and
    the longest that is there wins. Of equal prefixes the last name counts. Repeated rows stay; a null key has no table.
    """
    registry = tables.filter("prefix IS NOT NULL").groupBy("prefix").agg(F.max("name").alias("_name"))
    lengths = [r[0] for r in registry.select(F.length("prefix")).distinct().collect()]  # as many as a key has characters at most
    own = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("key"))
    keys = files.select("key").filter("key IS NOT NULL").distinct().withColumn("_n", F.explode(own)).withColumn("prefix", F.expr("left(key, _n)"))
    best = keys.join(registry, "prefix").groupBy("key").agg(F.max(F.struct("_n", "_name"))["_name"].alias("route"))
    out = files.join(best, "key", "left")
    out = out.select(*files.columns, "route")
    return out.withColumn("route", F.coalesce("route", F.lit(fallback))) if fallback else out


def allowed(files: DataFrame, suffixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) by an allow-list of suffixes; an empty list allows all."""
    ok = F.lower(suffix(F.col("key"))).isin(suffixes) if suffixes else F.lit(True)
    return files.filter(ok), files.filter(~ok)


#: What ends the name of a file's text form.
NORMALISED = "__normalized.txt"


def remapped(key: Column, old: Column, new: Column) -> Column:
    """A key of the segment old (its third) with new in its place, also in the name of that segment's text form; null for other keys."""
    head = F.regexp_extract(key, "^[^/]+/[^/]+/", 0)
    under = F.concat(head, old, F.lit("/"))
    rest = F.substring(key, F.length(under) + 1, F.length(key))
    was, now = F.concat(old, F.lit(NORMALISED)), F.concat(new, F.lit(NORMALISED))
    named = (rest == was) | F.endswith(rest, F.concat(F.lit("/"), was))
    return F.when((head != "") & F.startswith(key, under), F.concat(head, new, F.lit("/"), F.when(named, F.replace(rest, was, now)).otherwise(rest)))


def sidecars_migrated(sidecars: DataFrame, renames: DataFrame) -> DataFrame:
    """key, new_key, text of sidecars (key, text) below renamed segments (old, new, name): their JSON names the new place.

    identifier becomes the record's name, original_s3_key moves along if it lies below the segment, and both segments
    are noted; all other fields stay as they are, whatever their type. Texts that are no JSON object stay.
    """
    s = sidecars.withColumn("old", F.split_part("key", F.lit("/"), F.lit(3))).join(renames, "old")
    m = F.from_json("text", "map<string,variant>")
    text = lambda c: c.cast("variant")
    place = F.col("_m")["original_s3_key"]
    moved = remapped(F.try_variant_get(place, "$", "string"), F.col("old"), F.col("new"))
    own = F.create_map(F.lit("identifier"), text(F.col("name")), F.lit("migrated_from_s3_segment"), text(F.col("old")), F.lit("migrated_to_s3_segment"), text(F.col("new")))
    rest = F.map_filter("_m", lambda k, v: ~k.isin("identifier", "migrated_from_s3_segment", "migrated_to_s3_segment") & ~((k == "original_s3_key") & moved.isNotNull()))
    key = F.when(moved.isNotNull(), F.create_map(F.lit("original_s3_key"), text(moved))).otherwise(F.create_map().cast("map<string,variant>"))
    s = s.withColumn("_m", m).withColumn("text", F.coalesce(F.to_json(F.map_concat(rest, key, own)), F.col("text")))
    return s.select("key", remapped(F.col("key"), F.col("old"), F.col("new")).alias("new_key"), "text").filter("new_key is not null")


def migrated(keys: DataFrame, renames: DataFrame, existing: DataFrame) -> DataFrame:
    """key, new_key for keys whose third segment is renamed (old, new): targets that exist are skipped, of two with one target the first key stays."""
    from corvine.operators.hydrate import first_per

    k = keys.select("key", F.split_part("key", F.lit("/"), F.lit(3)).alias("old")).join(renames, "old")
    k = k.select("key", remapped(F.col("key"), F.col("old"), F.col("new")).alias("new_key")).filter("new_key <> key")
    k = k.join(existing.select(F.col("key").alias("new_key")), "new_key", "left_anti")
    return first_per(k, [F.col("new_key")], [F.col("key")]).select("key", "new_key")


def complete(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """expected (key, normalised_key, normalises) with done: whether the key that counts for it is in the listing."""
    want = F.when(F.col("normalises"), F.col("normalised_key")).otherwise(F.col("key"))
    l = listing.select(F.col("key").alias("_k")).distinct().withColumn("_there", F.lit(True))
    return expected.withColumn("_k", want).join(l, "_k", "left").withColumn("done", F.col("_there").isNotNull()).drop("_k", "_there")


def looked_up(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """keys (key) with exists and etag (null where there is none), from a listing (key, etag); quotes around tags go."""
    from corvine.functions.text import unquoted

    there = listing.groupBy(F.col("key").alias("_k")).agg(F.max(unquoted(F.col("etag"))).alias("etag"))
    return keys.join(there, F.col("key") == F.col("_k"), "left").withColumn("exists", F.col("_k").isNotNull()).drop("_k")


class Store:
    """Single objects below a root that Spark can reach; tables of objects go through scan() and Spark's writers."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def at(self, key: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.conf), path

    def exists(self, key: str) -> bool:
        fs, path = self.at(key)
        return fs.exists(path)

    def put(self, key: str, content: bytes) -> None:
        """Write an object, or write it anew."""
        fs, path = self.at(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, key: str) -> bytes | None:
        """An object's bytes, none if it doesn't exist."""
        fs, path = self.at(key)
        if not fs.exists(path):
            return None
        read = fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(read))
        finally:
            read.close()

    def text(self, key: str) -> str | None:
        b = self.get(key)
        return None if b is None else b.decode("utf-8", "replace")

    def delete(self, key: str) -> None:
        fs, path = self.at(key)
        fs.delete(path, False)
