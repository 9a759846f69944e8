"""A stored inverted index: positional postings in blocks of documents, written once, added to per batch, pruned by block maxima.

Layout below the index folder, all Parquet:

  settings            one row: the name fields, documents a block, buckets
  postings/batch/bucket   field, term, block, n, first, ids (documents, less the first), tfs, lens, positions, impacts
  terms/batch/bucket      field, term, df
  stats/batch             field, n (documents that have it), total (their terms); written last, so a batch counts when it is complete

A block is a run of documents in the order of their ids, the same one for all terms and fields, so bounds of several
terms add up per block. impacts are the pairs of term frequency and length in a block that no other pair beats in
both: whatever the average length becomes when batches are added, the block's best score of the term is one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.operators import lexical
from corvine.session import scratch

#: Query terms, or pairs of query and block, up to which that side of a join is broadcast.
BROADCAST = 100_000
TEXT = 0


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def create(spark: SparkSession, path: str, names: tuple[str, ...] = (), block: int = 128, buckets: int = 32) -> None:
    """An empty index over the text and the name fields; where there is one, it stays."""
    spark.createDataFrame([(list(names), block, buckets)], "names array<string>, block int, buckets int").write.mode("ignore").parquet(f"{path}/settings")


def settings(spark: SparkSession, path: str) -> tuple[tuple[str, ...], int, int]:
    r = spark.read.parquet(f"{path}/settings").first()
    return tuple(r["names"]), r["block"], r["buckets"]


def batches(spark: SparkSession, path: str) -> list[int]:
    """The complete batches."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [f.getPath() for f in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _impacts(pairs: Column) -> Column:
    """The (tf, dl) of an array that no other pair beats, by falling tf."""
    ordered = F.array_sort(F.transform(pairs, lambda x: F.struct((-x.tf).alias("tf"), x.dl.alias("dl"))))
    none = F.array().cast("array<struct<tf:int,dl:int>>")
    better = lambda a, x: F.when((F.size(a) == 0) | (x.dl < F.element_at(a, -1).dl), F.concat(a, F.array(F.struct((-x.tf).cast("int").alias("tf"), x.dl.alias("dl"))))).otherwise(a)
    return F.aggregate(ordered, none, better)


def add(docs: DataFrame, path: str) -> int:
    """Index docs (doc_id, text, the name fields) as the next batch, and return its number. Ids must be new to the index.

    Texts are analysed once, in one range shuffle by id, which makes the blocks; then postings of a document are made
    before the shuffle, and those of a block meet by term and block, so no term, however common, is one group.
    """
    spark = docs.sparkSession
    names, block, buckets = settings(spark, path)
    number = max(batches(spark, path), default=-1) + 1
    fields = ("text", *names)
    terms = [lexical.analyzed(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)]
    mid = F.monotonically_increasing_id()
    at = scratch(spark, "analysed")
    placed = docs.select("doc_id", *fields).repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_mid", mid)
    row = F.col("_mid").bitwiseAND((1 << 33) - 1)
    placed.select("doc_id", (F.shiftright("_mid", 33) * (1 << 33) + F.floor(row / block)).alias("block"), *terms).write.parquet(at)
    analysed = spark.read.parquet(at)
    each = [
        analysed.select("block", "doc_id", F.lit(i).alias("field"), F.size(f"t{i}").alias("dl"), F.posexplode(f"t{i}").alias("pos", "term"))
        for i in range(len(fields))
    ]
    own = reduce(DataFrame.unionByName, each).groupBy("field", "term", "block", "doc_id", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    own = own.withColumn("bucket", bucket(F.col("term"), buckets)).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(8)).cast("int"))
    own = own.repartition("bucket", "part").withColumn("tf", F.size("positions"))
    run = own.groupBy("bucket", "part", "field", "term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "dl", "positions"))).alias("p"))
    first = F.get("p", F.lit(0)).doc_id
    out = run.select(
        "bucket", "field", "term", "block", F.size("p").alias("n"), first.alias("first"),
        F.transform("p", lambda x: x.doc_id - first).alias("ids"), F.transform("p", lambda x: x.tf).alias("tfs"), F.transform("p", lambda x: x.dl).alias("lens"),
        F.transform("p", lambda x: x.positions).alias("positions"), _impacts(F.col("p")).alias("impacts"),
    )
    out.sortWithinPartitions("bucket", "field", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
    written = spark.read.schema(out.schema).parquet(f"{path}/postings/batch={number}")
    counted = written.groupBy("bucket", "field", "term").agg(F.sum("n").alias("df"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/batch={number}")
    sizes = analysed.select(F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.size(f"t{i}").alias("dl")) for i in range(len(fields))))).alias("x")).select("x.*")
    stats = sizes.filter("dl > 0").groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    stats.write.mode("overwrite").parquet(f"{path}/stats/batch={number}")
    return number


def _table(spark: SparkSession, path: str, name: str, wanted: list[int] | None) -> DataFrame:
    """A table of all complete batches, with `batch`, cut to buckets by partition filters."""
    live = batches(spark, path)
    df = spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/batch={b}" for b in live))
    return df if wanted is None else df.filter(F.col("bucket").isin(wanted))


class Search:
    """Queries (query_id, text) against an index: bounds of blocks, then exact scores of those that can count."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, slop: int = 1, boosts: tuple[float, float, float] = (2.0, 4.0, 2.0), k1: float = 1.2, b: float = 0.75):
        self.spark, self.path, self.slop, self.boosts, self.k1, self.b = spark, path, slop, boosts, k1, b
        self.names, _, self.buckets = settings(spark, path)
        live = batches(spark, path)
        stats = spark.read.option("basePath", f"{path}/stats").parquet(*(f"{path}/stats/batch={x}" for x in live)) if live else None
        rows = stats.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect() if live else []
        self.n = {r["field"]: r["n"] for r in rows}
        self.mean = {r["field"]: r["total"] / r["n"] for r in rows}
        self.queries = queries.select("query_id", lexical.analyzed(F.coalesce(F.col("text"), F.lit(""))).alias("words")).filter(F.size("words") > 0)
        terms = self.queries.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
        at = scratch(spark, "terms")
        terms.write.parquet(at)
        self.terms = spark.read.parquet(at)
        self.wanted = [r[0] for r in self.terms.select(bucket(F.col("term"), self.buckets)).distinct().collect()]  # as many as there are buckets at most
        df = self._table("terms").join(_small(self.terms.select("term").distinct()), "term").groupBy("field", "term").agg(F.sum("df").alias("df"))
        n = self._by_field(self.n)
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        at = scratch(spark, "weights")
        self.terms.join(df, "term").select("query_id", "field", "term", idf.alias("idf")).write.parquet(at)
        self.weights = spark.read.parquet(at)

    def _table(self, name: str) -> DataFrame:
        return _table(self.spark, self.path, name, self.wanted)

    def _by_field(self, values: dict) -> Column:
        out = F.lit(None).cast("double")
        for f, v in values.items():
            out = F.when(F.col("field") == f, F.lit(float(v))).otherwise(out)
        return out

    def part(self, tf: Column, dl: Column, mean: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / mean))

    def fields(self, column: str) -> list[Column]:
        return [F.sum(F.when(F.col("field") == i, F.col(column))).alias(f"s{i}") for i in range(1 + len(self.names))]

    def total(self, phrase: Column) -> Column:
        """The three clauses together, from s0, s1, ... and the phrase's score."""
        out = self.boosts[0] * F.coalesce("s0", F.lit(0.0)) + self.boosts[1] * F.coalesce(phrase, F.lit(0.0))
        return out + self.boosts[2] * lexical.best_fields([F.col(f"s{i + 1}") for i in range(len(self.names))]) if self.names else out

    def whole(self) -> DataFrame:
        """(query_id, words, each, whole): the words, how many are distinct, and the weight of all as a phrase."""
        w = self.queries.select("query_id", F.explode("words").alias("term")).join(self.weights.filter(F.col("field") == TEXT), ["query_id", "term"])
        w = w.groupBy("query_id").agg(F.sum("idf").alias("whole"))
        return self.queries.join(w, "query_id", "left").select("query_id", "words", F.size(F.array_distinct("words")).alias("each"), "whole")

    def bounds(self) -> DataFrame:
        """(query_id, batch, block, bound): no document of the block has a higher score. Reads neither ids nor positions."""
        heads = self._table("postings").select("field", "term", "batch", "block", "impacts")
        heads = heads.join(_small(self.weights), ["field", "term"])
        peak = F.array_max(F.transform("impacts", lambda x: self.part(x.tf, x.dl, F.col("_mean"))))
        heads = heads.withColumn("_mean", self._by_field(self.mean)).withColumn("_s", F.col("idf") * peak)
        at = heads.groupBy("query_id", "batch", "block").agg(*self.fields("_s"), F.count(F.when(F.col("field") == TEXT, 1)).alias("_met"))
        at = at.join(F.broadcast(self.whole().drop("words")) if self.queries.limit(BROADCAST + 1).count() <= BROADCAST else self.whole().drop("words"), "query_id")
        phrase = F.when(F.col("_met") == F.col("each"), F.col("whole") * (self.k1 + 1))
        return at.select("query_id", "batch", "block", self.total(phrase).alias("bound"))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all documents with a query term in the given pairs (query_id, batch, block)."""
        p = self._table("postings").select("field", "term", "batch", "block", "first", "ids", "tfs", "lens", "positions")
        p = p.join(_small(self.weights), ["field", "term"]).join(_small(pairs.select("query_id", "batch", "block")), ["query_id", "batch", "block"])
        p = p.select("query_id", "field", "term", "idf", "first", F.explode(F.arrays_zip("ids", "tfs", "lens", "positions")).alias("x"))
        s = F.col("idf") * self.part(F.col("x.tfs"), F.col("x.lens"), self._by_field(self.mean))
        in_text = F.col("field") == TEXT
        found = F.collect_list(F.when(in_text, F.struct("term", F.col("x.positions").alias("positions"))))
        d = p.withColumn("_s", s).groupBy("query_id", (F.col("first") + F.col("x.ids")).alias("doc_id")).agg(*self.fields("_s"), found.alias("found"), F.max(F.when(in_text, F.col("x.lens"))).alias("dl"))
        d = d.join(_small(self.whole()), "query_id")
        place = F.transform("words", lambda w, k: F.transform(F.element_at(F.filter("found", lambda x: x.term == w), 1).positions, lambda i: i - k))
        d = d.withColumn("_at", F.when(F.size("found") == F.col("each"), place))
        pf = F.aggregate(lexical.phrase_hits(F.col("_at"), self.slop), F.lit(0.0), lambda x, y: x + y)
        d = d.withColumn("_pf", F.when(F.col("_at").isNotNull(), pf))
        phrase = F.when(F.col("_pf") > 0, F.col("whole") * self.part(F.col("_pf"), F.col("dl"), F.lit(float(self.mean.get(TEXT, 1.0)))))
        return d.select("query_id", "doc_id", F.round(self.total(phrase), 6).alias("score"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, **how) -> DataFrame:
    """The k best documents of each query: query_id, doc_id, score, rank, as lexical.match_query scores them.

    Only buckets of the queries' terms are read. From the heads of their blocks follow bounds; the k blocks with the
    highest bounds of a query, each with a match, are scored, and the k-th score there is a threshold. Then the
    blocks whose bound reaches it are scored; no other can hold one of the k best. Queries without words have no rows.
    """
    if not batches(spark, path):
        return spark.createDataFrame([], queries.select("query_id").schema.add("doc_id", "long").add("score", "double").add("rank", "long"))
    s = Search(spark, path, queries, **how)
    at = scratch(spark, "bounds")
    s.bounds().write.parquet(at)
    bounds = spark.read.parquet(at)
    first = bounds.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "batch", "block"))).filter(F.col("_r") <= k)
    least = ranked(s.scores(first), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    at = scratch(spark, "live")
    bounds.join(_small(least), "query_id", "left").filter(F.col("bound") + 1e-6 >= F.coalesce("_least", F.lit(0.0))).write.parquet(at)
    return ranked(s.scores(spark.read.parquet(at)), k)
