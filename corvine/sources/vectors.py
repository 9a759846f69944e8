"""A stored vector index: vectors in cells of trained centres, product-quantised codes beside them, both pruned by cell.

Layout below the index folder, all Parquet:

  centres             cell, centre (unit vectors)
  codebooks           sub, code, centre (of that part of unit vectors)
  settings            probes and factor, measured against exact search
  vectors/batch/cell  vec_id, label, vector (unit, floats)
  codes/batch/cell    vec_id, code (a byte for each part)
  stats/batch         cell, n; written last, so a batch counts when it is complete

Centres are fitted by Lloyd steps, each an aggregation of sums per centre over the partitions of a sample. Queries meet
only the cells nearest to them. Vectors that are null, zero, of another length or not finite are not indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.session import scratch
from corvine.sources.postings import batches

#: Vectors that centres and codebooks are fitted to, at most; all are indexed.
SAMPLE = 65_536
#: Rows of one side of a block of comparisons.
BLOCK = 4096
#: Rows of vectors in a block where every query meets all vectors, and numbers in a working array.
WHOLE, CELLS = 32_768, 2_000_000
UNIT = "vec_id long, label int, vector array<float>"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def units(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, label and the unit vector of all rows that have one, from vec_id, label, embedding."""
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    fine = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.when(fine, e).alias("_e"), F.when(fine, norm).alias("_n"))
    return v.filter((F.col("_n") > 0) & (F.col("_n") < float("inf"))).select("vec_id", "label", F.transform("_e", lambda x: (x / F.col("_n")).cast("float")).alias("vector"))


def slabs(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows, so that an array of `width` numbers for each row of one has CELLS at most."""
    each = max(1, CELLS // max(1, width))
    return (slice(i, min(rows, i + each)) for i in range(0, rows, each))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each row; of equal ones the first."""
    norms = (centres * centres).sum(1)[None, :]
    return np.concatenate([np.argmin(norms - 2 * x[part] @ centres.T, 1) for part in slabs(len(x), len(centres))] or [np.empty(0, np.int64)])


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place) of the k highest scores of each row, the highest first, of equal ones the smallest id."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    by = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[by], column[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], column[keep], place[keep]


def lloyd(sample: DataFrame, parts: int, count: int, steps: int = 8) -> np.ndarray:
    """Centres (parts, count, dimensions of a part) of vectors cut into equal parts; sample: vector, a written table.

    It begins with the vectors of smallest hash. A step sends, for each partition, one row of sums and counts a centre, and
    these are added per centre; what comes back has the size of the centres. A centre without vectors stays.
    """
    first = np.array([r["vector"] for r in sample.orderBy(F.xxhash64("vector")).limit(count).collect()], float)
    if not len(first):
        raise ValueError("no vector to fit to")
    centres = np.stack(np.split(np.resize(first, (count, first.shape[1])), parts, axis=1))
    schema = "part int, centre int, n long, total array<double>"

    for _ in range(steps):

        def partial(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centres), np.zeros(centres.shape[:2], np.int64)
            for b in batches:
                for p, x in enumerate(np.split(_matrix(b.column(0)), parts, axis=1)) if b.num_rows else ():
                    at = nearest(x, centres[p])
                    np.add.at(total[p], at, x)
                    n[p] += np.bincount(at, minlength=count)
            p, c = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n[p, c]), pa.array(list(total[p, c]), pa.list_(pa.float64()))], names=["part", "centre", "n", "total"])

        sums = sample.select("vector").mapInArrow(partial, schema).select("part", "centre", "n", F.posexplode("total").alias("k", "x"))
        sums = sums.groupBy("part", "centre", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        centres = centres.copy()
        for r in sums:
            centres[r["part"], r["centre"], r["k"]] = r["x"] / r["n"]
    return centres


def create(vectors: DataFrame, path: str, cells: int, parts: int = 16, codes: int = 256) -> None:
    """Fit centres and codebooks to at most SAMPLE of the vectors, those of smallest hash; the index is empty then."""
    spark = vectors.sparkSession
    dim = vectors.filter("embedding IS NOT NULL").agg(F.max(F.size("embedding"))).first()[0]
    if not dim or dim % parts:
        raise ValueError("the parts must divide the vectors")
    at = scratch(spark, "units")
    units(vectors, dim).write.parquet(at)
    whole = spark.read.parquet(at)
    share = min(1.0, 1.1 * SAMPLE / max(1, whole.count()))
    at = scratch(spark, "sample")
    whole.filter(F.xxhash64("vec_id") <= min(2**63 - 1, int(share * 2.0**64) - 2**63)).limit(SAMPLE).select("vector").write.parquet(at)
    sample = spark.read.parquet(at)
    coarse = lloyd(sample, 1, cells)[0]
    coarse /= np.maximum(np.linalg.norm(coarse, axis=1, keepdims=True), 1e-12)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(coarse)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    fine = lloyd(sample, parts, codes)
    rows = [(s, c, x.tolist()) for s in range(parts) for c, x in enumerate(fine[s])]
    spark.createDataFrame(rows, "sub int, code int, centre array<double>").write.parquet(f"{path}/codebooks")


def centres_of(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Centres of cells, and codebooks (part, code, component). Their size is a parameter of the index."""
    coarse = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    fine = spark.read.parquet(f"{path}/codebooks").orderBy("sub", "code").collect()
    parts = 1 + max(r["sub"] for r in fine)
    return np.array([r["centre"] for r in coarse]), np.array([r["centre"] for r in fine]).reshape(parts, len(fine) // parts, -1)


def encoded(x: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """A byte for each part of each row."""
    return np.stack([nearest(p, c) for p, c in zip(np.split(x, len(codebooks), axis=1), codebooks, strict=True)], 1).astype(np.uint8)


def add(vectors: DataFrame, path: str) -> int:
    """Index vec_id, label, embedding as the next batch. Each vector goes to its nearest cell; nothing is fitted again."""
    spark = vectors.sparkSession
    coarse, fine = centres_of(spark, path)
    number = max(batches(spark, path), default=-1) + 1

    def place(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks:
            if b.num_rows:
                x = _matrix(b.column(2))
                code = encoded(x, fine)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(np.concatenate([np.argmax(x[part] @ coarse.T, 1) for part in slabs(len(x), len(coarse))]).astype(np.int32))], names=["vec_id", "label", "vector", "code", "cell"])

    at = scratch(spark, "placed")
    units(vectors, coarse.shape[1]).mapInArrow(place, f"{UNIT}, code binary, cell int").write.parquet(at)
    placed = spark.read.parquet(at)
    # cells of many vectors are several files, so that no task writes a whole one
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))).sortWithinPartitions("cell", "vec_id")
    dealt.select("vec_id", "label", "vector", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors/batch={number}")
    dealt.select("vec_id", "code", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes/batch={number}")
    placed.groupBy("cell").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/stats/batch={number}")
    return number


def _cells(spark: SparkSession, path: str, name: str, wanted: list[int] | None = None) -> DataFrame:
    """A table of all complete batches, cut to cells by partition filters."""
    live = batches(spark, path)
    df = spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/batch={b}" for b in live))
    return df if wanted is None else df.filter(F.col("cell").isin(wanted))


def visits(queries: DataFrame, coarse: np.ndarray, probes: int) -> DataFrame:
    """(query_id, vector, cell, visit): the nearest cells of each query (query_id, vector), the nearest first."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks:
            x, own = _matrix(b.column(1)), np.arange(len(coarse))
            for part in slabs(b.num_rows, max(len(coarse), probes * coarse.shape[1])):
                row, cell, place = best_of(x[part] @ coarse.T, own, probes)
                at = pa.array(row + part.start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell.astype(np.int32)), pa.array(place.astype(np.int32))], names=["query_id", "vector", "cell", "visit"])

    return queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<float>")).mapInArrow(run, "query_id long, vector array<float>, cell int, visit int")


def _met(rows: DataFrame, value: str, asked: DataFrame, sizes: dict[int, int], scorer: Callable[[pa.Table], Callable[[np.ndarray], np.ndarray]], k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, cell, vec_id, score): the k best of rows (cell, vec_id, value) for each query in each block of its cells.

    Both sides of a cell are cut into blocks by hashes, of `block` rows and BLOCK queries, and a call compares two, a slab
    of scores at a time; so a cell that holds many of the rows or meets many queries is many calls of bounded size.
    """
    spark = rows.sparkSession
    at = scratch(spark, "asked")
    asked.write.parquet(at)
    asked = spark.read.parquet(at)
    many = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    dealt = [(c, 1 + sizes.get(c, 0) // block, 1 + n // BLOCK) for c, n in many.items()]
    blocks = F.broadcast(spark.createDataFrame(dealt, "cell int, _v int, _q int"))  # a row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(blocks, "cell").withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("_v")).cast("int")).withColumn("qb", every("_q"))
    right = asked.join(blocks, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("_q")).cast("int")).withColumn("vb", every("_v"))

    def best(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "cell": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, score = _matrix(q["vector"]), scorer(v)
        ids, asks = v["vec_id"].to_numpy(), q["query_id"].to_numpy()
        found = []
        for part in slabs(len(asks), len(ids)):
            s = score(x[part])
            row, at, _ = best_of(s, ids, k)
            found.append((asks[part][row], ids[at], s[row, at]))
        query_id, vec_id, scores = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": query_id, "cell": pa.array(np.full(len(vec_id), v["cell"][0].as_py(), np.int32)), "vec_id": vec_id, "score": scores})

    keys = ("cell", "vb", "qb")
    grouped = left.select(*keys, "vec_id", value).groupBy(*keys).cogroup(right.select(*keys, "query_id", "vector").groupBy(*keys))
    return grouped.applyInArrow(best, "query_id long, cell int, vec_id long, score double")


def _exact(v: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
    x = _matrix(v["vector"])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)  # stored as floats
    return lambda q: (q / np.linalg.norm(q, axis=1, keepdims=True)) @ x.T


def _looked_up(codebooks: np.ndarray) -> Callable[[pa.Table], Callable[[np.ndarray], np.ndarray]]:
    """Scores from codes: a table of each query's products with all centres of a part, added up over the parts."""

    def scorer(v: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
        code = np.frombuffer(b"".join(v["code"].to_pylist()), np.uint8).reshape(v.num_rows, -1)

        def score(q: np.ndarray) -> np.ndarray:
            out = np.zeros((len(q), v.num_rows))
            for p, (part, centres) in enumerate(zip(np.split(q, len(codebooks), axis=1), codebooks, strict=True)):
                out += (part @ centres.T)[:, code[:, p]]
            return out

        return score

    return scorer


def ranked(found: DataFrame, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank", *extra)


class Index:
    """Reads of an index; its centres are loaded once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.coarse, self.fine = centres_of(spark, path)
        stats = spark.read.parquet(*(f"{path}/stats/batch={b}" for b in batches(spark, path)))
        self.sizes = {r["cell"]: r["n"] for r in stats.groupBy("cell").agg(F.sum("n").alias("n")).collect()}

    def search(self, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """The k nearest of the vectors in the `probes` nearest cells of each query (query_id, vector): query_id, vec_id, score, rank.

        where: a filter on label, below the comparison.
        """
        asked, wanted = self._asked(queries, probes or self.settings()[0])
        rows = _cells(self.spark, self.path, "vectors", wanted)
        rows = rows if where is None else rows.filter(where)
        found = _met(rows, "vector", asked, self.sizes, _exact, k)
        return ranked(found.withColumn("score", F.round("score", 6)), k)

    def search_all(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest of all vectors, as search() over all cells finds them: the work is every query times every vector.

        Cells play no part. Queries are copied for each WHOLE vectors and vectors for each BLOCK queries, which is what is
        shuffled; a call compares two such blocks.
        """
        asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<float>"), F.lit(0).alias("cell"))
        rows = _cells(self.spark, self.path, "vectors").select(F.lit(0).alias("cell"), "vec_id", "vector")
        found = _met(rows, "vector", asked, {0: sum(self.sizes.values())}, _exact, k, WHOLE)
        return ranked(found.withColumn("score", F.round("score", 6)), k)

    def search_coded(self, queries: DataFrame, k: int, probes: int | None = None, factor: int | None = None) -> DataFrame:
        """As search(), but from codes: the k * factor best by looked-up products are scored again by their vectors.

        The scan reads ids and codes only, of the cells visited; vectors are fetched for the candidates.
        """
        probes, factor = probes or self.settings()[0], factor or self.settings()[1]
        asked, wanted = self._asked(queries, probes)
        rough = _met(_cells(self.spark, self.path, "codes", wanted), "code", asked, self.sizes, _looked_up(self.fine), k * factor)
        at = scratch(self.spark, "rough")
        ranked(rough, k * factor, ("cell",)).write.parquet(at)
        rough = self.spark.read.parquet(at).select("query_id", "cell", "vec_id")
        near = [r["cell"] for r in rough.select("cell").distinct().collect()]
        v = _cells(self.spark, self.path, "vectors", near).select("cell", "vec_id", "vector")
        pairs = rough.join(v, ["cell", "vec_id"]).join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("q")), "query_id")

        def again(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks:
                if b.num_rows:
                    q, x = _matrix(b.column(2)), _matrix(b.column(3))
                    s = (q * x).sum(1) / (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query_id", "vec_id", "score"])

        exact = pairs.select("query_id", "vec_id", "q", "vector").mapInArrow(again, "query_id long, vec_id long, score double")
        return ranked(exact.withColumn("score", F.round("score", 6)), k)

    def _asked(self, queries: DataFrame, probes: int) -> tuple[DataFrame, list[int]]:
        at = scratch(self.spark, "visits")
        visits(queries, self.coarse, probes).drop("visit").write.parquet(at)
        asked = self.spark.read.parquet(at)
        return asked, [r["cell"] for r in asked.select("cell").distinct().collect()]  # a cell each at most

    def calibrate(self, queries: DataFrame, k: int = 10, recall: float = 0.95) -> tuple[int, int]:
        """Measure, against exact search over all cells, how many cells and candidates give the recall, and store both.

        queries are some of the vectors that are asked for; their number bounds what is compared.
        """
        cells = len(self.coarse)
        true = ranked(_met(_cells(self.spark, self.path, "vectors"), "vector", self._asked(queries, cells)[0], self.sizes, _exact, k), k, ("cell",)).select("query_id", "vec_id", "cell")
        at = scratch(self.spark, "true")
        true.write.parquet(at)
        true = self.spark.read.parquet(at)
        total = true.count()
        seen = true.join(visits(queries, self.coarse, cells).select("query_id", "cell", "visit"), ["query_id", "cell"]).groupBy("visit").agg(F.count("*").alias("n"))
        probes = _enough({r["visit"]: r["n"] for r in seen.collect()}, total, recall)
        most = 200 * k
        rough = ranked(_met(_cells(self.spark, self.path, "codes"), "code", self._asked(queries, cells)[0], self.sizes, _looked_up(self.fine), most), most)
        placed = true.join(rough.select("query_id", "vec_id", "rank"), ["query_id", "vec_id"]).groupBy(F.floor((F.col("rank") - 1) / k).cast("int").alias("f")).agg(F.count("*").alias("n"))
        factor = _enough({r["f"]: r["n"] for r in placed.collect()}, total, recall)
        self.spark.createDataFrame([(probes, factor)], "probes int, factor int").write.mode("overwrite").parquet(f"{self.path}/settings")
        return probes, factor

    def settings(self) -> tuple[int, int]:
        return tuple(self.spark.read.parquet(f"{self.path}/settings").first())


def _enough(counts: dict[int, int], total: int, recall: float) -> int:
    """The smallest n so that the counts at places below n come to the share of total; all places if none does."""
    seen = 0
    for place in sorted(counts):
        seen += counts[place]
        if seen >= recall * total:
            return place + 1
    return 1 + max(counts, default=0)
