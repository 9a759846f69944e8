"""Near-duplicate embeddings by an inverted multi-index: two codebooks span a grid of cells, the nearest are visited."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import components, cut, lean
from corvine.llm.pairs import LINKS, comparable, deal, forest
from corvine.session import table

COSINE = 0.93
#: Vectors that the codebooks are fitted to at least, in the order of a hash; every vector is indexed.
SAMPLE = 8192
#: Vectors to a cell on average, and sample vectors to a centre at least.
PER_CELL, PER_CENTRE = 200, 16
#: Vector lengths that get codebooks, the most frequent; vectors of any other length share one cell a length.
LENGTHS = 1000


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x, from a fixed start; many centres are found in two levels, within coarse ones."""
    if k > 128:
        coarse = k_means(x, int(k**0.5), rounds)
        near = nearest(x, coarse)
        parts = [x[near == c] for c in range(len(coarse))]
        return np.vstack([k_means(part, max(1, round(k * len(part) / len(x))), rounds) for part in parts if len(part)])
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row, a few rows at a time."""
    step = max(1, 4_000_000 // len(centres))
    return np.concatenate([distances(x[i : i + step], centres).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def closest(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k smallest of each row, smallest first; of equal ones the first."""
    if 4 * k < d.shape[1]:
        some = np.sort(np.argpartition(d, k, 1)[:, :k], 1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), 1, kind="stable"), 1)
    return np.argsort(d, 1, kind="stable")[:, :k]


class Grid:
    """The product grid of a codebook for each half of unit vectors, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [k_means(sample[:, : self.half], k), k_means(sample[:, self.half :], k)]
        self.sizes = [len(b) for b in self.books]
        self.visits = self.calibrated(sample, cosine, recall)

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The `visits` nearest cells of each row, nearest first.

        Multi-sequence order: cells by the sum of their two distances. The cell of ranks (i, j) comes behind the
        (i + 1) * (j + 1) - 1 cells it dominates, so only ranks with (i + 1) * (j + 1) <= visits can be among them.
        """
        d = [distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])]
        order = [closest(y, min(visits, y.shape[1])) for y in d]
        d = [np.take_along_axis(y, o, 1) for y, o in zip(d, order, strict=True)]
        pairs = [(i, j) for i in range(order[0].shape[1]) for j in range(min(order[1].shape[1], visits // (i + 1)))]
        i, j = np.array(pairs).T
        best = np.argsort(d[0][:, i] + d[1][:, j], 1, kind="stable")[:, :visits]
        return np.take_along_axis(order[0], i[best], 1) * self.sizes[1] + np.take_along_axis(order[1], j[best], 1)

    def home_and_visits(self, x: np.ndarray) -> np.ndarray:
        """traverse() with the calibrated number of visits, a few rows at a time."""
        step = max(1, 4_000_000 // max(self.sizes))
        return np.vstack([self.traverse(x[i : i + step], self.visits) for i in range(0, len(x), step)])

    def calibrated(self, sample: np.ndarray, cosine: float, recall: float) -> int:
        """The fewest visits that bring together that share of pairs whose cosine is just the threshold.

        The pairs are sample vectors and copies turned away in random directions by the threshold's angle; a pair
        meets when either visits the other's cell.
        """
        rng = np.random.default_rng(6)
        x = sample[rng.choice(len(sample), min(1000, len(sample)), replace=False)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1)[:, None] * x
        length = np.linalg.norm(away, axis=1)
        x, away = x[length > 0], away[length > 0] / length[length > 0, None]
        if not len(x):
            return 1
        y = cosine * x + np.sqrt(1 - cosine * cosine) * away
        most, cells_ = 64, self.sizes[0] * self.sizes[1]
        while True:
            cx, cy = self.traverse(x, min(most, cells_)), self.traverse(y, min(most, cells_))
            a, b = cx == cy[:, :1], cy == cx[:, :1]
            need = 1 + np.minimum(np.where(a.any(1), a.argmax(1), cells_), np.where(b.any(1), b.argmax(1), cells_))
            found = int(np.quantile(need, recall, method="higher"))
            if found <= most or most >= cells_:
                return min(found, cells_)
            most *= 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # so that neither huge nor tiny components leave the range of squares
    return x / np.linalg.norm(x, axis=1)[:, None]


def cells(shared: Broadcast):
    """Rows with the cells to visit, home first. shared: the grid of each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = shared.value
        for b in batches:
            for dim in set(b.column("dim").to_pylist()):
                rows = b.filter(pa.array([x == dim for x in b.column("dim").to_pylist()]))
                n = rows.num_rows
                if (grid := grids.get(dim)) is None:  # no vector of this length in the sample: one cell
                    visits = np.zeros((n, 1), np.int64)
                else:
                    visits = grid.home_and_visits(unit(np.array(rows.column("embedding").to_pylist())))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * visits.shape[1]).astype(np.int32)), pa.array(visits.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "visits"])

    return run


def verify(cosine: float):
    """Links in one call: pairs of two homes, and of a home and a visitor, each pair of vectors once in all calls."""

    def run(t: pa.Table) -> pa.Table:
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        rep, size, blk, group = (t[c].to_numpy() for c in ("rep", "size", "blk", "code"))
        visiting, cell = t["cell"].to_numpy(), t["home"].to_numpy()
        found = []
        order = np.argsort(group, kind="stable")
        for who in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            own = cell[who] == visiting[who]
            if len(who) < 2 or not own.any():
                continue
            x = unit(np.array(t["embedding"].take(pa.array(who)).to_pylist()))
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if (across := comparable(blk[who], lo, hi)) is not None:
                linked &= across
            linked &= own[:, None] | own[None, :]
            # a visitor meets a home here; where the home visits the visitor's cell too, the smaller id's visit counts
            i, j = np.nonzero(linked & ~own[:, None])
            if len(i):
                visits = np.array(t["visits"].take(pa.array(who)).to_pylist())
                twice = np.zeros(len(i), bool)
                for k in range(visits.shape[1]):
                    twice |= visits[j, k] == cell[who][i]
                gone = twice & (rep[who][i] > rep[who][j])
                linked[i[gone], j[gone]] = linked[j[gone], i[gone]] = False
            found.append(forest(linked, rep[who], size[who]))
        ids, roots, links = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return pa.table({"rep": ids.astype(np.int64), "root": roots.astype(np.int64), "links": links.astype(np.int64)})

    return run


def near_dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of equal label and length link when their cosine, in double precision, is `cosine` or more. A null label,
    and a vector that is null, empty, zero or holds null or non-finite components, links with nothing. Equal vectors
    of one label are one representative with a size. Codebooks have sqrt(n / PER_CELL) centres a half for n different
    vectors, so cells stay as small whatever n is; they are fitted to `sample` vectors or PER_CENTRE to a centre, if that
    is more, in the order of a hash. All vectors are indexed, each in its home cell, and each visits as many cells as
    `recall` needs. Cells of any size are dealt as pairs of blocks. Different vectors are nodes of their own whatever their
    vec_ids, so null and repeated ids join nothing; component_id is the smallest id of a component, null only where none
    of its rows has one: then the rows of one of its vectors are kept. Other columns are not read. An empty table gives
    an empty result.
    """
    number = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fit", F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    v = v.withColumn("f1", F.xxhash64("embedding")).withColumn("f2", F.xxhash64(F.lit("second"), "embedding"))
    good = v.filter("fit")
    reps = good.groupBy("label", "f1", "f2").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    reps = cut(reps.withColumn("dim", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    lengths = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    grids, spark = {}, vectors.sparkSession
    wanted = {dim: (int(max(4, (n / PER_CELL) ** 0.5)), n) for dim, n in lengths.items() if dim > 1}
    if wanted:
        total = sum(n for _, n in wanted.values())
        shares = [(dim, min(1.0, max(256, PER_CENTRE * k, sample * n // total) / n)) for dim, (k, n) in wanted.items()]
        bounds = spark.createDataFrame([(dim, min(2**63 - 1, int(share * 2.0**64) - 2**63)) for dim, share in shares], "dim int, bound long")
        picked = reps.join(F.broadcast(bounds), "dim").filter(F.xxhash64("label", "f1", "f2") <= F.col("bound"))
        seen: dict[int, list] = {}
        for r in picked.select("dim", "embedding", "label", "f1", "f2").collect():
            seen.setdefault(r["dim"], []).append((r["label"], r["f1"], r["f2"], r["embedding"]))
        grids = {dim: Grid(unit(np.array([x[-1] for x in sorted(rows)])), wanted[dim][0], cosine, recall) for dim, rows in seen.items()}
    shared = spark.sparkContext.broadcast(grids)
    placed = reps.select("label", "embedding", "rep", "size", "dim").mapInArrow(lean(cells(shared)), f"label string, embedding array<{number}>, rep long, size long, dim int, visits array<long>")
    placed = cut(placed, "placed").withColumn("home", F.element_at("visits", 1)).withColumn("cell", F.explode("visits"))
    placed = placed.withColumn("code", F.xxhash64("label", "dim", "cell")).withColumn("w", F.col("dim").cast("long"))
    dealt = deal(placed, ["label", "dim", "cell"], "rep", "w", 1024, 1_000_000, 1 + sum(lengths.values()) // 2000)
    found = cut(dealt.drop("label", "w").groupBy("task", "lo", "hi").applyInArrow(verify(cosine), LINKS), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.filter("rep <> root"), "rep", "root").select(F.col("id").alias("rep"), F.col("label").alias("root"))
    named = roots.join(reps.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("component"))
    roots = roots.join(named, "root")
    classes = reps.select("label", "f1", "f2", "rep", "first", "size").join(links, "rep", "left").join(roots, "rep", "left")
    component = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component"))
    main = component.isNotNull() | F.col("root").isNull() | (F.col("root") == F.col("rep"))
    classes = classes.select("label", "f1", "f2", component.alias("component_id"), main.alias("main"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    known = good.select("vec_id", "label", "f1", "f2").join(classes, ["label", "f1", "f2"]).select("vec_id", "n_links", "component_id", "main")
    alone = v.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("main"))
    return known.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("main")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


#: All pairs; equals the query as long as the index misses none, which recall tests watch.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON a = id
"""
