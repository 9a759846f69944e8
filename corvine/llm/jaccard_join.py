"""Join of documents on the Jaccard similarity of their word n-grams: MinHash bands, then verification on full sets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import NO_ID, bitmap_filter, components, cut, lean, slices, small_batches
from corvine.llm.pairs import LINKS, comparable, deal, forest
from corvine.session import table

WORDS = re.compile(r"\w+")
SIGNED = "doc_id long, n long, f1 long, f2 long, bands array<long>"
GRAM, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 8


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with that probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of hashed word n-grams. Words are runs of word characters, in lower case.

    A text with fewer than n words, but any, has one shingle of all its words; a text without words has none.
    """

    def __init__(self, gram: int = GRAM):
        import xxhash

        class Hashes(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > 150_000:
                    self.clear()
                h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
                return h

        self.gram, self.hashes = gram, Hashes()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All sets one after the other, each sorted and without repeats, and len(texts) + 1 offsets."""
        words = [WORDS.findall(t.lower()) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((h for w in words for h in map(self.hashes.__getitem__, w)), np.uint64, counts.sum())
        g = self.gram
        padded = np.append(flat, np.zeros(g, np.uint64))
        begins = np.cumsum(counts) - counts
        n = np.maximum(counts - g + 1, np.minimum(counts, 1))
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)
        used = np.repeat(np.minimum(counts, g), n)
        h = np.repeat(np.minimum(counts, g).astype(np.uint64), n)
        for k in range(g):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(used > k, padded[at + k], np.uint64(0)))
        ends = np.append(0, np.cumsum(n))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            h[a:b].sort()
        owner = np.repeat(np.arange(len(texts)), n)
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
        return h[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(texts))))


def signatures(flat: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes (sets by bands) of non-empty sets: minima of `bands * rows` hash functions, hashed by band."""
    rng = np.random.default_rng(20)
    folded = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(offsets) - 1, bands), np.uint64)
    for b in range(bands):
        h = np.full(len(out), b + 1, np.uint64)
        for _ in range(rows):
            a, c = rng.integers(0, 2**32, 2, dtype=np.uint32)
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(folded * (a | np.uint32(1)) + c, offsets[:-1]))
        out[:, b] = h
    return out.view(np.int64)


def fingerprints(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints (2 by sets) of shingle sets, 0 for empty ones."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    if len(full):
        for k, salt in enumerate((1, 2)):
            out[k, full] = np.add.reduceat(mix(flat + np.uint64(salt * 0x9E3779B9)), offsets[:-1][full])
    return out.view(np.int64)


def sign(docs: DataFrame, gram: int, bands: int, rows: int) -> DataFrame:
    """Per row: the size and a 128-bit fingerprint of its shingle set, and its band hashes (empty sets: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(gram)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                flat, offsets = shingle(texts[i:j])
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                prints = fingerprints(flat, offsets)
                bits = signatures(flat, np.append(offsets[:-1][full], len(flat)), bands, rows) if len(full) else np.empty((0, bands), np.int64)
                sizes = np.zeros(j - i, np.int32)
                sizes[full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), lists], names=["doc_id", "n", "f1", "f2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), SIGNED)


def overlaps(owner: np.ndarray, shingles: np.ndarray, m: int) -> np.ndarray:
    """Sizes of the intersections of m sets, from all (owner, shingle): m by m.

    Shingles of one set add nothing. Frequent ones are multiplied as dense blocks, the others' pairs are counted.
    """
    order = np.argsort(shingles, kind="stable")
    s, o = shingles[order], owner[order]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    df = np.diff(np.append(heads, len(s)))
    out = np.zeros((m, m), np.float32)
    dense = max(8, m // 16)
    heavy = np.flatnonzero(df >= dense)
    width = max(64, 8_000_000 // m)
    for k in range(0, len(heavy), width):
        part = heavy[k : k + width]
        matrix = np.zeros((m, len(part)), np.float32)
        rows = np.arange(df[part].sum()) - np.repeat(np.cumsum(df[part]) - df[part], df[part]) + np.repeat(heads[part], df[part])
        matrix[o[rows], np.repeat(np.arange(len(part)), df[part])] = 1
        out += matrix @ matrix.T
    for d in np.unique(df[(df > 1) & (df < dense)]):
        runs = heads[df == d]
        step = max(1, 2_000_000 // (d * d))
        for k in range(0, len(runs), step):
            who = o[runs[k : k + step, None] + np.arange(d)]
            out += np.bincount((who[:, :, None] * m + who[:, None, :]).ravel(), minlength=m * m).reshape(m, m)
    return out


def verify(gram: int, num: int, den: int):
    """Links among the members of each group of one call, judged on full sets: overlap / union >= num / den.

    Two members may meet in several groups; a pair counts in the smallest of those only.
    """

    def run(t: pa.Table) -> pa.Table:
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        group, size, blk, node = (t[c].to_numpy() for c in ("group", "size", "blk", "node"))
        flat, ends = unfolded(t["shingles"])
        elsewhere, at = unfolded(t["groups"])
        found = []
        order = np.lexsort((node, group))
        for who in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(who) < 2:
                continue
            n = ends[who + 1] - ends[who]
            both = overlaps(np.repeat(np.arange(len(who)), n), flat[spread(ends[who], n)], len(who))
            linked = both * den >= (n[:, None] + n[None, :] - both) * num
            np.fill_diagonal(linked, False)
            if (across := comparable(blk[who], lo, hi)) is not None:
                linked &= across
            m = at[who + 1] - at[who]
            others = elsewhere[spread(at[who], m)]
            smaller = others < group[who[0]]
            if smaller.any():
                names, which = np.unique(others[smaller], return_inverse=True)
                member = np.zeros((len(who), len(names)), np.float32)
                member[np.repeat(np.arange(len(who)), m)[smaller], which] = 1
                linked &= member @ member.T == 0
            found.append(forest(linked, node[who], size[who]))
        columns = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return pa.table({name: x.astype(np.int64) for name, x in zip(("rep", "root", "links"), columns, strict=True)})

    return run


def unfolded(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists one after the other, and where each list begins, and the last ends."""
    one = lists.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    return one.flatten().to_numpy(), np.append(0, np.cumsum(one.value_lengths().to_numpy()))


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers begins[k] .. begins[k] + counts[k] - 1 of all k, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)


def candidate_groups(banded: DataFrame) -> DataFrame:
    """(node, groups): for each node of banded (node, band) that shares a band, the groups in which it meets others.

    A band's nodes hang on the smallest of them, its root; a root that itself hangs on smaller nodes passes its own on
    to the smallest. So two nodes with a common band have a common group, a tight cluster makes one or a few groups
    instead of one for each band, and no group reaches further than two steps from its root: similar texts that only
    chain along do not gather in one. Rows carry numbers alone, as many for a node as it has bands at most.
    """
    buckets = banded.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("last")).filter("root < last").drop("last")
    met = cut(banded.join(buckets, "band").groupBy("node").agg(F.collect_set("root").alias("roots")), "met")
    up = met.select(F.col("node").alias("root"), F.array_min("roots").alias("group"))
    return met.select("node", F.explode("roots").alias("root")).join(up, "root").groupBy("node").agg(F.sort_array(F.collect_set("group")).alias("groups"))


def jaccard_join(docs: DataFrame, gram: int = GRAM, num: int = 4, den: int = 5, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, kept.

    Two documents link when the Jaccard similarity of their word n-gram sets is num/den or more. n_links counts the
    other documents linked directly, class_id is the smallest doc_id reachable by links and kept marks that document.
    Documents with equal sets are one node with a size and a representative, the smallest doc_id. Nodes that share a
    band hash meet in candidate groups, where every pair is verified once on its full sets, so that of the pairs at the
    threshold a share of `recall` or more is found. Large groups are dealt as pairs of blocks.

    Texts that are null, empty or without words link with nothing. Null stands for one doc_id, the smallest; different
    texts under one doc_id have links and classes of their own; repeated rows count as copies. Columns beside doc_id and
    text are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(sign(d, gram, bands_for(num / den, recall, rows), rows), "signed")
    some = signed.filter("n > 0")
    reps = cut(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.min_by("bands", "doc_id").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "reps")
    groups = candidate_groups(reps.select("node", F.explode("bands").alias("band")))
    active = cut(reps.drop("bands").join(groups, "node"), "active")
    members = active.select("node", "size", "n", "f1", "f2", "groups", F.explode("groups").alias("group"))
    weight = members.agg(F.sum("n")).first()[0] or 0
    dealt = deal(members, ["group"], "node", "n", 1024, 1_000_000, 1 + weight // 400_000)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(gram)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in slices(texts):
                flat, offsets = shingle(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, fingerprints(flat, offsets)), lists], names=["f1", "f2", "shingles"])

    texts = bitmap_filter(d, F.col("doc_id"), active.select("rep"))
    sets = texts.select("text").mapInArrow(lean(shingles), "f1 long, f2 long, shingles array<long>")
    sets = bitmap_filter(sets, F.col("f1"), active.select("f1")).groupBy("f1", "f2").agg(F.first("shingles").alias("shingles"))
    calls = dealt.join(sets, ["f1", "f2"]).groupBy("task", "lo", "hi")
    found = cut(calls.applyInArrow(verify(gram, num, den), LINKS), "links")
    links = found.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("rep <> root"), "rep", "root").select(F.col("id").alias("node"), "label")
    joined = cut(reps.drop("bands", "n").join(links, "node", "left").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "classes")
    # classes are numbered by node; the smallest doc_id of one names it
    named = joined.filter("links > 0").groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = joined.join(named, "label", "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    classes = classes.select("f1", "f2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2").join(classes, ["f1", "f2"], "left")
    own = F.coalesce("class_id", "doc_id")
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("doc_id")).alias("doc_id"), back(own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("doc_id") == own).alias("kept"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: All pairs by shared shingles.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS doc_id, class_id, coalesce(n, 0) AS n_links, id = class_id AS kept FROM c LEFT JOIN n ON a = id
"""
