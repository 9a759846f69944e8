"""The stored vector index against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.session import scratch
from corvine.sources import vectors

N, DIM = 900, 16


def data():
    r = np.random.default_rng(2)
    heart = r.normal(size=(12, DIM))
    return heart[r.integers(0, 12, N)] + 0.6 * r.normal(size=(N, DIM))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(data())]
    rows += [(9001, None, 1), (9002, [0.0] * DIM, 1), (9003, [float("nan")] + [1.0] * (DIM - 1), 1), (9004, [1.0], 1), (None, [1.0] * DIM, 1), (9005, [1.0, None] * (DIM // 2), 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.fixture(scope="module")
def index(spark, table):
    path = scratch(spark, "vectors")
    vectors.create(table, path, cells=24, parts=4, codes=64)
    assert vectors.add(table.filter("vec_id % 2 = 0"), path) == 0
    assert vectors.add(table.filter("vec_id % 2 = 1 OR vec_id IS NULL"), path) == 1
    i = vectors.Index(spark, path)
    i.calibrate(asked(table, 7))
    return i


def asked(table, rest):
    return vectors.units(table.filter(f"vec_id % 50 = {rest} AND vec_id < 9000"), DIM).select(F.col("vec_id").alias("query_id"), "vector")


def truth(k=10, label=None):
    x = data() / np.linalg.norm(data(), axis=1, keepdims=True)
    s = x[::50] @ x.T
    if label is not None:
        s[:, np.arange(N) % 3 != label] = -2
    return {q * 50: [(int(v), round(float(s[q, v]), 5)) for v in np.argsort(-s[q], kind="stable")[:k]] for q in range(len(s))}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 5)))
    return out


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_all_cells_are_exact(table, index):
    got, want = found(index.search(asked(table, 0), 10, probes=24)), truth()
    assert recall(got, want) == 1.0
    assert all(abs(a[1] - b[1]) < 2e-5 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_recall_of_cells_and_codes(table, index):
    probes, factor = index.settings()
    assert probes < 24 and recall(found(index.search(asked(table, 0), 10)), truth()) >= 0.9
    coded = found(index.search_coded(asked(table, 0), 10))
    assert recall(coded, truth()) >= 0.9
    exact = {(q, v): s for q, w in truth(N).items() for v, s in w}
    assert all(abs(exact[q, v] - s) < 2e-5 for q, w in coded.items() for v, s in w)  # scored again by the vectors


def test_filtered(table, index):
    got = found(index.search(asked(table, 0), 5, probes=24, where=F.col("label") == 1))
    assert recall(got, truth(5, 1)) == 1.0


def test_only_visited_cells_are_read(spark, table, index):
    asked_for, wanted = index._asked(asked(table, 0).limit(1), 3)
    assert len(wanted) == 3
    df = vectors._cells(spark, index.path, "codes", wanted)
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan
    assert df.inputFiles() and all(int(f.split("cell=")[1].split("/")[0]) in wanted for f in df.select("cell").distinct().inputFiles()) or df.count() == sum(index.sizes[c] for c in wanted)
    assert set(df.columns) == {"vec_id", "code", "batch", "cell"} and all(len(r.code) == 4 for r in df.collect())


def test_batches_are_one_index(spark, table, index):
    path = scratch(spark, "vectors")
    for t in ("centres", "codebooks", "settings"):
        spark.read.parquet(f"{index.path}/{t}").write.parquet(f"{path}/{t}")
    vectors.add(table, path)
    whole = vectors.Index(spark, path)
    assert whole.sizes == index.sizes and sum(whole.sizes.values()) == N
    assert found(whole.search(asked(table, 0), 10)) == found(index.search(asked(table, 0), 10))
    assert found(whole.search_coded(asked(table, 0), 10)) == found(index.search_coded(asked(table, 0), 10))


def test_blocks_of_large_cells(spark, table, index, monkeypatch):
    want = found(index.search(asked(table, 0), 10))
    monkeypatch.setattr(vectors, "BLOCK", 5)
    assert found(index.search(asked(table, 0), 10)) == want


def test_working_arrays_are_bounded(spark, table, index, monkeypatch):
    want = truth()
    got = found(index.search_all(asked(table, 0), 10))
    assert recall(got, want) == 1.0 and all(abs(a[1] - b[1]) < 2e-5 for q in want for a, b in zip(got[q], want[q], strict=True))
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 5, (50, 40)).astype(float), rng.permutation(40)
    row, column, place = vectors.best_of(scores, ids, 7)
    plain = [sorted(range(40), key=lambda c: (-scores[r, c], ids[c]))[:7] for r in range(50)]
    assert column.reshape(50, 7).tolist() == plain and row.tolist() == [r for r in range(50) for _ in range(7)] and place.tolist() == list(range(7)) * 50
    x, centres = rng.normal(size=(30, 4)), rng.normal(size=(9, 4))
    whole = vectors.nearest(x, centres)
    monkeypatch.setattr(vectors, "CELLS", 20)
    assert [s.stop - s.start for s in vectors.slabs(7, 9)] == [2, 2, 2, 1] and vectors.nearest(x, centres).tolist() == whole.tolist()
