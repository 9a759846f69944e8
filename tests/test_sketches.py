from collections import Counter

from corvine.operators import sketches as S


def zipf(n, seed):
    import random

    r = random.Random(seed)
    return [f"v{int(1 / max(r.random(), 1e-4))}" for _ in range(n)]


def test_registers_merge_to_those_of_one_pass(spark):
    rows = [(f"x{i % 3000}", None if i % 7 else "") for i in range(6000)]
    d = spark.createDataFrame(rows, "a string, b string")
    whole = S.registers(S.values(d, ["a", "b"]))
    halves = [S.registers(S.values(spark.createDataFrame(rows[at : at + 2500], d.schema), ["a", "b"])) for at in (0, 2500, 5000)]
    merged = halves[0].unionByName(halves[1]).unionByName(halves[2]).unionByName(halves[0])
    assert S.distinct(merged).collect() == S.distinct(whole).collect()
    ((facet, n),) = S.distinct(whole).collect()
    assert facet == "a" and abs(n - 3000) < 3000 * 0.05


def test_counters_stay_within_their_error(spark, tmp_path):
    path, most, batches = f"file://{tmp_path}/s", 40, [zipf(4000, s) for s in range(3)]
    frames = [spark.createDataFrame([(v,) for v in b], "f string") for b in batches]
    for k in (0, 1, 2, 1):  # a batch that comes again changes nothing
        S.add(frames[k], path, k, ["f"], most)
    true = Counter(v for b in batches for v in b)
    s = S.reduced(S.stored(spark, path, "counters"), most)
    (error,) = [r.error for r in s.collect() if r.value is None]
    assert 0 < error <= sum(true.values()) / most
    got = {r.value: r.n for r in s.collect() if r.value is not None}
    assert len(got) <= most and all(n <= true[v] <= n + error for v, n in got.items())
    assert all(n <= error for v, n in true.items() if v not in got)
    top = S.vocabulary(spark, path, 5).collect()
    assert all(r.least <= true[r.value] <= r.greatest for r in top)
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))
    certain = [r.value for r in top if r.certain]
    assert set(certain) <= {v for v, _ in want[:5]} and certain
    everything = frames[0].union(frames[1]).union(frames[2])
    for k in (3, 10, 200):
        exact = S.recounted(S.stored(spark, path, "counters"), everything, ["f"], k).collect()
        assert sorted(((r.value, r.n) for r in exact), key=lambda x: (-x[1], x[0])) == want[:k]


def test_lists_nulls_and_empty_tables(spark, tmp_path):
    d = spark.createDataFrame([(["a", "b", None, ""], "x"), (None, "x"), (["a"], None)], "l array<string>, `s.t` string")
    got = {(r.facet, r.value): (r.least, r.certain) for r in S.frequent(S.counted(S.values(d, ["l", "s.t"])), 9).collect()}
    assert got == {("l", "a"): (2, True), ("l", "b"): (1, True), ("s.t", "x"): (2, True)}
    none = d.limit(0)
    S.add(none, f"file://{tmp_path}/s", 0, ["l"])
    assert S.vocabulary(spark, f"file://{tmp_path}/s").count() == S.cardinality(spark, f"file://{tmp_path}/s").count() == 0
