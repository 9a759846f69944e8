"""Packing of one ordered list against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import runs


def plain(sizes, most, close):
    out, number, held, some = [], 0, 0, False
    for n in sizes:
        n = n or 0
        if not close and some and held + n > most:
            number, held = number + 1, 0
        out.append(number)
        held, some = held + n, True
        if close and held >= most:
            number, held = number + 1, 0
    return out


@pytest.mark.parametrize("close", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_the_plain_loop(spark, seed, close):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 2, 3, 9, 30, None]) if seed else r.randrange(4) for _ in range(150)]
    d = spark.createDataFrame([(f"{i:04d}", n, i) for i, n in enumerate(sizes)], "k string, n int, bin_before int").repartition(5)
    got = runs.packed(d, ["k"], "n", 10, close).orderBy("k").collect()
    assert [x.bin for x in got] == plain(sizes, 10, close) and got[3].bin_before == 3


def test_one_and_none(spark):
    d = spark.createDataFrame([("a", 50)], "k string, n int")
    for close in (False, True):
        assert [x.bin for x in runs.packed(d, ["k"], "n", 10, close).collect()] == [0]
        assert runs.packed(d.limit(0), ["k"], "n", 10, close).collect() == []


def test_running_sums_over_partitions(spark):
    d = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("x"))
    got = runs.running(d, [F.col("x")], one=F.lit(1), total=F.col("x")).orderBy("x").collect()
    assert [(r.one, r.total) for r in got] == [(i + 1, i * (i + 1) // 2) for i in range(500)]


@pytest.mark.parametrize("close", [False, True])
def test_ways_through_many_blocks(spark, close, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 7)
    followed = []
    monkeypatch.setattr(runs, "written", lambda df, name, f=runs.written: followed.append((name, out := f(df, name))) or out)
    r = random.Random(5)
    sizes = [r.choice([0, 1, 2, 3, 9, 30, None]) for _ in range(150)]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k int, n int").repartition(5)
    assert [x.bin for x in runs.packed(d, ["k"], "n", 10, close).orderBy("k").collect()] == plain(sizes, 10, close)
    assert max(t.count() for name, t in followed if name == "jumps") < 75  # the rounds join entries of blocks, not items
