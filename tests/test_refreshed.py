import json

from pyspark.sql import functions as F

from corvine.operators import facets
from corvine.sources import objects, sinks
from corvine.streaming import incremental as I


def test_copy_in_slices(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    source = spark.createDataFrame([(i, f"v{i}") for i in range(40)] + [(3, "v3x"), (None, "lost")], "id int, v string")
    sinks.write(spark.createDataFrame([(5, "old")], source.schema), path, "id", 8)
    real, calls = sinks._add, []

    def broken(df, path, s):
        calls.append(1)
        if len(calls) == 3:
            raise OSError
        return real(df, path, s)

    monkeypatch.setattr(sinks, "_add", broken)
    try:
        sinks.copy(source, path, "id")
        raise AssertionError
    except OSError:
        pass
    there = sinks.read(spark, path).count()
    monkeypatch.setattr(sinks, "_add", real)
    made = sinks.copy(source, path, "id")
    assert made[:2] == [0, 0] and sum(made) == 40 - there
    assert sum(sinks.copy(source.limit(0), path, "id")) == 0
    assert sinks.copy(source, path, "id") == [0, 0, 0, 0]
    assert sinks.copy(spark.createDataFrame([(99, "new"), (1, "other")], source.schema), path, "id").count(1) == 1
    got = sorted((r.id, r.v) for r in sinks.read(spark, path).collect())
    assert got == sorted([*((i, f"v{i}") for i in range(40) if i not in (3, 5)), (3, "v3x"), (5, "old"), (99, "new")])


def test_sidecars_move_with_their_record(spark):
    renames = spark.createDataFrame([("rec1", "7_$1", "7 $1")], "old string, new string, name string")
    full = {"identifier": "?", "original_s3_key": "raw/t/rec1/cv/a/rec1__normalized.txt", "deep": {"a": [1, None, "x"]}, "n": 1.5, "ok": True}
    rows = [("raw/t/rec1/cv/m.json", json.dumps(full)), ("raw/t/rec1/m.json", '{"original_s3_key": "raw/t/rec12/x", "migrated_from_s3_segment": "a"}'), ("raw/t/rec1/x/m.json", '{"original_s3_key": 5}'), ("raw/t/rec1/bad", "{no"), ("raw/t/rec1/none", None), ("raw/t/rec12/m.json", "{}")]
    got = {r.key: (r.new_key, r.text) for r in objects.sidecars_migrated(spark.createDataFrame(rows, "key string, text string"), renames).collect()}
    own = {"identifier": "7 $1", "migrated_from_s3_segment": "rec1", "migrated_to_s3_segment": "7_$1"}
    assert got["raw/t/rec1/cv/m.json"][0] == "raw/t/7_$1/cv/m.json"
    assert json.loads(got["raw/t/rec1/cv/m.json"][1]) == full | own | {"original_s3_key": "raw/t/7_$1/cv/a/7_$1__normalized.txt"}
    assert json.loads(got["raw/t/rec1/m.json"][1]) == own | {"original_s3_key": "raw/t/rec12/x"}
    assert json.loads(got["raw/t/rec1/x/m.json"][1]) == own | {"original_s3_key": 5}
    assert got["raw/t/rec1/bad"][1] == "{no" and got["raw/t/rec1/none"][1] is None and "raw/t/rec12/m.json" not in got


def test_key_forms(spark):
    rows = [("raw/t/a/a__normalized.txt", "raw/t/b/b__normalized.txt"), ("raw/t/a/c/a__normalized.txt", "raw/t/b/c/b__normalized.txt"), ("raw/t/a/xa__normalized.txt", "raw/t/b/xa__normalized.txt"), ("raw/t/ab/f", None), ("raw/t/a", None), ("a", None), (None, None)]
    d = spark.createDataFrame(rows, "key string, want string").withColumn("got", objects.remapped(F.col("key"), F.lit("a"), F.lit("b")))
    assert all(r.got == r.want for r in d.collect())


def test_facets_of_records_and_keys(spark):
    d = spark.createDataFrame([(["Spain,Latin America", " ", None, "Cities \uff06 X "], "v", None), ([], " ", "x")], "`Practice Area` array<string>, a string, `b.c` string")
    got = [r.f for r in d.select(facets.extracted(d, d.columns).alias("f")).collect()]
    assert got[0] == {"practice_area": ["Spain,Latin America", "Cities & X"], "a": ["v"]} and len(got[1]) == 1
    twice = spark.createDataFrame([("1", "2"), ("1", " ")], "`A b` string, `a  B` string")
    assert [r.f for r in twice.select(facets.extracted(twice, twice.columns).alias("f")).collect()] == [{"a_b": ["2"]}, {"a_b": ["1"]}]
    r = spark.createDataFrame([("k", 2, "late", 1), ("k", 1, None, None), ("k", 3, "x", 2), ("m", 1, " ", None), (" ", 1, "x", 1), (None, 1, "x", 1)], "k string, o int, f string, g int")
    assert [tuple(x) for x in facets.first_per_key(r, "k", "o", ["f", "g"]).collect()] == [("k", "late", 1)]


def test_only_changed_summaries_are_made_anew(spark, tmp_path):
    path, parts = f"file://{tmp_path}/s", [("a", 1, "one"), ("a", 2, "two"), ("a", 2, "two"), ("b", 1, "b"), ("c", 1, " "), (None, 1, "x")]
    d = spark.createDataFrame(parts, "r string, o int, t string")
    I.summaries_refreshed(d, d, path, "r", "o", "t")
    later = spark.createDataFrame([("a", 1, "new"), ("b", 1, "ignored"), ("c", 1, None)], d.schema)
    assert len(I.summaries_refreshed(later, later.filter("r in ('a', 'c')"), path, "r", "o", "t")) == 1
    assert {x.r: (x.n, x.summary) for x in sinks.read(spark, path).collect()} == {"a": (1, "new"), "b": (1, "b")}
