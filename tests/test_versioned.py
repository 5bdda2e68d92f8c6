"""Rewrites by key: commits, deletions, compaction, and rewrites that die."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import catalogue as C
from leafmill.operators import html_tables as H
from leafmill.sources import versioned as V


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, tmp_path, data, schema="d string, n int, t string", key=("d",), buckets=4):
    return V.create(spark.createDataFrame(data, schema), str(tmp_path / "t"), key, buckets)


def test_commits_replace_and_delete(spark, tmp_path):
    t = table(spark, tmp_path, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "w"), (None, 1, "n")])
    make = lambda data: spark.createDataFrame(data, "d string, n int, t string")
    V.commit(spark, t, make([("a", 9, "new"), (None, 2, "m")]))
    V.commit(spark, t, make([("e", 1, "v")]), replaced=make([("b", 0, "")]).select("d"))
    V.commit(spark, t, replaced=make([("e", 0, "")]).select("d"))
    want = [("a", 9, "new"), ("c", 1, "w"), (None, 2, "m")]
    assert rows(V.read(spark, t)) == sorted(want, key=repr)
    assert rows(V.read(spark, V.open_table(spark, t.path), make([("a", 0, ""), ("b", 0, "")]).select("d"))) == [("a", 9, "new")]
    assert V.compact(spark, t) == 5 and V.compact(spark, t) == 5
    assert rows(V.read(spark, t)) == sorted(want, key=repr)
    V.commit(spark, t, make([("c", 2, "again")]))
    assert V.compact(spark, t) == 7 and len(rows(V.read(spark, t))) == 3
    left = sorted(p.name for p in (tmp_path / "t" / "commits").iterdir() if p.suffix == ".json")
    assert left == ["5-base.json", "6-change.json", "7-base.json"]


def test_a_rewrite_that_dies_leaves_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path, [("a", 1, "x"), ("b", 1, "y")])
    bad = spark.createDataFrame([("a", 5, "half"), ("b", 0, "boom")], "d string, n int, t string")
    bad = bad.withColumn("t", F.when(F.col("n") == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        V.commit(spark, t, bad)
    # One that wrote its rows and keys, but died before its manifest.
    for kind, data, schema in (("rows", [("a", 7, "never", 0)], "d string, n int, t string, bucket int"), ("keys", [("a", 0)], "d string, bucket int")):
        spark.createDataFrame(data, schema).write.mode("overwrite").partitionBy("bucket").parquet(f"{t.path}/{kind}/commit=2")
    assert rows(V.read(spark, t)) == [("a", 1, "x"), ("b", 1, "y")]
    assert V.commit(spark, t, spark.createDataFrame([("b", 2, "z")], "d string, n int, t string")) == 2
    assert rows(V.read(spark, t)) == [("a", 1, "x"), ("b", 2, "z")]


def test_of_two_commits_at_once_one_fails(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, [("a", 1, "x")])
    new = spark.createDataFrame([("a", 2, "y")], "d string, n int, t string")
    seen = V._commits(spark, t)
    V.commit(spark, t, new)
    monkeypatch.setattr(V, "_commits", lambda *a: seen)
    with pytest.raises(Exception, match="(?i)exist"):
        V.commit(spark, t, new)


def test_reading_keys_prunes_buckets(spark, tmp_path):
    t = table(spark, tmp_path, [(str(i), i, "x") for i in range(100)], buckets=8)
    one = V.read(spark, t, spark.createDataFrame([("7",)], "d string"))
    assert rows(one) == [("7", 7, "x")]
    assert "bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_stored_catalogue(spark, tmp_path):
    docs = spark.createDataFrame([("a", "new", "e"), ("b", "new", "e")], "id string, parse_status string, parse_error string").withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    t = V.create(docs, str(tmp_path / "docs"), ["id"], 4)
    patches = spark.createDataFrame([("b", "done", True), ("zz", "done", True)], "id string, parse_status string, clear_error boolean")
    C.patch_documents(spark, t, patches, F.timestamp_seconds(F.lit(9)))
    assert [(r.id, r.parse_status, r.parse_error) for r in V.read(spark, t).orderBy("id").collect()] == [("a", "new", "e"), ("b", "done", None)]
    runs = V.create(spark.createDataFrame([("r1", "a"), ("r2", "b")], "run_id string, document_id string"), str(tmp_path / "runs"), ["document_id"], 4)
    events = V.create(spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r1")], "id int, run_id string"), str(tmp_path / "events"), ["run_id"], 4)
    tables = {"documents": t, "runs": runs, "run_events": events}
    for _ in range(2):  # a repeat changes nothing
        C.delete_documents(spark, tables, spark.createDataFrame([("a",), ("none",)], "document_id string"))
    assert [rows(V.read(spark, x).select(x.key[0])) for x in (t, runs, events)] == [[("b",)], [("b",)], [("r2",)]]


def test_table_records_are_saved_by_key(spark, tmp_path):
    kind = "id string, document_id string, table_id string, payload string, provenance string, validation string, review_status string"
    at = lambda df, c, s: df.withColumn(c, F.timestamp_seconds(F.lit(s)))
    old = at(at(spark.createDataFrame([("1", "d", "t1", "p", "v", "q", "approved"), ("2", "d", "t2", "p", "v", "q", "edited")], kind), "created_at", 1), "updated_at", 1)
    t = V.create(old, str(tmp_path / "t"), ["document_id", "table_id"], 4)
    new = at(spark.createDataFrame([("9", "d", "t2", "P", "V", "Q", None), ("8", "e", "t1", "P", "V", "Q", "approved")], kind), "saved_at", 5)
    H.save_table_records(spark, t, new)
    got = V.read(spark, t).select("id", "document_id", "table_id", "payload", "review_status", F.unix_seconds("created_at"), F.unix_seconds("updated_at"))
    assert rows(got) == [("1", "d", "t1", "p", "approved", 1, 1), ("2", "d", "t2", "P", "pending", 1, 5), ("8", "e", "t1", "P", "approved", 5, 5)]
