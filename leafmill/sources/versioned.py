"""Tables that are rewritten by key: a commit adds the keys' new rows, readers take the newest.

A commit writes the new rows and the list of keys it sets, in folders of its own by bucket
of the first key column, and then its manifest, which it alone can create. So a rewrite
touches no stored file, one that dies is never read, and of two at once one fails. A
reader takes, for each key, the rows of its newest commit; keys set without rows are
deleted. ``compact`` folds all into a new base. The key, the number of buckets and the
schema are recorded with the table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


@dataclass(frozen=True)
class Table:
    path: str
    key: tuple[str, ...]
    buckets: int
    schema: T.StructType

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key[0]), F.lit(self.buckets)).cast("int").alias("bucket")


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, value: dict) -> None:
    fs, target = _hadoop(spark, path)
    out = fs.create(target, False)  # fails where the file exists
    out.write(bytearray(json.dumps(value).encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("value string").text(path, wholetext=True).first().value)


def open_table(spark: SparkSession, path: str) -> Table:
    meta = _get(spark, f"{path}/table.json")
    return Table(path, tuple(meta["key"]), meta["buckets"], T.StructType.fromJson(meta["schema"]))


def _commits(spark: SparkSession, t: Table) -> tuple[int, int]:
    """(newest base, newest commit)"""
    fs, target = _hadoop(spark, f"{t.path}/commits/*.json")
    names = [s.getPath().getName() for s in fs.globStatus(target) or []]
    bases = [int(n.split("-")[0]) for n in names if n.endswith("-base.json")]
    return max(bases), max(int(n.split("-")[0]) for n in names)


def _write(t: Table, df: DataFrame, kind: str, n: int) -> None:
    laid = df.withColumn("bucket", t.bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", *t.key)
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{t.path}/{kind}/commit={n}")


def _read(spark: SparkSession, t: Table, kind: str, first: int, last: int) -> DataFrame:
    own = t.schema if kind == "rows" else T.StructType([t.schema[k] for k in t.key])
    schema = T.StructType([*own.fields, T.StructField("commit", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{t.path}/{kind}").where(F.col("commit").between(first, last))


def create(df: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> Table:
    """A new table of ``df``'s rows."""
    spark = df.sparkSession
    t = Table(path, tuple(key), buckets, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))
    _put(spark, f"{path}/table.json", {"key": list(key), "buckets": buckets, "schema": t.schema.jsonValue()})
    _write(t, df, "rows", 1)
    _put(spark, f"{path}/commits/1-base.json", {})
    return t


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def read(spark: SparkSession, t: Table, keys: DataFrame | None = None) -> DataFrame:
    """The newest rows of every key, or of those in ``keys`` (by whichever key columns it has).

    With keys, folders of other buckets are not read.
    """
    base, last = _commits(spark, t)
    rows = _read(spark, t, "rows", base, last)
    touched = _read(spark, t, "keys", base + 1, last) if last > base else None
    if keys is not None:
        by = [k for k in t.key if k in keys.columns]
        wanted = keys.select(*by).distinct()
        if t.key[0] in by:
            found = [r.bucket for r in wanted.select(t.bucket()).distinct().collect()]  # at most as many as buckets
            rows = rows.where(F.col("bucket").isin(found))
            touched = None if touched is None else touched.where(F.col("bucket").isin(found))
        renamed = wanted.select(*[F.col(k).alias(f"_{k}") for k in by])
        rows = rows.join(renamed, _same(rows, renamed, by), "left_semi")
    if touched is not None:
        newest = touched.groupBy(*[F.col(k).alias(f"_{k}") for k in t.key]).agg(F.max("commit").alias("_newest"))
        rows = rows.join(newest, _same(rows, newest, t.key), "left").where(F.coalesce("_newest", F.lit(base)) == F.col("commit"))
    return rows.select(*t.schema.fieldNames())


def commit(spark: SparkSession, t: Table, rows: DataFrame | None = None, replaced: DataFrame | None = None) -> int:
    """Sets the keys of ``rows`` to those rows; keys of ``replaced`` that have none there are deleted."""
    _, last = _commits(spark, t)
    n = last + 1
    touched = None if replaced is None else replaced.select(*t.key)
    if rows is not None:
        _write(t, rows.select(*t.schema.fieldNames()), "rows", n)
        own = _read(spark, t, "rows", n, n).select(*t.key)
        touched = own if touched is None else touched.unionByName(own)
    if touched is None:
        return last
    _write(t, touched.distinct(), "keys", n)
    _put(spark, f"{t.path}/commits/{n}-change.json", {})
    return n


def compact(spark: SparkSession, t: Table) -> int:
    """Fold all commits into a new base; what lies before the base before it is removed."""
    base, last = _commits(spark, t)
    if last == base:
        return base
    _write(t, read(spark, t), "rows", last + 1)
    _put(spark, f"{t.path}/commits/{last + 1}-base.json", {})
    for n in range(1, base):
        for old in (f"rows/commit={n}", f"keys/commit={n}", f"commits/{n}-base.json", f"commits/{n}-change.json"):
            fs, target = _hadoop(spark, f"{t.path}/{old}")
            fs.delete(target, True)
    return last + 1
