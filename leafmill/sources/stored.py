"""Stored tables: scans with JSON defaults, and bucketed rewrite sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import scratch_path

BUCKETS = 64


def json_or_default(c: Column, schema: str | T.DataType | None = None, default: str = "{}") -> Column:
    """Decode JSON text; bad or empty text gives the default instead of an error."""
    parsed = F.coalesce(F.try_parse_json(c), F.parse_json(F.lit(default)))
    if schema is None:
        return parsed
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return F.coalesce(F.try_variant_get(parsed, "$", ddl), F.from_json(F.lit(default), ddl))


def stored_table_scan(df: DataFrame, json_columns: dict[str, tuple[str | T.DataType | None, str]]) -> DataFrame:
    """Rows with their JSON text columns decoded, in one projection."""
    return df.withColumns({c: json_or_default(F.col(c), schema, default) for c, (schema, default) in json_columns.items()})


def with_bucket(df: DataFrame, key: str = "document_id", buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_bucketed(
    df: DataFrame, path: str, key: str = "document_id", sort: Sequence[str] = (), buckets: int = BUCKETS
) -> None:
    """Overwrite just the buckets present in ``df``.

    One directory per hash bucket, not per document, keeps the file count in
    check for millions of documents; the rebalance hint lets AQE split a bucket
    that holds one very large document over several tasks and files.
    """
    out = with_bucket(df, key, buckets).hint("rebalance", "bucket")
    out = out.sortWithinPartitions("bucket", key, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def buckets_of(df: DataFrame, key: str = "document_id", buckets: int = BUCKETS) -> list[int]:
    """The buckets that rows of ``df`` fall into: at most ``buckets`` integers."""
    return [r.bucket for r in with_bucket(df.select(key), key, buckets).select("bucket").distinct().collect()]


def touched(current: DataFrame, changed: DataFrame, key: str = "document_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``current`` lying in the buckets that ``changed`` writes to.

    The bucket numbers are literals of a filter on the partition column, so other
    buckets' folders are not read.
    """
    return current.filter(F.col("bucket").isin(buckets_of(changed, key, buckets)))


def replace_rows(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    documents: DataFrame | None = None,
    key: str = "document_id",
    sort: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> None:
    """Each document's rows are replaced by its rows in ``new``; others are kept.

    ``documents`` names the replaced documents where some may have no new rows.
    Rows of other documents in the touched buckets are written back alongside.
    ``new`` is computed once, into the shared folder.
    """
    once = scratch_path(spark, "rewrite")
    new.write.parquet(once)
    new = spark.read.schema(new.schema).parquet(once)
    current = read_bucketed(spark, path)
    replaced = (new if documents is None else documents).select(key).distinct()
    kept = touched(current, replaced, key, buckets).join(replaced, key, "left_anti").drop("bucket")
    merged = kept.unionByName(new)
    emptied: set[int] = set()  # buckets whose every row goes
    if documents is not None:
        emptied = set(buckets_of(replaced, key, buckets)) - set(buckets_of(merged, key, buckets))
    write_bucketed(merged, path, key, sort, buckets)
    for folder in [once, *(f"{path}/bucket={b}" for b in sorted(emptied))]:
        _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
