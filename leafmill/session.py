"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leafmill", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local work; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")
    )
    if not os.environ.get("SPARK_MASTER_URL"):
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        )
    return builder.getOrCreate()


_LOCAL_ROOT: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    local master, as in tests, gets one temporary folder per process; any other is
    refused, as its executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = _LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back.

    For an expensive result that several later steps read: each step then scans
    only the columns it needs instead of computing the result again, and a lost
    executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
