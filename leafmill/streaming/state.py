"""State of many keys, folded from streams without a state store.

A state row holds, for each field, the value and the sequence number of the last row that
gave it. Numbers come from the data, so rows merge in any order and any number of times:
late rows, replays, new checkpoints and a clock set back change nothing. Each micro-batch
writes the partial states of its own rows, in a folder that a replay overwrites. From time
to time ``compact`` folds the folders written so far into a new snapshot, laid out in
buckets of the key; a reader takes the newest finished snapshot and the folders behind it.
A compaction that dies leaves no manifest, so its snapshot is never read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
# By field: its value, and whether a row gives it.
Fields = dict[str, tuple[Column, Column]]


def folded(rows: DataFrame, key: str, seq: str, fields: Fields) -> DataFrame:
    """Per key and field struct<seq, value> of the last row that gives it, else null."""

    def last(name: str, value: Column, given: Column) -> Column:
        at = F.when(F.coalesce(given, F.lit(False)), F.col(seq))
        return F.max_by(F.struct(F.col(seq).alias("seq"), value.alias("value")), at).alias(name)

    return rows.groupBy(key).agg(*[last(n, v, g) for n, (v, g) in fields.items()])


def merged(states: DataFrame, key: str) -> DataFrame:
    """One state per key out of several."""
    fields = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(*[F.max_by(c, F.col(c)["seq"]).alias(c) for c in fields])


def values(states: DataFrame, key: str) -> DataFrame:
    """The states' values, without sequence numbers."""
    return states.select(key, *[F.col(c)["value"].alias(c) for c in states.columns if c != key])


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the query that owns a checkpoint, as Spark wrote it there."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id


def batch_folder(spark: SparkSession, path: str, checkpoint: str, batch_id: int) -> str:
    """Where one micro-batch of one query writes.

    A replayed batch overwrites its own folder, so a retry changes nothing; a query
    with a new checkpoint counts its batches anew and has folders of its own.
    """
    return f"{path}/query_id={query_id(spark, checkpoint)}/batch_id={batch_id}"


def append_states(rows: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write the partial states of each micro-batch; ``fold`` makes them of its rows."""

    def save(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(batch_folder(batch.sparkSession, f"{path}/tail", checkpoint, batch_id))

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _found(spark: SparkSession, pattern: str) -> list[str]:
    fs, target = _fs(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(target) or [])


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """(version, last batch covered of each query) of the newest finished snapshot; version 0 where there is none."""
    names = [p.rsplit("/", 1)[1] for p in _found(spark, f"{path}/manifest/*.json")]
    version = max((int(n[:-5]) for n in names), default=0)
    if not version:
        return 0, {}
    text = spark.read.schema("value string").text(f"{path}/manifest/{version}.json", wholetext=True).first().value
    return version, json.loads(text)


def _tail(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(query, batch, folder) of every finished micro-batch."""
    out = []
    for done in _found(spark, f"{path}/tail/query_id=*/batch_id=*/_SUCCESS"):
        folder = done.rsplit("/", 1)[0]
        query, batch = (p.split("=", 1)[1] for p in folder.split("/")[-2:])
        out.append((query, int(batch), folder))
    return out


def stored_states(spark: SparkSession, path: str, key: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """States of the newest snapshot and of the batches behind it, not merged yet.

    ``keys`` names the wanted ones: of the snapshot only their buckets' folders are read.
    """
    version, covered = _manifest(spark, path)
    behind = [folder for query, batch, folder in _tail(spark, path) if batch > covered.get(query, -1)]
    parts = []
    if version:
        snapshot = spark.read.parquet(f"{path}/snapshot/version={version}")
        if keys is not None:
            wanted = keys.select(_bucket(key, buckets).alias("b")).distinct()
            snapshot = snapshot.where(F.col("bucket").isin([r.b for r in wanted.collect()]))  # at most as many as buckets
        parts.append(snapshot.drop("bucket"))
    if behind:
        parts.append(spark.read.parquet(*behind))
    if not parts:
        raise FileNotFoundError(f"no state under {path}")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both if keys is None else both.join(keys.select(key).distinct(), key, "left_semi")


def current(spark: SparkSession, path: str, key: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The state of every key, or of the wanted ones, as values."""
    return values(merged(stored_states(spark, path, key, keys, buckets), key), key)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def compact(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Fold finished batches into a new snapshot; gives its version.

    The manifest is created last and only once, so of two compactions one fails. Snapshots
    before the last and the batches they cover are removed; a reader that began before
    still finds its own.
    """
    version, covered = _manifest(spark, path)
    tail = _tail(spark, path)
    behind = [(q, b) for q, b, _ in tail if b > covered.get(q, -1)]
    if not behind:
        return version
    whole = merged(stored_states(spark, path, key), key).withColumn("bucket", _bucket(key, buckets))
    new = f"{path}/snapshot/version={version + 1}"
    whole.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(new)
    now = dict(covered)
    for q, b in behind:
        now[q] = max(b, now.get(q, -1))
    fs, target = _fs(spark, f"{path}/manifest/{version + 1}.json")
    out = fs.create(target, False)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    old = [folder for q, b, folder in tail if b <= covered.get(q, -1)] + [f"{path}/snapshot/version={version - 1}", f"{path}/manifest/{version - 1}.json"]
    for folder in old:
        fs.delete(_fs(spark, folder)[1], True)
    return version + 1
