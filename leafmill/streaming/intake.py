"""Files arriving in a folder, catalogued once per content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources.files import intake_by_hash
from leafmill.streaming.state import batch_folder, query_id

CATALOGUE = (
    "id string, filename string, file_path string, sha256 string, page_count int, bytes bigint, "
    "parse_status string, parse_error string"
)


def watch_folder(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


# Hexadecimal digits of a hash that name its folder.
PREFIX = 2


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    schema = CATALOGUE + ", query_id string, batch_id bigint, prefix string"
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _prefix(sha256: str = "sha256"):
    return F.substring(sha256, 1, PREFIX)


def stream_intake(
    hashed: DataFrame, path: str, checkpoint: str, initial: DataFrame | None = None
) -> StreamingQuery:
    """Append files whose bytes were never seen, however late they come.

    Identity has no expiry, so the catalogue itself is the state: each batch is
    anti-joined with ``initial``, a catalogue kept elsewhere, and with every other
    batch folder under ``path``, those of earlier queries included. Rows lie in folders
    by hash prefix, and a batch reads only those of its own hashes.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = [r.p for r in batch.select(_prefix().alias("p")).distinct().collect()]  # at most 16 ** PREFIX
        known = _others(spark, path, query_id(spark, checkpoint), batch_id).where(F.col("prefix").isin(touched))
        if initial is not None:
            known = known.select("sha256").unionByName(initial.select("sha256"))
        folder = batch_folder(spark, path, checkpoint, batch_id)
        new = intake_by_hash(batch, known).withColumn("prefix", _prefix())
        new.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(folder)
        batch.unpersist()

    return (
        hashed.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _others(spark: SparkSession, path: str, query: str, batch_id: int) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], CATALOGUE + ", prefix string")
    own = (F.col("query_id") == query) & (F.col("batch_id") == batch_id)
    return read_catalogue(spark, path).filter(~own).drop("query_id", "batch_id")
