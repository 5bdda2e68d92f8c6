"""Window status updates as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.windows import chunk_summary
from leafmill.streaming import state


def latest_status(updates: DataFrame) -> DataFrame:
    """Partial states of windows: the last status by seq; ``chunk_key`` names the window."""
    keyed = updates.withColumn("chunk_key", F.concat_ws("#", "document_id", "chunk_ord"))
    fields = {c: (F.col(c), F.lit(True)) for c in ("document_id", "chunk_ord", "status")}
    return state.folded(keyed, "chunk_key", "seq", fields)


def stream_chunk_progress(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return state.append_states(updates, latest_status, path, checkpoint)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Chunk summary over the streamed state."""
    return chunk_summary(state.current(spark, path, "chunk_key"))
