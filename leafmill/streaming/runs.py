"""Run events: append-only log, running state per run, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.schemas import RUN_EVENTS
from leafmill.streaming import state
from leafmill.streaming.state import Fields


def run_fields(events: DataFrame) -> Fields:
    """What an event can change: stage and progress where given, and how the run ended."""
    moved = F.col("stage").isNotNull() | F.col("progress").isNotNull()
    failed, ended = F.col("type") == "agent_failed", F.col("type").isin("agent_completed", "agent_failed")
    summary = F.col("summary") if "summary" in events.columns else F.lit(None).cast("string")
    end = F.struct(
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(~failed, summary).alias("summary"),
        F.when(failed, F.col("message")).alias("error"),
    )
    return {
        "stage": (F.col("stage"), F.col("stage").isNotNull()),
        "progress": (F.col("progress"), F.col("progress").isNotNull()),
        "updated_at": (F.col("created_at"), moved | ended),
        "end": (end, ended),
        "last_id": (F.col("id"), F.lit(True)),
    }


def partial_runs(events: DataFrame) -> DataFrame:
    return state.folded(events, "run_id", "id", run_fields(events))


def _shown(runs: DataFrame) -> DataFrame:
    status = F.coalesce("end.status", F.lit("running")).alias("status")
    return runs.select("run_id", "stage", "progress", "updated_at", status, "end.summary", "end.error", "last_id")


def fold_run_events(events: DataFrame) -> DataFrame:
    """State of each run after its events, in the order of their ids.

    The last event that ends a run gives its status, summary and error (an error's text is
    the event's message); ``summary`` is an optional column of JSON text.
    """
    return _shown(state.values(partial_runs(events), "run_id"))


def current_runs(runs: DataFrame, folded: DataFrame) -> DataFrame:
    """Stored runs with their folded state; a run without events keeps its own columns.

    ``runs`` has run_id, status, stage, progress, updated_at; a new run starts as
    running, queued, 0.
    """
    fields = ["status", "stage", "progress", "updated_at", *(c for c in ("summary", "error") if c in runs.columns)]
    f = folded.select("run_id", *[F.col(c).alias(f"f_{c}") for c in fields])
    out = runs.join(f, "run_id", "left")
    return out.withColumns({c: F.coalesce(f"f_{c}", c) for c in fields}).drop(*[f"f_{c}" for c in fields])


def event_append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the Parquet log."""
    return (
        events.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def event_history(events: DataFrame, run_id: str | None = None) -> DataFrame:
    """Past events of one run (or all), each run's in the order of their ids.

    Runs are not ordered among each other, so nothing is sorted beyond one run.
    """
    rows = events if run_id is None else events.filter(F.col("run_id") == run_id)
    return rows.repartition("run_id").sortWithinPartitions("run_id", "id")


def replay_and_follow(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """One run's events up to now, and a stream of those behind them.

    The last id seen parts the two, so no event is lost or comes twice, whenever it is
    written; a run's ids grow with time.
    """
    mine = F.col("run_id") == run_id
    seen = spark.read.schema(RUN_EVENTS).parquet(path).where(mine)
    last = seen.agg(F.max("id")).first()[0]
    last = -1 if last is None else last
    return event_history(seen.where(F.col("id") <= last)), event_tail(spark, path).where(mine & (F.col("id") > last))


def event_tail(spark: SparkSession, path: str) -> DataFrame:
    """New events of the log as they arrive."""
    return spark.readStream.schema(RUN_EVENTS).parquet(path)


def stream_run_state(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the folded state of every run; read it with ``run_states``."""
    return state.append_states(events, partial_runs, path, checkpoint)


def run_states(spark: SparkSession, path: str, runs: DataFrame | None = None) -> DataFrame:
    """State of every streamed run, or of those in ``runs`` (run_id)."""
    return _shown(state.current(spark, path, "run_id", runs))
