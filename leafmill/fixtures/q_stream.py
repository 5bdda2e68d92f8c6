"""Queries: the streaming jobs, each run over its whole table with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import views as D
from leafmill.fixtures.registry import query
from leafmill.session import scratch_path
from leafmill.sources.files import hashed_files
from leafmill.streaming import chunks as SC
from leafmill.streaming import intake as SI
from leafmill.streaming import review as SR
from leafmill.streaming import runs as SN
from leafmill.streaming import state


def _stream(spark, sf, name):
    schema = D.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


# Bytes of a table that one file of a dealt stream holds, about.
FILE_BYTES = 64 << 20


def _batches(spark, sf, name, key, n=3):
    """The whole table as a stream of n micro-batches, dealt by a hash of the key: rows come out of order.

    A batch takes as many files as the table's size asks for, so no task writes or reads a
    whole batch; rows with one key lie in one file.
    """
    path = scratch_path(spark, f"{name}-batches")
    t = D.table(spark, sf, name)
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    size = source.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(source).getLength()
    files = 1 + size // (n * FILE_BYTES)
    t.repartition(n * files, F.xxhash64(key)).write.option("maxRecordsPerFile", 0).parquet(path)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", files).parquet(path)


def _paths(spark, label):
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


EVENTS = "SELECT id, run_id, type, stage, progress, message, created_at FROM run_events"


@query("event_append", EVENTS)
def _(spark, sf):
    path, checkpoint = _paths(spark, "events")
    SN.event_append(_stream(spark, sf, "events").selectExpr(*D.RUN_EVENT_COLUMNS), path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query("event_history", EVENTS)
def _(spark, sf):
    return SN.event_history(D.run_events(spark, sf))


ENDS = """
WITH e AS (SELECT id, run_id, stage, progress, message, created_at, CASE WHEN id % 50 = 0 THEN 'agent_completed' WHEN id % 70 = 1 THEN 'agent_failed' ELSE 'agent_progress' END AS type FROM run_events),
f AS (SELECT *, type <> 'agent_progress' AS ended, CASE WHEN type = 'agent_completed' THEN 'completed' WHEN type = 'agent_failed' THEN 'failed' END AS s,
  CASE WHEN type = 'agent_completed' THEN concat('{"count":', id % 9, '}') END AS sum, CASE WHEN type = 'agent_failed' THEN message END AS err FROM e)
SELECT run_id, arg_max(stage, id) FILTER (stage IS NOT NULL) AS stage, arg_max(progress, id) FILTER (progress IS NOT NULL) AS progress,
  arg_max(created_at, id) FILTER (stage IS NOT NULL OR progress IS NOT NULL OR ended) AS updated_at,
  coalesce(arg_max(s, id) FILTER (ended), 'running') AS status, arg_max(coalesce(sum, ''), id) FILTER (ended AND s = 'completed' OR ended AND s = 'failed') AS summary,
  arg_max(coalesce(err, ''), id) FILTER (ended) AS error, max(id) AS last_id
FROM f GROUP BY run_id
"""


@query("stream_run_state", ENDS)
def _(spark, sf):
    """Two streams with checkpoints of their own, a compaction between them, batches out of order."""
    path, checkpoint = _paths(spark, "run-state")
    kind = "case when event_id % 50 = 0 then 'agent_completed' when event_id % 70 = 1 then 'agent_failed' else 'agent_progress' end as type"
    columns = [c for c in D.RUN_EVENT_COLUMNS if not c.endswith("as type")]
    events = _batches(spark, sf, "events", "event_id").selectExpr(*columns, kind, "case when event_id % 50 = 0 then concat('{\"count\":', event_id % 9, '}') end as summary")
    SN.stream_run_state(events.where("id % 4 > 0"), path, checkpoint).awaitTermination()
    state.compact(spark, path, "run_id")
    SN.stream_run_state(events.where("id % 4 = 0"), path, f"{checkpoint}-2").awaitTermination()
    # The last end's summary or error, whichever it has not, reads as the empty text.
    told = [F.when(F.col("status") != "running", F.coalesce(c, F.lit(""))).alias(c) for c in ("summary", "error")]
    return SN.run_states(spark, path).select("run_id", "stage", "progress", "updated_at", "status", *told, "last_id")


@query(
    "stream_review",
    """
WITH p AS (SELECT reaction_id, arg_max(edit_text, seq) FILTER (edit_text IS NOT NULL) AS edit_text, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, max(seq) AS seq FROM review_patches GROUP BY 1)
SELECT r.id, coalesce(p.edit_text, r.reaction_text) AS reaction_text, coalesce(p.status, r.review_status) AS review_status,
  coalesce(1735689600 + p.seq, cast(epoch(cast(r.created_at AS timestamp)) AS bigint)) AS updated_s FROM reactions r LEFT JOIN p ON p.reaction_id = r.id
""",
)
def _(spark, sf):
    path, checkpoint = _paths(spark, "review-state")
    patches = _batches(spark, sf, "labels", "doc_id").selectExpr(*D.PATCH_COLUMNS, "timestamp_seconds(1735689600 + doc_id) as at")
    SR.stream_review(patches, path, checkpoint).awaitTermination()
    out = SR.reviewed(spark, D.reactions(spark, sf), path)
    return out.select("id", F.col("payload.reaction_text").alias("reaction_text"), "review_status", F.unix_seconds("updated_at").alias("updated_s"))


EDITS = """
WITH p AS (SELECT doc_id AS seq, concat('r', doc_id // 3) AS reaction_id, doc_id % 4 AS k, quality, toxic FROM labels),
ok AS (SELECT *, CASE WHEN k < 2 THEN 'pending' WHEN toxic = 1 THEN 'rejected' WHEN k = 2 THEN 'edited' ELSE 'approved' END AS status,
  CASE WHEN k < 2 THEN concat('edit ', seq) WHEN k = 2 THEN concat('patch ', seq) END AS text, CASE WHEN k < 2 THEN seq % 50 WHEN k = 2 THEN 1 END AS share
  FROM p WHERE NOT (k = 0 AND quality = 0)),
f AS (SELECT reaction_id, arg_max(text, seq) FILTER (text IS NOT NULL) AS text, arg_max(share, seq) FILTER (share IS NOT NULL) AS share, arg_max(status, seq) AS status, max(seq) AS last FROM ok GROUP BY 1),
n AS (SELECT reaction_id, count(*) AS refused FROM p WHERE k = 0 AND quality = 0 GROUP BY 1)
SELECT r.id, coalesce(f.text, r.reaction_text) AS reaction_text, cast(CASE WHEN f.text IS NOT NULL THEN f.share ELSE r.yield_percent END AS double) AS yield_percent,
  coalesce(f.status, r.review_status) AS review_status, coalesce(1735689600 + f.last, cast(epoch(cast(r.created_at AS timestamp)) AS bigint)) AS updated_s, coalesce(n.refused, 0) AS refused
FROM reactions r LEFT JOIN f ON f.reaction_id = r.id LEFT JOIN n ON n.reaction_id = r.id
"""


@query("stream_review_edits", EDITS)
def _(spark, sf):
    """Edits judged by a schema among reviewers' patches: some are refused, others put the record back to pending."""
    example = {"reaction_text": "", "yield_percent": 1.5}
    text = (
        "case doc_id % 4 when 0 then concat('{\"reaction_text\":\"edit ', doc_id, '\",\"yield_percent\":', case when quality = 0 then '\"much\"' else cast(doc_id % 50 as string) end, '}')"
        " when 1 then concat('{\"more\":1,\"reaction_text\":\"edit ', doc_id, '\",\"yield_percent\":\"', doc_id % 50, '\"}')"
        " when 2 then concat('{\"reaction_text\":\"patch ', doc_id, '\",\"yield_percent\":1}') end"
    )
    columns = [
        "cast(doc_id as bigint) as seq", "concat('r', doc_id div 3) as reaction_id", "case when doc_id % 4 < 2 then 'edit' else 'review' end as kind", f"parse_json({text}) as payload",
        "case when toxic = 1 then 'rejected' when doc_id % 4 = 3 then 'approved' end as review_status", "timestamp_seconds(1735689600 + doc_id) as at",
    ]
    path, checkpoint = _paths(spark, "review-edits")
    SR.stream_review(_batches(spark, sf, "labels", "doc_id").selectExpr(*columns), path, checkpoint, example).awaitTermination()
    state.compact(spark, path, "reaction_id")
    bad = SR.refused(D.table(spark, sf, "labels").selectExpr(*columns), example).groupBy("reaction_id").agg(F.count(F.lit(1)).alias("refused"))
    r = D.reactions(spark, sf).withColumn("payload", F.to_variant_object("payload"))
    out = SR.reviewed(spark, r, path).join(bad, F.col("id") == bad["reaction_id"], "left").na.fill(0, ["refused"])
    return out.select(
        "id", F.try_variant_get("payload", "$.reaction_text", "string").alias("reaction_text"), F.try_variant_get("payload", "$.yield_percent", "double").alias("yield_percent"),
        "review_status", F.unix_seconds("updated_at").alias("updated_s"), "refused",
    )


@query(
    "stream_intake",
    """
SELECT filename, file_path, sha256, bytes FROM (SELECT concat(doc_id, '.pdf') AS filename, concat('/in/', doc_id, '.pdf') AS file_path, sha256(text) AS sha256, strlen(text) AS bytes,
  row_number() OVER (PARTITION BY sha256(text) ORDER BY strlen(text), concat('/in/', doc_id, '.pdf')) AS rn FROM documents) WHERE rn = 1
""",
)
def _(spark, sf):
    path, checkpoint = _paths(spark, "catalogue")
    # Equal texts meet in one batch, so the least path names them whatever the order of batches.
    files = _batches(spark, sf, "documents", "text").select(
        F.expr("concat('/in/', doc_id, '.pdf')").alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    SI.stream_intake(hashed_files(files.withColumn("length", F.length("content").cast("bigint"))), path, checkpoint).awaitTermination()
    return SI.read_catalogue(spark, path).select("filename", "file_path", "sha256", "bytes")


@query(
    "stream_chunk_progress",
    """
WITH s AS (SELECT cast(user_id AS varchar) AS document_id, event_id % 7 + 1 AS chunk_ord, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'retrying' WHEN 'view' THEN 'pending' ELSE 'completed' END, event_id) AS status FROM events GROUP BY 1, 2)
SELECT document_id, count(*) AS chunk_count, count(*) FILTER (status = 'completed') AS completed_chunks, count(*) FILTER (status = 'failed') AS failed_chunks,
  cast(coalesce(min(chunk_ord) FILTER (status = 'retrying'), min(chunk_ord) FILTER (status = 'pending')) AS integer) AS current_ord,
  CASE WHEN count(*) FILTER (status IN ('completed','failed')) < count(*) THEN 'parsing' ELSE 'chunks_done' END AS overall,
  cast(floor(100.0 * count(*) FILTER (status = 'completed') / count(*) + 0.5) AS integer) AS percent
FROM s GROUP BY 1
""",
)
def _(spark, sf):
    path, checkpoint = _paths(spark, "chunk-state")
    updates = _batches(spark, sf, "events", "event_id").selectExpr(
        "cast(user_id as string) as document_id",
        "cast(event_id % 7 + 1 as int) as chunk_ord",
        "case event_type when 'error' then 'failed' when 'click' then 'retrying' when 'view' then 'pending' else 'completed' end as status",
        "event_id as seq",
    )
    SC.stream_chunk_progress(updates, path, checkpoint).awaitTermination()
    return SC.progress(spark, path)
