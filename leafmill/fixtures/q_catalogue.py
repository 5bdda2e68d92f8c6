"""Queries: catalogue, intake, windows and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import views as D
from leafmill.fixtures.registry import query
from leafmill.operators import catalogue as C
from leafmill.operators import windows as W
from leafmill.plans.batch import batch_plan
from leafmill.session import scratch_path
from leafmill.sources import files as FS
from leafmill.sources import stored as ST
from leafmill.sources import versioned


def _hashed(spark, sf):
    """Document texts as file contents: the bytes to be catalogued."""
    d = D.table(spark, sf, "documents").select(
        F.expr("concat('/in/', doc_id, '.pdf')").alias("path"), F.encode("text", "UTF-8").alias("content"),
    ).withColumn("length", F.length("content").cast("bigint"))
    return FS.hashed_files(d)


@query(
    "intake_by_hash",
    """
WITH f AS (SELECT concat('/in/', doc_id, '.pdf') AS path, concat(doc_id, '.pdf') AS filename, strlen(text) AS length, sha256(text) AS sha256, doc_id FROM documents),
known AS (SELECT DISTINCT sha256(CASE WHEN doc_id % 10 = 0 THEN text ELSE concat(text, ' v2') END) AS sha256 FROM documents)
SELECT filename, path AS file_path, sha256, length AS bytes, 'uploaded' AS parse_status FROM (
  SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY length, path) AS rn FROM f WHERE sha256 NOT IN (SELECT sha256 FROM known)) WHERE rn = 1
""",
)
def _(spark, sf):
    # Every document is catalogued, nine of ten in another version.
    known = D.table(spark, sf, "documents").select(F.sha2(F.expr("case when doc_id % 10 = 0 then text else concat(text, ' v2') end"), 256).alias("sha256"))
    return FS.intake_by_hash(_hashed(spark, sf), known).select("filename", "file_path", "sha256", "bytes", "parse_status")


@query(
    "artifact_pick",
    """
WITH k AS (SELECT *, regexp_extract(path, '[^/]+$', 0) AS name FROM artifact_files),
t AS (SELECT *, CASE WHEN name LIKE '%.md' THEN 'markdown' WHEN regexp_matches(name, 'content_list(_v2)?\\.json$') THEN 'content_list' WHEN regexp_matches(name, '(^|_)middle\\.json$') THEN 'middle' END AS kind,
  CASE WHEN name LIKE '%.md' THEN CASE WHEN lower(name) LIKE '%full%' THEN 0 ELSE 1 END WHEN name LIKE '%content_list.json' THEN 0 WHEN name LIKE '%_middle.json' AND name LIKE 'x%' THEN 0 ELSE 1 END AS pr,
  len(string_split(path, '/')) AS depth FROM k)
SELECT document_id, kind, path, length FROM (SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY pr, depth, length DESC, path) AS rn FROM t WHERE kind IS NOT NULL) WHERE rn = 1
""",
)
def _(spark, sf):
    return FS.artifact_pick(D.artifact_files(spark, sf))


@query(
    "page_image_listing",
    """
SELECT document_id, cast(regexp_replace(regexp_extract(path, '[^/]+$', 0), '[^0-9]', '', 'g') AS integer) AS page_no, path FROM artifact_files WHERE path LIKE '%.png'
UNION ALL SELECT document_id, page_no, path FROM page_images
""",
)
def _(spark, sf):
    cols = ["document_id", "path"]
    return FS.page_image_listing(D.artifact_files(spark, sf).select(*cols).unionByName(D.page_images(spark, sf).select(*cols)))


@query(
    "stored_table_scan",
    """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(json_extract_string(props, '$.k') AS double) END AS k,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n_tags FROM events
""",
)
def _(spark, sf):
    e = D.table(spark, sf, "events").selectExpr(
        "event_id",
        "case event_id % 3 when 0 then 'not json' else props end as payload_json",
        "case event_id % 4 when 0 then '' else '[\"a\"]' end as tags_json",
    )
    out = ST.stored_table_scan(e, {"payload_json": ("struct<k:double>", "{}"), "tags_json": ("array<string>", "[]")})
    return out.select("event_id", F.col("payload_json.k").alias("k"), F.size("tags_json").alias("n_tags"))


@query("documents_latest", "SELECT id, filename, parse_status, page_count FROM documents_cat")
def _(spark, sf):
    return C.documents_latest(D.documents_cat(spark, sf)).select("id", "filename", "parse_status", "page_count")


@query("large_document", "SELECT id, page_count, bytes, (page_count > 24 OR bytes > 20971520) AS large FROM documents_cat")
def _(spark, sf):
    return C.large_document(D.documents_cat(spark, sf)).select("id", "page_count", "bytes", "large")


def _running(spark, sf):
    return D.documents_cat(spark, sf).filter("parse_status = 'parsing' and page_count % 2 = 0").select(F.col("id").alias("document_id"))


@query(
    "auto_parse_queue",
    """
SELECT id, parse_status FROM documents_cat WHERE (page_count > 24 OR bytes > 20971520) AND parse_status <> 'completed'
  AND NOT (parse_status = 'parsing' AND page_count % 2 = 0)
""",
)
def _(spark, sf):
    return C.auto_parse_queue(D.documents_cat(spark, sf), _running(spark, sf)).select("id", "parse_status")


@query(
    "needs_full_parse",
    """
SELECT d.id, d.parse_status, coalesce(max(b.page_no), 0)::integer AS max_page, count(b.id) AS block_count FROM documents_cat d LEFT JOIN blocks b ON b.document_id = d.id
GROUP BY d.id, d.parse_status, d.page_count
HAVING d.parse_status <> 'completed' OR count(b.id) = 0 OR coalesce(max(b.page_no), 0) < greatest(d.page_count - 2, 1)
""",
)
def _(spark, sf):
    return C.needs_full_parse(D.documents_cat(spark, sf), D.blocks(spark, sf)).select("id", "parse_status", "max_page", "block_count")


def _elsewhere(df, own):
    """The whole table, its rows under other documents' ids where ``own`` fails."""
    return df.withColumn("document_id", F.when(F.expr(own), F.col("document_id")).otherwise(F.concat(F.lit("x"), "document_id")))


def _some_records(spark, sf, own="review_status = 'approved'"):
    return _elsewhere(D.reactions(spark, sf), own), _elsewhere(D.table_records(spark, sf), "review_status = 'edited'")


@query(
    "extracted_documents",
    """
WITH done AS (SELECT document_id FROM reactions WHERE review_status = 'approved' AND yield_percent IS NULL UNION SELECT document_id FROM table_records WHERE review_status = 'edited')
SELECT id, id IN (SELECT document_id FROM done) AS extracted FROM documents_cat
""",
)
def _(spark, sf):
    r, t = _some_records(spark, sf, "review_status = 'approved' and payload.yield_percent is null")
    docs = D.documents_cat(spark, sf)
    yes = C.extracted_documents(docs, r, t).select("id", F.lit(True).alias("extracted"))
    no = C.extracted_documents(docs, r, t, present=False).select("id", F.lit(False).alias("extracted"))
    return yes.unionByName(no)


@query(
    "update_document",
    """
SELECT id, filename, page_count, sha256, cast(epoch(created_at) AS bigint) AS created_s,
  CASE WHEN page_count % 3 = 0 THEN 'completed' ELSE parse_status END AS parse_status,
  CASE WHEN page_count % 3 = 0 AND page_count % 2 = 0 THEN NULL ELSE parse_error END AS parse_error,
  CASE WHEN page_count % 3 = 0 THEN 1735689600 ELSE cast(epoch(updated_at) AS bigint) END AS updated_s
FROM documents_cat
""",
)
def _(spark, sf):
    docs = D.documents_cat(spark, sf)
    patches = docs.filter("page_count % 3 = 0").selectExpr("id", "'completed' as parse_status", "page_count % 2 = 0 as clear_error")
    stored = versioned.create(docs, scratch_path(spark, "documents"), ["id"], buckets=8)
    C.patch_documents(spark, stored, patches, F.timestamp_seconds(F.lit(1735689600)))
    out = versioned.read(spark, stored)
    times = [F.unix_seconds("created_at").alias("created_s"), F.unix_seconds("updated_at").alias("updated_s")]
    return out.select("id", "filename", "page_count", "sha256", "parse_status", "parse_error", *times)


def _runs(spark, sf):
    return D.documents_cat(spark, sf).selectExpr("concat('run', id) as run_id", "id as document_id")


@query(
    "delete_cascade",
    """
WITH doomed AS (SELECT id FROM documents_cat WHERE page_count % 4 = 0)
SELECT 'documents' AS source, id, id AS document_id FROM documents_cat WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'blocks', id, document_id FROM blocks WHERE document_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'reactions', id, document_id FROM reactions WHERE document_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'table_records', id, document_id FROM table_records WHERE document_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'runs', 'run' || id, id FROM documents_cat WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'run_events', cast(id AS varchar), 'run' || (id // 10) FROM run_events WHERE cast(id // 10 AS varchar) NOT IN (SELECT id FROM doomed)
""",
)
def _(spark, sf):
    docs = D.documents_cat(spark, sf)
    doomed = docs.filter("page_count % 4 = 0").select(F.col("id").alias("document_id"))
    events = D.run_events(spark, sf).withColumn("run_id", F.expr("concat('run', id div 10)"))
    tables = {
        "documents": docs.select("id", F.col("id").alias("document_id")),
        "blocks": D.blocks(spark, sf).select("id", "document_id"),
        "reactions": D.reactions(spark, sf).select("id", "document_id"),
        "table_records": D.table_records(spark, sf).select("id", "document_id"),
        "runs": _runs(spark, sf).withColumn("id", F.col("run_id")),
        "run_events": events.select(F.col("id").cast("string").alias("id"), "run_id"),
    }
    key = {"documents": "id", "run_events": "run_id"}
    stored = {name: versioned.create(df, scratch_path(spark, f"cascade-{name}"), [key.get(name, "document_id")], buckets=8) for name, df in tables.items()}
    C.delete_documents(spark, stored, doomed)
    out = None
    for name, t in stored.items():
        owner = "run_id" if name == "run_events" else "document_id"
        rows = versioned.read(spark, t).select(F.lit(name).alias("source"), "id", F.col(owner).alias("document_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "orphan_check",
    """
SELECT 'reactions' AS source, id, document_id FROM reactions WHERE document_id NOT IN (SELECT id FROM documents_cat)
UNION ALL SELECT 'table_records', id, document_id FROM table_records WHERE document_id NOT IN (SELECT id FROM documents_cat)
""",
)
def _(spark, sf):
    docs = D.documents_cat(spark, sf)
    parts = []
    for name, df in (("reactions", D.reactions(spark, sf)), ("table_records", D.table_records(spark, sf))):
        parts.append(C.orphan_check(df.select("id", "document_id"), docs).select(F.lit(name).alias("source"), "id", "document_id"))
    return parts[0].unionByName(parts[1])


# ---- windows -------------------------------------------------------------------
@query(
    "plan_chunks",
    """
WITH a AS (SELECT id, page_count AS n, CASE WHEN bytes / 1048576.0 / greatest(page_count, 1) >= 0.22 THEN 8 WHEN bytes / 1048576.0 / greatest(page_count, 1) >= 0.08 THEN 16 ELSE 24 END AS size,
  CASE WHEN bytes / 1048576.0 / greatest(page_count, 1) >= 0.08 THEN 1 ELSE 2 END AS lap FROM documents_cat WHERE page_count > 0),
r AS (SELECT id, n, size, lap, 1 AS ord, 0 AS s, least(size - 1, n - 1) AS e FROM a
  UNION ALL SELECT id, n, size, lap, ord + 1, e - lap + 1, least(e - lap + size, n - 1) FROM r WHERE e < n - 1)
SELECT id AS document_id, ord AS chunk_ord, 'c' || lpad(cast(ord AS varchar), 4, '0') AS chunk_id, s AS start_page, e AS end_page, e - s + 1 AS page_count,
  CASE WHEN ord = 1 THEN 0 ELSE lap END AS overlap_with_previous, 'pending' AS status FROM r -- RECURSIVE
""",
)
def _(spark, sf):
    return W.plan_chunks(D.documents_cat(spark, sf)).drop("error")


def _with_path(df):
    return df.withColumn("input_path", F.concat(F.lit("/data/"), "document_id", F.lit(".pdf")))


@query(
    "plan_reuse",
    """
WITH d AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT c.document_id, c.chunk_ord, c.start_page, c.end_page, cast(c.document_id AS bigint) % 4 = 0 AS reused,
  CASE WHEN cast(c.document_id AS bigint) % 4 = 0 THEN c.status ELSE 'pending' END AS status
FROM chunks c JOIN d USING (document_id)
""",
)
def _(spark, sf):
    stored = _with_path(D.chunks(spark, sf))
    planned = stored.withColumn("status", F.lit("pending"))
    # One document in four was stored as it would be planned now; the others moved,
    # changed a range, or hold one window more.
    n = F.col("document_id").cast("bigint") % 4
    stored = stored.withColumn("input_path", F.when(n == 1, "/old.pdf").otherwise(F.col("input_path")))
    stored = stored.withColumn("end_page", F.when(n == 2, F.col("end_page") + 1).otherwise(F.col("end_page")))
    extra = stored.filter((n == 3) & (F.col("chunk_ord") == 1)).withColumn("chunk_ord", F.lit(999))
    return W.plan_reuse(planned, stored.unionByName(extra))


@query("pending_chunks", "SELECT document_id, chunk_ord, chunk_id, status FROM chunks WHERE status <> 'completed'")
def _(spark, sf):
    return W.pending_chunks(D.chunks(spark, sf)).select("document_id", "chunk_ord", "chunk_id", "status")


@query(
    "chunk_attempts",
    """
WITH c AS (SELECT *, (cast(document_id AS bigint) + chunk_ord) % 4 AS m FROM chunks)
SELECT document_id, chunk_ord, CASE WHEN status = 'completed' THEN status WHEN m = 0 THEN status WHEN m = 1 THEN 'completed' WHEN m = 2 THEN 'failed' ELSE 'retrying' END AS status,
  CASE WHEN status = 'completed' OR m IN (0, 1) THEN NULL WHEN m = 2 THEN 'e2' ELSE 'e1' END AS error
FROM c
""",
)
def _(spark, sf):
    c = D.chunks(spark, sf)
    m = (F.col("document_id").cast("bigint") + F.col("chunk_ord")) % 4
    tries = (
        c.withColumn("m", m)
        .filter("m > 0")
        .withColumn("attempt", F.explode(F.when(F.col("m") == 3, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
        .select(
            "document_id", "chunk_ord", "attempt",
            ((F.col("m") == 1) & (F.col("attempt") == 2)).alias("ok"),
            F.concat(F.lit("e"), "attempt").alias("error"),
        )
    )
    return W.settle_attempts(c, tries).select("document_id", "chunk_ord", "status", "error")


CHUNK_SUMMARY = """
SELECT document_id, count(*) AS chunk_count, count(*) FILTER (status = 'completed') AS completed_chunks, count(*) FILTER (status = 'failed') AS failed_chunks,
  coalesce(min(chunk_ord) FILTER (status IN ('retrying','running','parsing')), min(chunk_ord) FILTER (status = 'pending')) AS current_ord,
  CASE WHEN count(*) FILTER (status IN ('completed','failed')) < count(*) THEN 'parsing' ELSE 'chunks_done' END AS overall,
  cast(floor(100.0 * count(*) FILTER (status = 'completed') / count(*) + 0.5) AS integer) AS percent
FROM chunks GROUP BY document_id
"""


@query("chunk_summary", CHUNK_SUMMARY)
def _(spark, sf):
    return W.chunk_summary(D.chunks(spark, sf))


@query(
    "parse_progress",
    f"""
WITH s AS ({CHUNK_SUMMARY})
SELECT d.id AS document_id, parse_status, parse_status = 'parsing' AS running, (page_count > 24 OR bytes > 20971520) AS large,
  (coalesce(chunk_count, 0) > 0 OR page_count > 24 OR bytes > 20971520 OR parse_status = 'parsing') AS chunked, bytes AS file_size_bytes,
  coalesce(chunk_count, 0) AS chunk_count, coalesce(completed_chunks, 0) AS completed_chunks, coalesce(failed_chunks, 0) AS failed_chunks, current_ord, parse_error AS message
FROM documents_cat d LEFT JOIN s ON s.document_id = d.id AND cast(d.id AS bigint) % 3 > 0
""",
)
def _(spark, sf):
    return W.parse_progress(D.documents_cat(spark, sf), _elsewhere(D.chunks(spark, sf), "cast(document_id as bigint) % 3 > 0"))


@query(
    "merge_report",
    """
SELECT document_id, concat('merged_', count(*) FILTER (status = 'completed'), '_of_', count(*), '_chunks') AS merged,
  'incomplete_chunks:' || string_agg(chunk_id, ',' ORDER BY chunk_ord) FILTER (status <> 'completed') AS incomplete
FROM chunks GROUP BY document_id
""",
)
def _(spark, sf):
    return W.merge_report(D.chunks(spark, sf))


@query(
    "resume_list",
    """
WITH s AS (SELECT document_id, bool_or(status <> 'completed') AS open FROM chunks WHERE cast(document_id AS bigint) % 3 > 0 GROUP BY 1)
SELECT d.id AS document_id, parse_status, coalesce(open, false) AS open FROM documents_cat d LEFT JOIN s ON s.document_id = d.id
WHERE parse_status = 'parsing' OR (open IS NULL AND parse_status <> 'completed') OR coalesce(open, false)
""",
)
def _(spark, sf):
    return W.resume_list(D.documents_cat(spark, sf), _elsewhere(D.chunks(spark, sf), "cast(document_id as bigint) % 3 > 0"))


@query(
    "batch_plan",
    """
WITH todo AS (SELECT d.id FROM documents_cat d LEFT JOIN blocks b ON b.document_id = d.id GROUP BY d.id, d.parse_status, d.page_count
  HAVING d.parse_status <> 'completed' OR count(b.id) = 0 OR coalesce(max(b.page_no), 0) < greatest(d.page_count - 2, 1)),
done AS (SELECT document_id FROM reactions WHERE review_status = 'approved' UNION SELECT document_id FROM table_records WHERE review_status = 'edited')
SELECT id AS document_id, filename, bytes, id IN (FROM todo) AS parse, id IN (FROM todo) AND id IN (FROM done) AS clear, id IN (FROM todo) OR id NOT IN (FROM done) AS extract
FROM documents_cat
""",
)
def _(spark, sf):
    return batch_plan(D.documents_cat(spark, sf), D.blocks(spark, sf), *_some_records(spark, sf))


@query(
    "replace_blocks",
    """
SELECT document_id, page_no, id, block_type, CASE WHEN cast(document_id AS bigint) % 5 = 0 THEN 'again ' || coalesce(text, '') ELSE text END AS text
FROM blocks WHERE cast(document_id AS bigint) % 5 > 0 OR reading_order < 10
""",
)
def _(spark, sf):
    cols = ["document_id", "page_no", "id", "block_type", "text", "reading_order"]
    all_blocks = D.blocks(spark, sf).select(*cols)
    stored = versioned.create(all_blocks, scratch_path(spark, "blocks"), ["document_id"], buckets=8)
    again = all_blocks.filter("cast(document_id as bigint) % 5 = 0")
    new = again.filter("reading_order < 10").withColumn("text", F.concat(F.lit("again "), F.coalesce("text", F.lit(""))))
    versioned.commit(spark, stored, new, replaced=again.select("document_id").distinct())
    return versioned.read(spark, stored).select("document_id", "page_no", "id", "block_type", "text")
