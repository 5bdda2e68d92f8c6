"""Page windows (chunks): planning, reuse, progress and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.ordering import gather_text

MIB = 1024 * 1024
# MiB per page at or above which a (size, overlap) applies.
HEAVY, HEAVY_WINDOW = 0.22, (8, 1)
MEDIUM, MEDIUM_WINDOW = 0.08, (16, 1)
LIGHT_WINDOW = (24, 2)
# Larger than either is a large document.
LARGE_PAGES, LARGE_BYTES = 24, 20 * MIB
ACTIVE = ["retrying", "running", "parsing"]


def is_large(page_count: Column, size: Column) -> Column:
    return (page_count > LARGE_PAGES) | (size > LARGE_BYTES)


def adaptive_window(page_count: Column, size: Column) -> tuple[Column, Column]:
    per_page = (size / F.lit(float(MIB))) / F.greatest(page_count, F.lit(1))

    def pick(i: int) -> Column:
        return (
            F.when(per_page >= HEAVY, HEAVY_WINDOW[i]).when(per_page >= MEDIUM, MEDIUM_WINDOW[i]).otherwise(LIGHT_WINDOW[i])
        )

    return pick(0), pick(1)


def window_array(
    page_count: Column,
    size: Column,
    start_page: Column | None = None,
    end_page: Column | None = None,
    chunk_pages: Column | None = None,
    overlap: Column | None = None,
) -> Column:
    """array<struct<chunk_ord, chunk_id, start_page, end_page, page_count, overlap_with_previous>>.

    Explicit sizes win over the adaptive ones; a window of 0 counts as unset
    while an overlap of 0 is kept. Both given skips the adaptive choice, so a
    window of 0 then means 1.
    """
    none = F.lit(None).cast("int")
    chunk_pages = none if chunk_pages is None else chunk_pages
    overlap = none if overlap is None else overlap
    first = F.greatest(F.lit(0), F.coalesce(start_page if start_page is not None else none, F.lit(0)))
    last = F.least(F.coalesce(end_page if end_page is not None else none, page_count - 1), page_count - 1)
    a_size, a_overlap = adaptive_window(page_count, size)
    chosen = F.when(chunk_pages.isNotNull() & overlap.isNotNull(), chunk_pages).otherwise(
        F.coalesce(F.nullif(chunk_pages, F.lit(0)), a_size)
    )
    width = F.greatest(F.lit(1), chosen)
    lap = F.greatest(F.lit(0), F.least(F.coalesce(overlap, a_overlap), width - 1))
    stride = width - lap
    pages = last - first + 1
    count = F.when(pages <= width, F.lit(1)).otherwise(1 + F.ceil((pages - width) / stride).cast("int"))

    def window(i: Column) -> Column:
        start = (first + i * stride).cast("int")
        end = F.least(start + width - 1, last).cast("int")
        return F.struct(
            (i + 1).cast("int").alias("chunk_ord"),
            # Zero-padded to four digits, wider from 10,000 on.
            F.format_string("c%04d", (i + 1).cast("int")).alias("chunk_id"),
            start.alias("start_page"),
            end.alias("end_page"),
            (end - start + 1).cast("int").alias("page_count"),
            F.when(i == 0, F.lit(0)).otherwise(lap).cast("int").alias("overlap_with_previous"),
        )

    windows = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), window)
    return F.when(last >= first, windows)


def plan_chunks(
    documents: DataFrame,
    start_page: str | None = None,
    end_page: str | None = None,
    chunk_pages: str | None = None,
    overlap: str | None = None,
    max_pages: int = 0,
) -> DataFrame:
    """One row per window. ``documents`` has id, page_count, bytes; an empty span gives no row.

    ``max_pages`` > 0 caps documents without an explicit end page.
    """

    def opt(name: str | None) -> Column | None:
        return None if name is None else F.col(name)

    end = opt(end_page)
    if max_pages > 0:
        start = F.coalesce(opt(start_page), F.lit(0)) if start_page else F.lit(0)
        capped = F.when(F.col("page_count") > max_pages, start + max_pages - 1)
        end = capped if end is None else F.coalesce(end, capped)
    arr = window_array(F.col("page_count"), F.col("bytes"), opt(start_page), end, opt(chunk_pages), opt(overlap))
    return documents.select(F.col("id").alias("document_id"), F.explode(arr).alias("w")).select(
        "document_id",
        "w.*",
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


def plan_reuse(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored windows of documents whose stored ranges equal the plan; else the plan.

    Both sides carry document_id, input_path, chunk_ord, start_page, end_page,
    status. Equality is an aggregate over a full join by window, so no list of
    windows is gathered.
    """
    s = stored.select(
        "document_id",
        "chunk_ord",
        F.col("input_path").alias("s_path"),
        F.col("start_page").alias("s_start"),
        F.col("end_page").alias("s_end"),
        F.col("status").alias("s_status"),
    )
    both = planned.join(s, ["document_id", "chunk_ord"], "full_outer")
    same = (
        F.col("start_page").eqNullSafe(F.col("s_start"))
        & F.col("end_page").eqNullSafe(F.col("s_end"))
        & F.col("input_path").eqNullSafe(F.col("s_path"))
    )
    verdict = both.groupBy("document_id").agg(F.bool_and(same).alias("reused"))
    return (
        both.filter("start_page is not null")
        .join(verdict, "document_id")
        .select(
            "document_id",
            "chunk_ord",
            "start_page",
            "end_page",
            F.when(F.col("reused"), F.col("s_status")).otherwise(F.col("status")).alias("status"),
            "reused",
        )
    )


def settle_attempts(chunks: DataFrame, attempts: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Window status after its attempts (document_id, chunk_ord, attempt, ok, error).

    Any success completes it, however late, and clears the error; ``max_attempts``
    failures fail it; fewer leave it retrying.
    """
    outcome = attempts.groupBy("document_id", "chunk_ord").agg(
        F.bool_or("ok").alias("done"),
        F.count(F.lit(1)).alias("tries"),
        F.max_by("error", "attempt").alias("last_error"),
    )
    status = (
        F.when((F.col("status") == "completed") | F.col("tries").isNull(), F.col("status"))
        .when(F.col("done"), "completed")
        .when(F.col("tries") >= max_attempts, "failed")
        .otherwise("retrying")
    )
    error = F.when((F.col("status") == "completed") | F.col("tries").isNull(), F.col("error")).when(
        ~F.col("done"), F.col("last_error")
    )
    return (
        chunks.join(outcome, ["document_id", "chunk_ord"], "left")
        .withColumns({"error": error, "status": status})
        .drop("done", "tries", "last_error")
    )


def pending_chunks(chunks: DataFrame) -> DataFrame:
    """Windows still to parse: completed ones are skipped."""
    return chunks.filter(F.col("status").isNull() | (F.col("status") != "completed"))


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Counts, current window and overall state per document, in one aggregation."""
    st = F.col("status")
    done, failed, n = F.count_if(st == "completed"), F.count_if(st == "failed"), F.count(F.lit(1))
    # The current window is the earliest active one, else the earliest pending one.
    active, waiting = F.when(st.isin(*ACTIVE), F.col("chunk_ord")), F.when(st == "pending", F.col("chunk_ord"))
    return (
        chunks.groupBy("document_id")
        .agg(
            n.alias("chunk_count"),
            done.alias("completed_chunks"),
            failed.alias("failed_chunks"),
            F.coalesce(F.min(active), F.min(waiting)).alias("current_ord"),
        )
        .withColumn(
            "overall",
            F.when(F.col("completed_chunks") + F.col("failed_chunks") < F.col("chunk_count"), "parsing").otherwise("chunks_done"),
        )
        .withColumn(
            "percent",
            F.floor(100.0 * F.col("completed_chunks") / F.col("chunk_count") + 0.5).cast("int"),
        )
    )


def parse_progress(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    summary = chunk_summary(chunks)
    large = is_large(F.col("page_count"), F.col("bytes"))
    n = F.coalesce("chunk_count", F.lit(0))
    return documents.join(summary, documents["id"] == summary["document_id"], "left").select(
        F.col("id").alias("document_id"),
        "parse_status",
        (F.col("parse_status") == "parsing").alias("running"),
        large.alias("large"),
        ((n > 0) | large | (F.col("parse_status") == "parsing")).alias("chunked"),
        F.col("bytes").alias("file_size_bytes"),
        n.alias("chunk_count"),
        F.coalesce("completed_chunks", F.lit(0)).alias("completed_chunks"),
        F.coalesce("failed_chunks", F.lit(0)).alias("failed_chunks"),
        "current_ord",
        F.col("parse_error").alias("message"),
    )


def merge_report(chunks: DataFrame) -> DataFrame:
    """"merged c of n" and the ids of windows that are not completed, in window order."""
    counts = chunks.groupBy("document_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count(F.lit(1)).alias("total")
    )
    open_ids = gather_text(pending_chunks(chunks), ["document_id"], ["chunk_ord"], F.col("chunk_id"), ",", "open_ids")
    return counts.join(open_ids, "document_id", "left").select(
        "document_id",
        F.format_string("merged_%d_of_%d_chunks", "completed", "total").alias("merged"),
        F.when(F.col("open_ids").isNotNull(), F.concat(F.lit("incomplete_chunks:"), "open_ids")).alias("incomplete"),
    )


def resume_list(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents parsing, or unplanned and not completed, or with an open window."""
    state = chunks.groupBy("document_id").agg(F.bool_or(~F.col("status").eqNullSafe("completed")).alias("open"))
    return (
        documents.join(state, documents["id"] == state["document_id"], "left")
        .filter(
            (F.col("parse_status") == "parsing")
            | (F.col("open").isNull() & (F.col("parse_status") != "completed"))
            | F.coalesce("open", F.lit(False))
        )
        .select(F.col("id").alias("document_id"), "parse_status", F.coalesce("open", F.lit(False)).alias("open"))
    )
