"""Merging window outputs back to whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions.ordering import with_ends


def rebase_page(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Global page index and chunk tag for items whose page_idx is window-local."""
    spans = chunks.select("document_id", "chunk_ord", "chunk_id", "start_page")
    return items.join(spans, ["document_id", "chunk_ord"]).withColumn(
        "page_idx", F.col("start_page") + F.coalesce("page_idx", F.lit(0))
    ).drop("start_page")


def overlap_keep_first(items: DataFrame) -> DataFrame:
    """Each page belongs to the earliest window that has an item on it.

    Page ownership is aggregated first (partial per task); only pages claimed by
    more than one window, the overlaps, come back to be joined, so most items
    meet a small side and a page with very many items is never sorted whole.
    """
    owner = (
        items.groupBy("document_id", "page_idx")
        .agg(F.min("chunk_ord").alias("_owner"), F.max("chunk_ord").alias("_last"))
        .filter("_owner < _last")
        .select("document_id", "page_idx", "_owner")
    )
    return (
        items.join(owner, ["document_id", "page_idx"], "left")
        .filter(F.col("_owner").isNull() | (F.col("chunk_ord") == F.col("_owner")))
        .drop("_owner")
    )


def overlap_keep_all(items: DataFrame) -> DataFrame:
    """Both copies of an overlapping page are kept."""
    return items


def page_tree_keep_first(pages: DataFrame) -> DataFrame:
    """First page-tree entry per global page, repeats inside one window included.

    Winners are chosen on keys, and only pages that several entries claim come back to
    meet the trees, which are never sorted. (document, window, pos) names one entry;
    ``pages`` is read twice, so it should be stored.
    """
    at = F.struct("chunk_ord", "pos")
    claimed = (
        pages.groupBy("document_id", "page_idx")
        .agg(F.min(at).alias("_winner"), F.count(F.lit(1)).alias("_claims"))
        .filter("_claims > 1")
        .select("document_id", "page_idx", "_winner")
    )
    held = pages.join(claimed.hint("shuffle_hash"), ["document_id", "page_idx"], "left")
    return held.filter(F.col("_winner").isNull() | (at == F.col("_winner"))).drop("_winner")


def image_path_rewrite(items: DataFrame, images: DataFrame, path: str = "image_path") -> DataFrame:
    """Paths point at the merged image folder, prefixed when the window owns the image.

    ``images`` has document_id, chunk_ord, name. A null path stays null.
    """
    owned = images.select("document_id", "chunk_ord", F.col("name").alias("_name"), F.lit(True).alias("_owned")).distinct()
    name = F.regexp_extract(path, r"[^/]+$", 0)
    target = F.when(F.col("_owned"), F.concat(F.col("chunk_id"), F.lit("_"), F.col("_name"))).otherwise(F.col("_name"))
    return (
        items.withColumn("_name", name)
        .join(owned, ["document_id", "chunk_ord", "_name"], "left")
        .withColumn(path, F.when(F.col(path).isNotNull(), F.concat(F.lit("images/"), target)))
        .drop("_name", "_owned")
    )


def chunk_comment(chunk_id: Column, start_page: Column, end_page: Column) -> Column:
    return F.format_string(X.CHUNK_COMMENT, chunk_id, start_page + 1, end_page + 1)


def merged_markdown(chunks: DataFrame) -> DataFrame:
    """Pieces of each document's merged markdown, in (document_id, chunk_ord) order.

    Concatenating a document's pieces gives its file: a comment naming window and
    1-based pages, then the window's text; overlaps are not removed, the whole is
    trimmed and ends with one newline. Pieces stay rows, so a very long document
    is never one value. ``chunks`` has document_id, chunk_ord, chunk_id,
    start_page, end_page, text; windows without text are left out.
    """
    have = with_ends(chunks.filter("text is not null"), "document_id", ["chunk_ord"])
    body = F.concat(
        F.when(F.col("opens"), F.lit("")).otherwise(F.lit("\n\n")),
        chunk_comment(F.col("chunk_id"), F.col("start_page"), F.col("end_page")),
        F.lit("\n\n"),
        F.col("text"),
    )
    trimmed = F.concat(F.regexp_replace(body, r"(?U)\s+$", ""), F.lit("\n"))
    return have.select("document_id", "chunk_ord", F.when(F.col("closes"), trimmed).otherwise(body).alias("piece"))
