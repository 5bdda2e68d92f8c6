"""Layout JSON of many documents to blocks, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions.ordering import dense_position
from leafmill.operators.blocks import item_columns, normalize_blocks
from leafmill.operators.merge import image_path_rewrite, overlap_keep_first, page_tree_keep_first
from leafmill.session import materialize
from leafmill.sources.layout import layout_items_scan, page_sizes, page_tree_scan, read_page_tree, tree_pages, without_items


KEYS = ["document_id", "chunk_ord"]
SPAN = ["chunk_id", "start_page"]


def completed_windows(payloads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Payloads of completed windows with chunk_id and start_page: text moves once, before it is parsed."""
    spans = chunks.filter("status = 'completed'").select(*KEYS, *SPAN)
    return payloads.select(*KEYS, "payload").join(spans, KEYS)


def on_global_pages(rows: DataFrame) -> DataFrame:
    """Rows of windows that hold their start_page, with page_idx as the page of the document."""
    return rows.withColumn("page_idx", F.col("start_page") + F.coalesce("page_idx", F.lit(0))).drop("start_page")


def scanned_items(payloads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Typed items of completed windows with global pages, written once.

    ``payloads`` has document_id, chunk_ord, payload (JSON text). The JSON is
    parsed here only; page ownership and positions later read key columns.
    """
    rows = on_global_pages(layout_items_scan(completed_windows(payloads, chunks), [*KEYS, *SPAN]))
    return materialize(item_columns(rows, [*KEYS, "chunk_id", "pos", "page_idx"]), "layout-items", "zstd")


def scanned_trees(trees: DataFrame, chunks: DataFrame) -> DataFrame:
    """Page-tree entries of completed windows with global pages, parsed and written once.

    ``trees`` has document_id, chunk_ord and payload (JSON text). Sizes and ownership
    later read their own columns.
    """
    read = completed_windows(trees, chunks).select(*KEYS, *SPAN, read_page_tree(F.col("payload")).alias("pages"))
    pages = on_global_pages(tree_pages(read, [*KEYS, *SPAN]))
    return materialize(pages.select(*KEYS, "pos", "page", "page_idx", "chunk_id"), "layout-trees", "zstd")


def merged_items(scanned: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Items with overlaps removed; item_index is the position in the merged document."""
    kept = overlap_keep_first(scanned)
    if images is not None:
        kept = image_path_rewrite(kept, images)
    return dense_position(kept, ["document_id"], "chunk_ord", "pos", [], "item_index")


def parse_documents(
    payloads: DataFrame,
    chunks: DataFrame,
    images: DataFrame | None = None,
    trees: DataFrame | None = None,
    supplied_sizes: DataFrame | None = None,
) -> DataFrame:
    """Blocks of every document; page trees give sizes and stand in where a document has no items."""
    scanned = scanned_items(payloads, chunks)
    items = merged_items(scanned, images)
    if trees is None:
        return normalize_blocks(items, supplied_sizes)
    tree = scanned_trees(trees, chunks)
    # Sizes travel without the page's blocks; blocks travel for lonely documents only.
    size_only = tree.withColumn("page", F.struct(F.col("page.page_size").alias("page_size")))
    sizes = page_sizes(page_tree_keep_first(size_only), supplied_sizes)
    fallback = page_tree_scan(page_tree_keep_first(without_items(tree, scanned)), KEYS)
    stand_in = fallback.select(
        "document_id",
        "page_idx",
        F.lit(0).alias("page_no"),
        "type",
        X.truthy(F.btrim("text", F.lit(X.LAYOUT_SPACES))).alias("body"),
        F.lit(None).cast("string").alias("caption"),
        F.lit(None).cast("string").alias("image_path"),
        "bbox",
        F.col("page_size").alias("item_size"),
        F.col("reading_order").alias("own_order"),
        F.concat_ws("-", "page_idx", "reading_order").alias("item_index"),
        *[F.lit(None).cast("string").alias(c) for c in ("text_level", "sub_type", "table_body", "table_caption", "table_footnote", "image_footnote", "chunk_id")],
    )
    return normalize_blocks(items, sizes).unionByName(normalize_blocks(stand_in, sizes))
