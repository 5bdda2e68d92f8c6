"""Layout JSON scans: item lists and page trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import variants as V

SPAN = "struct<content:string>"
LINE = f"struct<spans:array<{SPAN}>>"
BLOCK = f"struct<type:string,bbox:array<double>,lines:array<{LINE}>>"
PAGE = f"struct<page_idx:int,page_size:array<double>,para_blocks:array<{BLOCK}>,preproc_blocks:array<{BLOCK}>>"
PAGE_TREE = f"struct<pdf_info:array<{PAGE}>>"


def decoded(payload: Column) -> Column:
    """VARIANT of a JSON text, reading through one level of string encoding.

    The first character tells a string, so the payload is parsed once and not walked.
    """
    quoted = F.startswith(F.ltrim(payload, F.lit(" \t\n\r")), F.lit('"'))
    return F.when(quoted, F.try_parse_json(V.text_of(F.try_parse_json(payload)))).otherwise(F.try_parse_json(payload))


def layout_items_scan(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """One row per layout item object: keys, pos, outer_pos, item, page_idx.

    A list of lists gives each item its outer position as page index when the
    item has none; a flat list keeps objects only; anything else gives no rows.
    ``pos`` counts kept objects in list order.
    """
    doc = df.select(*keys, decoded(F.col(payload)).alias("_v")).select(*keys, V.items(F.col("_v")).alias("_a"))
    nested = V.items(F.get("_a", F.lit(0))).isNotNull()

    def entry(item: Column, outer: Column) -> Column:
        return F.struct(item.alias("item"), outer.alias("outer_pos"))

    from_lists = F.flatten(
        F.transform(
            "_a",
            lambda page, i: F.transform(
                F.coalesce(V.items(page), F.array().cast("array<variant>")), lambda x: entry(x, i)
            ),
        )
    )
    flat = F.transform("_a", lambda x: entry(x, F.lit(None).cast("int")))
    objects = F.filter(F.when(nested, from_lists).otherwise(flat), lambda e: V.is_object(e["item"]))
    return (
        doc.select(*keys, F.posexplode(objects).alias("pos", "_e"))
        .select(*keys, "pos", F.col("_e.outer_pos").alias("outer_pos"), F.col("_e.item").alias("item"))
        .withColumn(
            "page_idx",
            # An explicit null page index stays null; only an absent key takes the position.
            F.when(V.field(F.col("item"), "page_idx").isNull(), F.col("outer_pos")).otherwise(
                F.try_variant_get("item", "$.page_idx", "int")
            ),
        )
    )


def read_page_tree(payload: Column) -> Column:
    """Typed page tree of a JSON text; bad text gives null."""
    return F.try_variant_get(decoded(payload), "$", PAGE_TREE)["pdf_info"]


def tree_pages(trees: DataFrame, keys: list[str], pages: str = "pages") -> DataFrame:
    """One row per page entry of each tree, with its position."""
    return trees.select(*keys, F.posexplode(pages).alias("pos", "page")).withColumn(
        "page_idx", F.coalesce("page.page_idx", F.lit(0))
    )


def without_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Tree pages of documents that have no flat item list."""
    return pages.join(items.select("document_id").distinct(), "document_id", "left_anti")


def page_tree_scan(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Items read from page-tree entries (keys, pos, page_idx, page).

    Reading order is the block's index in its page; text is the spans' contents
    joined without a separator.
    """
    blocks = F.when(F.size("page.para_blocks") > 0, F.col("page.para_blocks")).otherwise(F.col("page.preproc_blocks"))
    spans = F.flatten(F.transform(F.col("b.lines"), lambda ln: F.coalesce(ln["spans"], F.array().cast(f"array<{SPAN}>"))))
    text = F.array_join(F.filter(F.transform(spans, lambda s: s["content"]), lambda x: x.isNotNull() & (x != "")), "")
    return pages.select(*keys, "pos", "page_idx", "page", F.posexplode(blocks).alias("reading_order", "b")).select(
        *keys,
        F.col("pos").alias("page_pos"),
        "page_idx",
        "reading_order",
        F.coalesce("b.type", F.lit("text")).alias("type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.col("b.bbox").alias("bbox"),
        F.col("page.page_size").alias("page_size"),
    )


def page_sizes(pages: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """(document_id, page_idx, page_size): last size in the tree wins, supplied ones fill gaps."""
    sized = pages.filter(F.size("page.page_size") >= 2)
    tree = sized.groupBy("document_id", "page_idx").agg(
        F.max_by(F.slice("page.page_size", 1, 2), "pos").alias("tree_size")
    )
    if supplied is None:
        return tree.withColumnRenamed("tree_size", "page_size")
    return tree.join(supplied, ["document_id", "page_idx"], "full_outer").select(
        "document_id", "page_idx", F.coalesce("tree_size", "page_size").alias("page_size")
    )
