"""Layout items to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import variants as V


def page_index(page_idx: Column, page_no: Column) -> Column:
    """0-based page: page_idx unless 0 or absent, else page_no - 1 unless 0 or absent, else 0."""
    return (
        F.when(F.coalesce(page_idx, F.lit(0)) != 0, page_idx)
        .when(F.coalesce(page_no, F.lit(0)) != 0, page_no - 1)
        .otherwise(F.lit(0))
    )


def page_number(page_idx: Column, page_no: Column) -> Column:
    return page_index(page_idx, page_no) + 1


def block_text(body: Column, caption: Column) -> Column:
    """Body with the caption line before it, unless the body already contains it."""
    joined = F.when(F.contains(body, caption), body).otherwise(F.concat(caption, F.lit("\n"), body))
    return F.when(body.isNull(), caption).when(caption.isNull(), body).otherwise(joined)


def item_columns(items: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """Typed columns of variant layout items, without a shuffle.

    The three text sources of an item pass through one text expression together.
    """

    def scalar(name: str, to: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", to)

    sources = F.array(
        V.first_truthy(item, "text", "content", "table_body", "image_caption", "table_caption"),
        F.when(F.col("type").isin("title", "paragraph"), F.try_variant_get(item, "$.content", "variant")),
        V.first_truthy(item, "image_caption", "table_caption", "code_caption"),
    )
    kind = F.coalesce(V.text_of(V.first_truthy(item, "type", "block_type")), F.lit("text"))
    typed = items.withColumn("type", kind).withColumns(
        {
            "_sources": sources,
            "image_path": V.text_of(V.first_truthy(item, "img_path", "image_path")),
            "page_no": scalar("page_no", "int"),
            "bbox": scalar("bbox", "array<double>"),
            "item_size": scalar("page_size", "array<double>"),
            "own_order": scalar("reading_order", "int"),
            # Kept as they came: a list or object stays JSON text.
            **{c: scalar(c, "string") for c in _AS_GIVEN},
        }
    ).withColumn("_texts", V.join_texts("_sources"))
    return typed.select(
        *keys,
        "type",
        F.coalesce(F.get("_texts", F.lit(0)), F.get("_texts", F.lit(1))).alias("body"),
        F.get("_texts", F.lit(2)).alias("caption"),
        *_ITEM_COLUMNS,
    )


_AS_GIVEN = ["text_level", "sub_type", "table_body", "table_caption", "table_footnote", "image_footnote"]
_ITEM_COLUMNS = ["image_path", "page_no", "bbox", "item_size", "own_order", *_AS_GIVEN]


def normalize_blocks(items: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Blocks from typed items (``item_columns`` plus document_id, page_idx, item_index).

    An item's own page size wins over ``sizes``. The default reading order is the
    item's index in its document, dropped items counted. Rows with neither text
    nor image are dropped.
    """
    rows = items.withColumn("page_idx", page_index(F.col("page_idx"), F.col("page_no")))
    own = F.when(F.size("item_size") > 0, F.col("item_size"))
    if sizes is None:
        rows = rows.withColumn("page_size", own)
    else:
        rows = rows.join(sizes, ["document_id", "page_idx"], "left").withColumn("page_size", F.coalesce(own, "page_size"))
    chunk = F.col("chunk_id") if "chunk_id" in items.columns else F.lit(None).cast("string")
    return (
        rows.withColumn("text", block_text(F.col("body"), F.col("caption")))
        .filter("text is not null or image_path is not null")
        .select(
            F.concat_ws("-", "document_id", "item_index").alias("id"),
            "document_id",
            (F.col("page_idx") + 1).cast("int").alias("page_no"),
            F.col("type").alias("block_type"),
            "text",
            G.raw_bbox(F.col("bbox")).alias("bbox"),
            G.normalize_bbox(F.col("bbox"), F.col("page_size")).alias("bbox_norm"),
            "image_path",
            F.coalesce("own_order", F.col("item_index").try_cast("int")).alias("reading_order"),
            F.struct(
                "text_level",
                "sub_type",
                "page_size",
                "table_body",
                "table_caption",
                "table_footnote",
                "image_footnote",
                chunk.alias("chunk_id"),
            ).alias("meta"),
        )
    )
