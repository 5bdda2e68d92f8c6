"""Page-level reads: blocks, search, counts, markdown, labels, hit test, page view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import text as X
from leafmill.functions.ordering import first_n_per_key, gather, gather_text

ORDER = ["reading_order", "id"]


def blocks_by_page(blocks: DataFrame, document_id: str | None = None, page_no: int | None = None) -> DataFrame:
    """Blocks in page order; page 0 or none means every page.

    Without a document, order holds inside each page; pages lie in no order.
    """
    out = blocks
    if document_id is not None:
        out = out.filter(F.col("document_id") == document_id)
    if page_no:
        out = out.filter(F.col("page_no") == page_no)
    if document_id is None:
        return out.repartition("document_id", "page_no").sortWithinPartitions("document_id", "page_no", *ORDER)
    return out.orderBy("page_no", *ORDER)


def json_page(provenance_json: Column) -> Column:
    """Page of a JSON provenance text: page_no, else page, as an integer."""
    value = F.coalesce(F.get_json_object(provenance_json, "$.page_no"), F.get_json_object(provenance_json, "$.page"))
    return value.try_cast("double").try_cast("int")


def json_page_filter(records: DataFrame, page_no: int | None, provenance: str = "provenance_json") -> DataFrame:
    return records.filter(json_page(F.col(provenance)) == page_no) if page_no else records


def records_by_page(records: DataFrame, document_id: str | None = None, page_no: int | None = None) -> DataFrame:
    """Reactions or table records in creation order."""
    out = records
    if document_id is not None:
        out = out.filter(F.col("document_id") == document_id)
    if page_no:
        out = out.filter(F.col("provenance.page_no") == page_no)
    return out.orderBy("document_id", "created_at", "id")


def search_blocks(blocks: DataFrame, query: str, document_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Matching blocks: all, or the first ``limit`` per document by (page, order)."""
    hits = blocks.filter(X.like_ascii(F.col("text"), query))
    if document_id is not None:
        hits = hits.filter(F.col("document_id") == document_id)
    if limit is None:
        return hits
    return first_n_per_key(hits, ["document_id"], ["page_no", *ORDER], limit)


def figure_filter(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("block_type").isin(*X.FIGURE_TYPES))


def table_block_filter(blocks: DataFrame) -> DataFrame:
    return blocks.filter(X.is_table_block(F.col("block_type"), F.col("text"), F.col("meta.table_body")))


def interesting_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(X.interesting(F.col("text"), F.col("block_type")))


def block_labels(blocks: DataFrame) -> DataFrame:
    """One row per (block, label); labels overlap."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def test(pattern: str | None, types: list[str]) -> Column:
        by_type = F.col("block_type").isin(*types) if types else F.lit(False)
        return by_type | text.rlike(pattern) if pattern else by_type

    labels = F.array_compact(F.array(*[F.when(test(p, t), F.lit(n)) for n, p, t in X.LABEL_PATTERNS]))
    return blocks.withColumn("label", F.explode(labels))


def counts_by_page(rows: DataFrame, page: str = "page_no") -> DataFrame:
    """Rows per (document, page) with the document total beside.

    Totals come from the page counts, and are joined rather than windowed, so a
    document with very many pages is not pulled into one task.
    """
    per_page = rows.groupBy("document_id", page).agg(F.count(F.lit(1)).alias("page_count"))
    totals = per_page.groupBy("document_id").agg(F.sum("page_count").alias("total_count"))
    return per_page.join(totals, "document_id")


def page_coverage(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Highest page and block count of every document, zeros when it has none."""
    agg = blocks.groupBy("document_id").agg(F.max("page_no").alias("max_page"), F.count(F.lit(1)).alias("block_count"))
    return documents.select(F.col("id").alias("document_id")).join(agg, "document_id", "left").na.fill(
        0, ["max_page", "block_count"]
    )


def page_text(blocks: DataFrame) -> DataFrame:
    return gather_text(blocks, ["document_id", "page_no"], ORDER, F.coalesce("text", F.lit("")), "\n", "page_text")


def _markdown_part(text: Column, block_type: Column) -> Column:
    return F.coalesce(X.truthy(X.strip(text)), F.concat(F.lit("*["), block_type, F.lit("]*")))


def _markdown_page(page_no: Column, body: Column) -> Column:
    return F.concat(F.format_string(X.PAGE_HEADING, page_no), F.lit("\n\n"), body, F.lit("\n"))


def page_markdown(blocks: DataFrame) -> DataFrame:
    """Heading, then each block's text (or its type in italics), blank line between."""
    part = _markdown_part(F.col("text"), F.col("block_type"))
    body = gather_text(blocks, ["document_id", "page_no"], ORDER, part, "\n\n", "body")
    return body.select("document_id", "page_no", _markdown_page(F.col("page_no"), F.col("body")).alias("markdown"))


def page_manifest(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Every page 1..N of each document with its image path, if any."""
    pages = documents.filter("page_count > 0").select(
        F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no")
    )
    pick = images.groupBy("document_id", "page_no").agg(F.min("path").alias("image_path"))
    return pages.join(pick, ["document_id", "page_no"], "left")


def union_bbox(blocks: DataFrame) -> DataFrame:
    box = G.union_bbox_agg(F.col("bbox_norm"))
    return blocks.groupBy("document_id", "page_no").agg(box.alias("bbox"))


# ---- hit test ----------------------------------------------------------------
# A box lies in the square grid whose cells are a half of its longer side or more, but
# less than the whole, so it reaches at most 3 x 3 cells.
COARSEST, FINEST = 1, 12  # log2 of the cells along a page


def hit_union(blocks: DataFrame, reactions: DataFrame, tables: DataFrame) -> DataFrame:
    """Boxes of all three kinds: document_id, page_no, kind_rank, kind, id, bbox."""

    def four(c: str) -> Column:
        return F.size(c) == 4

    block_box = F.when(four("bbox_norm"), F.col("bbox_norm")).when(four("bbox"), F.col("bbox"))
    parts = [
        blocks.select("document_id", "page_no", F.lit(0).alias("kind_rank"), F.lit("block").alias("kind"), "id", block_box.alias("bbox"),
                      F.struct("page_no", "reading_order", F.lit("").alias("t"), "id").alias("seq")),
    ]
    for rank, (kind, df) in enumerate([("reaction", reactions), ("table", tables)], start=1):
        box = F.when(four("provenance.bbox"), F.col("provenance.bbox"))
        parts.append(
            df.select("document_id", F.coalesce("provenance.page_no", F.lit(0)).alias("page_no"), F.lit(rank).alias("kind_rank"),
                      F.lit(kind).alias("kind"), "id", box.alias("bbox"),
                      F.struct(F.lit(0).alias("page_no"), F.lit(0).alias("reading_order"), F.col("created_at").cast("string").alias("t"), "id").alias("seq"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("bbox is not null")


def _cell(c: Column) -> Column:
    """Cell of a coordinate in the row's own grid; the outer cells reach past the page."""
    cells = F.pow(F.lit(2.0), F.col("_level"))
    return F.least(F.greatest(F.floor(c * cells), F.lit(0)), cells.cast("bigint") - 1).cast("int")


def hit_test(clicks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Smallest box containing each click, ties by kind then input order.

    Each box is stored once per cell it reaches in the grid of its own size, and a
    click looks into one cell of every grid that its page has boxes in. Where boxes cover a whole cell only the
    best of them can win there, so one per cell is kept, and partly covering boxes
    that rank behind it are dropped before the join.
    """
    page = ["document_id", "page_no"]
    b = boxes.withColumns(
        {
            "_l": F.least(F.col("bbox")[0], F.col("bbox")[2]),
            "_r": F.greatest(F.col("bbox")[0], F.col("bbox")[2]),
            "_t": F.least(F.col("bbox")[1], F.col("bbox")[3]),
            "_b": F.greatest(F.col("bbox")[1], F.col("bbox")[3]),
            "_rank": F.struct(G.area(F.col("bbox")).alias("area"), F.col("kind_rank"), F.col("seq")),
        }
    )
    side = F.greatest(F.col("_r") - F.col("_l"), F.col("_b") - F.col("_t"))
    fitting = F.coalesce(F.floor(-F.log2(side)) + COARSEST, F.lit(FINEST))
    b = b.withColumn("_level", F.least(F.greatest(fitting, F.lit(COARSEST)), F.lit(FINEST)).cast("int"))

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(_cell(F.col(low)), _cell(F.col(high))))

    # Cells strictly between the corner cells lie inside the box.
    inner = [F.col(c) > _cell(F.col(low)) for c, low in (("_cx", "_l"), ("_cy", "_t"))]
    inner += [F.col(c) < _cell(F.col(high)) for c, high in (("_cx", "_r"), ("_cy", "_b"))]
    spread = b.withColumn("_cx", cells("_l", "_r")).withColumn("_cy", cells("_t", "_b"))
    spread = spread.withColumn("_full", inner[0] & inner[1] & inner[2] & inner[3])
    cell = [*page, "_level", "_cx", "_cy"]
    box = ["kind", "id", "bbox", "_rank", "_l", "_r", "_t", "_b"]
    full = spread.filter("_full").groupBy(*cell).agg(F.min_by(F.struct(*box), "_rank").alias("_best"))
    partial = (
        spread.filter("not _full")
        .select(*cell, *box)
        .join(full.select(*cell, F.col("_best._rank").alias("_limit")), cell, "left")
        .filter(F.col("_limit").isNull() | (F.col("_rank") < F.col("_limit")))
        .drop("_limit")
    )
    targets = partial.unionByName(full.select(*cell, "_best.*"))
    # Grids in use, a bit each; a page without boxes drops its clicks here.
    used = b.groupBy(*page).agg(F.expr("bit_or(shiftleft(1, _level))").alias("_used"))
    levels = F.expr(f"filter(sequence({COARSEST}, {FINEST}), v -> shiftright(_used, v) % 2 = 1)")
    points = clicks.join(used, page).withColumn("_level", F.explode(levels)).drop("_used")
    points = points.withColumns({"_cx": _cell(F.col("x")), "_cy": _cell(F.col("y"))})
    inside = (F.col("x") >= F.col("_l")) & (F.col("x") <= F.col("_r")) & (F.col("y") >= F.col("_t")) & (F.col("y") <= F.col("_b"))
    pairs = points.join(targets, cell).filter(inside)
    return (
        pairs.groupBy("click_id")
        .agg(F.min_by(F.struct(*page, "kind", "id", "bbox"), "_rank").alias("h"))
        .select("click_id", "h.*")
    )


def page_view(documents: DataFrame, blocks: DataFrame, reactions: DataFrame, tables: DataFrame) -> DataFrame:
    """Everything one page shows: markdown, the records of each kind and the counts."""
    key = ["document_id", "page_no"]
    paged = {
        "blocks": (blocks, ORDER),
        "reactions": (reactions.withColumn("page_no", F.col("provenance.page_no")), ["_at", "id"]),
        "tables": (tables.withColumn("page_no", F.col("provenance.page_no")), ["_at", "id"]),
    }
    # Totals, from one pass over document ids, meet a document's one row; lists meet its pages.
    kinds = None
    for name, (df, _) in paged.items():
        kind = df.select("document_id", F.lit(name).alias("_kind"))
        kinds = kind if kinds is None else kinds.unionByName(kind)
    totals = kinds.groupBy("document_id").agg(*[F.count_if(F.col("_kind") == n).alias(f"{n}_total") for n in paged])
    held = documents.filter("page_count > 0").select(F.col("id").alias("document_id"), F.col("page_count").alias("document_pages")).join(totals, "document_id", "left")
    out = held.select("document_id", "document_pages", F.explode(F.sequence(F.lit(1), F.col("document_pages"))).alias("page_no"), *[f"{n}_total" for n in paged])
    for name, (df, order) in paged.items():
        if "_at" in order:
            df = df.withColumn("_at", F.unix_micros("created_at"))
        lists = gather(df, key, order, **{name: F.struct(*[c for c in df.columns if c not in ("_at", *key)])})
        out = out.join(lists, key, "left")
    # A page's counts and its markdown come from its lists.
    parts = F.transform("blocks", lambda r: _markdown_part(r["text"], r["block_type"]))
    out = out.withColumn("markdown", _markdown_page(F.col("page_no"), F.array_join(parts, "\n\n")))
    out = out.withColumns({f"{n}_on_page": F.when(F.col(n).isNotNull(), F.size(n)).otherwise(0).cast("bigint") for n in paged})
    return out.na.fill(0, [f"{n}_total" for n in paged]).na.fill("", ["markdown"])
