"""Queries: layout JSON, overlap merge and block normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import views as D
from leafmill.fixtures.registry import query, view
from leafmill.functions import geometry as G
from leafmill.functions import variants as V
from leafmill.operators import blocks as B
from leafmill.operators import merge as M
from leafmill.plans.parse import merged_items, parse_documents, scanned_items, scanned_trees
from leafmill.sources import layout as L

KEYS = ["document_id", "chunk_ord"]

# Pages seen from completed windows: the first window with the page owns it.
view(
    "owned_rows",
    """
SELECT r.* FROM layout_rows r JOIN (SELECT document_id, page, min(chunk_ord) AS owner FROM layout_rows WHERE status = 'completed' GROUP BY 1, 2) o
  ON r.document_id = o.document_id AND r.page = o.page AND r.chunk_ord = o.owner
""",
)


@query("layout_items_scan", "SELECT document_id, chunk_ord, cast(pos AS integer) AS pos, cast(local_page AS integer) AS page_idx, CASE WHEN p % 3 = 0 THEN '' ELSE t END AS text FROM layout_rows")
def _(spark, sf):
    scan = L.layout_items_scan(D.payloads(spark, sf), KEYS)
    return scan.select(*KEYS, "pos", "page_idx", F.try_variant_get("item", "$.text", "string").alias("text"))


@query(
    "join_text",
    """
SELECT document_id, chunk_ord, cast(pos AS integer) AS pos,
  CASE WHEN p % 3 = 0 THEN CASE WHEN trim(t) = '' THEN 'end' ELSE trim(t) || chr(10) || 'end' END ELSE nullif(trim(t), '') END AS text FROM layout_rows
""",
)
def _(spark, sf):
    scan = L.layout_items_scan(D.payloads(spark, sf), KEYS)
    texts = scan.withColumn("v", F.array(V.first_truthy("item", "text", "content"))).withColumn("t", V.join_texts("v"))
    return texts.select(*KEYS, "pos", F.get("t", F.lit(0)).alias("text"))


@query(
    "rebase_page",
    "SELECT document_id, chunk_ord, cast(pos AS integer) AS pos, cast(page AS integer) AS page_idx, chunk_id FROM layout_rows",
)
def _(spark, sf):
    scan = L.layout_items_scan(D.payloads(spark, sf), KEYS).select(*KEYS, "pos", "page_idx")
    return M.rebase_page(scan, D.chunks(spark, sf)).select(*KEYS, "pos", "page_idx", "chunk_id")


def _global_items(spark, sf):
    scan = L.layout_items_scan(D.payloads(spark, sf), KEYS).select(*KEYS, "pos", "page_idx")
    return M.rebase_page(scan, D.chunks(spark, sf).filter("status = 'completed'"))


@query("overlap_keep_first", "SELECT document_id, chunk_ord, cast(pos AS integer) AS pos, cast(page AS integer) AS page_idx FROM owned_rows")
def _(spark, sf):
    return M.overlap_keep_first(_global_items(spark, sf)).select(*KEYS, "pos", "page_idx")


@query(
    "overlap_keep_all",
    "SELECT document_id, cast(page AS integer) AS page_idx, count(*) AS items, count(DISTINCT chunk_ord) AS copies FROM layout_rows WHERE status = 'completed' GROUP BY 1, 2",
)
def _(spark, sf):
    kept = M.overlap_keep_all(_global_items(spark, sf))
    per = kept.groupBy("document_id", "page_idx", "chunk_ord").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("document_id", "page_idx").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("copies"))


@query(
    "image_path_rewrite",
    """
SELECT document_id, chunk_ord, cast(pos AS integer) AS pos,
  CASE WHEN p % 5 = 0 THEN concat('images/', CASE WHEN p % 10 = 0 THEN chunk_id || '_' ELSE '' END, p, '.png') END AS image_path FROM layout_rows
""",
)
def _(spark, sf):
    items = B.item_columns(L.layout_items_scan(D.payloads(spark, sf), KEYS), [*KEYS, "pos", "page_idx"])
    tagged = M.rebase_page(items.select(*KEYS, "pos", "page_idx", "image_path"), D.chunks(spark, sf))
    name = F.regexp_extract("image_path", r"[^/]+$", 0)
    owned = tagged.filter(F.regexp_extract(name, r"^\d+", 0).try_cast("int") % 10 == 0).select(*KEYS, name.alias("name"))
    return M.image_path_rewrite(tagged, owned).select(*KEYS, "pos", "image_path")


def _tree_pages(spark, sf):
    return scanned_trees(D.page_trees(spark, sf), D.chunks(spark, sf).withColumn("status", F.lit("completed")))


def _half_empty(spark, sf):
    """Item lists of all documents; those of odd ones are empty, so that their trees stand in."""
    even = F.col("document_id").cast("bigint") % 2 == 0
    return D.payloads(spark, sf).withColumn("payload", F.when(even, F.col("payload")).otherwise("[]"))


@query("page_tree_keep_first", "SELECT document_id, cast(page AS integer) AS page_idx, min(chunk_ord) AS chunk_ord FROM layout_rows GROUP BY 1, 2")
def _(spark, sf):
    return M.page_tree_keep_first(_tree_pages(spark, sf)).select("document_id", "page_idx", "chunk_ord")


@query(
    "page_sizes",
    """
SELECT DISTINCT document_id, cast(page AS integer) AS page_idx, CASE WHEN page % 2 = 0 THEN 600.0::double + page ELSE 500.0::double END AS w, CASE WHEN page % 2 = 0 THEN 800.0::double ELSE 700.0::double END AS h
FROM layout_rows
""",
)
def _(spark, sf):
    pages = M.page_tree_keep_first(_tree_pages(spark, sf))
    supplied = pages.select("document_id", "page_idx", F.array(F.lit(500.0), F.lit(700.0)).alias("page_size"))
    s = L.page_sizes(pages, supplied)
    return s.select("document_id", "page_idx", F.col("page_size")[0].alias("w"), F.col("page_size")[1].alias("h"))


@query(
    "page_tree_scan",
    """
SELECT document_id, chunk_ord, cast(page AS integer) AS page_idx, cast(p % 20 AS integer) AS reading_order, 'text' AS type, t AS text FROM layout_rows r
WHERE cast(document_id AS bigint) % 2 = 1 AND chunk_ord = (SELECT min(chunk_ord) FROM layout_rows m WHERE m.document_id = r.document_id AND m.page = r.page)
""",
)
def _(spark, sf):
    # Even documents have items, so their trees are not read.
    items = L.layout_items_scan(_half_empty(spark, sf), KEYS)
    scan = L.page_tree_scan(M.page_tree_keep_first(L.without_items(_tree_pages(spark, sf), items)), KEYS)
    return scan.select(*KEYS, "page_idx", "reading_order", "type", "text")


@query(
    "page_number",
    """
SELECT event_id, cast(CASE WHEN coalesce(a, 0) <> 0 THEN a + 1 WHEN coalesce(b, 0) <> 0 THEN b ELSE 1 END AS integer) AS page_no
FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS a, CASE WHEN event_id % 4 > 0 THEN event_id % 7 END AS b FROM events)
""",
)
def _(spark, sf):
    e = D.table(spark, sf, "events").selectExpr(
        "event_id",
        "case when event_id % 3 > 0 then cast(event_id % 5 as int) end as a",
        "case when event_id % 4 > 0 then cast(event_id % 7 as int) end as b",
    )
    return e.select("event_id", B.page_number(F.col("a"), F.col("b")).cast("int").alias("page_no"))


BOXES = """
WITH e AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 2.5 ELSE 0.2 END::double AS f,
  o_orderkey % 3 AS k, o_totalprice % 600 AS a, o_totalprice % 401 AS b FROM orders),
x AS (SELECT *, a * f AS x1, b * f AS y1, (a + 100) * f AS x2, (b + 50) * f AS y2 FROM e),
n AS (SELECT *, greatest(x1, y1, x2, y2) AS top FROM x),
s AS (SELECT *, CASE WHEN top <= 1 THEN 1.0 WHEN k > 0 AND x2 <= 595 * 1.05 AND y2 <= 842 * 1.05 THEN 595.0 WHEN top <= 1000 THEN 1000.0 WHEN k > 0 THEN 595.0 ELSE 1.0 END::double AS sx,
  CASE WHEN top <= 1 THEN 1.0 WHEN k > 0 AND x2 <= 595 * 1.05 AND y2 <= 842 * 1.05 THEN 842.0 WHEN top <= 1000 THEN 1000.0 WHEN k > 0 THEN 842.0 ELSE 1.0 END::double AS sy FROM n)
"""


@query(
    "normalize_bbox",
    BOXES
    + """
SELECT id, round(greatest(0.0, least(1.0, x1 / sx)), 6) AS x1, round(greatest(0.0, least(1.0, y1 / sy)), 6) AS y1,
  round(greatest(0.0, least(1.0, x2 / sx)), 6) AS x2, round(greatest(0.0, least(1.0, y2 / sy)), 6) AS y2 FROM s
""",
)
def _(spark, sf):
    o = D.table(spark, sf, "orders").selectExpr(
        "o_orderkey as id",
        "case o_orderkey % 4 when 0 then 0.001D when 1 then 1.0D when 2 then 2.5D else 0.2D end as f",
        "case when o_orderkey % 3 > 0 then array(595.0D, 842.0D) end as size",
        "o_totalprice % 600 as a",
        "o_totalprice % 401 as b",
    )
    o = o.selectExpr("id", "size", "array(a * f, b * f, (a + 100) * f, (b + 50) * f) as bbox")
    n = o.select("id", G.normalize_bbox(F.col("bbox"), F.col("size")).alias("n"))
    return n.select("id", *[F.round(F.col("n")[i], 6).alias(c) for i, c in enumerate(["x1", "y1", "x2", "y2"])])


# Block text of a layout row: body, with the figure caption line before it.
view(
    "block_rows",
    """
SELECT document_id, chunk_ord, chunk_id, page, p, row_number() OVER (PARTITION BY document_id ORDER BY chunk_ord, pos) - 1 AS idx,
  CASE WHEN p % 7 = 1 THEN 'title' ELSE 'text' END AS block_type,
  CASE WHEN p % 5 <> 0 THEN body WHEN body IS NULL THEN 'Fig ' || p WHEN contains(body, 'Fig ' || p) THEN body ELSE 'Fig ' || p || chr(10) || body END AS text,
  CASE WHEN p % 5 = 0 THEN concat('img/x/', p, '.png') END AS image_path
FROM (SELECT *, CASE WHEN p % 3 = 0 THEN CASE WHEN trim(t) = '' THEN 'end' ELSE trim(t) || chr(10) || 'end' END
    WHEN t <> '' THEN nullif(trim(t), '') WHEN p % 5 = 0 THEN 'Fig ' || p END AS body FROM owned_rows)
""",
)

NORMALIZED = """
SELECT document_id, cast(page + 1 AS integer) AS page_no, cast(idx AS integer) AS reading_order, block_type, text, image_path, chunk_id,
  round(p % 5 * 100.0::double / 1000, 6) AS x1, round((p % 20 * 40.0::double + 35) / 1000, 6) AS y2
FROM block_rows WHERE text IS NOT NULL OR image_path IS NOT NULL
"""


def _flat_blocks(b):
    return b.select(
        "document_id", "page_no", "reading_order", "block_type", "text", "image_path", F.col("meta.chunk_id").alias("chunk_id"),
        F.round(F.col("bbox_norm")[0], 6).alias("x1"), F.round(F.col("bbox_norm")[3], 6).alias("y2"),
    )


@query("normalize_blocks", NORMALIZED)
def _(spark, sf):
    return _flat_blocks(B.normalize_blocks(merged_items(scanned_items(D.payloads(spark, sf), D.chunks(spark, sf)))))


@query(
    "parse_documents",
    """
WITH own AS (SELECT document_id, page, min(chunk_ord) AS chunk_ord FROM layout_rows WHERE status = 'completed' GROUP BY 1, 2)
SELECT document_id, cast(page + 1 AS integer) AS page_no, cast(idx AS integer) AS reading_order, block_type, text, chunk_id FROM block_rows
WHERE cast(document_id AS bigint) % 2 = 0 AND (text IS NOT NULL OR image_path IS NOT NULL)
UNION ALL
SELECT r.document_id, cast(r.page + 1 AS integer), cast(r.p % 20 AS integer), 'text', trim(r.t), NULL FROM layout_rows r JOIN own o
  ON r.document_id = o.document_id AND r.page = o.page AND r.chunk_ord = o.chunk_ord
WHERE cast(r.document_id AS bigint) % 2 = 1 AND trim(r.t) <> ''
""",
)
def _(spark, sf):
    out = parse_documents(_half_empty(spark, sf), D.chunks(spark, sf), trees=D.page_trees(spark, sf))
    return out.select("document_id", "page_no", "reading_order", "block_type", "text", F.col("meta.chunk_id").alias("chunk_id"))


@query(
    "merged_markdown",
    """
WITH m AS (SELECT document_id, chunk_ord, chunk_id, start_page, end_page, min(chunk_ord) OVER w AS a, max(chunk_ord) OVER w AS z,
    concat('window ', chunk_ord, chr(10), ' ', chr(10)) AS text FROM chunks WHERE status = 'completed' WINDOW w AS (PARTITION BY document_id)),
b AS (SELECT *, concat(CASE WHEN chunk_ord = a THEN '' ELSE chr(10) || chr(10) END, '<!-- mineru-chunk ', chunk_id, ' pages ', start_page + 1, '-', end_page + 1, ' -->', chr(10), chr(10), text) AS body FROM m)
SELECT document_id, chunk_ord, CASE WHEN chunk_ord = z THEN regexp_replace(body, '\\s+$', '') || chr(10) ELSE body END AS piece FROM b
""",
)
def _(spark, sf):
    c = D.chunks(spark, sf).withColumn(
        "text", F.when(F.col("status") == "completed", F.concat(F.lit("window "), "chunk_ord", F.lit("\n \n")))
    )
    return M.merged_markdown(c)
