"""Queries: page reads, filters, counts, search and hit test."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import views as D
from leafmill.fixtures.registry import query
from leafmill.functions import text as X
from leafmill.operators import views as V

BLOCK_COLS = ["document_id", "page_no", "reading_order", "id", "block_type", "text"]


@query("blocks_by_page", "SELECT document_id, page_no, reading_order, id, block_type, text FROM blocks WHERE page_no = 2")
def _(spark, sf):
    return V.blocks_by_page(D.blocks(spark, sf), page_no=2).select(*BLOCK_COLS)


@query(
    "page_text",
    """
SELECT document_id, page_no, string_agg(coalesce(text, ''), chr(10) ORDER BY reading_order, id) AS page_text
FROM blocks GROUP BY ALL
UNION ALL
SELECT document_id, page_no, string_agg(coalesce(text, ''), chr(10) ORDER BY reading_order, id) AS page_text
FROM entry_blocks GROUP BY ALL
""",
)
def _(spark, sf):
    return V.page_text(D.blocks(spark, sf)).unionByName(V.page_text(D.entry_blocks(spark, sf)))


@query(
    "page_markdown",
    """
SELECT document_id, page_no, concat('## 第 ', page_no, ' 页', chr(10), chr(10),
  string_agg(CASE WHEN t = '' THEN concat('*[', block_type, ']*') ELSE t END, chr(10) || chr(10) ORDER BY reading_order, id), chr(10)) AS markdown
FROM (SELECT *, regexp_replace(coalesce(text, ''), '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g') AS t
  FROM (SELECT document_id, page_no, reading_order, id, block_type, text FROM blocks
        UNION ALL SELECT document_id, page_no, reading_order, id, block_type, text FROM web_blocks))
GROUP BY document_id, page_no
""",
)
def _(spark, sf):
    cols = ["document_id", "page_no", "reading_order", "id", "block_type", "text"]
    return V.page_markdown(D.blocks(spark, sf).select(*cols).unionByName(D.web_blocks(spark, sf).select(*cols)))


@query(
    "counts_by_page",
    """
SELECT 'block' AS kind, document_id, page_no, count(*) AS page_count, sum(count(*)) OVER (PARTITION BY document_id)::bigint AS total_count
FROM blocks GROUP BY document_id, page_no
UNION ALL
SELECT 'reaction', document_id, page_no, count(*), sum(count(*)) OVER (PARTITION BY document_id)::bigint FROM reactions GROUP BY document_id, page_no
UNION ALL
SELECT 'table', document_id, page_no, count(*), sum(count(*)) OVER (PARTITION BY document_id)::bigint FROM table_records GROUP BY document_id, page_no
""",
)
def _(spark, sf):
    sides = [("block", D.blocks(spark, sf))]
    for kind, df in (("reaction", D.reactions(spark, sf)), ("table", D.table_records(spark, sf))):
        sides.append((kind, df.select("document_id", F.col("provenance.page_no").alias("page_no"))))
    parts = [V.counts_by_page(df).select(F.lit(k).alias("kind"), "document_id", "page_no", "page_count", "total_count") for k, df in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "page_coverage",
    """
SELECT d.id AS document_id, coalesce(max(b.page_no), 0)::integer AS max_page, count(b.id) AS block_count
FROM documents_cat d LEFT JOIN blocks b ON b.document_id = d.id GROUP BY d.id
""",
)
def _(spark, sf):
    return V.page_coverage(D.documents_cat(spark, sf), D.blocks(spark, sf))


@query(
    "search_blocks",
    "SELECT document_id, page_no, reading_order, id, block_type, text FROM blocks WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th%on_re%'",
)
def _(spark, sf):
    return V.search_blocks(D.blocks(spark, sf), "TH%on_re", limit=None).select(*BLOCK_COLS)


@query(
    "search_top30",
    """
SELECT document_id, page_no, reading_order, id, block_type FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_no, reading_order, id) AS rn
  FROM blocks WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%en%') WHERE rn <= 30
""",
)
def _(spark, sf):
    return V.search_blocks(D.blocks(spark, sf), "En", limit=30).select("document_id", "page_no", "reading_order", "id", "block_type")


@query("figure_filter", "SELECT document_id, page_no, reading_order, id, block_type, image_path FROM blocks WHERE block_type IN ('image','table','chart','figure')")
def _(spark, sf):
    return V.figure_filter(D.blocks(spark, sf)).select("document_id", "page_no", "reading_order", "id", "block_type", "image_path")


@query(
    "table_block_filter",
    """
SELECT id, document_id, page_no FROM blocks WHERE block_type = 'table'
UNION ALL SELECT DISTINCT block_id, document_id, page_no FROM table_cells_rel
""",
)
def _(spark, sf):
    cols = ["id", "document_id", "page_no"]
    plain = D.blocks(spark, sf).unionByName(D.html_blocks(spark, sf), allowMissingColumns=True)
    return V.table_block_filter(plain).select(*cols)


HINT = "(反应|催化|酯化|萃取|scheme|reaction|yield|产率|catalyst|smiles|→|->|>>|℃|°c|substrate|reagent|afford|product [0-9])"


@query(
    "interesting_blocks",
    f"""
SELECT id, document_id, page_no, block_type FROM (
  SELECT id, document_id, page_no, block_type, text FROM blocks UNION ALL SELECT id, document_id, page_no, block_type, text FROM entry_blocks)
WHERE regexp_matches(coalesce(text, ''), '{HINT}', 'i') OR block_type IN ('image','table','chart','equation')
""",
)
def _(spark, sf):
    cols = ["id", "document_id", "page_no", "block_type", "text"]
    both = D.blocks(spark, sf).select(*cols).unionByName(D.entry_blocks(spark, sf).select(*cols))
    return V.interesting_blocks(both).drop("text")


@query(
    "block_labels",
    """
WITH b AS (SELECT id, document_id, block_type, coalesce(text, '') AS t FROM blocks UNION ALL SELECT id, document_id, block_type, coalesce(text, '') FROM entry_blocks)
SELECT id, document_id, 'molecule' AS label FROM b WHERE regexp_matches(t, 'mol|smiles|compound|化合物', 'i')
UNION ALL SELECT id, document_id, 'reaction' FROM b WHERE regexp_matches(t, '反应|reaction|scheme|yield|产率|>>|→', 'i') OR block_type IN ('image','table','equation')
UNION ALL SELECT id, document_id, 'table' FROM b WHERE block_type = 'table'
UNION ALL SELECT id, document_id, 'figure' FROM b WHERE block_type IN ('image','chart')
UNION ALL SELECT id, document_id, 'formula' FROM b WHERE block_type IN ('equation','equation_interline')
""",
)
def _(spark, sf):
    cols = ["id", "document_id", "block_type", "text"]
    both = D.blocks(spark, sf).select(*cols).unionByName(D.entry_blocks(spark, sf).select(*cols))
    return V.block_labels(both).select("id", "document_id", "label")


@query(
    "page_manifest",
    """
SELECT p.document_id, p.page_no, min(i.path) AS image_path
FROM (SELECT id AS document_id, cast(unnest(range(1, page_count + 1)) AS integer) AS page_no FROM documents_cat) p
LEFT JOIN page_images i USING (document_id, page_no) GROUP BY p.document_id, p.page_no
""",
)
def _(spark, sf):
    from leafmill.sources.files import page_image_listing

    return V.page_manifest(D.documents_cat(spark, sf), page_image_listing(D.page_images(spark, sf)))


@query(
    "union_bbox",
    """
SELECT document_id, page_no, round(min(bbox_norm[1]), 6) AS x1, round(min(bbox_norm[2]), 6) AS y1, round(max(bbox_norm[3]), 6) AS x2, round(max(bbox_norm[4]), 6) AS y2
FROM blocks GROUP BY document_id, page_no
""",
)
def _(spark, sf):
    box = V.union_bbox(D.blocks(spark, sf))
    names = ["x1", "y1", "x2", "y2"]
    return box.select("document_id", "page_no", *[F.round(F.col("bbox")[i], 6).alias(n) for i, n in enumerate(names)])


@query(
    "json_page_filter",
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 9 WHEN 1 THEN cast(json_extract_string(props, '$.k') AS bigint) END::integer AS page FROM events
WHERE CASE event_id % 4 WHEN 0 THEN event_id % 9 WHEN 1 THEN cast(json_extract_string(props, '$.k') AS bigint) END = 5
""",
)
def _(spark, sf):
    e = D.table(spark, sf, "events").selectExpr(
        "event_id",
        "case event_id % 4 when 0 then concat('{\"page_no\":', event_id % 9, ',\"page\":7}') when 1 then concat('{\"page\":\"', get_json_object(props, '$.k'), '\"}')"
        " when 2 then '{\"page_no\":\"x\"}' else 'bad' end as provenance_json",
    )
    return V.json_page_filter(e, 5).select("event_id", V.json_page(F.col("provenance_json")).alias("page"))


HIT_BOXES = """
box AS (
  SELECT document_id, page_no, 0 AS k, 'block' AS kind, id, bbox_norm AS b, lpad(cast(reading_order AS varchar), 9, '0') || id AS seq FROM blocks
  UNION ALL SELECT document_id, page_no, 1, 'reaction', id, bbox, cast(created_at AS varchar) || id FROM reactions
  UNION ALL SELECT document_id, page_no, 2, 'table', id, bbox, cast(created_at AS varchar) || id FROM table_records)
"""


@query("hit_union", f"WITH {HIT_BOXES.strip()} SELECT kind, document_id, page_no, id, round(b[1], 6) AS x1, round(b[4], 6) AS y2 FROM box")
def _(spark, sf):
    boxes = V.hit_union(D.blocks(spark, sf), D.reactions(spark, sf), D.table_records(spark, sf))
    return boxes.select("kind", "document_id", "page_no", "id", F.round(F.col("bbox")[0], 6).alias("x1"), F.round(F.col("bbox")[3], 6).alias("y2"))


@query(
    "hit_test",
    f"""
WITH {HIT_BOXES.strip()}
SELECT click_id, kind, id, document_id, page_no FROM (
  SELECT c.click_id, b.kind, b.id, c.document_id, c.page_no,
    row_number() OVER (PARTITION BY c.click_id ORDER BY abs(b.b[3] - b.b[1]) * abs(b.b[4] - b.b[2]), b.k, b.seq) AS rn
  FROM clicks c JOIN box b ON c.document_id = b.document_id AND c.page_no = b.page_no
    AND c.x BETWEEN least(b.b[1], b.b[3]) AND greatest(b.b[1], b.b[3]) AND c.y BETWEEN least(b.b[2], b.b[4]) AND greatest(b.b[2], b.b[4]))
WHERE rn = 1
""",
)
def _(spark, sf):
    boxes = V.hit_union(D.blocks(spark, sf), D.reactions(spark, sf), D.table_records(spark, sf))
    return V.hit_test(D.clicks(spark, sf), boxes).select("click_id", "kind", "id", "document_id", "page_no")


@query(
    "page_view",
    """
WITH spine AS (SELECT id AS document_id, cast(unnest(range(1, page_count + 1)) AS integer) AS page_no FROM documents_cat),
bm AS (SELECT document_id, page_no, count(*) AS n, string_agg(id, ',' ORDER BY reading_order, id) AS ids FROM blocks GROUP BY ALL),
rm AS (SELECT document_id, page_no, count(*) AS n, string_agg(id, ',' ORDER BY created_at, id) AS ids FROM reactions GROUP BY ALL),
tm AS (SELECT document_id, page_no, count(*) AS n, string_agg(id, ',' ORDER BY created_at, id) AS ids FROM table_records GROUP BY ALL)
SELECT s.document_id, s.page_no, bm.ids AS block_ids, rm.ids AS reaction_ids, tm.ids AS table_ids,
  coalesce(bm.n, 0) AS blocks_on_page, coalesce(rm.n, 0) AS reactions_on_page, coalesce(tm.n, 0) AS tables_on_page,
  coalesce(bt.n, 0)::bigint AS blocks_total, coalesce(rt.n, 0)::bigint AS reactions_total, coalesce(tt.n, 0)::bigint AS tables_total
FROM spine s LEFT JOIN bm USING (document_id, page_no) LEFT JOIN rm USING (document_id, page_no) LEFT JOIN tm USING (document_id, page_no)
LEFT JOIN (SELECT document_id, sum(n) AS n FROM bm GROUP BY 1) bt USING (document_id)
LEFT JOIN (SELECT document_id, sum(n) AS n FROM rm GROUP BY 1) rt USING (document_id)
LEFT JOIN (SELECT document_id, sum(n) AS n FROM tm GROUP BY 1) tt USING (document_id)
""",
)
def _(spark, sf):
    v = V.page_view(D.documents_cat(spark, sf), D.blocks(spark, sf), D.reactions(spark, sf), D.table_records(spark, sf))

    def ids(name):
        return F.array_join(F.transform(name, lambda x: x["id"]), ",")

    return v.select(
        "document_id", "page_no", ids("blocks").alias("block_ids"), ids("reactions").alias("reaction_ids"), ids("tables").alias("table_ids"),
        *[f"{n}_{s}" for n in ("blocks", "reactions", "tables") for s in ("on_page", "total")],
    )


@query(
    "crop_rect",
    """
SELECT id, cast(trunc(greatest(0.0, bbox_norm[1] - 0.01) * 1240) AS integer) AS left_px, cast(trunc(greatest(0.0, bbox_norm[2] - 0.01) * 1754) AS integer) AS top_px,
  cast(trunc(least(1.0, bbox_norm[3] + 0.01) * 1240) AS integer) AS right_px, cast(trunc(least(1.0, bbox_norm[4] + 0.01) * 1754) AS integer) AS bottom_px
FROM blocks
""",
)
def _(spark, sf):
    from leafmill.functions.geometry import crop_rect

    r = crop_rect(F.col("bbox_norm"), F.lit(1240), F.lit(1754))
    return D.blocks(spark, sf).select("id", r.alias("r")).select(
        "id", F.col("r.left").alias("left_px"), F.col("r.top").alias("top_px"), F.col("r.right").alias("right_px"), F.col("r.bottom").alias("bottom_px")
    )


@query(
    "export_stem",
    """
SELECT id, regexp_replace(regexp_replace(concat(filename, CASE WHEN page_count % 2 = 0 THEN ' (a) 第.PDF' ELSE '' END), '[^A-Za-z0-9_.\\x{4e00}-\\x{9fff}-]+', '_', 'g'), '\\.pdf$', '', 'i') AS stem
FROM documents_cat
""",
)
def _(spark, sf):
    name = F.concat("filename", F.when(F.col("page_count") % 2 == 0, " (a) 第.PDF").otherwise(""))
    return D.documents_cat(spark, sf).select("id", X.export_stem(name).alias("stem"))
