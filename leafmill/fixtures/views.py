"""Views derived from the given tables, in Spark and as SQL for the oracle.

Each view grows with its source table. The SQL text of a view states the same
rows in plain relational terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.fixtures.registry import view
from leafmill.operators.windows import plan_chunks

PAGE_BLOCKS = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- documents ---------------------------------------------------------------
def documents_cat(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.selectExpr(
        "cast(doc_id as string) as id",
        "concat(source, '-', doc_id, '.pdf') as filename",
        "concat('/in/', source, '/', doc_id, '.pdf') as file_path",
        "sha2(text, 256) as sha256",
        "cast(n_chars div 200 as int) as page_count",
        "cast(n_chars * (case doc_id % 3 when 0 then 200 when 1 then 600 else 2000 end) as bigint) as bytes",
        "case doc_id % 5 when 0 then 'pending' when 1 then 'uploaded' when 2 then 'parsing' else 'completed' end as parse_status",
        "case when doc_id % 10 = 2 then 'planning' end as parse_error",
        "timestamp_seconds(1704067200 + doc_id) as created_at",
        "timestamp_seconds(1704067200 + doc_id) as updated_at",
    )


view(
    "documents_cat",
    """
SELECT cast(doc_id AS varchar) AS id,
  concat(source, '-', doc_id, '.pdf') AS filename,
  concat('/in/', source, '/', doc_id, '.pdf') AS file_path,
  sha256(text) AS sha256,
  cast(n_chars // 200 AS integer) AS page_count,
  cast(n_chars * (CASE doc_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 600 ELSE 2000 END) AS bigint) AS bytes,
  CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'parsing' ELSE 'completed' END AS parse_status,
  CASE WHEN doc_id % 10 = 2 THEN 'planning' END AS parse_error,
  make_timestamp((1704067200 + doc_id) * 1000000) AS created_at,
  make_timestamp((1704067200 + doc_id) * 1000000) AS updated_at
FROM documents
""",
)


# ---- blocks: one per line of a document ---------------------------------------
def blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    typed = lines.withColumn(
        "block_type",
        F.get(F.array(*[F.lit(x) for x in ("text", "title", "table", "image", "equation", "chart", "figure")]), F.col("p") % 7),
    )
    return typed.selectExpr(
        "concat(doc_id, '-', p) as id",
        "cast(doc_id as string) as document_id",
        f"cast(p div {PAGE_BLOCKS} + 1 as int) as page_no",
        "block_type",
        "nullif(t, '') as text",
        "array(p % 5 * 100.0D, p % 20 * 40.0D, p % 5 * 100.0D + 500, p % 20 * 40.0D + 35) as bbox",
        "array(p % 5 / 10.0D, p % 20 / 25.0D, p % 5 / 10.0D + 0.5D, p % 20 / 25.0D + 0.035D) as bbox_norm",
        "case when block_type in ('image', 'chart') then concat('images/', doc_id, '_', p, '.png') end as image_path",
        f"cast(p % {PAGE_BLOCKS} as int) as reading_order",
        "named_struct('table_body', cast(null as string), 'chunk_id', cast(null as string)) as meta",
    )


view(
    "blocks",
    """
SELECT concat(doc_id, '-', p) AS id, cast(doc_id AS varchar) AS document_id,
  cast(p // 20 + 1 AS integer) AS page_no,
  (['text','title','table','image','equation','chart','figure'])[p % 7 + 1] AS block_type,
  nullif(t, '') AS text,
  [cast(p % 5 AS double) / 10.0, cast(p % 20 AS double) / 25.0,
   cast(p % 5 AS double) / 10.0 + 0.5, cast(p % 20 AS double) / 25.0 + 0.035] AS bbox_norm,
  CASE WHEN p % 7 IN (3, 5) THEN concat('images/', doc_id, '_', p, '.png') END AS image_path,
  cast(p % 20 AS integer) AS reading_order
FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS p
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
""",
)


# ---- web blocks: headings, paragraphs and list items of a page ----------------
def web_blocks(spark: SparkSession, sf: str) -> DataFrame:
    body = F.regexp_replace("html", r"(?is)<script.*?</script>", "")
    pattern = r"(?s)<(h1|p|li)>(.*?)</(?:h1|p|li)>"
    tags, texts = F.regexp_extract_all(body, F.lit(pattern), 1), F.regexp_extract_all(body, F.lit(pattern), 2)
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("t"))).alias("p", "e"))
    return rows.selectExpr(
        "concat('w', page_id, '-', p) as id",
        "concat('w', page_id div 10) as document_id",
        "cast(page_id % 10 + 1 as int) as page_no",
        "case e.tag when 'h1' then 'title' when 'li' then 'list' else 'text' end as block_type",
        "nullif(e.t, '') as text",
        "cast(p as int) as reading_order",
    )


view(
    "web_blocks",
    """
SELECT concat('w', page_id, '-', p) AS id, concat('w', page_id // 10) AS document_id,
  cast(page_id % 10 + 1 AS integer) AS page_no,
  CASE tag WHEN 'h1' THEN 'title' WHEN 'li' THEN 'list' ELSE 'text' END AS block_type,
  nullif(t, '') AS text, cast(p AS integer) AS reading_order
FROM (SELECT page_id, unnest(tags) AS tag, unnest(texts) AS t, generate_subscripts(tags, 1) - 1 AS p
  FROM (SELECT page_id,
      regexp_extract_all(body, '(?s)<(h1|p|li)>(.*?)</(?:h1|p|li)>', 1) AS tags,
      regexp_extract_all(body, '(?s)<(h1|p|li)>(.*?)</(?:h1|p|li)>', 2) AS texts
    FROM (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>', '', 'g') AS body FROM pages)))
""",
)


# ---- entry blocks: reaction-like pages, one block per line item -----------------
def entry_blocks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "concat(l_linenumber, case when l_suppkey % 2 = 0 then ' ' else '' end, substr('abcd', cast(l_partkey % 4 + 1 as int), 1)) as label",
        "concat(cast(round(l_discount * 100) as int) * 8 + 10, case when l_partkey % 4 = 1 then '.5' else '' end,"
        " case when l_partkey % 3 = 0 then ' %' else '%' end) as share",
    )
    body = (
        F.when(F.expr("l_suppkey % 11 = 0"), "Plain line without numbers")
        .when(
            F.expr("l_suppkey % 7 = 0"),
            F.concat(F.lit("General conditions: catalyst Pd"), "l_linenumber", F.lit(", "), F.col("l_quantity").cast("int"),
                     F.lit(" °C, "), "l_linenumber", F.lit(".5 h, dry\n"), "label", F.lit("  "), "share"),
        )
        .when(F.expr("l_suppkey % 7 = 1"), F.concat(F.lit("reaction SMILES:\nCCO.CC(=O)O>>CC(=O)OC"), F.expr("repeat('C', l_linenumber)"), F.lit(".O")))
        .when(F.expr("l_suppkey % 7 = 2"), F.concat(F.lit("yield of $$\\mathrm{A \\rightarrow B_"), "l_linenumber", F.lit("}$$")))
        .otherwise(F.concat("label", F.lit("  "), "share"))
    )
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_discount * 100) as int), cast(l_quantity as int))"
    return li.withColumn("text", body).selectExpr(
        f"{key} as id",
        "concat('o', l_orderkey div 40) as document_id",
        "cast(l_orderkey % 40 + 1 as int) as page_no",
        "case when l_suppkey % 6 = 0 then 'image' else 'text' end as block_type",
        "text",
        "array(l_linenumber / 20.0D, 0.1D, l_linenumber / 20.0D + 0.5D, 0.9D) as bbox_norm",
        f"case when l_suppkey % 6 = 0 then concat('images/', {key}, '.png') end as image_path",
        "cast(l_linenumber * 1000 + l_partkey % 1000 as int) as reading_order",
    )


view(
    "entry_blocks",
    r"""
SELECT id, concat('o', l_orderkey // 40) AS document_id, cast(l_orderkey % 40 + 1 AS integer) AS page_no,
  CASE WHEN l_suppkey % 6 = 0 THEN 'image' ELSE 'text' END AS block_type,
  CASE WHEN l_suppkey % 11 = 0 THEN 'Plain line without numbers'
    WHEN l_suppkey % 7 = 0 THEN concat('General conditions: catalyst Pd', l_linenumber, ', ', cast(l_quantity AS integer),
      ' °C, ', l_linenumber, '.5 h, dry', chr(10), label, '  ', share)
    WHEN l_suppkey % 7 = 1 THEN concat('reaction SMILES:', chr(10), 'CCO.CC(=O)O>>CC(=O)OC', repeat('C', l_linenumber), '.O')
    WHEN l_suppkey % 7 = 2 THEN concat('yield of $$\mathrm{A \rightarrow B_', l_linenumber, '}$$')
    ELSE concat(label, '  ', share) END AS text,
  [l_linenumber / 20.0::double, 0.1, l_linenumber / 20.0::double + 0.5, 0.9] AS bbox_norm,
  CASE WHEN l_suppkey % 6 = 0 THEN concat('images/', id, '.png') END AS image_path,
  cast(l_linenumber * 1000 + l_partkey % 1000 AS integer) AS reading_order
FROM (SELECT *,
    concat(l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '' END, substr('abcd', cast(l_partkey % 4 + 1 AS integer), 1)) AS label,
    concat(cast(round(l_discount * 100) AS integer) * 8 + 10, CASE WHEN l_partkey % 4 = 1 THEN '.5' ELSE '' END,
      CASE WHEN l_partkey % 3 = 0 THEN ' %' ELSE '%' END) AS share,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_discount * 100) AS integer), cast(l_quantity AS integer)) AS id
  FROM lineitem)
""",
)


# ---- windows and window-local layout JSON --------------------------------------
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of each document's text pages, most of them completed."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.ceil(F.size(F.split("text", "\n")) / PAGE_BLOCKS).cast("int").alias("page_count"),
        (F.col("n_chars") * F.lit(1024)).alias("bytes"),
        F.lit(2).alias("window"),
        F.lit(1).alias("lap"),
    )
    planned = plan_chunks(d, chunk_pages="window", overlap="lap")
    turn = F.expr("(cast(document_id as bigint) + chunk_ord) % 9")
    return planned.withColumn(
        "status", F.when(turn == 3, "failed").when(turn == 5, "pending").when(turn == 7, "retrying").otherwise("completed")
    )


view(
    "chunks",
    """
SELECT document_id, cast(i + 1 AS integer) AS chunk_ord, concat('c', lpad(cast(i + 1 AS varchar), 4, '0')) AS chunk_id,
  cast(i AS integer) AS start_page, cast(least(i + 1, n - 1) AS integer) AS end_page,
  CASE (doc_id + i + 1) % 9 WHEN 3 THEN 'failed' WHEN 5 THEN 'pending' WHEN 7 THEN 'retrying' ELSE 'completed' END AS status
FROM (SELECT doc_id, cast(doc_id AS varchar) AS document_id, n, unnest(range(0, greatest(n - 1, 1))) AS i
  FROM (SELECT doc_id, cast(ceil(len(string_split(text, chr(10))) / 20.0) AS bigint) AS n FROM documents))
""",
)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Layout JSON of each window: flat, list of lists, or string-encoded, by document.

    A window's JSON is built from its own document row; nothing is grouped.
    """
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("document_id"), F.split("text", "\n").alias("lines")
    )
    spans = chunks(spark, sf).select("document_id", "chunk_ord", "start_page", "end_page")
    joined = d.join(spans, "document_id")

    def items(page, with_index: bool):
        def item(t, i):
            p = page * PAGE_BLOCKS + i
            fields = [
                F.when(p % 7 == 1, F.lit(None)).otherwise(F.lit("text")).alias("type"),
                F.when(p % 7 == 1, "title").alias("block_type"),
                F.when(p % 3 == 0, F.lit("")).otherwise(t).alias("text"),
                F.when(p % 3 == 0, F.array(t, F.lit(" "), F.lit("end"))).alias("content"),
                F.when(p % 5 == 0, F.array(F.concat(F.lit("Fig "), p.cast("string")))).alias("image_caption"),
                F.when(p % 5 == 0, F.concat(F.lit("img/x/"), p.cast("string"), F.lit(".png"))).alias("img_path"),
                F.array(p % 5 * 100.0, p % 20 * 40.0, p % 5 * 100.0 + 500.0, p % 20 * 40.0 + 35.0).alias("bbox"),
            ]
            if with_index:
                fields.append((page - F.col("start_page")).alias("page_idx"))
            return F.struct(*fields)

        return F.transform(F.slice("lines", page * PAGE_BLOCKS + 1, F.lit(PAGE_BLOCKS)), item)

    pages = F.sequence("start_page", "end_page")
    nested = F.to_json(F.transform(pages, lambda g: items(g, False)))
    flat = F.to_json(F.flatten(F.transform(pages, lambda g: items(g, True))))
    text = F.when(F.expr("doc_id % 3 = 0"), nested).otherwise(flat)
    quoted = F.to_json(F.array(text))
    encoded = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return joined.select(
        "document_id", "chunk_ord", F.when(F.expr("doc_id % 7 = 0"), encoded).otherwise(text).alias("payload")
    )


view(
    "layout_rows",
    """
SELECT c.document_id, c.chunk_ord, c.chunk_id, c.status, c.start_page, b.p, b.p // 20 AS page, b.p // 20 - c.start_page AS local_page,
  b.p - c.start_page * 20 AS pos, b.t
FROM chunks c JOIN (SELECT cast(doc_id AS varchar) AS document_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS p
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) b
  ON b.document_id = c.document_id AND b.p // 20 BETWEEN c.start_page AND c.end_page
""",
)


# ---- page trees, for the odd documents ------------------------------------------
def page_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Page-tree JSON of each window: blocks of two spans, sizes on even pages."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.split("text", "\n").alias("lines"))
    joined = d.join(chunks(spark, sf).select("document_id", "chunk_ord", "start_page", "end_page"), "document_id")

    def block(t, i):
        half = F.floor(F.length(t) / 2).cast("int")
        spans = F.array(
            F.struct(F.substring(t, F.lit(1), half).alias("content")),
            F.struct(F.lit("").alias("content")),
            F.struct(F.substring(t, half + 1, F.length(t)).alias("content")),
        )
        return F.struct(F.lit("text").alias("type"), F.array(F.lit(0.1), i / 25.0, F.lit(0.9), i / 25.0 + 0.03).alias("bbox"),
                        F.array(F.struct(spans.alias("spans"))).alias("lines"))

    def page(g):
        found = F.transform(F.slice("lines", g * PAGE_BLOCKS + 1, F.lit(PAGE_BLOCKS)), block)
        return F.struct(
            (g - F.col("start_page")).alias("page_idx"),
            F.when(g % 2 == 0, F.array(F.lit(600.0) + g, F.lit(800.0))).alias("page_size"),
            F.when(g % 3 == 0, F.slice(found, 1, 0)).otherwise(found).alias("para_blocks"),
            F.when(g % 3 == 0, found).alias("preproc_blocks"),
        )

    info = F.struct(F.transform(F.sequence("start_page", "end_page"), page).alias("pdf_info"))
    return joined.select("document_id", "chunk_ord", F.to_json(info).alias("payload"))


# ---- files -----------------------------------------------------------------------
def artifact_files(spark: SparkSession, sf: str) -> DataFrame:
    """A listing of parser outputs, from the events: several names and depths per document."""
    e = table(spark, sf, "events")
    return e.selectExpr(
        "concat('e', event_id div 20) as document_id",
        "concat('/out/e', event_id div 20, case event_id % 3 when 0 then '/a' else '/a/b' end, '/',"
        " case event_id % 8 when 0 then concat('FULL_', event_id, '.md') when 1 then concat('x', event_id, '.md')"
        " when 2 then concat('x', event_id, '_content_list.json') when 3 then concat('x', event_id, '_content_list_v2.json')"
        " when 4 then concat('x', event_id, '_middle.json') when 5 then 'middle.json'"
        " when 6 then concat('page_', lpad(event_id % 20 + 1, 4, '0'), '.png') else 'notes.txt' end) as path",
        "cast(value * 100 as bigint) as length",
    )


view(
    "artifact_files",
    """
SELECT concat('e', event_id // 20) AS document_id,
  concat('/out/e', event_id // 20, CASE event_id % 3 WHEN 0 THEN '/a' ELSE '/a/b' END, '/',
    CASE event_id % 8 WHEN 0 THEN concat('FULL_', event_id, '.md') WHEN 1 THEN concat('x', event_id, '.md')
    WHEN 2 THEN concat('x', event_id, '_content_list.json') WHEN 3 THEN concat('x', event_id, '_content_list_v2.json')
    WHEN 4 THEN concat('x', event_id, '_middle.json') WHEN 5 THEN 'middle.json'
    WHEN 6 THEN concat('page_', lpad(cast(event_id % 20 + 1 AS varchar), 4, '0'), '.png') ELSE 'notes.txt' END) AS path,
  cast(trunc(value * 100) AS bigint) AS length
FROM events
""",
)


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Page image files of the catalogue's documents."""
    return table(spark, sf, "events").selectExpr(
        "cast(event_id div 10 as string) as document_id",
        "concat('/data/', event_id div 10, '/pages/page_', lpad(event_id % 10 * 3 + 1, 4, '0'), '.png') as path",
    )


view(
    "page_images",
    """
SELECT cast(event_id // 10 AS varchar) AS document_id, cast(event_id % 10 * 3 + 1 AS integer) AS page_no,
  concat('/data/', event_id // 10, '/pages/page_', lpad(cast(event_id % 10 * 3 + 1 AS varchar), 4, '0'), '.png') AS path
FROM events
""",
)


# ---- records -----------------------------------------------------------------------
def reactions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.selectExpr(
        "concat('r', o_orderkey) as id",
        "cast(o_orderkey div 10 as string) as document_id",
        "named_struct("
        " 'reaction_text', concat('Route ', o_orderkey % 3),"
        " 'reaction_smiles', case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then 'CCO' else concat('CC>O.N>C', repeat('C', cast(o_orderkey % 3 as int)), '>>CC.O') end,"
        " 'atom_mapped_reaction_smiles', case o_orderkey % 5 when 0 then '[CH3:1]>>[CH2:1]' when 1 then 'C>>C' end,"
        " 'reaction_latex', cast(null as string),"
        " 'rxn_path', case when o_orderkey % 3 > 0 then concat('reactions/', o_orderkey, '.rxn') end,"
        " 'conditions', named_struct('catalyst', o_orderpriority, 'temperature_c', cast(o_orderkey % 90 as double), 'time_h', cast(null as double)),"
        " 'yield_percent', case when o_orderkey % 7 > 0 then o_orderkey % 50 + (o_orderkey % 2) / 2.0D end) as payload",
        "named_struct("
        " 'page_no', cast(o_orderkey % 5 + 1 as int),"
        " 'bbox', array(o_orderkey % 4 / 10.0D, 0.2D, o_orderkey % 4 / 10.0D + 0.4D, 0.6D),"
        " 'source_type', 'text',"
        " 'source_text', concat('got ', o_orderkey % 50, case when o_orderkey % 2 = 1 then '.5' else '' end, case when o_orderkey % 3 = 0 then ' %' when o_orderkey % 3 = 1 then '%' else ' g' end),"
        " 'source_image_path', cast(null as string),"
        " 'entry_label', concat(o_orderkey % 4, 'a'),"
        " 'block_ids', array(concat('b', o_orderkey))) as provenance",
        "named_struct('schema_valid', true, 'missing', case when o_orderkey % 6 = 0 then array(named_struct('field', 'yield_percent', 'missing_reason', 'not_reported')) else cast(array() as array<struct<field:string,missing_reason:string>>) end) as validation",
        "case o_orderkey % 5 when 0 then 'pending' when 1 then 'approved' when 2 then 'edited' when 3 then 'uncertain' else 'rejected' end as review_status",
        "cast(o_orderdate as timestamp) as created_at",
        "cast(o_orderdate as timestamp) as updated_at",
    )


view(
    "reactions",
    """
SELECT concat('r', o_orderkey) AS id, cast(o_orderkey // 10 AS varchar) AS document_id,
  concat('Route ', o_orderkey % 3) AS reaction_text,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'CCO' ELSE concat('CC>O.N>C', repeat('C', o_orderkey % 3), '>>CC.O') END AS reaction_smiles,
  CASE o_orderkey % 5 WHEN 0 THEN '[CH3:1]>>[CH2:1]' WHEN 1 THEN 'C>>C' END AS mapped,
  CASE WHEN o_orderkey % 3 > 0 THEN concat('reactions/', o_orderkey, '.rxn') END AS rxn_path,
  o_orderpriority AS catalyst, cast(o_orderkey % 90 AS double) AS temperature_c,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 50 + (o_orderkey % 2) / 2.0::double END AS yield_percent,
  cast(o_orderkey % 5 + 1 AS integer) AS page_no,
  [(o_orderkey % 4) / 10.0::double, 0.2, (o_orderkey % 4) / 10.0::double + 0.4, 0.6] AS bbox,
  concat('got ', o_orderkey % 50, CASE WHEN o_orderkey % 2 = 1 THEN '.5' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN ' %' WHEN o_orderkey % 3 = 1 THEN '%' ELSE ' g' END) AS source_text,
  concat(o_orderkey % 4, 'a') AS entry_label,
  o_orderkey % 6 = 0 AS listed_yield,
  CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'edited' WHEN 3 THEN 'uncertain' ELSE 'rejected' END AS review_status,
  o_orderdate AS created_at, o_orderkey
FROM orders
""",
)


def table_records(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    tid = "concat('table_', lpad(c_custkey % 4 + 1, 6, '0'))"
    return c.selectExpr(
        "concat('t', c_custkey) as id",
        "cast(c_custkey div 4 as string) as document_id",
        f"{tid} as table_id",
        f"named_struct('table_id', {tid}, 'table_path', concat('tables/', {tid}, '.parquet'),"
        " 'table_title', case when c_custkey % 3 > 0 then c_name end, 'table_description', cast(null as string),"
        f" 'source_image_path', concat('images/', {tid}, '.png')) as payload",
        "named_struct('page_no', cast(c_custkey % 5 + 1 as int), 'bbox', array(0.2D, 0.2D, 0.6D, 0.2D + c_custkey % 5 / 10.0D), 'block_id', concat('b', c_custkey)) as provenance",
        "named_struct('schema_valid', true, 'row_count', cast(c_nationkey as int)) as validation",
        "case c_custkey % 5 when 0 then 'pending' when 1 then 'approved' when 2 then 'edited' when 3 then 'uncertain' else 'rejected' end as review_status",
        "timestamp_seconds(1704067200 + c_custkey) as created_at",
        "timestamp_seconds(1704067200 + c_custkey) as updated_at",
    )


view(
    "table_records",
    """
SELECT concat('t', c_custkey) AS id, cast(c_custkey // 4 AS varchar) AS document_id,
  concat('table_', lpad(cast(c_custkey % 4 + 1 AS varchar), 6, '0')) AS table_id,
  CASE WHEN c_custkey % 3 > 0 THEN c_name END AS table_title,
  cast(c_custkey % 5 + 1 AS integer) AS page_no,
  [0.2, 0.2, 0.6, 0.2 + (c_custkey % 5) / 10.0::double] AS bbox,
  cast(c_nationkey AS integer) AS row_count,
  CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'edited' WHEN 3 THEN 'uncertain' ELSE 'rejected' END AS review_status,
  make_timestamp((1704067200 + c_custkey) * 1000000) AS created_at, c_custkey
FROM customer
""",
)


# ---- HTML tables: twenty parts each ---------------------------------------------------
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Table blocks whose HTML lists twenty parts; a group never holds more."""
    cell = (
        "concat('<tr><td>', p_partkey, '</td><td class=\"n\">', p_name, ' &amp;  co</td><td>', p_size, '%</td><td>',"
        " case when p_partkey % 4 = 0 then 'n/a' else cast(p_size as string) end, '</td><td>', p_brand, '</td><td>-</td><td>',"
        " case when p_partkey div 20 % 2 = 0 then concat(p_size, '.25') else concat(p_size, case when p_partkey % 2 = 0 then '%' else ' kg' end) end, '</td></tr>')"
    )
    rows = table(spark, sf, "part").selectExpr("p_partkey div 20 as g", "p_partkey as k", f"{cell} as tr")
    grouped = rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tr"))), lambda x: x["tr"]), "").alias("trs"))
    head = "<table border=1><tr><th>Part  key</th><th>Name</th><th>Size (%)</th><th>Size</th><th>Name</th><th></th><th>Mix</th></tr>"
    return grouped.select(
        F.concat(F.lit("p"), "g").alias("id"),
        F.expr("concat('p', g div 10)").alias("document_id"),
        F.expr("cast(g % 10 div 2 + 1 as int)").alias("page_no"),
        F.lit("text").alias("block_type"),
        F.concat(F.lit("Table "), "g", F.lit(" of parts\n"), F.lit(head), "trs", F.lit("</table>")).alias("text"),
        F.array(F.lit(0.1), F.lit(0.1), F.lit(0.9), F.lit(0.9)).alias("bbox_norm"),
        F.lit(None).cast("string").alias("image_path"),
        F.expr("cast(g % 2 as int)").alias("reading_order"),
        F.struct(F.lit(None).cast("string").alias("table_body")).alias("meta"),
    )


# The same cells without going through HTML.
view(
    "table_cells_rel",
    """
SELECT concat('p', g // 10) AS document_id, concat('p', g) AS block_id, cast(g % 10 // 2 + 1 AS integer) AS page_no, cast(g % 2 AS integer) AS reading_order, g,
  cast(k - g * 20 AS integer) AS row, cast(c AS integer) AS col,
  (['Part_key','Name','Size','Size_2','Name_2','col_6','Mix'])[c + 1] AS header,
  (vals)[c + 1] AS raw,
  (kinds)[c + 1] AS kind
FROM (SELECT p_partkey // 20 AS g, p_partkey AS k, unnest(range(0, 7)) AS c,
  [cast(p_partkey AS varchar), concat(p_name, ' & co'), concat(p_size, '%'), CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE cast(p_size AS varchar) END, p_brand, '-',
    CASE WHEN p_partkey // 20 % 2 = 0 THEN concat(p_size, '.25') ELSE concat(p_size, CASE WHEN p_partkey % 2 = 0 THEN '%' ELSE ' kg' END) END] AS vals,
  ['long', 'text', 'percent', CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE 'long' END, 'text', 'null',
    CASE WHEN p_partkey // 20 % 2 = 0 THEN 'double' WHEN p_partkey % 2 = 0 THEN 'percent' ELSE 'text' END] AS kinds
  FROM part)
""",
)


# ---- answers ----------------------------------------------------------------------------
def answer_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate per turn, its text as the source."""
    return table(spark, sf, "conversations").selectExpr(
        "cast(conv_id as string) as document_id",
        "cast(turn + 1 as int) as page_no",
        "0 as entry_no",
        "cast(turn as bigint) as candidate_index",
        "array(0.1D, 0.1D, 0.9D, 0.9D) as bbox",
        "'text' as source_type",
        "text as source_text",
        "array(concat(conv_id, '-', turn)) as block_ids",
        "cast(null as string) as image_path",
        "cast(null as string) as entry_label",
        "cast(null as double) as yield_percent",
        "cast(null as struct<catalyst:string,temperature_c:double,time_h:double>) as inherited_conditions",
    )


GOOD = (
    "concat('{\"reaction_text\":\"A -> B ', conv_id, '\",\"reaction_smiles\":\"', case when conv_id % 3 = 0 then 'CC' else concat('CC>>C', turn) end,"
    " '\",\"atom_mapped_reaction_smiles\":\"[C:1]>>[C:1]\",\"reaction_latex\":\"\",\"rxn_path\":\"\",\"extra\":[1],"
    "\"conditions\":{\"catalyst\":\"null\",\"temperature_c\":\"80\",\"time_h\":2.5},\"yield_percent\":', conv_id % 100, '}')"
)
BAD = (
    "concat('{\"reaction_text\":5,\"reaction_smiles\":\"\",\"atom_mapped_reaction_smiles\":null,\"reaction_latex\":null,\"rxn_path\":null,"
    "\"conditions\":{\"catalyst\":\"Pd\",\"temperature_c\":\"warm\",\"time_h\":null}}')"
)


def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """First and second answers: good, fenced, malformed, unfit, or none, by turn."""
    c = table(spark, sf, "conversations")
    m = "(conv_id + turn) % 6"
    a1 = c.selectExpr(
        "conv_id", "turn", "1 as attempt",
        f"case {m} when 0 then 'no braces in this one' when 1 then concat('Here it is:\\n```json\\n', {GOOD}, '\\n``` done')"
        f" when 2 then {BAD} when 3 then concat('see ', {BAD}, ' end') when 4 then {GOOD} end as answer_text",
    ).filter("answer_text is not null")
    a2 = c.selectExpr(
        "conv_id", "turn", "2 as attempt",
        f"case when {m} = 2 and conv_id % 2 = 0 then {GOOD} when {m} = 3 then {BAD} end as answer_text",
    ).filter("answer_text is not null")
    return a1.unionByName(a2).selectExpr(
        "cast(conv_id as string) as document_id", "cast(turn as bigint) as candidate_index", "attempt", "answer_text"
    )


# which answer a candidate ends up with: good (g), unfit after repair (f) or the fallback (k)
view(
    "answered",
    """
SELECT cast(conv_id AS varchar) AS document_id, cast(turn AS bigint) AS candidate_index, conv_id, turn, text,
  CASE WHEN (conv_id + turn) % 6 IN (1, 4) THEN 'g' WHEN (conv_id + turn) % 6 = 2 AND conv_id % 2 = 0 THEN 'g'
    WHEN (conv_id + turn) % 6 = 3 THEN 'f' ELSE 'k' END AS verdict
FROM conversations
""",
)


# ---- events, patches, clicks ----------------------------------------------------------------
RUN_EVENT_COLUMNS = [
    "event_id as id",
    "cast(user_id as string) as run_id",
    "case when event_id % 50 = 0 then 'agent_completed' else 'agent_progress' end as type",
    "case when event_type <> 'error' then event_type end as stage",
    "case when event_id % 3 > 0 then cast(get_json_object(props, '$.k') as double) / 100 end as progress",
    "concat('event ', event_id) as message",
    "ts as created_at",
]


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*RUN_EVENT_COLUMNS)


view(
    "run_events",
    """
SELECT event_id AS id, cast(user_id AS varchar) AS run_id,
  CASE WHEN event_id % 50 = 0 THEN 'agent_completed' ELSE 'agent_progress' END AS type,
  CASE WHEN event_type <> 'error' THEN event_type END AS stage,
  CASE WHEN event_id % 3 > 0 THEN cast(json_extract_string(props, '$.k') AS double) / 100 END AS progress,
  concat('event ', event_id) AS message, ts AS created_at
FROM events
""",
)

PATCH_COLUMNS = [
    "cast(doc_id as bigint) as seq",
    "concat('r', doc_id div 2) as reaction_id",
    "case when quality = 0 then named_struct('reaction_text', concat('edit ', doc_id), 'reaction_smiles', cast(null as string),"
    " 'atom_mapped_reaction_smiles', cast(null as string), 'reaction_latex', cast(null as string), 'rxn_path', cast(null as string),"
    " 'conditions', cast(null as struct<catalyst:string,temperature_c:double,time_h:double>), 'yield_percent', cast(doc_id as double)) end as payload",
    "case when toxic = 1 then 'rejected' when quality = 1 then 'approved' end as review_status",
]


def review_patches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").selectExpr(*PATCH_COLUMNS)


view(
    "review_patches",
    """
SELECT doc_id AS seq, concat('r', doc_id // 2) AS reaction_id,
  CASE WHEN quality = 0 THEN concat('edit ', doc_id) END AS edit_text,
  CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'edited' END AS status
FROM labels
""",
)


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id as click_id",
        "cast(event_id div 10 as string) as document_id",
        "cast(event_id % 5 + 1 as int) as page_no",
        "pmod(cast(round(value * 100) as bigint), 101) / 100.0D as x",
        "cast(get_json_object(props, '$.k') as double) / 100.0D as y",
    )


view(
    "clicks",
    """
SELECT event_id AS click_id, cast(event_id // 10 AS varchar) AS document_id, cast(event_id % 5 + 1 AS integer) AS page_no,
  (cast(round(value * 100) AS bigint) % 101) / 100.0::double AS x,
  cast(json_extract_string(props, '$.k') AS double) / 100.0::double AS y
FROM events
""",
)
