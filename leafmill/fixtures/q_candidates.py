"""Queries: entries, conditions and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import views as D
from leafmill.fixtures.q_views import HINT
from leafmill.fixtures.registry import query, view
from leafmill.operators import candidates as K
from leafmill.operators import views as V
from leafmill.session import materialize

# One row per page: whole text, and the text, boxes and images of its interesting blocks.
view(
    "entry_pages",
    f"""
SELECT document_id, page_no,
  string_agg(text, chr(10) ORDER BY reading_order, id) AS page_text,
  string_agg(text, chr(10) ORDER BY reading_order, id) FILTER (hit) AS source,
  string_agg(id, ',' ORDER BY reading_order, id) FILTER (hit) AS block_ids,
  first(image_path ORDER BY reading_order, id) FILTER (hit AND image_path <> '') AS image_path,
  bool_or(hit AND block_type = 'image') AS has_image,
  min(bbox_norm[1]) FILTER (hit) AS x1, max(bbox_norm[3]) FILTER (hit) AS x2
FROM (SELECT *, regexp_matches(text, '{HINT}', 'i') OR block_type IN ('image','table','chart','equation') AS hit FROM entry_blocks)
GROUP BY document_id, page_no
""",
)

# The oracle's forms of the patterns in functions/text.py.
# RE2 has no look-behind: a blank after every % keeps entries that follow one directly.
view(
    "entry_lists",
    r"""
SELECT *, regexp_extract_all(replace(page_text, '%', '% '), '(^|[^A-Za-z0-9])(\d+\s*[a-z])\s+(\d{1,3}(?:\.\d+)?)\s*%', 2, 'i') AS labels,
  regexp_extract_all(replace(page_text, '%', '% '), '(^|[^A-Za-z0-9])(\d+\s*[a-z])\s+(\d{1,3}(?:\.\d+)?)\s*%', 3, 'i') AS shares,
  nullif(regexp_extract(page_text, '(?:general conditions?|一般条件|反应条件)[:：]?\s*([^\n]{8,})', 1, 'i'), '') AS line
FROM entry_pages
""",
)

view(
    "page_facts",
    r"""
SELECT *, nullif(regexp_extract(line, '\b([A-Z][A-Za-z0-9()\[\]]{1,24})\b', 1), '') AS catalyst,
  cast(nullif(regexp_extract(line, '(\d+(?:\.\d+)?)\s*(?:°c|℃|c\b)', 1, 'i'), '') AS double) AS temperature_c,
  cast(nullif(regexp_extract(line, '(\d+(?:\.\d+)?)\s*h\b', 1, 'i'), '') AS double) AS time_h
FROM entry_lists
""",
)

view(
    "candidates",
    r"""
SELECT document_id, page_no, cast(i AS integer) AS entry_no, block_ids, image_path, x1, x2,
  CASE WHEN len(labels) >= 2 THEN 'scheme_entry' WHEN has_image THEN 'reaction_scheme' ELSE 'text' END AS source_type,
  source AS source_text,
  CASE WHEN len(labels) >= 2 THEN regexp_replace(labels[i + 1], '\s+', '', 'g') END AS entry_label,
  CASE WHEN len(labels) >= 2 THEN cast(shares[i + 1] AS double) END AS yield_percent,
  catalyst, temperature_c, time_h
FROM (SELECT *, unnest(range(0, CASE WHEN len(labels) >= 2 THEN len(labels) ELSE 1 END)) AS i FROM page_facts WHERE source IS NOT NULL)
""",
)


@query("scheme_entries", "SELECT document_id, page_no, cast(i - 1 AS integer) AS entry_no, regexp_replace(labels[i], '\\s+', '', 'g') AS label, cast(shares[i] AS double) AS yield_percent FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM entry_lists)")
def _(spark, sf):
    text = V.page_text(D.entry_blocks(spark, sf))
    return text.select("document_id", "page_no", F.posexplode(K.scheme_entries(F.col("page_text"))).alias("entry_no", "e")).select(
        "document_id", "page_no", "entry_no", "e.label", "e.yield_percent"
    )


@query("page_conditions", "SELECT document_id, page_no, catalyst, temperature_c, time_h FROM page_facts WHERE line IS NOT NULL")
def _(spark, sf):
    text = V.page_text(D.entry_blocks(spark, sf)).withColumn("c", K.page_conditions(F.col("page_text")))
    return text.filter("c is not null").select("document_id", "page_no", "c.*")


@query(
    "reaction_candidates",
    """
SELECT document_id, page_no, entry_no, source_type, source_text, block_ids, image_path, entry_label, yield_percent, catalyst, temperature_c, time_h,
  round(x1, 6) AS x1, round(x2, 6) AS x2 FROM candidates
""",
)
def _(spark, sf):
    c = K.reaction_candidates(D.entry_blocks(spark, sf))
    return c.select(
        "document_id", "page_no", "entry_no", "source_type", "source_text", F.array_join("block_ids", ",").alias("block_ids"), "image_path",
        "entry_label", "yield_percent", "inherited_conditions.*",
        F.round(F.col("bbox")[0], 6).alias("x1"), F.round(F.col("bbox")[2], 6).alias("x2"),
    )


@query(
    "candidate_index",
    "SELECT document_id, page_no, entry_no, row_number() OVER (PARTITION BY document_id ORDER BY page_no, entry_no) - 1 AS candidate_index FROM candidates",
)
def _(spark, sf):
    c = K.reaction_candidates(D.entry_blocks(spark, sf)).select("document_id", "page_no", "entry_no")
    return K.candidate_index(materialize(c, "candidates"))
