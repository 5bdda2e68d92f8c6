"""Queries: HTML tables to typed columns and table records."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import views as D
from leafmill.fixtures.registry import query
from leafmill.operators import html_tables as H
from leafmill.operators.views import table_block_filter
from leafmill.plans.extract import extract_tables
from leafmill.session import scratch_path
from leafmill.sources import versioned

KEYS = ["document_id", "block_id"]


def _parsed(spark, sf):
    b = D.html_blocks(spark, sf).select("document_id", F.col("id").alias("block_id"), F.col("text").alias("html"))
    return H.parsed_tables(b)


@query("html_cells", "SELECT document_id, block_id, row, col, header, raw, kind FROM table_cells_rel")
def _(spark, sf):
    return H.html_cells(_parsed(spark, sf), KEYS).drop("malformed")


@query("header_suffix", "SELECT DISTINCT document_id, block_id, col, header FROM table_cells_rel")
def _(spark, sf):
    return _parsed(spark, sf).select(*KEYS, F.posexplode("headers").alias("col", "header"))


TYPES = """
SELECT document_id, block_id, col, header, CASE WHEN bool_and(kind = 'null') THEN 'boolean' WHEN bool_and(kind IN ('null','long')) THEN 'long'
  WHEN bool_and(kind IN ('null','long','double','percent')) THEN 'double' ELSE 'string' END AS type FROM table_cells_rel GROUP BY ALL
"""


@query("table_column_types", TYPES)
def _(spark, sf):
    return H.table_column_types(H.html_cells(_parsed(spark, sf), KEYS), KEYS)


@query(
    "cell_inference",
    f"""
WITH t AS ({TYPES})
SELECT c.document_id, c.block_id, c.row, c.col, c.header, t.type, CASE WHEN t.type = 'long' AND kind <> 'null' THEN cast(raw AS bigint) END AS long_value,
  CASE WHEN t.type = 'double' AND kind <> 'null' THEN cast(replace(raw, '%', '') AS double) END AS double_value,
  CASE WHEN t.type = 'string' AND kind <> 'null' THEN CASE WHEN kind IN ('percent','double') THEN cast(cast(replace(raw, '%', '') AS double) AS varchar) ELSE raw END END AS string_value
FROM table_cells_rel c JOIN t USING (document_id, block_id, col)
""",
)
def _(spark, sf):
    return H.typed_cells(_parsed(spark, sf), KEYS)


@query("table_shape", "SELECT document_id, block_id, 'Part_key|Name|Size|Size_2|Name_2|col_6|Mix' AS columns, cast(count(DISTINCT row) AS integer) AS row_count FROM table_cells_rel GROUP BY 1, 2")
def _(spark, sf):
    return H.table_shape(_parsed(spark, sf), KEYS)


@query("table_preview", "SELECT document_id, block_id, row, col, header, raw, kind FROM table_cells_rel WHERE row < 8")
def _(spark, sf):
    return H.table_preview(H.html_cells(_parsed(spark, sf), KEYS), KEYS).drop("malformed")


@query(
    "table_ids",
    """
SELECT document_id, id, concat('table_', lpad(cast(row_number() OVER (PARTITION BY document_id ORDER BY page_no, reading_order, id) AS varchar), 6, '0')) AS table_id FROM (
  SELECT DISTINCT document_id, block_id AS id, page_no, reading_order FROM table_cells_rel
  UNION ALL SELECT document_id, id, page_no, reading_order FROM blocks WHERE block_type = 'table')
""",
)
def _(spark, sf):
    b = D.blocks(spark, sf).unionByName(D.html_blocks(spark, sf), allowMissingColumns=True)
    return H.table_ids(table_block_filter(b)).select("document_id", "id", "table_id")


@query(
    "table_record_build",
    """
WITH t AS (SELECT document_id, block_id, g, page_no, reading_order, count(DISTINCT row) AS n FROM table_cells_rel GROUP BY ALL)
SELECT document_id, concat('table_', lpad(cast(i AS varchar), 6, '0')) AS table_id, concat('tables/table_', lpad(cast(i AS varchar), 6, '0'), '.parquet') AS table_path,
  concat('Table ', g, ' of parts') AS table_title, page_no, block_id, cast(n AS integer) AS row_count, 7 AS n_columns, 'table_description' AS missing
FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_no, reading_order, block_id) AS i FROM t)
""",
)
def _(spark, sf):
    t = extract_tables(D.html_blocks(spark, sf))
    return t.select(
        "document_id", "table_id", "payload.table_path", "payload.table_title", "provenance.page_no", "provenance.block_id", "validation.row_count",
        F.size("validation.columns").alias("n_columns"), F.array_join(F.transform("validation.missing", lambda m: m["field"]), ",").alias("missing"),
    )


@query(
    "typed_table_parquet",
    """
SELECT document_id, block_id, row, max(CASE WHEN col = 0 THEN cast(raw AS bigint) END) AS part_key, max(CASE WHEN col = 1 THEN raw END) AS name,
  max(CASE WHEN col = 2 THEN cast(replace(raw, '%', '') AS double) END) AS size, max(CASE WHEN col = 3 AND kind = 'long' THEN cast(raw AS bigint) END) AS size_2,
  max(CASE WHEN col = 6 AND g % 2 = 0 THEN cast(raw AS double) END) AS mix_number,
  max(CASE WHEN col = 6 AND g % 2 = 1 THEN CASE WHEN kind = 'percent' THEN cast(cast(replace(raw, '%', '') AS double) AS varchar) ELSE raw END END) AS mix_text
FROM table_cells_rel GROUP BY document_id, block_id, row, g
""",
)
def _(spark, sf):
    head = [("Part_key", "long"), ("Name", "string"), ("Size", "double"), ("Size_2", "long"), ("Name_2", "string"), ("col_6", "boolean")]
    path = scratch_path(spark, "typed-tables")
    H.write_typed_tables(_parsed(spark, sf), KEYS, path)
    stored, out = spark.read.parquet(path), []
    for mix in ("double", "string"):
        wide = H.widened(stored, KEYS, [*head, ("Mix", mix)])
        number, text = ("Mix", "cast(null as string)") if mix == "double" else ("cast(null as double)", "Mix")
        out.append(
            wide.selectExpr(*KEYS, "row", "Part_key as part_key", "Name as name", "Size as size", "Size_2 as size_2", f"{number} as mix_number", f"{text} as mix_text")
        )
    return out[0].unionByName(out[1])


@query(
    "upsert_table_records",
    """
SELECT id, document_id, table_id, CASE WHEN c_custkey % 3 = 0 THEN 'again' ELSE table_title END AS table_title,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END ELSE review_status END AS review_status, cast(epoch(created_at) AS bigint) AS created_s,
  CASE WHEN c_custkey % 3 = 0 THEN 1735689600 ELSE cast(epoch(created_at) AS bigint) END AS updated_s FROM table_records
UNION ALL
SELECT concat('n', c_custkey), document_id, concat(table_id, 'x'), 'again', CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END, 1735689600, 1735689600
FROM table_records WHERE c_custkey % 5 = 0
""",
)
def _(spark, sf):
    t = D.table_records(spark, sf)
    k = F.expr("cast(substr(id, 2) as bigint)")
    status = F.when(k % 2 == 0, "approved")
    base = t.withColumns({"k": k, "saved_at": F.timestamp_seconds(F.lit(1735689600)), "review_status": status})
    base = base.withColumn("payload", F.col("payload").withField("table_title", F.lit("again")))
    again = base.filter("k % 3 = 0").withColumn("id", F.concat(F.lit("n"), "k"))
    fresh = base.filter("k % 5 = 0").withColumns({"id": F.concat(F.lit("n"), "k"), "table_id": F.concat("table_id", F.lit("x"))})
    columns = ["id", "document_id", "table_id", "payload", "provenance", "validation", "review_status", "created_at", "updated_at"]
    stored = versioned.create(t.select(*columns), scratch_path(spark, "table-records"), ["document_id", "table_id"], buckets=8)
    H.save_table_records(spark, stored, again.unionByName(fresh))
    out = versioned.read(spark, stored)
    return out.select("id", "document_id", "table_id", "payload.table_title", "review_status", F.unix_seconds("created_at").alias("created_s"), F.unix_seconds("updated_at").alias("updated_s"))


@query(
    "typed_table_schemas",
    """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row FROM orders),
n AS (SELECT c % 1000 AS s, c % 2 AS p, count(DISTINCT c) AS tables, count(*) AS records FROM o GROUP BY 1, 2)
SELECT c AS custkey, cast(row AS integer) AS row, concat('A|A_2|Key|T', c % 1000) AS columns, concat('long|double|long|', CASE WHEN c % 2 = 0 THEN 'string' ELSE 'double' END) AS types, tables, records,
  concat('{"A":', k % 7, ',"A_2":', k % 5, '.5,"Key":', k, ',"T', c % 1000, '":', CASE WHEN c % 2 = 0 THEN concat('"', k % 9, ' kg"') ELSE concat(k % 9, '.0') END, '}') AS value
FROM o JOIN n ON n.s = c % 1000 AND n.p = c % 2
""",
)
def _(spark, sf):
    """One table per customer, a thousand schemas, written in one pass; of columns sharing a name the last one counts."""
    cells = "concat('<tr><td>', o_orderkey % 7, '<td>x<td>', o_orderkey, '<td>', o_orderkey % 9, case when o_custkey % 2 = 0 then ' kg' else '%' end, '<td>', o_orderkey % 5, '.5')"
    rows = D.table(spark, sf, "orders").selectExpr("o_custkey as custkey", "o_orderkey as k", f"{cells} as tr")
    tables = rows.groupBy("custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tr"))), lambda x: x["tr"]), "").alias("trs"))
    head = F.concat(F.lit("<table><tr><th>A<th>A_2<th>Key<th>T"), F.col("custkey") % 1000, F.lit("<th>A</tr>"))
    path = scratch_path(spark, "typed-schemas")
    H.write_typed_tables(H.parsed_tables(tables.select("custkey", F.concat(head, "trs", F.lit("</table>")).alias("html"))), ["custkey"], path)
    stored = spark.read.parquet(path)
    schemas = H.table_schemas(stored).select("schema_id", F.array_join("columns", "|").alias("columns"), F.array_join("types", "|").alias("types"), "tables", "records")
    found = stored.where("row is not null").drop("columns", "types").join(schemas, "schema_id")
    return found.select("custkey", "row", "columns", "types", "tables", "records", F.to_json("values").alias("value"))
