"""Queries: eligibility, exports and review envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import views as D
from leafmill.fixtures.registry import query
from leafmill.operators import review as V
from leafmill.session import scratch_path


@query(
    "exportable",
    """
SELECT 'strict' AS mode, id, review_status FROM reactions WHERE review_status IN ('approved','edited')
UNION ALL SELECT 'pending', id, review_status FROM reactions WHERE review_status <> 'rejected'
""",
)
def _(spark, sf):
    r = D.reactions(spark, sf)
    cols = ["id", "review_status"]
    strict = V.exportable(r).select(F.lit("strict").alias("mode"), *cols)
    return strict.unionByName(V.exportable(r, include_pending=True).select(F.lit("pending").alias("mode"), *cols))


def _back(spark, path):
    return spark.read.schema("document_id string, value string").json(path)


FIELDS = "document_id, reaction_text, reaction_smiles, catalyst, temperature_c, yield_percent"


def _fields(df, value):
    def get(p, to="string"):
        return F.get_json_object(value, f"$.{p}").cast(to)

    return df.select(
        "document_id", get("reaction_text").alias("reaction_text"), get("reaction_smiles").alias("reaction_smiles"), get("conditions.catalyst").alias("catalyst"),
        get("conditions.temperature_c", "double").alias("temperature_c"), get("yield_percent", "double").alias("yield_percent"),
        F.contains(value, F.lit('"reaction_latex":null')).alias("keeps_null"),
        *[c for c in ("opens", "closes") if c in df.columns],
    )


@query("export_jsonl", f"SELECT {FIELDS}, true AS keeps_null FROM reactions WHERE review_status IN ('approved','edited')")
def _(spark, sf):
    path = scratch_path(spark, "export-jsonl")
    V.write_text_export(V.export_jsonl(D.reactions(spark, sf)), path)
    return _fields(_back(spark, path), F.col("value"))


@query(
    "export_json",
    f"""
SELECT {FIELDS}, true AS keeps_null, row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) = 1 AS opens,
  row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1 AS closes FROM reactions WHERE review_status <> 'rejected'
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, false, true, true FROM documents_cat WHERE id NOT IN (SELECT document_id FROM reactions WHERE review_status <> 'rejected')
""",
)
def _(spark, sf):
    path = scratch_path(spark, "export-json")
    V.write_text_export(V.export_json(D.reactions(spark, sf), include_pending=True, documents=D.documents_cat(spark, sf)), path)
    lines = _back(spark, path)
    value = F.regexp_replace("value", r"^\[|[\],]$", "")
    marked = lines.withColumns({"opens": F.col("value").startswith("["), "closes": F.col("value").endswith("]")})
    return _fields(marked, value)


@query(
    "export_tables",
    """
SELECT document_id, table_id, 'tables/' || table_id || '.parquet' AS table_path, table_title, true AS keeps_null FROM table_records WHERE review_status IN ('approved','edited')
""",
)
def _(spark, sf):
    path = scratch_path(spark, "export-tables")
    V.write_text_export(V.export_tables(D.table_records(spark, sf)), path)
    parts = [F.get_json_object("value", f"$.{k}").alias(k) for k in ("table_id", "table_path", "table_title")]
    return _back(spark, path).select("document_id", *parts, F.contains("value", F.lit('"table_description":null')).alias("keeps_null"))


@query(
    "export_rxn_text",
    """
SELECT document_id, CASE WHEN row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) = 1 THEN '' ELSE chr(10) || chr(10) || '$$$$' || chr(10) || chr(10) END || '$RXN ' || o_orderkey AS value
FROM reactions WHERE review_status IN ('approved','edited') AND rxn_path IS NOT NULL AND o_orderkey % 7 > 0
""",
)
def _(spark, sf):
    # Every seventh body lies under a name that no record has.
    bodies = D.table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey div 10 as string) as document_id", "concat('reactions/', o_orderkey, case when o_orderkey % 7 > 0 then '.rxn' else '.old' end) as rxn_path",
        "concat('\\n$RXN ', o_orderkey, '\\n ') as body",
    )
    path = scratch_path(spark, "export-rxn")
    V.write_text_export(V.export_rxn_text(D.reactions(spark, sf), bodies), path, value="piece")
    return _back(spark, path)


@query(
    "review_envelope",
    r"""
WITH r AS (SELECT document_id AS source_document_id, reaction_text AS title, page_no, 'reaction.v1' AS schema_version, review_status, true AS schema_valid, entry_label FROM reactions
  UNION ALL SELECT document_id, table_title, page_no, 'table.v1', review_status, true, NULL FROM table_records)
SELECT r.*, coalesce(regexp_replace(filename, '\.pdf$', ''), source_document_id) AS stem FROM r LEFT JOIN documents_cat d ON d.id = source_document_id
""",
)
def _(spark, sf):
    documents = D.documents_cat(spark, sf).select(F.col("id"), "filename")
    # Records of documents outside the catalogue are exported under their own id.
    out = None
    for df, version, title, label in ((D.reactions(spark, sf), "reaction.v1", "reaction_text", "provenance.entry_label"), (D.table_records(spark, sf), "table.v1", "table_title", None)):
        path = scratch_path(spark, f"review-{version}")
        V.write_review(df, documents, version, path)
        shape = V.review_envelope(df, version).schema.add("stem", "string")
        back = spark.read.schema(shape).json(path)
        entry = F.col(label) if label else F.lit(None).cast("string")
        rows = back.select(F.col(title).alias("title"), "source_document_id", "page_no", "schema_version", "review_status", "quality.schema_valid", entry.alias("entry_label"), "stem")
        out = rows if out is None else out.unionByName(rows)
    return out
