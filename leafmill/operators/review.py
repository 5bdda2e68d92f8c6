"""Review patches and exports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import example_schema as S
from leafmill.functions import text as X
from leafmill.functions.ordering import with_ends
from leafmill.operators.records import DEFAULT_SCHEMA
from leafmill.operators.user_records import projected_text

KEEP_NULLS = {"ignoreNullFields": "false"}
TABLE_KEYS = ["table_id", "table_path", "table_title", "table_description", "source_image_path"]


def exportable(records: DataFrame, include_pending: bool = False) -> DataFrame:
    status = F.col("review_status")
    return records.filter(status != "rejected" if include_pending else status.isin("approved", "edited"))


def patch_status(status: Column, payload: Column) -> Column:
    """Status one patch sets: the given one, else edited when it carries a payload."""
    return F.coalesce(status, F.when(payload.isNotNull(), F.lit("edited")))


def fold_patches(patches: DataFrame) -> DataFrame:
    """Net effect of all patches per reaction: last given value of each field, by seq.

    Works the same on a batch and on a stream; partial aggregates combine before
    the shuffle.
    """
    fields = [c for c in ("payload", "provenance", "validation") if c in patches.columns]
    status = patch_status(F.col("review_status"), F.col("payload"))
    p = patches.withColumn("_status", status)

    def last(c: str) -> Column:
        # max_by skips rows whose ordering value is null.
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))

    at = [F.max_by("at", "seq").alias("updated_at")] if "at" in patches.columns else []
    return p.groupBy("reaction_id").agg(
        *[last(c).alias(c) for c in fields],
        last("_status").alias("review_status"),
        *at,
        F.max("seq").alias("seq"),
    )


def apply_patches(reactions: DataFrame, folded: DataFrame) -> DataFrame:
    """Reactions with folded patches applied; the rules are not run again.

    The last patch's time becomes the record's; a record without patch keeps its own.
    """
    fields = [c for c in ("payload", "provenance", "validation", "review_status", "updated_at") if c in folded.columns]
    p = folded.select(F.col("reaction_id").alias("id"), *[F.col(c).alias(f"p_{c}") for c in fields])
    out = reactions.join(p, "id", "left")
    return out.withColumns({c: F.coalesce(f"p_{c}", c) for c in fields}).drop(*[f"p_{c}" for c in fields])


def projected_payload(records: DataFrame, example: dict[str, Any] | None = None) -> Column:
    """Payload as JSON text in the example's shape, the default one if none is given; null fields kept.

    A typed payload already has the default shape; a variant one is projected.
    """
    if example is not None:
        return projected_text(example, F.col("payload"))
    kind = records.schema["payload"].dataType.typeName()
    value = S.project(DEFAULT_SCHEMA, F.col("payload")) if kind == "variant" else F.col("payload")
    return F.to_json(value, KEEP_NULLS)


def export_jsonl(reactions: DataFrame, include_pending: bool = False, example: dict[str, Any] | None = None) -> DataFrame:
    """One JSON line per exportable record, in creation order within the document."""
    rows = exportable(reactions, include_pending)
    return rows.select("document_id", "created_at", "id", projected_payload(rows, example).alias("value"))


AT = ["created_at", "id"]


def json_array_lines(lines: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Lines of a JSON array per document: "[" opens the first, "]" closes the last.

    A document's lines, in order, are its JSON file, so no array is ever built
    from a whole document. Of ``documents`` (id), those without lines get "[]".
    """
    marked = with_ends(lines, "document_id", AT)
    value = F.concat(F.when(F.col("opens"), "[").otherwise(""), "value", F.when(F.col("closes"), "]").otherwise(","))
    out = marked.select("document_id", *AT, value.alias("value"))
    if documents is None:
        return out
    bare = documents.select(F.col("id").alias("document_id")).join(lines.select("document_id").distinct(), "document_id", "left_anti")
    none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in AT]
    return out.unionByName(bare.select("document_id", *none, F.lit("[]").alias("value")))


def export_json(reactions: DataFrame, include_pending: bool = False, documents: DataFrame | None = None, example: dict[str, Any] | None = None) -> DataFrame:
    return json_array_lines(export_jsonl(reactions, include_pending, example), documents)


def export_tables(tables: DataFrame, include_pending: bool = False) -> DataFrame:
    rows = exportable(tables, include_pending)
    five = F.struct(*[F.col(f"payload.{k}").alias(k) for k in TABLE_KEYS])
    return rows.select("document_id", "created_at", "id", F.to_json(five, KEEP_NULLS).alias("value"))


def export_rxn_text(reactions: DataFrame, bodies: DataFrame, include_pending: bool = False) -> DataFrame:
    """Pieces of each document's record-file export, in creation order.

    ``bodies`` has document_id, rxn_path, body. Bodies are trimmed; all but the
    first follow the separator line.
    """
    rows = exportable(reactions, include_pending).filter(X.truthy(F.col("payload.rxn_path")).isNotNull())
    have = rows.select("document_id", "created_at", "id", F.col("payload.rxn_path").alias("rxn_path")).join(
        bodies, ["document_id", "rxn_path"]
    )
    return with_ends(have, "document_id", AT).select(
        "document_id", *AT, F.concat(F.when(F.col("opens"), "").otherwise(X.RXN_SEPARATOR), X.strip(F.col("body"))).alias("piece")
    )


def review_envelope(records: DataFrame, version: str) -> DataFrame:
    """Payload first, then review fields; every status is included."""
    p = F.col("provenance")
    head = [F.col(f"payload.{f}").alias(f) for f in records.schema["payload"].dataType.fieldNames()]
    return records.select(
        *head,
        F.col("document_id").alias("source_document_id"),
        p["page_no"].alias("page_no"),
        p["bbox"].alias("bbox"),
        F.lit(version).alias("schema_version"),
        "review_status",
        F.col("validation").alias("quality"),
        "provenance",
    )


def write_text_export(lines: DataFrame, path: str, value: str = "value", per_document: bool = False) -> None:
    """Write ordered export lines.

    Rows are range-partitioned by (document, created_at, id), so a document's
    lines lie in consecutive files in order and a very long document spans
    several tasks. By default each row is written with its document_id, one set
    of files for all documents. ``per_document`` makes a folder of plain text per
    document, for a chosen few: its part files read in name order are its export.
    """
    order = ["document_id", "created_at", "id"]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("document_id", F.col(value).alias("value"))
    if per_document:
        rows.write.mode("overwrite").partitionBy("document_id").text(path)
    else:
        rows.write.mode("overwrite").json(path)


def write_review(records: DataFrame, documents: DataFrame, version: str, path: str) -> None:
    """Review envelopes as JSON with null fields kept, tagged with the export stem of their file.

    Records of documents that ``documents`` (id, filename) lacks take the document's id.
    """
    stems = documents.select(F.col("id").alias("source_document_id"), X.export_stem(F.col("filename")).alias("stem"))
    told = review_envelope(records, version).join(stems, "source_document_id", "left").withColumn("stem", F.coalesce("stem", "source_document_id"))
    told.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
