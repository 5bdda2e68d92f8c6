"""Folder batch as set operations: what to parse, what to clear, what to extract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.catalogue import clear_extractions, extracted_documents, needs_full_parse


def batch_plan(documents: DataFrame, blocks: DataFrame, reactions: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per document with its steps: parse, clear, extract or skip.

    A document that needs a full parse is parsed, cleared and extracted again;
    otherwise it is extracted only when it has no records.
    """
    todo = needs_full_parse(documents, blocks).select("id", F.lit(True).alias("parse"))
    done = extracted_documents(documents, reactions, tables).select("id", F.lit(True).alias("has_records"))
    return (
        documents.select("id", "filename", "bytes")
        .join(todo, "id", "left")
        .join(done, "id", "left")
        .select(
            F.col("id").alias("document_id"),
            "filename",
            "bytes",
            F.coalesce("parse", F.lit(False)).alias("parse"),
            (F.coalesce("parse", F.lit(False)) & F.coalesce("has_records", F.lit(False))).alias("clear"),
            (F.coalesce("parse", F.lit(False)) | ~F.coalesce("has_records", F.lit(False))).alias("extract"),
        )
    )


def cleared(plan: DataFrame, reactions: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records left after clearing the documents to be parsed again."""
    return clear_extractions(reactions, tables, plan.filter("clear").select("document_id"))
