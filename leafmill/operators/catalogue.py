"""Document catalogue: state predicates, patches and cascading deletes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.views import page_coverage
from leafmill.operators.windows import is_large
from leafmill.sources import versioned

PATCHABLE = ["filename", "file_path", "page_count", "parse_status", "parse_error"]


def documents_latest(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.col("created_at").desc(), "id")


def large_document(documents: DataFrame) -> DataFrame:
    return documents.withColumn("large", is_large(F.col("page_count"), F.col("bytes")))


def auto_parse_queue(documents: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Large documents neither completed nor being parsed right now.

    ``running`` lists document_ids with a live job; without it a parsing status
    counts as live.
    """
    waiting = documents.filter(is_large(F.col("page_count"), F.col("bytes")) & (F.col("parse_status") != "completed"))
    if running is None:
        return waiting.filter("parse_status <> 'parsing'")
    live = running.select(F.col("document_id").alias("id"), F.lit(True).alias("_live")).distinct()
    return waiting.join(live, "id", "left").filter(~((F.col("parse_status") == "parsing") & F.coalesce("_live", F.lit(False)))).drop("_live")


def needs_full_parse(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Not completed, or no blocks, or blocks that stop short of the last pages."""
    cover = page_coverage(documents, blocks).withColumnRenamed("document_id", "id")
    return documents.join(cover, "id").filter(
        (F.col("parse_status") != "completed")
        | (F.col("block_count") == 0)
        | (F.col("max_page") < F.greatest(F.col("page_count") - 2, F.lit(1)))
    )


def extracted_documents(documents: DataFrame, reactions: DataFrame, tables: DataFrame, present: bool = True) -> DataFrame:
    """Documents with (or without) any reaction or table record."""
    done = reactions.select("document_id").union(tables.select("document_id")).distinct()
    how = "left_semi" if present else "left_anti"
    return documents.join(done, documents["id"] == done["document_id"], how)


def update_document(documents: DataFrame, patches: DataFrame, now: Column | None = None) -> DataFrame:
    """Partial update: given fields win, updated_at moves, hash and created_at stay.

    ``patches`` has at most one row per id. A null field means not given, except
    parse_error, which clears when ``clear_error`` is true.
    """
    stamp = F.current_timestamp() if now is None else now
    given = [c for c in PATCHABLE if c in patches.columns]
    p = patches.select("id", *[F.col(c).alias(f"p_{c}") for c in given], *[c for c in ("clear_error",) if c in patches.columns], F.lit(True).alias("_hit"))
    joined = documents.join(p, "id", "left")

    def patched(c: str) -> Column:
        if c == "updated_at":
            return F.when(F.col("_hit"), stamp).otherwise(F.col(c))
        value = F.coalesce(f"p_{c}", c) if c in given else F.col(c)
        if c == "parse_error" and "clear_error" in patches.columns:
            value = F.when(F.coalesce("clear_error", F.lit(False)), F.lit(None).cast("string")).otherwise(value)
        return value

    return joined.select(*[patched(c).alias(c) for c in documents.columns])


def delete_cascade(tables: Mapping[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the doomed documents' rows.

    ``tables`` may hold documents, blocks, reactions, table_records, runs and
    run_events; events go with their run. ``doomed`` has document_id.
    """
    ids = doomed.select("document_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "documents":
            out[name] = df.join(ids, df["id"] == ids["document_id"], "left_anti")
        elif name == "run_events":
            gone = tables["runs"].join(ids, "document_id", "left_semi").select(F.col("run_id"))
            out[name] = df.join(gone, "run_id", "left_anti")
        else:
            out[name] = df.join(ids, "document_id", "left_anti")
    return out


def patch_documents(spark: SparkSession, stored: versioned.Table, patches: DataFrame, now: Column | None = None) -> int:
    """Partial update of a stored catalogue: only the patched documents are read and written."""
    current = versioned.read(spark, stored, patches.select("id"))
    return versioned.commit(spark, stored, update_document(current, patches, now))


def delete_documents(spark: SparkSession, stored: Mapping[str, versioned.Table], doomed: DataFrame) -> None:
    """Documents and everything that hangs on them go from the stored tables, children first.

    Tables are those of ``delete_cascade``; each is keyed by its document (documents by id,
    run_events by run_id). Deletion writes keys only. It can be repeated after a failure.
    """
    ids = doomed.select("document_id").distinct()
    for name in sorted(stored, key=["run_events", "runs", "table_records", "reactions", "blocks", "documents"].index):
        t = stored[name]
        if name == "run_events":
            gone = versioned.read(spark, stored["runs"], ids).select("run_id")
        else:
            gone = ids.withColumnRenamed("document_id", t.key[0])
        rows = versioned.read(spark, t, gone).select(*t.key).distinct()
        versioned.commit(spark, t, replaced=rows)


def clear_extractions(reactions: DataFrame, tables: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the reaction and table records of the doomed documents go."""
    out = delete_cascade({"reactions": reactions, "table_records": tables}, doomed)
    return out["reactions"], out["table_records"]


def orphan_check(child: DataFrame, parent: DataFrame, key: str = "document_id", parent_key: str = "id") -> DataFrame:
    """Child rows without a parent."""
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.join(p, key, "left_anti")
