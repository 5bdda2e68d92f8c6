"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.ArrayType(T.DoubleType())

MISSING = T.ArrayType(
    T.StructType(
        [
            T.StructField("field", T.StringType()),
            T.StructField("missing_reason", T.StringType()),
        ]
    )
)

CONDITIONS = T.StructType(
    [
        T.StructField("catalyst", T.StringType()),
        T.StructField("temperature_c", T.DoubleType()),
        T.StructField("time_h", T.DoubleType()),
    ]
)

REACTION_PAYLOAD = T.StructType(
    [
        T.StructField("reaction_text", T.StringType()),
        T.StructField("reaction_smiles", T.StringType()),
        T.StructField("atom_mapped_reaction_smiles", T.StringType()),
        T.StructField("reaction_latex", T.StringType()),
        T.StructField("rxn_path", T.StringType()),
        T.StructField("conditions", CONDITIONS),
        T.StructField("yield_percent", T.DoubleType()),
    ]
)

TABLE_PAYLOAD = T.StructType(
    [
        T.StructField("table_id", T.StringType()),
        T.StructField("table_path", T.StringType()),
        T.StructField("table_title", T.StringType()),
        T.StructField("table_description", T.StringType()),
        T.StructField("source_image_path", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("parse_status", T.StringType()),
        T.StructField("parse_error", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

BLOCK_META = T.StructType(
    [
        T.StructField("text_level", T.StringType()),
        T.StructField("sub_type", T.StringType()),
        T.StructField("page_size", T.ArrayType(T.DoubleType())),
        T.StructField("table_body", T.StringType()),
        T.StructField("table_caption", T.StringType()),
        T.StructField("table_footnote", T.StringType()),
        T.StructField("image_footnote", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("bbox_norm", BBOX),
        T.StructField("image_path", T.StringType()),
        T.StructField("reading_order", T.IntegerType()),
        T.StructField("meta", BLOCK_META),
    ]
)

RUN_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("run_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("progress", T.DoubleType()),
        T.StructField("message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Enumerations: fixed values shared with stored data.
REVIEW_STATUSES = ["pending", "approved", "edited", "uncertain", "rejected"]
PARSE_STATUSES = ["pending", "uploaded", "parsing", "completed", "failed"]
CHUNK_STATUSES = ["pending", "retrying", "completed", "failed"]
