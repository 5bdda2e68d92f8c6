"""Review patches and edits as a stream.

Whether an edit fits the schema shows in the edit alone, and what a patch sets depends on
nothing it replaces. So patches fold to the last accepted value of each field, in any
order of arrival, and no record needs state of its own while the stream runs.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions import example_schema as S
from leafmill.functions.ordering import settled
from leafmill.operators.review import apply_patches, patch_status
from leafmill.operators.user_records import as_variant, user_schema
from leafmill.streaming import state

FIELDS = ["payload", "provenance", "validation"]


def judged(patches: DataFrame, example: dict[str, Any]) -> DataFrame:
    """Patches with errors (none: accepted) and what they set.

    ``patches`` has seq, reaction_id, kind, payload (variant), review_status, and may have
    provenance, validation and at. A reviewer's patch (kind review) is taken as it is. An
    edit (kind edit) must fit the schema: it takes the checked payload and puts the record
    back to pending; one that does not fit changes nothing at all.
    """
    node = user_schema(example)
    edit = F.col("kind") == "edit"
    checked = S.validate(node, F.col("payload"))
    d = settled(patches, {"_c": F.when(edit & F.col("payload").isNotNull(), checked)})
    none = F.array().cast("array<string>")
    return d.withColumns(
        {
            "errors": F.coalesce("_c.errors", none),
            "payload": F.when(F.col("_c").isNotNull(), as_variant(node, F.col("_c.value"))).otherwise(F.col("payload")),
            "review_status": F.when(edit, F.lit("pending")).otherwise(F.col("review_status")),
        }
    ).drop("_c")


def partial_reviews(patches: DataFrame) -> DataFrame:
    """Partial states of records: the last value of each field that a patch gives, and its time."""
    fields = {c: (F.col(c), F.col(c).isNotNull()) for c in FIELDS if c in patches.columns}
    status = patch_status(F.col("review_status"), F.col("payload"))
    fields["review_status"] = (status, status.isNotNull())
    if "at" in patches.columns:
        fields["updated_at"] = (F.col("at"), F.lit(True))
    return state.folded(patches, "reaction_id", "seq", fields)


def partial_edits(patches: DataFrame, example: dict[str, Any]) -> DataFrame:
    return partial_reviews(judged(patches, example).where(F.size("errors") == 0))


def stream_review(patches: DataFrame, path: str, checkpoint: str, example: dict[str, Any] | None = None) -> StreamingQuery:
    """Keep the net effect of all patches per record; with an example, edits are judged by it."""
    fold = partial_reviews if example is None else lambda batch: partial_edits(batch, example)
    return state.append_states(patches, fold, path, checkpoint)


def refused(patches: DataFrame, example: dict[str, Any]) -> DataFrame:
    """(reaction_id, seq, errors) of edits that change nothing, of a batch or a stream."""
    return judged(patches, example).where(F.size("errors") > 0).select("reaction_id", "seq", "errors")


def reviewed(spark: SparkSession, reactions: DataFrame, path: str) -> DataFrame:
    """Records with every streamed patch applied."""
    return apply_patches(reactions, state.current(spark, path, "reaction_id"))
