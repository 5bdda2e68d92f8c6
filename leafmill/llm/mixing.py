"""Mixing sources to target weights by temperature.

A source's share of all tokens, raised to an exponent and normalised, is its weight.
The exponent is bisected: 1 keeps the shares, 0 makes all sources equal. It is the
least one (the most even mixture) that respects the repetition limit, or the one that
meets a target entropy if that lies above it. A token budget times the weight is a
source's quota. It is realised by block permutations: a source's documents are hashed
into BLOCKS blocks; whole epochs take every document once each; the last, partial
epoch takes blocks in the order of a seeded hash until the quota is full, and of the
block that crosses the quota the documents, in hash order, that still fit.

Only the token totals by source reach the driver. No window spans a source's rows: it
spans a source's blocks, of which there are BLOCKS at most, or one block's rows.

Defined results: a null source is a source of its own; a null or empty text has no
tokens and is taken once per epoch, the partial one included where its block is;
repeated rows are taken independently; rows of one id are ordered by their texts, and
rows without id are dealt to blocks by their texts; an empty table gives an empty
table; further columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.words import fresh

WORD = r"[^\x20\x09-\x0D]+"


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(totals: list[int], exponent: float) -> list[float]:
    """Normalised powers of the shares; a source without tokens gets nothing."""
    whole = sum(totals)
    raised = [(t / whole) ** exponent if t else 0.0 for t in totals]
    return [r / sum(raised) for r in raised] if whole else [0.0] * len(totals)


def bisect(holds, steps: int = 60) -> float:
    """The least exponent between 0 and 1 from which on ``holds``, which holds at 1."""
    low, high = 0.0, 1.0
    if holds(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def mixture(totals: list[int], budget: int, max_repeats: float | None, target_entropy: float | None) -> tuple[float, list[float]]:
    """(exponent, weights). The repetition limit wins over the target entropy."""
    if max_repeats is not None and budget > max_repeats * sum(totals) * (1 + 1e-12):
        raise ValueError("the budget needs more repetition than the limit allows")
    fits = lambda a: max_repeats is None or all(w * budget <= max_repeats * t * (1 + 1e-12) for w, t in zip(tempered(totals, a), totals, strict=True))
    exponent = bisect(fits)
    if target_entropy is not None:
        exponent = max(exponent, bisect(lambda a: entropy(tempered(totals, a)) <= target_entropy))
    return exponent, tempered(totals, exponent)


def mix(docs: DataFrame, budget: int | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None, seed: str = "mix", blocks: int = 4096, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the mixture, a document once for each time it is taken.

    All columns of ``docs``, then ``mix_tokens``, ``mix_epoch`` (0, 1, ...), ``mix_block``
    and ``mix_weight``; of these names, those that ``docs`` has itself end in underscores
    here. ``budget`` is in words; by default as many as the documents have.
    """
    spark = docs.sparkSession
    digits = 3 if blocks <= 4096 else 4
    # The rows travel as one value, so that none of their names meets those made here.
    text_hash = F.xxhash64(F.col(text_col))
    marked = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("mix_row"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("mix_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("mix_tokens"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("|"), text_hash.cast("string"))))).alias("mix_order"),
        F.struct(F.col(id_col), text_hash).alias("mix_tie"),
    ).withColumn("mix_block", F.pmod(F.conv(F.substring("mix_order", 1, digits), 16, 10).cast("int"), F.lit(blocks)))
    by_block = marked.groupBy("mix_key", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens"))
    totals = sorted((r[0], r[1] or 0) for r in by_block.groupBy("mix_key").agg(F.sum("block_tokens")).collect())
    whole = sum(t for _, t in totals)
    budget = whole if budget is None else budget
    _, weights = mixture([t for _, t in totals], budget, max_repeats, target_entropy)
    quotas = []
    for (key, total), weight in zip(totals, weights, strict=True):
        quota = math.floor(weight * budget + 1e-6)
        quotas.append((key, quota // total if total else 1, quota % total if total else 0, float(weight)))
    quota = spark.createDataFrame(quotas, "mix_key string, mix_full long, mix_left long, mix_weight double")
    order = F.md5(F.concat_ws("|", F.lit(seed), "mix_key", F.col("mix_full").cast("string"), F.col("mix_block").cast("string")))
    running = Window.partitionBy("mix_key").orderBy("place", "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        by_block.join(quota, "mix_key")
        .withColumn("place", order)
        .withColumn("mix_before", F.coalesce(F.sum("block_tokens").over(running), F.lit(0)))
        .drop("place", "block_tokens")
    )
    inside = Window.partitionBy("mix_key", "mix_block").orderBy("mix_order", "mix_tie").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        marked.join(placed, ["mix_key", "mix_block"])
        .withColumn("mix_end", F.col("mix_before") + F.sum("mix_tokens").over(inside))
        .withColumn("mix_copies", F.col("mix_full") + ((F.col("mix_end") <= F.col("mix_left")) & (F.col("mix_left") > 0)).cast("long"))
        .where("mix_copies > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)))
    )
    made = ["mix_tokens", "mix_epoch", "mix_block", "mix_weight"]
    named = zip(made, fresh(docs.columns, *made), strict=True)
    return taken.select(*(F.col("mix_row").getField(c).alias(c) for c in docs.columns), *(F.col(a).alias(b) for a, b in named))
