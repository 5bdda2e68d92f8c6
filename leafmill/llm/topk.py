"""Exact top-k by inner product over vectors grouped by length.

Candidates are grouped into buckets of like length (norm), and a bucket of any size
into blocks of at most BLOCK_ROWS vectors. A first pass scores every query against a
few blocks of the longest vectors, which gives each query a score that its k-th best
cannot fall below. In the second pass every block compares this score with what its
longest vector could reach. The quotient is the block's local cosine threshold:
above 1 the block is left out (blocks that no query of a query block can use are left
out before any vector moves, by their lengths alone); a high one prunes by coordinates (a vector with such a
cosine must lie near the query in the query's largest coordinates); a low one prunes
by length alone. Survivors are verified by exact integer products.

Defined results: a vector that is null, empty of an id, or holds null or non-finite
components takes no part; rows that share a vec_id are candidates each, and queries
whose best scores are ranked together, never against one another; vectors
of different dimension are not compared; equal scores rank by smaller vec_id; a query
with fewer candidates gets all of them; scores outside the 64-bit range saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import materialize

BLOCK_ROWS = 4096
QUERY_ROWS = 256
FOCUS = 3  # coordinates looked at by coordinate pruning
HIGH_COSINE = 0.5
SLACK = 1e-9
FIRST_BLOCKS = 2

PACKED = "block long, dim int, longest double, ids array<long>, lens array<double>, values binary"
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, row, v, norm2, dim): components floor(scale * x) of the vectors that take part, every row with a number."""
    v = F.transform(F.col("v"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~bad)
        .select("vec_id", F.monotonically_increasing_id().alias("row"), v.alias("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        .withColumn("dim", F.size("v"))
    )


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition, sorted by block, to one row per block."""
    rest = None

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, rows in part.groupby("block", sort=False):
            values = np.array(rows["v"].tolist(), dtype=np.int64).reshape(len(rows), -1)
            lens = np.sqrt(rows["norm2"].to_numpy())
            out.append((block, values.shape[1], float(lens.max()), rows["vec_id"].to_numpy(), lens, values.tobytes()))
        return pd.DataFrame(out, columns=["block", "dim", "longest", "ids", "lens", "values"])

    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch])
        last = rest["block"].iloc[-1] if len(rest) else None
        done = rest[rest["block"] != last]
        if len(done):
            yield packed(done)
            rest = rest[rest["block"] == last]
    if rest is not None and len(rest):
        yield packed(rest)


def blocks(ints: DataFrame, rows: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """Packed blocks of like dimension and length, and by dimension the block numbers, longest vectors first.

    The counts by dimension and length class that reach the driver are bounded by the
    classes there are: four to each power of two.
    """
    kind = F.when(F.col("norm2") > 0, F.floor(2 * F.log2("norm2"))).otherwise(F.lit(-1)).cast("long")
    marked = ints.withColumn("kind", kind)
    sizes = sorted(((r["dim"], -r["kind"], r["count"]) for r in marked.groupBy("dim", "kind").count().collect()))
    first, number, by_dim = [], 0, {}
    for dim, kind_, count in sizes:
        parts = -(-count * 5 // (rows * 4))  # a fifth more, as hashing fills them unevenly
        first.append((dim, -kind_, number, parts))
        by_dim.setdefault(dim, []).extend(range(number, number + parts))
        number += parts
    places = ints.sparkSession.createDataFrame(first, "dim int, kind long, first long, parts long")
    spread = (
        marked.join(places, ["dim", "kind"])
        .withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))
        .select("block", "vec_id", "v", "norm2")
        .repartition(F.col("block"))
        .sortWithinPartitions("block")
    )
    return spread.mapInPandas(_pack, PACKED), by_dim


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats only where they are exact."""
    bound = float(np.sqrt((q.astype(float) ** 2).sum(-1).max(initial=0)) * np.sqrt((c.astype(float) ** 2).sum(-1).max(initial=0)))
    if bound < 2.0**52:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if bound < 2.0**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def search_block(q_ids, q, floor, c_ids, c, k: int) -> list[tuple[int, int, int]]:
    """Each query's k best candidates of one block that can reach the query's floor."""
    lens = np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.lexsort((c_ids, -lens))
    c, c_ids, lens = c[order], c_ids[order], lens[order]
    unit = c / np.maximum(lens, 1e-300)[:, None]
    q_lens = np.sqrt((q.astype(float) ** 2).sum(1))
    whole = np.zeros(len(q), bool)
    kept: list[tuple[int, np.ndarray]] = []
    for i in range(len(q)):
        reach = q_lens[i] * lens[0] * (1 + SLACK)
        if floor[i] > reach:
            continue
        cosine = floor[i] / reach if reach > 0 else -1.0
        if cosine >= HIGH_COSINE:
            # A unit vector of this cosine or more: each coordinate f lies within these bounds.
            u = q[i] / q_lens[i]
            focus = np.argsort(-np.abs(u))[:FOCUS]
            t = max(0.0, cosine * (1 - SLACK))
            near = np.ones(len(c), bool)
            for f in focus:
                width = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - u[f] * u[f])) + 1e-9
                low = t * u[f] - width if u[f] < t else u[f] * t - width
                high = 1.0 if u[f] >= t else t * u[f] + width
                if u[f] <= -t:
                    low = -1.0
                near &= (unit[:, f] >= low) & (unit[:, f] <= high)
            kept.append((i, np.flatnonzero(near)))
        else:
            n = len(c) if floor[i] <= 0 or q_lens[i] == 0 else int(np.searchsorted(-lens * q_lens[i] * (1 + SLACK), -floor[i], "right"))
            if n == len(c):
                whole[i] = True
            else:
                kept.append((i, np.arange(n)))
    out = []

    def best(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        fit = (c_ids[at] != q_ids[i]) & (scores >= floor[i])
        at, scores = at[fit], scores[fit]
        if len(at) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        for j in np.lexsort((c_ids[at], -scores))[:k]:
            out.append((int(q_ids[i]), int(c_ids[at[j]]), int(scores[j])))

    full = np.flatnonzero(whole)
    for i, scores in zip(full, _products(q[full], c) if len(full) else (), strict=True):
        best(int(i), np.arange(len(c)), scores)
    for i, at in kept:
        if len(at):
            best(i, at, _products(q[i : i + 1], c[at])[0])
    return out


def _search(k: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                dim = int(r.dim)
                q_ids, c_ids = np.asarray(r.q_ids, np.int64), np.asarray(r.ids, np.int64)
                q = np.frombuffer(r.q_values, np.int64).reshape(len(q_ids), dim)
                c = np.frombuffer(r.values, np.int64).reshape(len(c_ids), dim)
                found = search_block(q_ids, q, np.asarray(r.floors, float), c_ids, c, k)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return task


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row where ``is_query`` holds.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    # Written once: row numbers stay as they are, whichever executors are lost.
    ints = materialize(integer_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    candidates, c_blocks = blocks(ints, BLOCK_ROWS)
    queries, q_blocks = blocks(ints.where(is_query), QUERY_ROWS)
    if not q_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = materialize(candidates, "topk-candidates")
    queries = materialize(queries.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("lens").alias("q_lens"), F.col("values").alias("q_values")), "topk-queries")

    def searched(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        """The k best of each query over the pairs (q_block, block)."""
        both = pairs.join(queries, "q_block").join(floors, "q_block").join(candidates.select("block", "ids", "values"), "block")
        found = both.select("dim", "q_ids", "q_values", "floors", "ids", "values").mapInPandas(_search(k), FOUND)
        w = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", w).where(F.col("rank") <= k)

    # A few blocks of each dimension, of the longest vectors.
    few = spark.createDataFrame([(d, b) for d, at in c_blocks.items() for b in at[:FIRST_BLOCKS]], "dim int, block long")
    no_floor = queries.select("q_block", F.transform("q_ids", lambda _: F.lit(float("-inf"))).alias("floors"))
    first = searched(queries.select("q_block", "dim").join(few, "dim").drop("dim"), no_floor)
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k)
    flat = queries.select("q_block", F.posexplode(F.arrays_zip("q_ids", "q_lens")).alias("at", "q"))
    flat = flat.select("q_block", "at", F.col("q.q_ids").alias("query_id"), F.col("q.q_lens").alias("len")).join(floors.drop("n"), "query_id", "left")
    floor = F.coalesce("floor", F.lit(float("-inf")))
    # The least length of a candidate that could reach the floor of any query of the block.
    need = F.when(floor <= 0, F.lit(float("-inf"))).when(F.col("len") > 0, floor / F.col("len")).otherwise(F.lit(float("inf")))
    flat = materialize(
        flat.groupBy("q_block").agg(F.min(need).alias("need"), F.array_sort(F.collect_list(F.struct("at", floor.alias("floor")))).alias("f")).select("q_block", "need", F.col("f.floor").alias("floors")),
        "topk-floors",
    )
    lengths = candidates.select("block", "dim", "longest")
    wanted = flat.select("q_block", "need").join(queries.select("q_block", "dim"), "q_block").join(lengths, "dim").where(F.col("longest") * (1 + SLACK) >= F.col("need"))
    return searched(wanted.select("q_block", "block"), flat.select("q_block", "floors")).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
