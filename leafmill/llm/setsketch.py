"""Near duplicates by SetSketch registers.

A document is the set of its hashed word shingles; documents with equal sets form a
class. A sketch holds REGISTERS registers. Register i is the largest of
``floor(1 - log_b(x))`` over the set, x being exponentially distributed by the i-th hash
of a shingle, cut to 0..65535: a truncated minimum on exponentially spaced steps. The
maximum of two sketches is the sketch of the union (``merge``).

Classes meet where the registers of one of BANDS bands agree; with a similarity of 0.85
or more a pair misses every band with a probability below 3e-7. Buckets with the same
members are one. In a bucket's task each pair is looked at in the first band it shares
only: sizes, then the joint likelihood of its registers, given both sizes, must allow the
similarity with a margin of five standard errors; what is left is confirmed on the full
sets, likeliest first, and skipped where the bucket has already joined both. So a task
emits fewer links than members and no pair ever becomes a row. A large bucket is dealt
out as pairs of blocks.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing, each row by itself; a text with fewer words than ``width`` is one shingle;
repeated rows are copies; rows without an id take the least id of their component (null
where it has none) and are not marked kept; an empty table gives an empty table; further
columns are not read. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import components
from leafmill.llm.jaccard import _grouped, _starts, set_hash, shingle_sets
from leafmill.llm.words import chunks, mix, stream
from leafmill.session import materialize

BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
MARGIN = 5.0
BLOCK_MEMBERS, BLOCK_BYTES = 1024, 1 << 24
STEP = 4096

_XOR, _TIMES = stream(REGISTERS, 21), stream(REGISTERS, 22) | np.uint64(1)
_BAND = stream(ROWS, 23) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STEP):
        np.minimum(least, ((shingles[at : at + STEP, None] ^ _XOR) * _TIMES).min(0), out=least)
    # The step is monotone, so it is taken once, of the least hash.
    x = -np.log1p(-np.minimum((least + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(one, two)


def _chance(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that a register of one set exceeds the other's, and its derivative."""
    part = (BASE - 1) / BASE
    return -np.log1p(-x * part) / math.log(BASE), part / (math.log(BASE) * (1 - x * part))


def slope(more: np.ndarray, less: np.ndarray, same: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Derivative of the registers' joint log-likelihood by the similarity.

    The likelihood is concave, so a slope of 0 or more says that its maximum lies at
    ``similarity`` or above. n and m are the sizes; neither may be under ``similarity``
    times the other.
    """
    u, v = n / (n + m), m / (n + m)
    (p, dp), (q, dq) = _chance(u - v * similarity), _chance(v - u * similarity)
    return same * (v * dp + u * dq) / (1 - p - q) - more * v * dp / p - less * u * dq / q


def least_estimate(share: int) -> float:
    """The estimate below which a pair cannot reach the similarity, but for the margin."""
    t = share / 100
    return max(0.01, t - MARGIN * math.sqrt(t * (1 - t) / REGISTERS))


def estimate(one: np.ndarray, two: np.ndarray, n: int, m: int) -> float:
    """Likeliest similarity of two sketched sets of known sizes."""
    counts = [np.array([float(c)]) for c in ((one > two).sum(), (one < two).sum(), (one == two).sum())]
    low, high = 0.0, min(n, m) / max(n, m) * (1 - 1e-9)
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(*counts, np.array([n]), np.array([m]), mid)[0] >= 0 else (low, mid)
    return low


def _facts(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            known: dict[int, bytes] = {}  # copies in one slice are sketched once
            hashes = [set_hash(s) if len(s) else None for s in sets]
            for h, s in zip(hashes, sets, strict=True):
                if h is not None and h not in known:
                    known[h] = registers(s).tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "t": part.column("t"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "s": pa.array(hashes, pa.int64()),
                    "sketch": pa.array([known.get(h) for h in hashes], pa.binary()),
                }
            )

    return task


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key per band; its last five bits are the band."""
    for batch in batches:
        bands = _matrix(batch.column("sketch")).reshape(-1, BANDS, ROWS).astype(np.uint64)
        number = np.arange(BANDS, dtype=np.uint64)
        keys = mix((bands * _BAND).sum(2, dtype=np.uint64) + number) & ~np.uint64(BANDS - 1) | number
        yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "s": np.repeat(batch.column("s").to_numpy(), BANDS)})


def _sets(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_pydict({"s": part.column("s"), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    return task


def linked(one: np.ndarray, two: np.ndarray, share: int) -> bool:
    small, large = (one, two) if len(one) < len(two) else (two, one)
    both = int((large[np.searchsorted(large, small).clip(0, len(large) - 1)] == small).sum())
    return 100 * both >= share * (len(one) + len(two) - both)


def bucket_links(band: int, sketches: np.ndarray, n: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links (places) that join members of ``left`` and ``right``; equal arrays mean one block."""
    cut, one_block = least_estimate(share), left is right
    found = []
    for k, i in enumerate(left):
        at = right[k + 1 :] if one_block else right
        at = at[100 * np.minimum(n[at], n[i]) >= share * np.maximum(n[at], n[i])]
        if not len(at):
            continue
        same = sketches[at] == sketches[i]
        first = ~same[:, : band * ROWS].reshape(len(at), band, ROWS).all(2).any(1)
        at, same = at[first], same[first].sum(1)
        if not len(at):
            continue
        more = (sketches[i] > sketches[at]).sum(1)
        fit = slope(more, REGISTERS - same - more, same, n[i], n[at], cut) >= 0
        if fit.any():
            found.append(np.stack([same[fit], np.full(int(fit.sum()), i), at[fit]]))
    if not found:
        return []
    pairs = np.concatenate(found, 1)
    pairs = pairs[:, np.argsort(-pairs[0], kind="stable")]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for i, j in zip(pairs[1].tolist(), pairs[2].tolist(), strict=True):
        if (a := root(i)) != (b := root(j)) and linked(sets[i], sets[j], share):
            parent[a] = b
            out.append((i, j))
    return out


def _links(share: int):
    """Of rows sorted by (g, block, other): links that join components of a pair of blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, ["g", "block", "other"]):
            g, block, other, mine, band, s, n = (batch.column(c).to_numpy() for c in ("g", "block", "other", "mine", "band", "s", "n"))
            sketches = _matrix(batch.column("sketch"))
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            bounds = np.append(_starts(g, block, other), len(g))
            a, b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                left = np.arange(lo, hi)[mine[lo:hi] == block[lo]]
                right = left if block[lo] == other[lo] else np.arange(lo, hi)[mine[lo:hi] == other[lo]]
                for i, j in bucket_links(int(band[lo]), sketches, n, sets, left, right, share):
                    a.append(s[i])
                    b.append(s[j])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return task


def link(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: id, n, s; classes with links: node, label). ``share`` is the similarity in hundredths."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    facts = materialize(texts.mapInArrow(_facts(width), f"id {id_type}, t long, n long, s long, sketch binary"), "setsketch-facts")
    # A class is represented by one of its rows, named by id and text, so rows without id stay apart.
    classes = facts.where("s is not null").groupBy("s").agg(F.min(F.struct("id", "t")).alias("row"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "setsketch-classes")
    posted = materialize(classes.select("sketch", "s").mapInArrow(_postings, "key long, s long"), "setsketch-postings")
    met = posted.groupBy("key").agg(F.count("*").alias("members"), F.expr("bit_xor(xxhash64(s))").alias("x"), F.min("s").alias("low")).where("members > 1")
    # Buckets of the same members are one, in the least of their bands.
    found = posted.join(met, "key").select(F.xxhash64("x", "members", "low").alias("g"), F.expr(f"cast(key & {BANDS - 1} as int)").alias("band"), "s")
    buckets = materialize(found.groupBy("g", "s").agg(F.min("band").alias("band")), "setsketch-buckets")
    known = materialize(classes.join(buckets.select("s").distinct(), "s"), "setsketch-known")
    want = known.select("s", F.col("row.id").alias("want_id"), F.col("row.t").alias("want_t"))
    chosen = texts.join(want, (F.col("t") == F.col("want_t")) & F.col("id").eqNullSafe(F.col("want_id"))).select("s", "text")
    sets = chosen.mapInArrow(_sets(width), "s long, shingles binary")
    whole = materialize(known.select("s", "n", "sketch").join(sets, "s"), "setsketch-sets")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    split = buckets.join(known.select("s", "n"), "s").groupBy("g").agg(parts.alias("parts"))
    rows = (
        buckets.join(split, "g")
        .withColumn("mine", F.pmod(F.xxhash64("s"), F.col("parts").cast("long")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("g", F.least("mine", "with").alias("block"), F.greatest("mine", "with").alias("other"), "mine", "band", "s")
        .join(whole, "s")
        .select("g", "block", "other", "mine", "band", "s", "n", "sketch", "shingles")
    )
    links = rows.repartition("g", "block", "other").sortWithinPartitions("g", "block", "other").mapInArrow(_links(share), "a long, b long")
    return facts.select("id", "n", "s"), components(materialize(links.distinct(), "setsketch-links"))


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept is the row with its component's least id."""
    facts, labels = link(docs, width, share, id_col, text_col)
    classes = facts.where("s is not null").groupBy("s").agg(F.min("id").alias("least"))
    named = classes.join(labels, F.col("s") == F.col("node"), "left").select("s", "least", F.coalesce("label", "s").alias("label"))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(heads, "label").select(F.col("s").alias("class"), "component_id")
    out = facts.join(by_class, F.col("s") == F.col("class"), "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
