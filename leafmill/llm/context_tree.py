"""Language-model scores by context-tree weighting over bytes.

A text is coded as its words (A-Z lowered), each a sequence of bytes closed by a space,
and one end. A byte's context is the DEPTH bytes before it: those of its own word, the space
before it and the last two bytes of the word before; places beyond are a symbol of their
own. A byte is decomposed into eight binary
decisions; for each (context, bits so far) the training counts give a
Krichevsky-Trofimov estimate, and the estimates of all context depths are mixed by the
weights of context-tree weighting: with Pe a node's own block probability and Pw its
weighted one, Pw = (Pe + product of the deeper nodes' Pw) / 2, and a node's estimate
counts Pe / 2Pw against the deeper ones. The mixture ends at the deepest context that
training holds.

How it runs. The texts are written once in blocks of at most BLOCK_BYTES, a longer text
being a block of its own; the block numbers are stored beside the texts, so every later
pass reads the same blocks however the files are split. One pass leaves every block's distinct words with their training counts and its distinct (context,
byte) pairs. Both are counted by shuffles that grow with the corpus. The tree is cut
into shards by the last two bytes of the context and weighted bottom-up in each; the
two top levels, at most 256 * 255 + 255 binary nodes, are finished on the driver and
sent to the shards. The blocks' words and pairs are joined with their counts and code
lengths and meet the block's texts again. No vocabulary or tree is broadcast.

Defined results: the byte NUL is read as the byte one; a null or empty text has the end token only; a null id's remainder is
that of the empty text; without training documents every estimate is uniform; repeated
rows are documents of their own; an empty table gives an empty table; further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.words import LOWER, Words, chunks, mix, split_words
from leafmill.session import materialize

DEPTH = 6
CHUNK_BYTES = 4_000_000
BLOCK_BYTES = 32_000_000
SPACE = 32
WIDTH = np.uint64(8)
OUT = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) for counts n >= 0: by a table, beyond it by Stirling's series."""
    table = np.cumsum(np.concatenate([[0.5 * math.log(math.pi)], np.log(np.arange(4096) + 0.5)]))
    x = np.maximum(n, 4096) + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 4096, table[np.minimum(n, 4096).astype(np.int64)], far)


def _lfactorial(n: np.ndarray) -> np.ndarray:
    table = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, 4097))]))
    x = np.maximum(n, 4096) + 1.0
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 4096, table[np.minimum(n, 4096).astype(np.int64)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the block probability of a zeros and b ones."""
    return _lgamma_half(a) + _lgamma_half(b) - math.log(math.pi) - _lfactorial(a + b)


def word_units(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, tail) of every word with the last two bytes of the word before it in its text.

    A tail is two bytes, the older one in the upper; zero where there is none.
    """
    if not len(words.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    low = LOWER[words.data]
    last = low[words.end - 1].astype(np.uint64)
    older = np.where(words.end - words.start > 1, low[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    tail = np.zeros(len(last), np.uint64)
    tail[1:] = ((older << WIDTH) | last)[:-1]
    tail[words.begin[:-1][np.diff(words.begin) > 0]] = 0
    return mix(hashes + (tail + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), tail


def unit_pairs(words: Words, tail: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, place in ``at``) for every byte, and the closing space, of the words at ``at``.

    A pair is an integer of ``depth`` context bytes, oldest first, and then the byte.
    """
    lens = (words.end - words.start)[at]
    ends = np.cumsum(lens + 4)
    starts = ends - (lens + 4)
    s = np.full(int(ends[-1]) if len(ends) else 0, SPACE, np.uint8)
    s[starts], s[starts + 1] = (tail[at] >> WIDTH).astype(np.uint8), (tail[at] & np.uint64(255)).astype(np.uint8)
    unit = np.repeat(np.arange(len(at)), lens + 4)
    place = np.arange(len(s)) - starts[unit]
    inner = (place >= 3) & (place < (lens + 3)[unit])
    first = np.cumsum(lens) - lens
    flat = LOWER[words.data[np.arange(int(lens.sum())) - np.repeat(first - words.start[at], lens)]]
    s[inner] = np.maximum(flat, 1)
    coded = np.flatnonzero(place >= 3)
    place = place[coded]
    pair = s[coded].astype(np.uint64)
    for d in range(1, depth + 1):
        near = s[np.maximum(coded - d, 0)].astype(np.uint64)
        if d > 3:
            near *= (place >= d).astype(np.uint64)
        pair |= near << np.uint64(8 * d)
    return pair, unit[coded]


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], *(np.add.reduceat(v[order], first) if len(key) else v[order] for v in values))


def bit_nodes(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes (context * 256 + bits so far with a leading one) with their zeros and ones."""
    keys, zeros, ones = [], [], []
    for b in range(8):
        prefix = (byte >> np.uint64(8 - b)) | np.uint64(1 << b)
        one = ((byte >> np.uint64(7 - b)) & np.uint64(1)).astype(float)
        keys.append((context << WIDTH) | prefix)
        ones.append(n * one)
        zeros.append(n * (1 - one))
    return _sum_by(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


class Level:
    """The binary nodes of one context depth: zeros, ones, and the share that their own estimate has."""

    def __init__(self, context, byte, n, deeper: tuple[np.ndarray, np.ndarray] | None):
        self.key, self.zeros, self.ones = bit_nodes(context, byte, n)
        own = log_kt(self.zeros, self.ones)
        below = np.full(len(own), np.nan)
        if deeper is not None and len(deeper[0]):
            at = np.minimum(np.searchsorted(self.key, deeper[0]), max(len(self.key) - 1, 0))
            below[at] = deeper[1]
        leaf = np.isnan(below)
        weighted = np.where(leaf, own, np.logaddexp(own, np.where(leaf, 0, below)) - math.log(2))
        self.log_weighted = weighted
        self.share = np.where(leaf, 1.0, np.exp(np.minimum(own - math.log(2) - weighted, 0.0)))

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(known, zeros, ones, share) of nodes."""
        if not len(self.key):
            none = np.zeros(len(key))
            return none.astype(bool), none, none, none
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[at] == key
        return known, np.where(known, self.zeros[at], 0), np.where(known, self.ones[at], 0), np.where(known, self.share[at], 0)


def _cut(context: np.ndarray, depth: int) -> np.ndarray:
    return context & np.uint64((1 << (8 * max(depth, 0))) - 1)


def shard_levels(pair: np.ndarray, n: np.ndarray, depth: int, top: int) -> dict[int, Level]:
    """Levels ``depth`` down to ``top`` of the contexts at hand, deepest first."""
    context, byte = pair >> WIDTH, pair & np.uint64(255)
    levels: dict[int, Level] = {}
    deeper = None
    for d in range(depth, top - 1, -1):
        here = n > 0
        key, total = _sum_by((_cut(context[here], d) << WIDTH) | byte[here], n[here])
        level = Level(key >> WIDTH, key & np.uint64(255), total, deeper)
        levels[d] = level
        deeper = up(level, d)
    return levels


def up(level: Level, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log weighted probabilities by the node one context byte shorter."""
    context, bits = level.key >> WIDTH, level.key & np.uint64(255)
    return _sum_by((_cut(context, d - 1) << WIDTH) | bits, level.log_weighted)


def code_lengths(pair: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the mixed probability of each pair's byte in its context."""
    context, byte = pair >> WIDTH, pair & np.uint64(255)
    total = np.zeros(len(pair))
    for b in range(8):
        prefix = (byte >> np.uint64(8 - b)) | np.uint64(1 << b)
        one = ((byte >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        mixed, left, last = np.zeros(len(pair)), np.ones(len(pair)), np.full(len(pair), 0.5)
        for d in sorted(levels):
            known, zeros, ones, share = levels[d].look((_cut(context, d) << WIDTH) | prefix)
            estimate = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)
            mixed += np.where(known, left * share * estimate, 0)
            left = np.where(known, left * (1 - share), left)
            last = np.where(known, estimate, last)
        total += np.log10(mixed + left * last)
    return total


def _block_facts(depth: int):
    """Per block: its distinct words and its distinct pairs, with their training counts."""
    kinds = {"block": pa.int64(), "word": pa.binary(), "h": pa.int64(), "pair": pa.int64(), "n": pa.int64()}

    def batch(block: int, size: int, **columns) -> pa.RecordBatch:
        columns |= {"block": np.full(size, block)}
        return pa.RecordBatch.from_pydict({k: pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()})

    def emit(block: int, known: dict, counts: list, pairs: list) -> Iterator[pa.RecordBatch]:
        yield batch(block, len(known), h=np.fromiter(known, np.uint64, len(known)).view(np.int64), word=[w for _, w in counts], n=[c for c, _ in counts])
        key, n = merged(pairs)
        yield batch(block, len(key), pair=key.view(np.int64), n=n.astype(np.int64))

    def merged(pairs: list) -> tuple[np.ndarray, np.ndarray]:
        return _sum_by(np.concatenate([k for k, _ in pairs]), np.concatenate([n for _, n in pairs])) if pairs else (np.zeros(0, np.uint64), np.zeros(0))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[dict, list, list]] = {}
        for part in chunks(batches, "text", CHUNK_BYTES):
            blocks = part.column("block").to_numpy(zero_copy_only=False)
            for block in np.unique(blocks):
                rows = part.filter(pa.array(blocks == block))
                words = split_words(rows.column("text"))
                hashes = words.hashes(True)
                train = rows.column("train").to_numpy(zero_copy_only=False).astype(float)[words.doc]
                h, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=train, minlength=len(h)).astype(np.int64)
                known, counts, pairs = seen.setdefault(int(block), ({}, [], []))
                low = LOWER[words.data].tobytes()
                for x, c, s, e in zip(h.tolist(), n.tolist(), words.start[first].tolist(), words.end[first].tolist(), strict=True):
                    if (at := known.get(x)) is None:
                        known[x] = len(counts)
                        counts.append([c, low[s:e]])
                    else:
                        counts[at][0] += c
                units, tail = word_units(words, hashes)
                _, first, inverse = np.unique(units, return_index=True, return_inverse=True)
                pair, unit = unit_pairs(words, tail, first, depth)
                pairs.append(_sum_by(pair, np.bincount(inverse, weights=train, minlength=len(first))[unit]))
                if len(pairs) >= 8:
                    pairs[:] = [merged(pairs)]
            for block in list(seen)[:-1]:  # a block's rows are read one after another
                yield from emit(block, *seen.pop(block))
        for block, facts in seen.items():
            yield from emit(block, *facts)

    return task


def _numbered(block_bytes: int):
    """Adds to every row the number of its block: the task's number and, below it, the block's in the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, block, held = TaskContext.get().partitionId() << 32, 0, 0
        for part in batches:
            numbers = np.empty(part.num_rows, np.int64)
            for i, size in enumerate(pc.fill_null(pc.binary_length(part.column("text")), 0).to_pylist()):
                if held and held + size > block_bytes:
                    block, held = block + 1, 0
                held += size
                numbers[i] = base + block
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers)], names=[*part.schema.names, "block"])

    return task


def _weigh(depth: int):
    """One shard's level 2, summed by the level above it: what the top of the tree needs."""

    def shard(rows: pa.Table) -> pa.Table:
        pair, n = rows["pair"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(float)
        key, total = up(shard_levels(pair, n, depth, 2)[2], 2)
        return pa.table({"key": key.view(np.int64), "below": total})

    return shard


def _predict(depth: int, top: dict[int, Level]):
    def shard(rows: pa.Table) -> pa.Table:
        pair, n = rows["pair"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(float)
        levels = shard_levels(pair, n, depth, 2) | top
        return pa.table({"pair": rows["pair"], "lp": code_lengths(pair, levels)})

    return shard


def _score_block(depth: int, id_type, known: dict):
    log_base = math.log10(known["n"] + 0.5 * (known["v"] + 1))
    p_end = (known["docs"] + 0.5) / (known["n"] + 1)

    def block(texts: pa.Table, facts: pa.Table) -> pa.Table:
        kind = facts["h"].is_null().to_numpy()
        h = facts["h"].filter(pa.array(~kind)).to_numpy().view(np.uint64)
        c = facts["c"].filter(pa.array(~kind)).to_numpy().astype(float)
        pair = facts["pair"].filter(pa.array(kind)).to_numpy().view(np.uint64)
        lp = facts["lp"].filter(pa.array(kind)).to_numpy()
        order, at = np.argsort(h), np.argsort(pair)
        h, c, pair, lp = h[order], c[order], pair[at], lp[at]
        out = []
        for part in chunks(texts.to_batches(), "text", CHUNK_BYTES):
            words = split_words(part.column("text"))
            hashes = words.hashes(True)
            units, tail = word_units(words, hashes)
            _, first, inverse = np.unique(units, return_index=True, return_inverse=True)
            mine = hashes[first]
            place = np.searchsorted(h, mine)
            if len(mine) and (h[place.clip(0, len(h) - 1)] != mine).any():
                raise RuntimeError("a block's texts differ from those of the first pass")
            count = c[place]
            pairs, unit = unit_pairs(words, tail, first, depth)
            word_lp = np.bincount(unit, weights=lp[np.searchsorted(pair, pairs)], minlength=len(mine)) + math.log10(1 - p_end) if len(mine) else np.zeros(0)
            base = (np.log10(count + 0.5) - log_base)[inverse]
            doc, docs = words.doc, part.num_rows
            sums = lambda x: np.bincount(doc, weights=x, minlength=docs)  # noqa: B023, E731
            out.append(
                pa.table(
                    {
                        "doc_id": part.column("id"),
                        "held_out": pa.array(~part.column("train").to_numpy(zero_copy_only=False)),
                        "n_tokens": np.diff(words.begin) + 1,
                        "n_known": (sums((count > 0)[inverse].astype(float)) + (known["docs"] > 0)).astype(np.int64),
                        "train_tokens": np.full(docs, known["n"]),
                        "base_score": sums(base) + math.log10(known["docs"] + 0.5) - log_base,
                        "score": sums(word_lp[inverse]) + math.log10(p_end),
                    }
                )
            )
        schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), *((k, pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return block


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document's log10 probability under the model and under word frequencies.

    Training documents are those whose crc32 of the id as text is not ``held`` modulo ``folds``.
    """
    train = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    texts = materialize(texts.mapInArrow(_numbered(block_bytes), T.StructType([*texts.schema.fields, T.StructField("block", T.LongType())])), "ctw-texts", "zstd")
    facts = materialize(texts.select("text", "train", "block").mapInArrow(_block_facts(depth), "block long, word binary, h long, pair long, n long"), "ctw-facts", "zstd")
    n_docs = texts.where("train").count()
    vocabulary = materialize(facts.where("word is not null").groupBy("word").agg(F.first("h").alias("h"), F.sum("n").alias("c")), "ctw-words", "zstd")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    known = {"n": n + n_docs, "v": v + (n_docs > 0), "docs": n_docs}
    tree = facts.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    tree = materialize(tree.withColumn("shard", F.shiftright("pair", 8).bitwiseAND(0xFFFF)), "ctw-pairs", "zstd")
    below = tree.groupBy("shard").applyInArrow(_weigh(depth), "key long, below double").groupBy("key").agg(F.sum("below").alias("below")).toPandas()
    one = tree.select(F.shiftright("pair", 8).bitwiseAND(0xFF).alias("context"), F.col("pair").bitwiseAND(0xFF).alias("byte"), "n").groupBy("context", "byte").agg(F.sum("n").alias("n")).where("n > 0").toPandas()
    top = top_levels(one, below)
    lengths = tree.groupBy("shard").applyInArrow(_predict(depth, top), "pair long, lp double")
    words = facts.where("word is not null").select("block", "h").join(vocabulary.select("h", "c"), "h").select("block", "h", "c", F.lit(None).cast("long").alias("pair"), F.lit(None).cast("double").alias("lp"))
    pairs = facts.where("pair is not null").select("block", "pair").join(lengths, "pair").select("block", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("c"), "pair", "lp")
    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    scored = texts.groupBy("block").cogroup(words.unionByName(pairs).groupBy("block")).applyInArrow(
        _score_block(depth, to_arrow_type(id_type), known), OUT.format(id=id_type.simpleString())
    )
    return scored.withColumnRenamed("doc_id", id_col)


def top_levels(one: pd.DataFrame, below: pd.DataFrame) -> dict[int, Level]:
    """Levels 1 and 0, from the byte counts by last byte and what level 2 passes up."""
    context, byte, n = (one[c].to_numpy() for c in ("context", "byte", "n"))
    below = below.sort_values("key")
    first = Level(context.astype(np.uint64), byte.astype(np.uint64), n.astype(float), (below["key"].to_numpy().view(np.uint64) if len(below) else np.zeros(0, np.uint64), below["below"].to_numpy()))
    root_byte, root_n = _sum_by(byte.astype(np.uint64), n.astype(float))
    return {1: first, 0: Level(np.zeros(len(root_byte), np.uint64), root_byte, root_n, up(first, 1))}
