"""Alignment of two tokenizers' tokens over a corpus, by inverted pair bitmaps.

A text is encoded by a byte-level tokenizer (A) and by a piece tokenizer (B). Byte offsets
where tokens of both end cut the text into groups; every A token of a group is linked with
every B token of it. A task numbers the documents of a block and keeps, for each id pair,
a bitmap of the documents that hold it, beside planes with the bits of how often. Bitmaps
of slices are OR-merged into the block's and written in the shortest of three forms: set
bits as bytes of gaps, as 16-bit numbers, or a plain bitmap. Blocks hold different
documents, so a pair's document count is the sum of its bitmaps' popcounts. The counts then
return to the blocks along the bitmaps, and add up per document there.

Rows of a block are bounded (BLOCK_DOCS, BLOCK_ENTRIES), so a common pair has one row a
block, not one a document. A group with many tokens on both sides is counted by distinct
ids, never spelt out as a product.

Defined results: texts that are null, empty, or that either tokenizer does not give back
byte for byte (characters that B normalises) have zeros and an empty digest; repeated rows
are documents of their own; an empty table gives an empty table; further columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import chunks
from leafmill.session import materialize

# Fixed value: the pattern by which the byte-level alphabet's tokenizers cut a text.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose classes no two versions of Unicode tables tell apart lie below.
LATER = re.compile("[\u0370-\U0010ffff]")
SLICE_BYTES = 400_000
BLOCK_DOCS = 1 << 15
BLOCK_ENTRIES = 1_500_000
WIDE_GROUP = 256  # links of a group that are still spelt out one by one
GAPS, NUMBERS, BITS = 0, 1, 2
NO_IDS = np.zeros(0, np.int64)


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coders:
    """Both tokenizers, made from their files' contents, and the bytes of their tokens."""

    def __init__(self, byte_json: str, piece_model: bytes):
        self.byte_json, self.piece_model = byte_json, piece_model

    @cached_property
    def said(self) -> dict:
        return json.loads(self.byte_json)

    @cached_property
    def byte_level(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.byte_json)
        made.encode_special_tokens = True  # their strings in a text are ordinary text
        return made

    @cached_property
    def ranked(self):
        """The same tokenizer as ranks, which is faster; None where its file is not a plain list of ranks."""
        import tiktoken

        said = self.said
        model, before = said["model"], said.get("pre_tokenizer") or {}
        plain = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        single = len(model["vocab"]) - len(merged)
        in_order = [model["vocab"].get(m, -1) for m in merged]
        if not plain or model.get("type") not in (None, "BPE") or in_order != sorted(set(in_order)) or single not in (256, 257):
            return None
        byte = byte_of_char()
        wanted = set(merged) | set(byte)
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t in wanted}
        return tiktoken.Encoding("byte-level", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def byte_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids by A. Texts of common characters take the ranks, others the file's own library."""
        fast = self.ranked
        common = [fast is not None and LATER.search(t) is None for t in texts]
        others = [t for t, c in zip(texts, common, strict=True) if not c]
        # The library is loaded where a text needs it.
        rest = iter(self.byte_level.encode_batch_fast(others, add_special_tokens=False) if others else ())
        return [fast.encode_ordinary(t) if c else next(rest).ids for t, c in zip(texts, common, strict=True)]

    @cached_property
    def pieces(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.piece_model)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        vocabulary = self.said["model"]["vocab"] | {t["content"]: t["id"] for t in self.said.get("added_tokens", ())}
        byte = byte_of_char()
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(byte[c] for c in token)
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        p = self.pieces
        return [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))

    @cached_property
    def written(self) -> list[str]:
        """Every id followed by each of the four separators."""
        return [f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for end in (",", "|", ";", "")]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of space+text by A and of text by B; None where the bytes differ."""
        spaced = [" " + t for t in texts]
        a = self.byte_ids(spaced)
        b = self.pieces.encode(texts, num_threads=1)
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        whole = [t.encode() for t in spaced]
        return [(x, y) if b"".join(map(a_of, x)) == w and b"".join(map(b_of, y)) == w else None for x, y, w in zip(a, b, whole, strict=True)]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] times each, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Aligned:
    """Groups and links of some documents' tokens, all laid end to end."""

    def __init__(self, coders: Coders, coded: list[tuple[list[int], list[int]]]):
        self.coders = coders
        self.n_a, self.n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([NO_IDS, *(np.array(c[k], np.int64) for c in coded)]) for k in (0, 1))
        ends = [np.cumsum(size[ids]) for size, ids in zip(coders.lengths, (self.a, self.b), strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        self.group_a, self.group_b = (np.searchsorted(common, e) for e in ends)
        self.in_a, self.in_b = (np.bincount(g, minlength=len(common)) for g in (self.group_a, self.group_b))
        last = ends[0][np.cumsum(self.n_a) - 1]  # a document's last byte ends a group
        self.doc = np.searchsorted(last, common)
        self.n_groups = np.bincount(self.doc, minlength=len(coded))
        self.n_links = np.zeros(len(coded), np.int64)
        np.add.at(self.n_links, self.doc, self.in_a * self.in_b)

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text."""
        # Places of the tokens in the text: a group's A ids, then its B ids.
        at_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]
        code = np.zeros(len(self.a) + len(self.b), np.int64)
        code[at_a], code[at_b] = 4 * self.a, 4 * self.b
        code[at_a[np.cumsum(self.in_a) - 1]] += 1
        code[at_b[np.cumsum(self.in_b) - 1]] += 2
        ends = np.cumsum(self.n_a + self.n_b)
        code[ends - 1] += 1
        written, code = self.coders.written, code.tolist()
        return [hashlib.sha256("".join(map(written.__getitem__, code[lo:hi])).encode()).hexdigest() for lo, hi in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist(), strict=True)]

    def links(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair * BLOCK_DOCS + document's number, how often) in order."""
        size_b = len(self.coders.b_bytes)
        wide = self.in_a * self.in_b > WIDE_GROUP
        first_b = np.cumsum(self.in_b) - self.in_b
        keep = np.flatnonzero(~wide[self.group_a])
        times = self.in_b[self.group_a[keep]]
        b = self.b[spread(first_b[self.group_a[keep]], times)]
        pair = np.repeat(self.a[keep], times) * size_b + b
        keys = [pair * BLOCK_DOCS + np.repeat(local[self.doc[self.group_a[keep]]], times)]
        counts = [np.ones(len(pair), np.int64)]
        first_a = np.cumsum(self.in_a) - self.in_a
        for g in np.flatnonzero(wide):
            a, some = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            b, more = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            keys.append(((a[:, None] * size_b + b) * BLOCK_DOCS + local[self.doc[g]]).ravel())
            counts.append((some[:, None] * more).ravel())
        return summed(np.concatenate(keys), np.concatenate(counts))


def packed(docs: np.ndarray, top: int) -> tuple[int, bytes]:
    """Sorted document numbers below ``top`` in their shortest form."""
    gaps = np.diff(docs, prepend=0)
    if gaps.max() < 256 and len(docs) <= top // 8 + 1:
        return GAPS, gaps.astype(np.uint8).tobytes()
    if 2 * len(docs) <= top // 8 + 1:
        return NUMBERS, docs.astype("<u2").tobytes()
    bits = np.zeros(top, bool)
    bits[docs] = True
    return BITS, np.packbits(bits).tobytes()


def unpacked(kind: int, data: bytes) -> np.ndarray:
    if kind == GAPS:
        return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.int64)
    if kind == NUMBERS:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def planes_of(times: np.ndarray) -> bytes | None:
    """Bits of how often, less one, a plane after another; None where every document has it once."""
    more = times - 1
    top = int(more.max()).bit_length()
    return b"".join(np.packbits((more >> k) & 1 == 1).tobytes() for k in range(top)) or None


def times_of(planes: bytes | None, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    if planes is not None:
        bits = np.unpackbits(np.frombuffer(planes, np.uint8).reshape(-1, -(-n // 8)), axis=1)[:, :n].astype(np.int64)
        out += (bits << np.arange(len(bits))[:, None]).sum(0)
    return out


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


class Block:
    """Bitmaps of up to BLOCK_DOCS documents."""

    def __init__(self, number: int):
        self.number, self.docs, self.entries = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def take(self, n: int) -> np.ndarray:
        self.docs += n
        return np.arange(self.docs - n, self.docs)

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(times)
        self.entries += len(keys)

    def postings(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.entries:
            return
        keys, times = summed(np.concatenate(self.keys), np.concatenate(self.times))
        pair, doc = keys // BLOCK_DOCS, keys % BLOCK_DOCS
        bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])), [len(pair)]])
        for at in range(0, len(bounds) - 1, 20_000):
            cut = bounds[at : at + 20_001].tolist()
            forms = [packed(doc[lo:hi], self.docs) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            planes = [planes_of(times[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            n = len(forms)
            yield _batch(
                schema,
                n,
                block=np.full(n, self.number),
                pair=pair[cut[:-1]],
                count=np.diff(cut),
                form=np.array([k for k, _ in forms], np.int8),
                docs=[d for _, d in forms],
                planes=planes,
            )


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


ROW = "block long, pair long, count long, form tinyint, docs binary, planes binary, local long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _align(files):
    """Rows of bitmaps (``pair`` set) and one row for each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(*files.value)
        base = TaskContext.get().partitionId() << 24
        block, schema = Block(base), None
        for part in (p.slice(i, BLOCK_DOCS) for p in chunks(batches, "text", SLICE_BYTES) for i in range(0, p.num_rows, BLOCK_DOCS)):
            if schema is None:
                kinds = {"long": pa.int64(), "tinyint": pa.int8(), "binary": pa.binary(), "string": pa.string()}
                schema = pa.schema([("id", part.column("id").type), *[(n, kinds[k]) for n, k in (f.split() for f in ROW.split(", "))]])
            texts = part.column("text").to_pylist()
            n = len(texts)
            if block.docs + n > BLOCK_DOCS or block.entries > BLOCK_ENTRIES:
                yield from block.postings(schema)
                block = Block(block.number + 1)
            facts = {c: np.zeros(n, np.int64) for c in FACTS}
            digest, local = [""] * n, block.take(n)
            live = [i for i, t in enumerate(texts) if t]
            coded = coders.encode([texts[i] for i in live]) if live else []
            held = [(i, c) for i, c in zip(live, coded, strict=True) if c is not None]
            if held:
                at = np.array([i for i, _ in held])
                aligned = Aligned(coders, [c for _, c in held])
                for c in FACTS:
                    facts[c][at] = getattr(aligned, c)
                for i, d in zip(at.tolist(), aligned.digests(), strict=True):
                    digest[i] = d
                block.add(*aligned.links(local[at]))
            yield _batch(schema, n, id=part.column("id"), block=np.full(n, block.number), local=local, groups_sha256=digest, **facts)
        if schema is not None:
            yield from block.postings(schema)

    return task


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by block, with their pair's count and whether it is its A id's best: sums by document."""
    schema = pa.schema([("block", pa.int64()), ("local", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    at, sums = None, np.zeros((2, BLOCK_DOCS), np.int64)

    def done() -> pa.RecordBatch:
        local = np.flatnonzero(sums[1])
        return _batch(schema, len(local), block=np.full(len(local), at), local=local, n_best=sums[0][local], count_sum=sums[1][local])

    for batch in batches:
        block, total, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "total", "best"))
        forms, docs, planes = (batch.column(c).to_pylist() for c in ("form", "docs", "planes"))
        bounds = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if at != block[lo]:
                if at is not None:
                    yield done()
                at, sums = block[lo], np.zeros((2, BLOCK_DOCS), np.int64)
            where = [unpacked(forms[i], docs[i]) for i in range(lo, hi)]
            times = [times_of(planes[i], len(w)) for i, w in zip(range(lo, hi), where, strict=True)]
            sizes = np.array([len(w) for w in where])
            where, times = np.concatenate(where), np.concatenate(times)
            np.add.at(sums[0], where, times * np.repeat(best[lo:hi].astype(np.int64), sizes))
            np.add.at(sums[1], where, times * np.repeat(total[lo:hi], sizes))
    if at is not None:
        yield done()


def align(docs: DataFrame, byte_json: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents; pairs: a_id, b_id, documents, best) of the tokenizers in the two files.

    The files are read on the driver and sent to the tasks; a tokenizer has some megabytes.
    """
    spark = docs.sparkSession
    with open(byte_json, encoding="utf-8") as f, open(piece_model, "rb") as g:
        contents = (f.read(), g.read())
    size_b = len(Coders(*contents).b_bytes)
    files = spark.sparkContext.broadcast(contents)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(texts.mapInArrow(_align(files), f"id {id_type}, {ROW}"), "alignment", codec="zstd")
    postings = rows.where("pair is not null").select("block", "pair", "count", "form", "docs", "planes")
    counts = postings.groupBy("pair").agg(F.sum("count").alias("total")).withColumn("a_id", F.expr(f"pair div {size_b}"))
    top = counts.groupBy("a_id").agg(F.max("total").alias("top"))
    pairs = materialize(counts.join(top, "a_id").select("pair", "a_id", (F.col("pair") % size_b).alias("b_id"), "total", (F.col("total") == F.col("top")).alias("best")), "alignment-pairs")
    back = postings.join(pairs.select("pair", "total", "best"), "pair").select("block", "total", "best", "form", "docs", "planes")
    sums = back.repartition("block").sortWithinPartitions("block").mapInArrow(_scores, "block long, local long, n_best long, count_sum long")
    facts = rows.where("pair is null").select("id", "block", "local", *FACTS, "groups_sha256")
    out = facts.join(sums, ["block", "local"], "left").na.fill(0, ["n_best", "count_sum"])
    found = out.select(F.col("id").alias(id_col), *FACTS, "n_best", "count_sum", "groups_sha256")
    return found, pairs.select("a_id", "b_id", F.col("total").alias("documents"), "best")
