"""Removal of word passages that occur more than once, by suffix automata of reference shards.

A window of ``width`` words is repeated if its word sequence starts anywhere else too.
Every window holds an anchor, the least of its runs of ANCHOR words by hash, so equal
windows have equal anchors at equal places. Consecutive windows that share an anchor
form a region (all their words). Anchors are counted first, and only regions of those
that occur again are kept; regions are counted by anchor and content with partial
aggregation: a region that occurs twice as a whole has only repeated windows; an anchor
with a single region has none. What is left are anchors with several different
regions, at the edges of copied passages. Their regions are the reference shards: one
per anchor, each of at most SHARD_REGIONS regions. A task builds a shard's suffix
automaton over words, with the number of places each substring ends at, and streams the
shard's regions through it for their matching statistics; windows that match in two
places are repeated. Anchors with more regions than that, those at the edges of a very
common passage, have their windows counted by hash with partial aggregation instead,
so that no shard grows with the data. The shards go to their anchor's task rather than
to every task, as the reference is the whole corpus and has no size bound.

Defined results: null, empty and blank texts have no words; a text shorter than
``width`` keeps all; copies lose all their words if they have a window; repeated rows
are copies; an empty table gives an empty table; further columns are not read. Words
and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import chunks, mix, runs, split_words, window_sums
from leafmill.session import materialize

ANCHOR = 8
SHARD_REGIONS = 4096
POSTS = "anchor long, region long, t long, first int, last int"


def sequence_hash(hashes: np.ndarray) -> int:
    """One number for a whole word sequence."""
    if not len(hashes):
        return 0
    total = window_sums(hashes, len(hashes))[:1] + np.array([len(hashes)], np.uint64)
    return int(mix(total).view(np.int64)[0])


def regions(words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, region hash, first window, last window) of every region; windows count from their text's start."""
    whole, place = runs(words, hashes, width)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    short, at = runs(words, hashes, ANCHOR)
    span = width - ANCHOR + 1
    of = np.searchsorted(at, place)
    least, where = short[of].copy(), of.copy()
    for j in range(1, span):
        lower = short[of + j] < least
        least[lower] = short[of[lower] + j]
        where[lower] = of[lower] + j
    text = np.searchsorted(words.begin, place, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text[1:] != text[:-1])]))
    end = np.append(new[1:], len(place)) - 1
    offset = (at[where[new]] - place[new]).astype(np.uint64)
    region = mix(whole[new] * np.uint64(3) + mix(whole[end]) + (offset * np.uint64(64) + (end - new).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    base = words.begin[text[new]]
    return text[new], least[new], region, place[new] - base, place[end] - base


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number of words, sequence hash, and digest of all its words."""
    for part in chunks(batches, "text"):
        words = split_words(part.column("text"))
        hashes, b = words.hashes(), words.begin
        data = words.data.tobytes()
        yield pa.RecordBatch.from_pydict(
            {
                "id": part.column("id"),
                "n": np.diff(b),
                "t": pa.array([sequence_hash(hashes[b[i] : b[i + 1]]) for i in range(len(b) - 1)], pa.int64()),
                "digest": pa.array([hashlib.sha256(b" ".join(data[words.offsets[i] : words.offsets[i + 1]].split())).hexdigest() for i in range(len(b) - 1)], pa.string()),
            }
        )


def _posts(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in the same task post once
        for part in chunks(batches, "text"):
            words = split_words(part.column("text"))
            hashes, b = words.hashes(), words.begin
            t = [sequence_hash(hashes[b[i] : b[i + 1]]) for i in range(len(b) - 1)]
            fresh = np.array([not (x in seen or seen.add(x)) for x in t], bool)
            text, anchor, region, first, last = regions(words, hashes, width)
            use = fresh[text]
            yield pa.RecordBatch.from_pydict(
                {"anchor": anchor[use].view(np.int64), "region": region[use].view(np.int64), "t": np.array(t, np.int64)[text[use]], "first": pa.array(first[use], pa.int32()), "last": pa.array(last[use], pa.int32())}
            )

    return task


def _cut_out(width: int):
    """The word hashes of regions, from the texts they lie in."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = split_words(part.column("text"))
            hashes, b = words.hashes(), words.begin
            out: list[tuple[int, int, bytes]] = []
            for i, (t, wanted) in enumerate(zip(part.column("t").to_pylist(), part.column("wanted").to_pylist(), strict=True)):
                own = hashes[b[i] : b[i + 1]]
                if sequence_hash(own) == t:
                    out += [(x["anchor"], x["region"], own[x["first"] : x["last"] + width].tobytes()) for x in wanted]
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([x[0] for x in out], pa.int64()), "region": pa.array([x[1] for x in out], pa.int64()), "words": pa.array([x[2] for x in out], pa.binary())})

    return task


class SuffixAutomaton:
    """Automaton of several sequences, with the number of places where each state's substrings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.ends = [-1], [0], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                self.ends[last] += 1
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]

    def _new(self, next_: dict[int, int], link: int, length: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.len.append(length)
        self.ends.append(0)
        return len(self.len) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._new(dict(self.next[q]), self.link[q], self.len[p] + 1)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another sequence came this way
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, word)
        state, p = self._new({}, 0, self.len[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, word)
        return state

    def repeated(self, sequence: list[int], width: int) -> int:
        """Bits of the windows of the sequence that end in two places or more, by matching statistics."""
        state = length = bits = 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            if length >= width:
                while self.len[self.link[state]] >= width:  # the state that holds the window itself
                    state = self.link[state]
                    length = self.len[state]
                if self.ends[state] > 1:
                    bits |= 1 << (i - width + 1)
        return bits


def _shards(width: int):
    """Of rows sorted by anchor: which of each region's windows occur twice in its shard."""
    from leafmill.llm.jaccard import _grouped, _starts

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, ["anchor"]):
            anchor, region = batch.column("anchor").to_numpy(), batch.column("region").to_numpy()
            words = batch.column("words").to_pylist()
            bits = np.zeros(len(anchor), np.int64)
            bounds = np.append(_starts(anchor), len(anchor))
            for b, e in zip(bounds[:-1], bounds[1:], strict=True):
                own = {int(region[i]): np.frombuffer(words[i], np.uint64).tolist() for i in range(b, e)}
                machine = SuffixAutomaton(list(own.values()))
                for i in range(b, e):
                    bits[i] = machine.repeated(own[int(region[i])], width)
            yield pa.RecordBatch.from_pydict({"anchor": anchor, "region": region, "bits": bits})

    return task


def _windows(width: int):
    """Window hashes of the regions of very common anchors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [window_sums(np.frombuffer(w, np.uint64), width) for w in batch.column("words").to_pylist()]
            n = np.array([len(r) for r in rows], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": np.repeat(batch.column("anchor").to_numpy(), n),
                    "region": np.repeat(batch.column("region").to_numpy(), n),
                    "at": pa.array(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), pa.int64()),
                    "h": mix(np.concatenate(rows)).view(np.int64) if rows else np.zeros(0, np.int64),
                }
            )

    return task


def _removed(width: int):
    """Kept words of texts with repeated windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = split_words(part.column("text"))
            hashes, b = words.hashes(), words.begin
            out = []
            for i, (t, id_, spans) in enumerate(zip(*(part.column(c).to_pylist() for c in ("t", "id", "spans")), strict=True)):
                n = int(b[i + 1] - b[i])
                if sequence_hash(hashes[b[i] : b[i + 1]]) != t:
                    continue
                change = np.zeros(n + 1, np.int64)
                for s in spans:
                    bits = s["bits"]
                    for k in range(bits.bit_length()):
                        if bits >> k & 1:
                            change[s["first"] + k] += 1
                            change[s["first"] + k + width] -= 1
                keep = np.flatnonzero(np.cumsum(change[:-1]) == 0) + b[i]
                out.append((id_, t, n - len(keep), b" ".join(words.bytes_of(k) for k in keep.tolist()).decode()))
            kind = part.schema.field("id").type
            yield pa.RecordBatch.from_pydict({"id": pa.array([x[0] for x in out], kind), "t": pa.array([x[1] for x in out], pa.int64()), "removed": pa.array([x[2] for x in out], pa.int64()), "kept": pa.array([x[3] for x in out], pa.string())})

    return task


def meet(texts: DataFrame, copies: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (t, ...) with the text that stands for the word sequence t; texts move once, and once the rows are few."""
    asked = rows.join(copies.select("t", F.col("one").alias("want")), "t")
    return texts.join(asked, F.col("id").eqNullSafe(F.col("want"))).drop("want")


def repeated_windows(texts: DataFrame, copies: DataFrame, width: int) -> DataFrame:
    """(t, first, bits): of the text with sequence hash t, the repeated ones among those from ``first`` on.

    ``texts`` are all texts; ``copies`` names the row that stands for each word sequence t.
    """
    every = texts.select("text").mapInArrow(_posts(width), POSTS)
    # Most anchors occur once, so their regions are counted by the anchor alone and never written.
    shared = materialize(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "dedup-anchors")
    posts = materialize(every.join(shared, "anchor", "left_semi"), "dedup-posts")
    place = F.xxhash64("t", "first")
    by_region = posts.groupBy("anchor", "region").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.min("t").alias("t"))
    by_region = materialize(by_region.select("anchor", "region", (F.col("low") != F.col("high")).alias("whole"), "t"), "dedup-regions")
    shards = by_region.groupBy("anchor").agg(F.count("*").alias("regions")).where("regions > 1")
    asked = by_region.join(shards, "anchor").select("anchor", "region", "t", (F.col("regions") > SHARD_REGIONS).alias("common"))
    # Where a region lies: in the text that stands for it, at the least place there.
    first = posts.join(asked.select("anchor", "region", "t"), ["anchor", "region", "t"]).groupBy("anchor", "region", "t").agg(F.min("first").alias("first"), F.min("last").alias("last"))
    wanted = first.groupBy("t").agg(F.collect_list(F.struct("anchor", "region", "first", "last")).alias("wanted"))
    cut = materialize(meet(texts, copies, wanted).select("text", "t", "wanted").mapInArrow(_cut_out(width), "anchor long, region long, words binary").dropDuplicates(["anchor", "region"]), "dedup-shards")
    sized = cut.join(shards, "anchor")
    few = sized.where(F.col("regions") <= SHARD_REGIONS).select("anchor", "region", "words")
    matched = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(width), "anchor long, region long, bits long")
    windows = sized.where(F.col("regions") > SHARD_REGIONS).select("anchor", "region", "words").mapInArrow(_windows(width), "anchor long, region long, at long, h long")
    common = windows.groupBy("anchor", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    counted = windows.join(common, ["anchor", "h"]).groupBy("anchor", "region").agg(F.bit_or(F.expr("shiftleft(1L, cast(at AS int))")).alias("bits"))
    partial = matched.unionByName(counted).where("bits <> 0")
    full = by_region.where("whole").select("anchor", "region", F.lit(-1).cast("long").alias("whole_bits"))
    bits = partial.join(full, ["anchor", "region"], "full").select("anchor", "region", F.coalesce("whole_bits", "bits").alias("bits"))
    marked = posts.join(materialize(bits, "dedup-bits"), ["anchor", "region"])
    all_ = F.expr("shiftleft(1L, last - first + 1) - 1")
    return marked.select("t", "first", F.col("bits").bitwiseAND(all_).alias("bits")).distinct()


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row; kept words are joined by one space."""
    if not ANCHOR <= width <= ANCHOR + 62:
        raise ValueError(f"width must be {ANCHOR} to {ANCHOR + 62}")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    facts = materialize(texts.mapInArrow(_facts, f"id {id_type}, n long, t long, digest string"), "dedup-facts")
    copies = facts.groupBy("t").agg(F.count("*").alias("copies"), F.min("id").alias("one"))
    found = repeated_windows(texts, copies, width)
    spans = found.groupBy("t").agg(F.collect_list(F.struct("first", "bits")).alias("spans"))
    parted = meet(texts, copies, spans).select("id", "t", "text", "spans").mapInArrow(_removed(width), f"id {id_type}, t long, removed long, kept string")
    parted = parted.dropDuplicates(["t"]).select("t", "removed", F.sha2("kept", 256).alias("rest"))
    out = facts.join(copies.select("t", "copies"), "t").join(parted, "t", "left")
    gone = (F.col("copies") > 1) & (F.col("n") >= width)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "digest")).alias("kept_sha256"),
    )
