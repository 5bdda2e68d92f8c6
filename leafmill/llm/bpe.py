"""Byte-level BPE encoding and decoding, contracted by DuckDB inside Spark tasks.

Each task keeps a small in-memory DuckDB holding the vocabulary and the merge
table (left id, right id, merged id). The text pieces it has not met yet are laid
out as token-position rows; a recursive query joins neighbouring rows with the
merge table and contracts the minimum-rank pair of every piece until none is left.
An ordered aggregation gives each piece's ids and, over the vocabulary's bytes,
its decoded bytes; both go to flat arrays, from which whole documents are taken. A
piece is contracted once as long as a task keeps it, however often it occurs. Past
CACHE_PIECES segments a task keeps those met again since they were learnt and forgets
the others, most of which are words that occur once; so its memory is bounded.

The pair contracted in a step is the leftmost one of minimum rank, so a piece takes
as many steps as it has merges. A piece of more than LONG_BYTES, such as a text
without spaces, would make the query quadratic; the same contraction is then done
with a heap of pairs, with the same result.

Defined results: a null text is the empty text, which has no tokens; a text that
is one long piece is contracted whole; repeated rows give repeated rows; an empty
table gives an empty table; further columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafmill.llm.words import tidy

OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}

CHUNK_CHARS = 1_500_000
LONG_BYTES = 1024
CACHE_PIECES = 600_000
# Pieces of one query: its rows stay in memory until it ends.
QUERY_PIECES = 20_000

# Every space before a visible character starts a new piece, so texts can be cut there.
CUT = r" (?=\S)"

# A row is a token at a place: k is its piece (upper 32 bits) and its first byte's
# position (lower 32). A pair belongs to its left row; contracting it keeps that row
# and drops the next, whose row before is the contracted one. Rows start in the order of
# k and one thread keeps it, so a step needs no sort; rows out of order are an error.
CONTRACT = """
WITH RECURSIVE step(k, t, done) AS (
    SELECT k, t, false FROM start
  UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT a.k, a.t, a.before, g.m, (g.m::BIGINT << 32) | (a.k & 4294967295) AS spot
        FROM (SELECT k, t, lag(k) OVER o AS before, CASE WHEN lag(k) OVER o >= k THEN error('rows out of order')
                     WHEN lead(k) OVER o >> 32 = k >> 32 THEN (t::BIGINT << 32) | lead(t) OVER o END AS pair
              FROM step WHERE NOT done WINDOW o AS ({order})) a
        LEFT JOIN merges g ON g.pair = a.pair),
    best AS MATERIALIZED (SELECT k >> 32 AS w, min(spot) AS first FROM pairs GROUP BY 1)
    SELECT k, CASE WHEN spot = first THEN m ELSE t END, first IS NULL
    FROM pairs JOIN best ON best.w = pairs.k >> 32
    WHERE first IS NULL OR before IS DISTINCT FROM (w << 32) | (first & 4294967295))
)
SELECT w, list(t) AS ids, string_agg(hexed, '') AS decoded
FROM (SELECT k >> 32 AS w, t, v.hexed FROM step JOIN vocab v ON v.id = step.t WHERE done ORDER BY k)
GROUP BY 1 ORDER BY 1
"""


def read_ranks(path: str) -> list[tuple[int, bytes]]:
    """(rank, token bytes) of a rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip())]


def merge_table(ranks: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that makes a token, the left id in the upper 32 bits, and the token made."""
    whole = {b: i for i, b in ranks}
    rows = [(whole[b[:k]], whole[b[k:]], i) for i, b in ranks for k in range(1, len(b)) if b[:k] in whole and b[k:] in whole]
    return np.array([(a << 32) | b for a, b, _ in rows], np.int64), np.array([m for _, _, m in rows], np.int32)


class Contractor:
    """Ids and bytes of text pieces, by recursive queries over one task's DuckDB."""

    def __init__(self, ranks: list[tuple[int, bytes]], pattern: str, merges: tuple[np.ndarray, np.ndarray] | None = None):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.out_of_order = duckdb.InvalidInputException
        self.whole = {b: i for i, b in ranks}
        self.bytes_of = [b""] * (max((i for i, _ in ranks), default=-1) + 1)
        for i, b in ranks:
            self.bytes_of[i] = b
        self.con = con = duckdb.connect(config={"threads": "1", "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": "true"})
        self.digits = pa.array([f"{i}," for i in range(len(self.bytes_of))], pa.large_binary())
        vocab = pa.table({"id": pa.array([i for i, _ in ranks], pa.int32()), "hexed": [b.hex() for _, b in ranks]})
        con.register("vocab_in", vocab)
        con.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        con.unregister("vocab_in")
        self.merges = merge_table(ranks) if merges is None else merges
        con.register("merges_in", pa.table({"pair": self.merges[0], "m": self.merges[1]}))
        con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        con.unregister("merges_in")
        self.one = np.array([self.whole.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.one < 0).any():
            raise ValueError("the vocabulary must hold every single byte")
        self.pieces: dict[str, int] = {}
        self.clear()

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The token that a pair makes, for long pieces."""
        return dict(zip(*(x.tolist() for x in self.merges), strict=True))

    def clear(self) -> None:
        """Forget the pieces met so far."""
        # The entry of a piece or segment numbers a run of ids and a run of decoded bytes.
        self.pieces.clear()
        self.blank = {""}
        # Segments: [0] starts a text, [1] follows a space.
        self.segments: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.ids, self.id_ends = array("i"), array("q", [0])
        self.decoded, self.decoded_ends = bytearray(), array("q", [0])
        self.met_again = bytearray()

    def trim(self) -> None:
        """Forgets the entries that no later text or segment asked for; all, where that leaves too many."""
        again = np.frombuffer(bytes(self.met_again), np.bool_)
        old = np.flatnonzero(again)
        flags = bytes(self.met_again)
        pieces, first, later = ({k: i for k, i in held.items() if flags[i]} for held in (self.pieces, *self.segments))
        (ids, id_ends), (decoded, decoded_ends) = self.ids_of(old), self.decoded_of(old)
        decoded = decoded.to_pybytes()[: int(decoded_ends[-1])]
        self.clear()
        if len(old) > CACHE_PIECES // 2:
            return
        self.add(ids.tobytes(), id_ends[1:], decoded, decoded_ends[1:])
        place = (np.cumsum(again) - 1).tolist()
        for held, kept in zip((self.pieces, *self.segments), (pieces, first, later), strict=True):
            held.update((k, place[i]) for k, i in kept.items())

    def add(self, ids: bytes, id_ends: np.ndarray, decoded: bytes, decoded_ends: np.ndarray) -> int:
        """Appends runs, given end by end, and tells the first one's entry."""
        entry, n, m = len(self.id_ends) - 1, len(self.ids), len(self.decoded)
        self.ids.frombytes(ids)
        self.decoded += decoded
        self.id_ends.frombytes((id_ends + n).astype(np.int64).tobytes())
        self.decoded_ends.frombytes((decoded_ends + m).astype(np.int64).tobytes())
        self.met_again += bytes(len(id_ends))
        return entry

    def mark(self, entries: np.ndarray, known: int) -> None:
        """Notes the use of entries that were there before."""
        np.frombuffer(self.met_again, np.uint8)[entries[entries < known]] = 1

    def add_one(self, ids: list[int]) -> int:
        decoded = b"".join(map(self.bytes_of.__getitem__, ids))
        return self.add(np.array(ids, np.int32).tobytes(), np.array([len(ids)]), decoded, np.array([len(decoded)]))

    def close(self) -> None:
        """Give back the task's memory: workers live on for tasks of other stages."""
        self.clear()
        self.con.close()

    def contract(self, pieces: Iterable[str]) -> None:
        """Adds the ids and the decoded bytes of pieces that are new here."""
        todo: list[tuple[str, bytes]] = []
        tokens: list[tuple[str, bytes, int]] = []
        for x in pieces:
            raw = x.encode("utf-8", "surrogatepass")
            if (one := self.whole.get(raw)) is not None:
                tokens.append((x, raw, one))
            elif len(raw) > LONG_BYTES:
                self.pieces[x] = self.add_one(self.contract_long(raw))
            else:
                todo.append((x, raw))
        ids, ends = np.array([one for *_, one in tokens], np.int32), np.cumsum([len(raw) for _, raw, _ in tokens], dtype=np.int64)
        entry = self.add(ids.tobytes(), np.arange(1, len(tokens) + 1), b"".join([raw for _, raw, _ in tokens]), ends)
        self.pieces.update((x, i) for i, (x, *_) in enumerate(tokens, entry))
        for at in range(0, len(todo), QUERY_PIECES):
            self.contract_rows(todo[at : at + QUERY_PIECES])

    def contract_rows(self, todo: list[tuple[str, bytes]]) -> None:
        """The same for pieces that one query contracts."""
        joined = b"".join([raw for _, raw in todo])
        lens = np.array([len(raw) for _, raw in todo])
        ends = np.cumsum(lens)
        k = (np.repeat(np.arange(len(todo)), lens) << 32) + np.arange(ends[-1]) - np.repeat(ends - lens, lens)
        self.con.register("start", pa.table({"k": k, "t": self.one[np.frombuffer(joined, np.uint8)]}))
        try:
            got = self.con.sql(CONTRACT.format(order="")).to_arrow_table()
        except self.out_of_order:
            got = self.con.sql(CONTRACT.format(order="ORDER BY k")).to_arrow_table()
        self.con.unregister("start")
        ids = pc.list_flatten(got["ids"]).to_numpy().astype(np.int32, copy=False)
        decoded = bytes.fromhex("".join(got["decoded"].to_pylist()))
        if decoded != joined:  # the ids stand in the same order
            raise RuntimeError("the ids of a piece do not decode to it")
        entry = self.add(ids.tobytes(), np.cumsum(pc.list_value_length(got["ids"]).to_numpy()), decoded, ends)
        self.pieces.update((x, i) for i, (x, _) in enumerate(todo, entry))

    def contract_long(self, raw: bytes) -> list[int]:
        """The ids of one long piece: the leftmost pair of minimum rank first, from a heap."""
        import heapq

        tokens: list[int] = self.one[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        rank = lambda i: self.pairs.get((tokens[i] << 32) | tokens[after[i]]) if after[i] < len(tokens) else None
        heap = [(m, i) for i in range(len(tokens)) if (m := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            if tokens[i] < 0 or rank(i) != m:
                continue
            gone = after[i]
            tokens[i], tokens[gone], after[i] = m, -1, after[gone]
            if after[i] < len(tokens):
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (new := rank(j)) is not None:
                    heapq.heappush(heap, (new, j))
        return [t for t in tokens if t >= 0]

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct segments of some texts, the number of each text's every one, and where texts begin and the last ends."""
        lists = pc.split_pattern(texts, " ")
        names, code, last = _coded(lists)
        later = np.ones(len(code), np.bool_)
        later[last[:-1]] = False
        self.blank.update(s for s in names if s[:1].isspace())
        blank = np.fromiter(map(self.blank.__contains__, names), np.bool_, len(names))
        odd = np.unique(np.searchsorted(last, np.flatnonzero(later & blank[code]), "right") - 1)
        if len(odd):  # spaces that other white space follows: cut anew
            place = np.arange(len(lists))
            place[odd] = len(lists) + np.arange(len(odd))
            anew = pa.array([re.split(CUT, t) for t in texts.take(pa.array(odd)).to_pylist()], lists.type)
            names, code, last = _coded(pa.concat_arrays([lists, anew]).take(pa.array(place)))
        return names, code, last

    def learn(self, kind: int, segments: list[str]) -> None:
        """Ids and bytes of text segments that are new here."""
        self.keep(kind, segments, self.find_each(segments) if kind else [self.find(s) for s in segments])

    def find_each(self, segments: list[str]) -> list[list[str]]:
        """The pieces of every segment, each behind a space: one search over all, cut where segments begin."""
        found = self.find("".join([f" {s}" for s in segments]))
        starts = np.cumsum([0, *(len(s) + 1 for s in segments)])
        places = np.cumsum([0, *map(len, found)])
        at = np.searchsorted(places, starts)
        if places[-1] != starts[-1] or (places[at] != starts).any():  # a match across segments, or characters left out
            return [self.find(" " + s) for s in segments]
        cuts = at.tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def keep(self, kind: int, segments: list[str], found: list[list[str]]) -> None:
        before = len(self.met_again)
        pieces = list(chain.from_iterable(found))
        self.contract(set(pieces).difference(self.pieces))
        runs = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        single = counts == 1
        entries = np.empty(len(found), np.int64)
        entries[single] = runs[(np.cumsum(counts) - counts)[single]]
        runs, last = runs[np.repeat(~single, counts)], np.cumsum(counts[~single])
        self.mark(runs, before)
        ids, id_ends = self.ids_of(runs)
        decoded, decoded_ends = self.decoded_of(runs)
        entry = self.add(ids.tobytes(), id_ends[last], decoded.to_pybytes(), decoded_ends[last])
        entries[~single] = np.arange(entry, entry + len(last))
        self.segments[kind].update(zip(segments, entries.tolist(), strict=True))

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after another, and where each begins and the last ends."""
        at = np.frombuffer(self.id_ends, np.int64)
        lens = at[entries + 1] - at[entries]
        ends = np.cumsum(lens)
        places = np.repeat(at[entries] - ends + lens, lens) + np.arange(lens.sum())
        return (np.frombuffer(self.ids, np.int32)[places] if len(places) else np.zeros(0, np.int32)), np.concatenate([[0], ends])

    def decoded_of(self, entries: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
        """The same of the decoded bytes."""
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.decoded_ends) - 1, [None, pa.py_buffer(self.decoded_ends), pa.py_buffer(self.decoded)])
        return _run(held.take(pa.array(entries)))

    def documents(self, texts: list[str], outputs: tuple[str, ...]) -> dict[str, list]:
        """The named outputs of every text."""
        return {k: v.to_pylist() for k, v in self.columns(texts, outputs).items()}

    def columns(self, texts: list[str] | pa.Array, outputs: tuple[str, ...]) -> dict[str, pa.Array]:
        """The same as Arrow columns."""
        names, code, last = self.cut(pc.fill_null(pa.array(texts, pa.large_string()), ""))
        head = np.zeros(len(code), np.bool_)
        head[last[:-1]] = True
        before = len(self.met_again)
        entries = np.empty(len(code), np.int64)
        for kind, rows in enumerate((head, ~head)):
            used = np.unique(code[rows])
            mine = [names[i] for i in used.tolist()]
            held = self.segments[kind]
            self.learn(kind, [s for s in mine if s not in held])
            entry = np.zeros(len(names), np.int64)
            entry[used] = np.fromiter(map(held.__getitem__, mine), np.int64, len(mine))
            entries[rows] = entry[code[rows]]
        self.mark(entries, before)
        ids, id_ends = self.ids_of(entries)
        id_ends = id_ends[last]
        out: dict[str, pa.Array] = {}
        if "n_tokens" in outputs:
            out["n_tokens"] = pa.array(np.diff(id_ends))
        if "ids" in outputs:
            out["ids"] = pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(ids, pa.int32()))
        if "ids_sha256" in outputs:
            digits, at = _run(self.digits.take(pa.array(ids)))
            view, at = memoryview(digits), at[id_ends].tolist()
            # A text's last comma is left out.
            out["ids_sha256"] = pa.array([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())
        if "decoded" in outputs or "decoded_sha256" in outputs:
            decoded, at = self.decoded_of(entries)
            view, at = memoryview(decoded), at[last].tolist()
            texts_back = [view[a:b] for a, b in zip(at, at[1:], strict=False)]
            if "decoded" in outputs:
                out["decoded"] = pa.array(map(bytes, texts_back), pa.binary())
            if "decoded_sha256" in outputs:
                out["decoded_sha256"] = pa.array([hashlib.sha256(b).hexdigest() for b in texts_back], pa.string())
        return out


def _coded(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct values of some lists, the number of each value, and where lists begin and the last ends."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def _run(values: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """All values' bytes on end, and where each begins and the last ends."""
    wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, wide)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, wide)
    return data if data is not None else pa.py_buffer(b""), at


def _chunks(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_CHARS; a text is never cut."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()):
        if size and size + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """One row per document: its id column and the named outputs.

    ``ranks_path`` is read on the driver (a vocabulary is a fixed file of bounded
    size) and sent to the tasks once each.
    """
    sc = docs.sparkSession.sparkContext
    ranks = read_ranks(ranks_path)
    sent = sc.broadcast((ranks, merge_table(ranks)))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(k, OUTPUTS[k]) for k in outputs)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, merges = sent.value
        bpe = Contractor(ranks, pattern, merges)
        try:
            for batch in batches:
                for part in _chunks(batch, text_col):
                    if len(bpe.segments[1]) > CACHE_PIECES:
                        bpe.trim()
                    got = bpe.columns(part.column(text_col), outputs)
                    yield pa.RecordBatch.from_arrays([part.column(id_col), *(got[k] for k in outputs)], names=[id_col, *outputs])
        finally:
            bpe.close()

    return docs.select(id_col, text_col).mapInArrow(tidy(task), schema)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that lists of ids stand for: one row per row, ``decoded`` binary.

    A null list is empty; an id outside the vocabulary is an error.
    """
    ranks = read_ranks(ranks_path)
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": "1", "memory_limit": "300MB", "temp_directory": ""})
        vocab = pa.table({"id": pa.array([i for i, _ in sent.value], pa.int32()), "bytes": pa.array([b for _, b in sent.value], pa.binary())})
        con.register("vocab", vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                con.register("lists", pa.table({"k": pa.array(range(part.num_rows), pa.int32()), "ids": part.column(ids_col)}))
                got = con.execute(
                    "WITH flat AS (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM lists) "
                    "SELECT k, string_agg(hex(v.bytes), '' ORDER BY p), count(*) = count(v.id) FROM flat f LEFT JOIN vocab v USING (id) GROUP BY k"
                ).fetchall()
                con.unregister("lists")
                if not all(ok for _, _, ok in got):
                    raise ValueError("an id is not in the vocabulary")
                found = {k: bytes.fromhex(h) for k, h, _ in got}
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([found.get(k, b"") for k in range(part.num_rows)], pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(task, schema)


def check_pattern(pattern: str) -> None:
    """Raises where a pattern could match across a cut, so that cutting first would change its matches."""
    import regex

    for sample in ("a b", "a  b", "a\n b", "1 2", "! ?", "a 's b", "   x"):
        whole = regex.findall(pattern, sample)
        cut = [x for k, s in enumerate(re.split(CUT, sample)) for x in regex.findall(pattern, " " * bool(k) + s)]
        if whole != cut:
            raise ValueError("this pattern needs texts uncut")
