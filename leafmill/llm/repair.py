"""Repair of the role structure of conversations, over a suffix-shared automaton.

A conversation's rows, in turn order, are spelt as a signature: one letter for role and
fault. The signatures of all conversations, read from the end, form an automaton whose
nodes are the distinct rests of a signature. A node holds, for each of the four states of
the grammar ``(s?(ua)+)?``, the least cost of the rest and the edit it starts with; edits
have different letters, so the ASCII-least audit among equally cheap ones follows from
first letters alone. Nodes are built from sorted reversed signatures, so a rest that many
conversations share is worked out once and the nodes in memory are those of one signature.
Distinct signatures are dealt out by their last letters.

Text travels once, to the task that hashes the repaired conversation as it streams by; a
conversation's rows are never gathered. Its signature and audit, a byte a row, are single
values.

Defined results: a null role or text is one space, and a null id or turn is one space in
the damage key; null turns come first; rows of the same turn are ordered by role, then by
the digest of their text; rows without ``conv_id`` are one conversation; repeated rows are
duplicates; an empty table gives an empty table; a conversation that lost all rows has
zeros, an empty audit and the empty text's hash; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialize

BLANKS = " \t\n\x0b\f\r"
STOPS = ".!?"
DROPPED = "d"  # the letter of a blank or duplicate row; others are the role's, upper case if truncated
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SHARED_TAIL = 8

# Grammar states: nothing yet, after system, after user, after assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ADDED = [2, 2, 3, 2]  # where an inserted or renamed row leads
NAMES = {2: "user", 3: "assistant"}
FAR = 1 << 60


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the planned damage: conv_id, turn, role, text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("_hit", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).where("_hit <> 0")
    hit = F.col("_hit")
    changed = F.when(hit == 1, F.lit("")).when(hit == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": changed, "role": F.when(hit == 4, F.lit("user")).otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_hit", "_copy")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with the digest that stands for their text."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))


def _symbol(text: str = "text") -> Column:
    """Role letter, upper case if truncated, or the letter of a blank row."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    last = F.right(F.rtrim(F.col(text), F.lit(BLANKS)), F.lit(1))
    return F.when(last == "", DROPPED).when(last.isin(*STOPS), role).otherwise(F.upper(role))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, initial, symbol, fault (0 none, 1 blank, 2 duplicate, 3 truncated); no text.

    Copies are numbered per (conversation, role, text), so no conversation meets in one task for it.
    """
    light = keyed(rows).select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), _symbol().alias("symbol"))
    numbered = light.selectExpr("*", "row_number() over (partition by conv_id, role, digest order by turn nulls first) as copy")
    blank, copied = F.col("symbol") == DROPPED, F.col("copy") > 1
    fault = F.when(blank, 1).when(copied, 2).when(F.col("symbol").rlike("[A-Z]"), 3).otherwise(0)
    return numbered.withColumns({"fault": fault, "symbol": F.when(copied, DROPPED).otherwise(F.col("symbol"))}).drop("copy")


SIGNED = "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def _order(*more: str) -> list:
    return ["conv_id", *more, F.col("turn").asc_nulls_first(), "role", "digest"]


class _Signed:
    """What one conversation's rows add up to so far."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.counts = conv_id, [], [0, 0, 0, 0]
        self.least = self.last = None
        self.turns = self.illegal = 0
        self.initial = None

    def add(self, turns: list, initials: list, symbols: list, faults: list) -> None:
        self.letters.append("".join(symbols))
        for t, i, f in zip(turns, initials, faults, strict=True):
            self.counts[f] += 1
            if self.initial is not None and self.initial + i not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = i
            if t is not None and t != self.last:
                self.least, self.last, self.turns = t if self.least is None else self.least, t, self.turns + 1

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, "".join(self.letters), gaps, *self.counts[1:], self.illegal)


def _runs(column: pa.Array) -> np.ndarray:
    """Borders of the runs of equal values, nulls being equal; the end is the last."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation and turn: one row for each conversation."""
    current: _Signed | None = None
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        schema = schema or pa.schema([("conv_id", ids.type), ("signature", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]])
        cells = [batch.column(c).to_pylist() for c in ("turn", "initial", "symbol", "fault")]
        out, borders = [], _runs(ids)
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            conv_id = ids[int(lo)].as_py()
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    out.append(current.row())
                current = _Signed(conv_id)
            current.add(*(c[lo:hi] for c in cells))
        yield _rows(out, schema)
    if current is not None:
        yield _rows([current.row()], schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Automaton:
    """Rests of signatures as nodes; a node's costs and first edits by grammar state.

    Costs are kept relative to the node's least one, so few different nodes exist and the
    step from one to the next is worked out once for each letter.
    """

    def __init__(self):
        end = self._closed([0, FAR, FAR, 0], ["", "", "", ""], [0, 1, 2, 3])
        self.path = [(0, end)]  # (least cost, node) of each rest of the current signature, from the end
        self.spelt = ""
        self.known: dict[tuple, tuple] = {}

    @staticmethod
    def _closed(cost: list[int], edit: list[str], to: list[int]) -> tuple:
        """The node after insertions before its first row have been weighed."""
        for _ in range(3):
            for q in range(4):
                added = cost[ADDED[q]] + INSERT
                if (added, "I") < (cost[q], edit[q]):
                    cost[q], edit[q], to[q] = added, "I", ADDED[q]
        return tuple(cost), tuple(edit), tuple(to)

    def _before(self, letter: str, node: tuple) -> tuple[int, tuple]:
        """(least cost, node) of a rest with one more row in front."""
        rest = node[0]
        role, late = letter.lower(), TRUNCATED if letter.isupper() else 0
        cost, edit, to = [], [], []
        for q in range(4):
            options = [(rest[q] + DELETE, "D", q)]
            if letter != DROPPED:
                if (q, role) in STEPS:
                    options.append((rest[STEPS[q, role]] + late, "K", STEPS[q, role]))
                options.append((rest[ADDED[q]] + REROLE + late, "R", ADDED[q]))
            c, e, t = min(options)
            cost.append(c)
            edit.append(e)
            to.append(t)
        cost, edit, to = self._closed(cost, edit, to)
        least = min(cost)
        return least, (tuple(c - least for c in cost), edit, to)

    def solve(self, signature: str) -> tuple[int, str]:
        """Least cost and its ASCII-least audit."""
        letters = signature[::-1]
        same = 0
        most = min(len(letters), len(self.spelt))
        while same < most and letters[same] == self.spelt[same]:
            same += 1
        del self.path[same + 1 :]
        base, node = self.path[-1]
        for letter in letters[same:]:
            step = self.known.get((letter, node))
            if step is None:
                step = self.known[letter, node] = self._before(letter, node)
            base, node = base + step[0], step[1]
            self.path.append((base, node))
        self.spelt = letters
        audit, state, at = [], 0, len(letters)
        while at >= 0:
            _, edit, to = self.path[at][1]
            if not edit[state]:
                break
            audit.append(edit[state])
            at -= edit[state] != "I"
            state = to[state]
        return base + node[0][0], "".join(audit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        signatures = batch.column("signature").to_pylist()
        found = [automaton.solve(s) for s in signatures]
        yield pa.RecordBatch.from_pydict(
            {"signature": batch.column("signature"), "cost": pa.array([c for c, _ in found], pa.int64()), "audit": pa.array([a for _, a in found], pa.string())}
        )


def solutions(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature."""
    once = signed.select("signature").distinct()
    dealt = once.repartition(F.right("signature", F.lit(SHARED_TAIL))).sortWithinPartitions(F.reverse("signature"))
    return dealt.mapInArrow(_solve, "signature string, cost long, audit string")


class Writer:
    """Carries out an audit on rows as they come, into a running hash or a list."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.hash, self.first = hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = ADDED[self.state], self.at + 1
            self._put(NAMES[self.state], "")

    def add(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state, role[:1]]
            self._put(role, text)
        elif edit == "R":
            self.state = ADDED[self.state]
            self._put(NAMES[self.state], text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _carry_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation, its head (``kind`` 0) first: one row for each."""
    writer: Writer | None = None
    head: tuple = ()
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = schema or pa.schema([("conv_id", batch.column("conv_id").type), *[(c, pa.int64()) for c in FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out = []
        names = ["conv_id", *FIGURES, "audit", "kind", "role", "text"]
        for *facts, kind, role, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if kind == 0:
                if writer is not None:
                    out.append((*head, writer.digest()))
                head, writer = tuple(facts), Writer(facts[-1])
            else:
                writer.add(role, text)
        yield _rows(out, schema)
    if writer is not None:
        yield _rows([(*head, writer.digest())], schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Every conversation's damage, its cheapest repair, and the digest of the repaired rows."""
    rows = damage(conversations)
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    light = marked(rows).repartition("conv_id").sortWithinPartitions(*_order(), "fault")
    signed = materialize(light.mapInArrow(_sign, f"conv_id {id_type}, {SIGNED}"), "repair-signed")
    solved = signed.join(solutions(signed), "signature").drop("signature").withColumnRenamed("conv_id", "_known")
    ids = conversations.select("conv_id").distinct()
    heads = ids.join(solved, F.col("conv_id").eqNullSafe(F.col("_known")), "left").drop("_known").na.fill(0, FIGURES).na.fill("", ["audit"])
    lines = heads.withColumn("kind", F.lit(0)).unionByName(keyed(rows).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    streamed = lines.repartition("conv_id").sortWithinPartitions(*_order("kind"))
    figures = ", ".join(f"{c} long" for c in FIGURES)
    return streamed.mapInArrow(_carry_out, f"conv_id {id_type}, {figures}, audit string, repaired_sha256 string")
