"""Conversation structure repair over a suffix-shared automaton.

A conversation is reduced to a signature, one letter per row: what role it has and what is wrong with it. Signatures
are sorted from their ends, so that those with a common suffix follow one another, over all conversations of a range;
the suffixes form an automaton whose node (letter, next node) is built once where it first occurs. A node holds, per
grammar state, the cost to go and the first letter of the best audit; nodes that agree in both up to a constant share
one entry. A conversation reads its cost and audit off the node of its whole signature.

Grammar: ``(s?(ua)+)?`` over role initials. Edits: K keep 0, R rerole to user or assistant 3, D delete 4, I insert an
empty turn 3; a truncated row that stays adds 3, blank and repeated rows must go. At equal cost the first letter
decides: the letters that lead out of a state all differ.

Defined cases: null roles and texts are one space, null ids and turns too where they are hashed; null turns come first,
turns of one number come in the order of the digests of role and text. Rows without a conv_id are one conversation.
Repeated rows are rows of their own, and the later ones duplicates. Texts of any length are streamed through the hash;
a task holds the signature and the audit of one conversation, a byte a row each. A conversation that loses all rows
keeps its row of zeros; an empty table gives none. Only conv_id, turn, role and text are read, so other columns may
have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsift.llm.exprs import SPACE_CHARS
from postsift.session import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or reroled turn must be in each state, and the state after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
MUST_GO = "x"
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60
BATCH = 4096

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
SIGNED = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", signature string"
REPAIRED = SIGNED + ", cost long, audit string"
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string, repaired_sha256 string"


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, copy, role, text) after damage by crc32(conv_id:turn) % 20; ``copy`` is null in dropped rows.

    0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    named = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20).alias("__damage"))
    damage = F.col("__damage")
    copies = F.when(damage == 3, F.array(F.lit(0), F.lit(1))).when(damage != 0, F.array(F.lit(0)))
    text = F.when(damage == 1, F.lit("")).when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", _digest(F.col("role"), F.col("text")).alias("tie"), F.explode_outer(copies).alias("copy"),
        F.when(damage == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"))


#: Rising, which puts nulls first.
ORDER = ["turn", "tie", "copy"]


def marked(rows: DataFrame) -> DataFrame:
    """The rows without their text: role initial, letter of the signature, and fault (null, blank, duplicate, truncated)."""
    kept = F.col("copy").isNotNull()
    body = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    narrow = rows.select(
        "conv_id", "turn", "tie", "copy", F.substring("role", 1, 1).alias("initial"), (body == "").alias("__blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("__cut"), F.when(kept, _digest(F.col("role"), F.col("text"))).alias("__same"))
    # A window of equal rows is streamed and may spill; it never meets in memory.
    again = (F.row_number().over(W.partitionBy("conv_id", "__same").orderBy(*ORDER)) > 1) & kept
    fault = (F.when(~kept, F.lit(None)).when(F.col("__blank"), "blank").when(F.col("__again"), "duplicate").when(F.col("__cut"), "truncated"))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = (F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(role)).otherwise(role))
    return narrow.withColumn("__again", again).select(
        "conv_id", "turn", "tie", "copy", "__again", F.when(kept, F.col("initial")).alias("initial"), fault.alias("fault"), letter.alias("letter"))


class Signer:
    """Counts and signature of one conversation, row by row."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.letters = conv, dict.fromkeys(COUNTS, 0), bytearray()
        self.first: int | None = None
        self.turn: int | None = None
        self.turns, self.initial = 0, None

    def add(self, turn: int | None, initial: str | None, fault: str | None, letter: str) -> None:
        if initial is None:
            return
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        self.letters += letter.encode()

    def row(self) -> tuple:
        if self.turns:
            self.counts["gaps"] = self.turn - self.first + 1 - self.turns
        return (self.conv, *self.counts.values(), self.letters.decode())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer, rows = None, []
    for batch in batches:
        for conv, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "fault", "letter"))):
            if signer is None or signer.conv != conv:
                if signer:
                    rows.append(signer.row())
                signer = Signer(conv)
            signer.add(*row)
        if len(rows) >= BATCH:
            yield _batch(rows, SIGNED)
            rows = []
    yield _batch(rows + ([signer.row()] if signer else []), SIGNED)


def signatures(marks: DataFrame) -> DataFrame:
    """(conv_id, counts, signature) of every conversation."""
    ordered = marks.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "__again")
    return ordered.mapInArrow(_signed, SIGNED)


def _settled(options: list[list[tuple]]) -> tuple[tuple[int, ...], tuple[tuple, ...]]:
    """Least cost and first step of each state, from (cost, edit, next state, whether the row is used up) and insertions."""
    costs = [min((o[0] for o in state), default=NEVER) for state in options]
    for _ in NEXT:
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    steps = []
    for state, found in enumerate(options):
        inserted = [(INSERT + costs[NEXT[state]], "I", NEXT[state], False)]
        steps.append(min((o for o in found + inserted if o[0] == costs[state]), key=lambda o: o[1])[1:])
    return tuple(costs), tuple(steps)


#: The end of all signatures: nothing, or whole user and assistant pairs, are complete.
END = _settled([[(0, "", START, False)], [], [], [(0, "", ASSISTANT, False)]])


@lru_cache(None)
def entry(letter: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple, ...]]:
    """(added cost, costs above it, steps) of a node; there are as many entries as letters and differences of costs."""
    extra = TRUNCATED if letter.isupper() else 0
    options = []
    for state in range(4):
        found = [(DELETE + after[state], "D", state, True)]
        if letter != MUST_GO:
            target, role = NEXT[state], letter.lower()
            same = role == ROLE[target][0]
            found.append((extra + (0 if same else REROLE) + after[target], "K" if same else "R", target, True))
            if state == START and role == "s":
                found.append((extra + after[SYSTEM], "K", SYSTEM, True))
        options.append(found)
    costs, steps = _settled(options)
    return min(costs), tuple(c - min(costs) for c in costs), steps


class Automaton:
    """The path of the last signature, from its end; a following one shares the nodes of their common suffix."""

    def __init__(self) -> None:
        self.letters, self.nodes = "", [(0, *END)]

    def repair(self, backwards: str) -> tuple[int, str]:
        shared, most = 0, min(len(backwards), len(self.letters))
        if backwards == self.letters:
            shared = most
        while shared < most and backwards[shared] == self.letters[shared]:
            shared += 1
        del self.nodes[shared + 1:]
        for letter in backwards[shared:]:
            base, costs, _ = self.nodes[-1]
            added, costs, steps = entry(letter, costs)
            self.nodes.append((base + added, costs, steps))
        self.letters = backwards
        at, state, audit = len(self.nodes) - 1, START, bytearray()
        cost = self.nodes[at][0] + self.nodes[at][1][START]
        while True:
            edit, state, used = self.nodes[at][2][state]
            if not edit:
                return cost, audit.decode()
            audit += edit.encode()
            at -= used


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        found = [automaton.repair(s[::-1]) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            [*batch.schema.names, "cost", "audit"])


def repairs(signed: DataFrame) -> DataFrame:
    """Adds (cost, audit). A common signature is cut by the hash of the conversation, so it spreads over tasks."""
    backwards = F.reverse("signature")
    ordered = signed.repartitionByRange(backwards, F.xxhash64("conv_id")).sortWithinPartitions(backwards)
    return ordered.mapInArrow(_repaired, REPAIRED)


class Rewriter:
    """Applies an audit to the rows of one conversation as they come, and hashes what results."""

    def __init__(self, header: tuple):
        self.header, self.audit = header, header[-1]
        self.at, self.state, self.hash, self.empty = 0, START, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self._put(ROLE[self.state], "")

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role.startswith("s") else NEXT[self.state]
        self._put(role if edit == "K" else ROLE[self.state], text)

    def row(self) -> tuple:
        self._insert()
        return (*self.header, self.hash.hexdigest())


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *COUNTS, "cost", "audit"]
    rewriter, rows = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (*names, "role", "text")]
        for *header, role, text in zip(*columns):
            if header[-1] is None:
                rewriter.add(role, text)
                continue
            if rewriter:
                rows.append(rewriter.row())
            rewriter = Rewriter(tuple(header))
        if len(rows) >= BATCH:
            yield _batch(rows, RESULT)
            rows = []
    yield _batch(rows + ([rewriter.row()] if rewriter else []), RESULT)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``rows`` are as from :func:`damaged`; only the last step moves texts.
    """
    heads = cut_lineage(repairs(signatures(marked(rows))), "repairs").drop("signature")
    missing = lambda names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
    heads = heads.select("*", F.lit(0).alias("kind"), *missing(["turn"], "long"), *missing(["tie"], "string"), *missing(["copy"], "int"),
                         *missing(["role", "text"], "string"))
    texts = rows.filter(F.col("copy").isNotNull()).select(
        "conv_id", *missing([*COUNTS, "cost"], "long"), *missing(["audit"], "string"), F.lit(1).alias("kind"), "turn", "tie", "copy", "role", "text")
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return both.mapInArrow(_rewritten, RESULT)
