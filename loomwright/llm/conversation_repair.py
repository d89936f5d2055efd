"""Repair of conversations: the cheapest edits that make the roles alternate and leave no blank or repeated turn.

A conversation is read as the signature of its rows, one symbol each: the class of its role and its first fault. All conversations
are sorted by their signatures from the end, so that those that end alike stand together and share the path of an automaton
whose nodes are suffixes. A node holds, for each state of the grammar, the cost to go and the first edit of the best rest of the
audit. It is made once for all conversations that pass it, from the node after it; suffixes of equal relative costs
share one set of edits. The states of the grammar ``(s?(ua)+)?`` over the initials of roles are: nothing yet, after a
system turn, after a user turn, after an assistant turn.

Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (a turn of user or assistant without text) 2; a truncated row
that stays costs 1 more. Blank and repeated rows have to go. At a state each letter stands for one edit, so that the first letter
decides between audits of equal cost.

Defined results
- Rows stand in the order of their turns, nulls first; rows of one turn by role, then by the hash of role and text. A null role or text is one
  space, so a null text is blank. Rows without a conversation are one conversation, without a name.
- The first fault of a row counts: blank (white space alone), duplicate (role and text stood in an earlier row), truncated (the last character that is
  no white space is none of .!?). Repeated rows are duplicates. Roles other than those of the initials s, u, a cannot be kept.
- Texts of any length are read whole. An empty table gives an empty result. Other columns do not take part, whatever their names.
- A conversation is one row of the result, and its hash runs over its rows in their order: so they pass one task, sorted, a batch at a time. That
  task holds 16 bytes for each different row to find duplicates, and one byte for each row as the signature, never the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import saved

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or renamed turn, by the state before it; and its role.
TURN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by its role's initial and the state before it.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The symbol of a row that has to go. Other symbols are s, u, a or o (another role), in capitals where the row is truncated.
GONE = "x"
ENDLESS = 1 << 40
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")

Costs = tuple[int, int, int, int]
#: For each state: the edit's letter, the state after it, the rows that it takes; none where the audit ends.
Moves = tuple[tuple[str, int, int] | None, ...]


@lru_cache(maxsize=65_536)
def _moves(rest: Costs, symbol: str) -> tuple[Costs, Moves]:
    """The costs to go, and the edits, of a suffix that begins with symbol; rest: those of the suffix after it."""
    late = TRUNCATED if symbol.isupper() else 0
    best: list[tuple[int, str, int, int]] = []
    for state in range(4):
        found = [(DELETE + rest[state], "D", state, 1)]
        if symbol != GONE:
            found.append((REROLE + late + rest[TURN[state]], "R", TURN[state], 1))
            after = KEPT.get(symbol.lower(), {}).get(state)
            if after is not None:
                found.append((late + rest[after], "K", after, 1))
        best.append(min(found))
    return _with_inserts(best)


def _with_inserts(best: list[tuple[int, str, int, int]]) -> tuple[Costs, Moves]:
    """best with turns inserted first where that is cheaper, or as cheap and of a lesser letter. Two in a row are enough."""
    for _ in range(2):
        best = [min(best[state], (INSERT + best[TURN[state]][0], "I", TURN[state], 0)) for state in range(4)]
    return tuple(x[0] for x in best), tuple(x[1:] if x[1] else None for x in best)  # type: ignore[return-value]


END = _with_inserts([(0, "", NOTHING, 0), (ENDLESS, "", SYSTEM, 0), (ENDLESS, "", USER, 0), (0, "", ASSISTANT, 0)])


class Suffixes:
    """The path of nodes of the signature read last, from its end; the next one keeps what it shares."""

    def __init__(self):
        self.read, self.path = "", [END]

    def audit(self, backwards: str) -> tuple[int, str]:
        """(cost, audit) of the signature, given from its end."""
        shared = 0
        if backwards == self.read:
            shared = len(backwards)
        else:
            most = min(len(backwards), len(self.read))
            while shared < most and backwards[shared] == self.read[shared]:
                shared += 1
        del self.path[shared + 1 :]
        for symbol in backwards[shared:]:
            costs = self.path[-1][0]
            least = min(costs)
            rest, moves = _moves(tuple(c - least for c in costs), symbol)
            self.path.append((tuple(c + least for c in rest), moves))
        self.read = backwards
        letters, state, at = [], NOTHING, len(backwards)
        while move := self.path[at][1][state]:
            letter, state, taken = move
            letters.append(letter)
            at -= taken
        return self.path[-1][0][NOTHING], "".join(letters)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with ``live``: by crc32(conv_id:turn) % 20 a row is dropped (0: a row with live false says so), emptied (1), loses its .!? (2), is
    repeated (3) or becomes the user's (4). Nulls are one space."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(copies).alias("live"))


def _rows(df: DataFrame, live: Column, *more: Column) -> DataFrame:
    """(conv_id, live, turn, role, key): key is the hash of role and text, and with turn and role the order of rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return df.select("conv_id", live.alias("live"), "turn", role.alias("role"), key.alias("key"), *more)


def _signatures(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order as a row for each conversation: its faults, and its signature from the end."""
    names, started = schema.names, False
    done: list[list] = [[] for _ in names]

    def close():
        gaps = last - first + 1 - turns if first is not None else 0
        for column, value in zip(done, (conv, gaps, *counts, "".join(reversed(symbols))), strict=True):
            column.append(value)

    for batch in batches:
        for c, live, turn, role, key, blank, whole in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if not started or c != conv:
                if started:
                    close()
                started, conv, first, last, turns, counts, symbols, seen, before = True, c, None, None, 0, [0, 0, 0, 0], [], set(), None
            if not live:
                continue
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
            initial = role[:1]
            if before is not None and before + initial not in ("su", "ua", "au"):
                counts[3] += 1
            before = initial
            if blank or key in seen:
                counts[0 if blank else 1] += 1
                symbols.append(GONE)
            else:
                symbol = initial if initial in KEPT else "o"
                counts[2] += not whole
                symbols.append(symbol if whole else symbol.upper())
            seen.add(key)
        if len(done[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(done, schema, strict=True)], schema=schema)
            done = [[] for _ in names]
    if started:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(done, schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def audits(df: DataFrame, live: Column | None = None) -> DataFrame:
    """A row for each conv_id of df (conv_id, turn, role, text): gaps of turns, blank, duplicate, truncated, illegal (neighbours that may not follow
    each other), cost and audit, the edits' letters. Rows where live is not true only say that the conversation is there."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    whole = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = _rows(df, F.coalesce(live if live is not None else F.lit(True), F.lit(False)), blank.alias("blank"), whole.alias("whole"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key")
    schema = T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("backwards", T.StringType())])
    arrow = _arrow(schema)
    signed = saved(rows.mapInArrow(lambda batches: _signatures(batches, arrow), schema), "conversation-signatures")
    # Equal signatures are split by conversation, so that a frequent one fills many tasks.
    ranged = signed.repartitionByRange("backwards", "conv_id").sortWithinPartitions("backwards")
    out = T.StructType([*schema.fields[:-1], T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    arrow_out = _arrow(out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Suffixes()
        for batch in batches:
            found = [shared.audit(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], schema=arrow_out)

    return ranged.mapInArrow(judge, out)


def follow(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the turns after the audit's edits of rows (role, text)."""
    state, at = NOTHING, 0

    def inserted() -> Iterator[tuple[str, str, str]]:
        nonlocal state, at
        while audit[at : at + 1] == "I":
            state, at = TURN[state], at + 1
            yield "I", NAMES[state], ""

    for role, text in rows:
        yield from inserted()
        letter = audit[at]
        at += 1
        if letter == "K":
            state = KEPT[role[:1]][state]
            yield letter, role, text
        elif letter == "R":
            state = TURN[state]
            yield letter, NAMES[state], text
    yield from inserted()


def _with_audits(df: DataFrame, audited: DataFrame, live: Column | None) -> DataFrame:
    """The live rows of each conversation in order, below a row with its audit and the rest of what audits() said."""
    said = F.struct(*[F.col(c) for c in audited.columns if c != "conv_id"])
    rows = _rows(df, F.coalesce(live if live is not None else F.lit(True), F.lit(False)), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")).filter("live").drop("live")
    both = rows.withColumn("said", F.lit(None).cast(audited.select(said).schema[0].dataType)).unionByName(audited.select("conv_id", said.alias("said")), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("said").isNull(), "turn", "role", "key").select("conv_id", "said", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict, Iterator[tuple[str, str]]]]:
    """(conv_id, what was said of it, its rows one by one) of what _with_audits() gives."""
    ahead: list = []
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def rows() -> Iterator[tuple[str, str]]:
        for row in stream:
            if row[1] is not None:
                ahead.append(row)
                return
            yield row[2], row[3]

    ahead.extend(x for x in [next(stream, None)] if x is not None)
    while ahead:
        conv, said, _, _ = ahead.pop()
        yield conv, said, rows()


def repair(df: DataFrame, live: Column | None = None) -> DataFrame:
    """(conv_id, n, edit, role, text): the turns of the repaired conversations, n from 0, edit K, R or I."""
    schema = T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), T.StructField("n", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])
    arrow = _arrow(schema)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, said, rows in _conversations(batches):
            for n, turn in enumerate(follow(said["audit"], rows)):
                out.append((conv, n, *turn))
                if len(out) >= 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return _with_audits(df, audits(df, live), live).mapInArrow(turns, schema)


def repair_report(df: DataFrame, live: Column | None = None) -> DataFrame:
    """audits() with repaired_sha256, the hash of the repaired turns as role:text, joined by newlines."""
    audited = audits(df, live)
    schema = T.StructType([*audited.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, said, rows in _conversations(batches):
            whole, first = hashlib.sha256(), True
            for _, role, text in follow(said["audit"], rows):
                whole.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            out.append((conv, *said.values(), whole.hexdigest()))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return _with_audits(df, audited, live).mapInArrow(digest, schema)
