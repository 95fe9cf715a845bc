"""Conversation structure repair by a run-length dynamic program.

The rows of a conversation, by turn, become symbols: the initial of the role and the
first fault (blank, duplicate, truncated).  A legal conversation has the role initials
``(s?(ua)+)?``.  What has been kept so far is one of four states (nothing, after ``s``, after ``u``, after
``a``), and a symbol is a 4 x 4 matrix of the cheapest ways to get from one to the
other: Keep 0 (5 more for a truncated row), Rerole 1 (the same), Delete 2, after any Inserts
of 5 each.  Equal consecutive symbols are one run; its matrix, in the algebra of minimum
and plus, is a product of cached binary powers.  The costs to the end are carried from the
last run to the first; the choices are then unrolled from the start, the letter that is least in ASCII first, a
long run by halves.

Order of rows: by turn (nulls first), ties by role, then text, and copies of a row stand
side by side.  A conversation is hashed by one task, since sha256 is sequential by its
definition, as a sorted stream: its memory is the runs and the letters of the audit (which
is one value of the result), and texts up to ``HELD`` bytes.  A longer conversation's texts
are streamed once more, behind its audit.

Defined cases: a null role or text is one space; a null turn is one space in the damage
key, comes first and counts for no gap; null conv_ids are one conversation; a
conversation without rows has zeros, an empty audit and the hash of the empty text; an
empty table gives an empty table; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bridgerec.llm.staging import Stage, shuffle_partitions

#: States: nothing kept, after a system row, after a user row, after an assistant row.
STATES = range(4)
INITIALS = "sua"
#: Costs of the edits, and of a truncated row that stays.
DELETE, RETURN, INSERT, TRUNCATED = 2, 1, 5, 5
NEVER = 1 << 60
#: Faults of a symbol: none, truncated, to be deleted.
SOUND, CUT, GONE = range(3)
#: Bytes of a conversation's texts that a task holds until its audit is known.
HELD = 16 << 20
#: Runs up to this length are unrolled from a table.
SHORT_RUN = 256

Vector = tuple[int, int, int, int]


def symbol_of(initial: str, fault: int) -> int:
    """4 * fault + the initial's place in ``sua`` (3 for others); deleted rows are all alike."""
    if fault == GONE:
        return 4 * GONE
    at = INITIALS.find(initial) if initial else -1
    return 4 * fault + (at if at >= 0 else 3)


def _next_role(state: int) -> int:
    """The state after a user or assistant row that is legal after ``state``."""
    return 3 if state == 2 else 2


def _keeps(symbol: int, state: int) -> int | None:
    """The state after keeping the row, None where that is not legal."""
    at = symbol % 4
    if symbol // 4 == GONE or at == 3:
        return None
    legal = state == 0 if at == 0 else (state == 2) == (at == 2)
    return at + 1 if legal else None


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, in ASCII order but for inserts."""
    extra = TRUNCATED if symbol // 4 == CUT else 0
    out = [("D", DELETE, state)]
    if (to := _keeps(symbol, state)) is not None:
        out.append(("K", extra, to))
    if symbol // 4 != GONE:
        out.append(("R", RETURN + extra, _next_role(state)))
    return out


def _after_inserts(cost: list[int]) -> Vector:
    """The costs with any number of inserts before; a third insert never helps."""
    for _ in range(2):
        cost = [min(cost[s], INSERT + cost[_next_role(s)]) for s in STATES]
    return tuple(cost)


#: Costs from each state after the last row.
END = _after_inserts([0, NEVER, NEVER, 0])


@lru_cache(maxsize=None)
def power(symbol: int, p: int) -> tuple[Vector, ...]:
    """Row s: the costs from s to each state over 2**p rows of the symbol (at most 12 x 64 matrices)."""
    if p:
        half = power(symbol, p - 1)
        return tuple(tuple(min(half[s][m] + half[m][t] for m in STATES) for t in STATES) for s in STATES)
    columns = []
    for t in STATES:
        one = [min((c for _, c, to in _edits(symbol, s) if to == t), default=NEVER) for s in STATES]
        columns.append(_after_inserts(one))
    return tuple(zip(*columns, strict=True))


def _normal(v: list[int]) -> tuple[int, Vector]:
    least = min(v)
    return least, tuple(min(x - least, NEVER) for x in v)


@lru_cache(maxsize=1 << 16)
def advance(symbol: int, length: int, after: Vector) -> tuple[int, Vector]:
    """The costs before a run from those after it, as the least one and what is above it."""
    base, v = 0, after
    for p in range(length.bit_length()):
        if length >> p & 1:
            m = power(symbol, p)
            least, v = _normal([min(m[s][t] + v[t] for t in STATES) for s in STATES])
            base += least
    return base, v


def unroll(symbol: int, length: int, state: int, after: Vector) -> tuple[str, int]:
    """The cheapest edits over a run, the ASCII-least of them, and the state they lead to."""
    if length <= SHORT_RUN:
        return _unroll(symbol, length, state, after)
    left, right = length - length // 2, length // 2
    first, state = unroll(symbol, left, state, advance(symbol, right, after)[1])
    second, state = unroll(symbol, right, state, after)
    return first + second, state


@lru_cache(maxsize=1 << 14)
def _unroll(symbol: int, length: int, state: int, after: Vector) -> tuple[str, int]:
    if length > 1:
        left, right = length - length // 2, length // 2
        first, state = _unroll(symbol, left, state, advance(symbol, right, after)[1])
        second, state = _unroll(symbol, right, state, after)
        return first + second, state
    cost = _after_inserts([min(c + after[to] for _, c, to in _edits(symbol, s)) for s in STATES])
    letters = ""
    while True:
        edits = _edits(symbol, state)
        edits.insert(1, ("I", INSERT, _next_role(state)))  # D, I, K, R
        for letter, c, to in edits:
            if c + (cost if letter == "I" else after)[to] == cost[state]:
                break
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def audit_of(runs: list[list[int]]) -> tuple[int, str]:
    """The least cost and the ASCII-least audit of runs ``[symbol, length]``."""
    after, total = [END], 0
    for symbol, length in reversed(runs):
        least, v = advance(symbol, length, after[-1])
        total += least
        after.append(v)
    total += after[-1][0]
    state, letters = 0, []
    for k, (symbol, length) in enumerate(runs):
        some, state = unroll(symbol, length, state, after[len(runs) - 1 - k])
        letters.append(some)
    while END[state] != 0 or state not in (0, 3):
        letters.append("I")
        state = _next_role(state)
    return total, "".join(letters)


def apply_audit(audit: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the repaired rows."""
    state = 0
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "K":
            state = INITIALS.index(role[0]) + 1
        else:
            state = _next_role(state)
            role = "user" if state == 2 else "assistant"
        yield letter, role, text


class _Hash:
    """sha256 of ``role:text`` lines."""

    def __init__(self) -> None:
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False


class _Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, conv_id, most_held: int):
        self.conv_id, self.most_held = conv_id, most_held
        self.runs: list[list[int]] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.lowest = self.highest = None
        self.turns = 0
        self.texts: list[tuple[str, str]] | None = []
        self.held = 0

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.highest:
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault:
            self.counts[fault] += 1
        symbol = symbol_of(initial, SOUND if fault is None else CUT if fault == "truncated" else GONE)
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])
        if self.texts is not None:
            self.texts.append((role, text if symbol != 4 * GONE else ""))
            self.held += len(text) + 64
            if self.held > self.most_held:
                self.texts = None

    def result(self) -> tuple:
        cost, audit = audit_of(self.runs)
        digest = None
        if self.texts is not None:
            out = _Hash()
            for _, role, text in apply_audit(iter(audit), iter(self.texts)):
                out.add(role, text)
            digest = out.sha.hexdigest()
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, audit, digest)


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copy, dropped)``: rows with the faults that
    crc32 of ``conv_id:turn`` deals; a dropped row stays as a mark without text."""
    blank = F.lit(" ")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("kind", kind).withColumn("text", text)
    rows = rows.withColumn("role", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).withColumn("dropped", F.col("kind") == 0).drop("kind")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows of each conversation in one task, in order, with their first fault."""
    parts = shuffle_partitions(rows.sparkSession)
    seen = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn", "copy")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = rows.repartition(parts, "conv_id").withColumn("again", F.row_number().over(seen) > 1).withColumn("end", last)
    fault = (
        F.when(F.col("end") == "", "blank")
        .when(F.col("again"), "duplicate")
        .when(~F.col("end").isin(".", "!", "?"), "truncated")
    )
    rows = rows.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    return rows.select("conv_id", "turn", "role", "text", "fault", "dropped")


def conversation_repair(rows: DataFrame, stage: Stage, held: int = HELD) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``
    of each conversation of ``rows(conv_id, turn, role, text, copy, dropped)``; texts of
    a conversation over ``held`` bytes are read twice."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [rows.schema["conv_id"], *(T.StructField(n, T.LongType()) for n in names)]
    schema = T.StructType([*fields, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        ready: list[tuple] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, turn, role, text, fault, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        ready.append(now.result())
                    now = _Conversation(conv_id, held)
                if not dropped:
                    now.add(turn, role, text, fault)
            if len(ready) >= 1000:
                yield packed(ready, kind)
                ready = []
        if now is not None:
            ready.append(now.result())
            yield packed(ready, kind)

    def packed(ready: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(names), pa.string(), pa.string()]
        columns = zip(*ready, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    found = stage.write(_ordered(rows).mapInArrow(run, schema), "found")
    long = found.filter("repaired_sha256 is null")
    if long.isEmpty():
        return found
    digests = _streamed(rows, long, True).toDF("long_id", "long_sha256")
    both = found.join(digests, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", "long_sha256")).select(found.columns)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)`` of the repaired conversations; ``found`` is
    what :func:`conversation_repair` gave for ``rows``."""
    return _streamed(rows, found, False)


def _streamed(rows: DataFrame, found: DataFrame, digest: bool) -> DataFrame:
    """The rows of the conversations in ``found``, streamed behind their audits."""
    wanted = found.select(F.col("conv_id").alias("wanted"))
    chosen = rows.filter("not dropped").join(wanted, F.col("conv_id").eqNullSafe(F.col("wanted")), "left_semi")
    turns = chosen.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text")
    head = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    order = ["conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text"]
    parts = shuffle_partitions(rows.sparkSession)
    sorted_rows = head.unionByName(turns).repartition(parts, "conv_id").sortWithinPartitions(*order)
    key = found.schema["conv_id"]
    if digest:
        schema = T.StructType([key, T.StructField("repaired_sha256", T.StringType())])
    else:
        fields = [("position", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
        schema = T.StructType([key, *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, stream in _conversations(batches):
            if digest:
                out = _Hash()
                for _, role, text in stream.edits:
                    out.add(role, text)
                yield _batch([(stream.conv_id, out.sha.hexdigest())], kind, schema)
                continue
            some: list[tuple] = []
            for k, (letter, role, text) in enumerate(stream.edits):
                some.append((stream.conv_id, k, letter, role, text))
                if len(some) == 1000:
                    yield _batch(some, kind, schema)
                    some = []
            if some:
                yield _batch(some, kind, schema)

    return sorted_rows.mapInArrow(run, schema)


def _batch(some: list[tuple], kind: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    types = [kind, *(pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema.fields[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=schema.names)


class _Stream:
    """A conversation's repaired rows, read from the sorted stream as they are asked for."""

    def __init__(self, conv_id, edits: Iterator[tuple[str, str, str]]):
        self.conv_id, self.edits = conv_id, edits


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, _Stream]]:
    """Each conversation's stream; it is to be read to its end before the next one."""

    def flat() -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield batch.schema.field(0).type, row

    rows = flat()
    head = next(rows, None)
    while head is not None:
        kind, (conv_id, _, _, _, audit) = head
        # an audit has as many letters other than I as its conversation has rows
        turns = ((role, text) for _, (_, _, _, role, text) in rows)
        yield kind, _Stream(conv_id, apply_audit(iter(audit), turns))
        head = next(rows, None)
