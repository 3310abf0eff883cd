"""Repair of the turn structure of conversations by a dynamic program over runs of equal rows.

Each row is a symbol: the initial of its role (s, u, a or other) and its first fault (none, truncated,
or blank or duplicate). Costs to go stand in a vector over the four states of ``(s?(ua)+)?``; a row
takes the vector back by a min-plus product with its symbol's transition, inserts included. Equal
consecutive symbols are collapsed, and a run of n rows is passed by the binary powers of that
transition, which are cached. From the first row on, the choices are then unrolled into the audit:
at each step the ASCII-least edit that stays on a cheapest way. No two cheapest audits lead to
different rows, as the roles of inserted and re-roled rows follow from the pattern.

On Spark: faults are native expressions. The first rows of texts that a conversation repeats come from
one aggregation (combined map-side) and are joined back, in a join that Spark may broadcast or split.
Rows are dealt by ranges of conversation, turn, role and the first characters of the text, so that a
conversation of any size is spread over tasks, which stream their sorted rows. A conversation that lies
within a task and has few rows is settled there. What is left (two for each task, and the long ones)
is cut into pieces with their own min-plus products; their vectors are chained from the last piece to
the first, and the audit from the first to the last. SHA-256 has no parallel form, so that last pass
streams a conversation's pieces through one task, a piece at a time; its audit (and without
``digests`` its repaired rows) is one value, which Spark bounds by 2 GB.

Defined results: a null role or text counts as one space; rows without a conversation form one; rows of
one turn go by role, then text, rows without a turn first; of equal rows of a turn the second is a
duplicate of the first; a conversation of which no row is ``present`` has zeros, an empty audit and
nothing repaired; an empty table gives an empty result; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.worker import releasing
from tidemark.session import materialize

#: States of the pattern: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits, the roles that may be given, and the initials that are told apart.
DELETE, INSERT, REROLE, TRUNCATED_STAYS = 3, 2, 2, 1
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = ["s", "u", "a"]
#: The state that an inserted or re-roled row leads to, and those that a kept row of each initial leads to.
GIVEN = (USER, USER, ASSISTANT, USER)
KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Faults as they stand in a symbol: 4 * fault + initial.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
NEVER = 1 << 60
#: A piece has so many rows, and so many characters of text unless it is one row, at most.
PIECE_ROWS, PIECE_CHARS = 4096, 2_000_000

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def apply(a: Matrix, after: Vector) -> Vector:
    return tuple(min(NEVER, *(x + y for x, y in zip(row, after, strict=True))) for row in a)


def _inserts() -> Matrix:
    cost = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for i in range(4):
        cost[i][GIVEN[i]] = min(cost[i][GIVEN[i]], INSERT)
        cost[i][GIVEN[GIVEN[i]]] = min(cost[i][GIVEN[GIVEN[i]]], 2 * INSERT)
    return tuple(map(tuple, cost))


INSERTS = _inserts()
#: Costs to go after the last row.
END = apply(INSERTS, tuple(0 if q in (START, ASSISTANT) else NEVER for q in range(4)))


def _edits(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a row in state q, least letter first."""
    fault, initial = divmod(symbol, 4)
    yield "D", DELETE, q
    if fault < BLANK:
        stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
        if initial in KEPT[q]:
            yield "K", stays, KEPT[q][initial]
        yield "R", REROLE + stays, GIVEN[q]


@cache
def power(symbol: int, j: int) -> Matrix:
    """The transition of 2**j rows of a symbol, inserts before each of them included."""
    if j:
        return product(power(symbol, j - 1), power(symbol, j - 1))
    row = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        for _, cost, to in _edits(symbol, q):
            row[q][to] = min(row[q][to], cost)
    return product(INSERTS, tuple(map(tuple, row)))


def advance(symbol: int, count: int, after: Vector) -> Vector:
    """Costs to go before ``count`` rows of a symbol, from those after them."""
    for j in range(count.bit_length()):
        if count >> j & 1:
            after = apply(power(symbol, j), after)
    return after


def transition(runs: list[tuple[int, int]]) -> Matrix:
    """The min-plus product of all rows of a piece."""
    columns = [tuple(0 if i == j else NEVER for i in range(4)) for j in range(4)]
    for symbol, count in reversed(runs):
        columns = [advance(symbol, count, c) for c in columns]
    return tuple(zip(*columns, strict=True))


@lru_cache(1 << 14)
def _choice(symbol: int, after: Vector, q: int) -> tuple[str, int]:
    """The letters up to this row's, and the state after it."""
    before, letters = advance(symbol, 1, after), ""
    while True:
        for letter, cost, to in sorted([*_edits(symbol, q), ("I", INSERT, GIVEN[q])]):
            if cost + (before if letter == "I" else after)[to] == before[q]:
                letters, q = letters + letter, to
                break
        if letters[-1] != "I":
            return letters, q


def _least_zero(v: Vector) -> Vector:
    low = min(v)
    return tuple(x - low for x in v)


def unroll(runs: list[tuple[int, int]], q: int, after: Vector) -> tuple[str, int]:
    """The audit of a piece's rows from state q on, and the state after them."""
    ends = [after]
    for symbol, count in reversed(runs):
        ends.append(advance(symbol, count, ends[-1]))
    letters = []
    for (symbol, count), end in zip(runs, reversed(ends[:-1]), strict=True):
        inside = [_least_zero(end)]
        for _ in range(count - 1):
            inside.append(_least_zero(advance(symbol, 1, inside[-1])))
        for v in reversed(inside):
            some, q = _choice(symbol, v, q)
            letters.append(some)
    return "".join(letters), q


def closing(q: int) -> str:
    """The inserts that follow the last row."""
    return "I" * (END[q] // INSERT)


def edited(audit: str, q: int, rows: Iterator[tuple[int, str, str]]) -> Iterator[tuple[str, str]]:
    """Roles and texts that the audit makes of rows (symbol, role, text) from state q on."""
    for letter in audit:
        if letter == "I":
            q = GIVEN[q]
            yield NAMES[q], ""
            continue
        symbol, role, text = next(rows)
        if letter == "K":
            q = KEPT[q][symbol % 4]
            yield role, text
        elif letter == "R":
            q = GIVEN[q]
            yield NAMES[q], text


class _Repaired:
    """The repaired rows, whole or as a digest."""

    def __init__(self, digests: bool):
        self._rows, self._hash, self._any = [], hashlib.sha256() if digests else None, False

    def add(self, rows: Iterator[tuple[str, str]]) -> None:
        if self._hash is None:
            self._rows += [{"role": r, "text": t} for r, t in rows]
            return
        for role, text in rows:
            self._hash.update(f"{chr(10) if self._any else ''}{role}:{text}".encode())
            self._any = True

    def value(self) -> object:
        return self._rows if self._hash is None else self._hash.hexdigest()


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _turns(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


class _Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv: object):
        self.conv, self.runs, self.rows, self.chars = conv, [], [], 0
        self.turns: list[int] = []  # distinct ones, ascending
        self.first = self.last = None  # initials of the first and the last row
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, symbol: int, turn: int | None, role: str, text: str) -> None:
        fault, initial = divmod(symbol, 4)
        if fault:
            self.counts["truncated" if fault == TRUNCATED else "blank" if fault == BLANK else "duplicate"] += 1
        if self.rows:
            self.counts["illegal"] += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + 1)
        else:
            self.runs.append((symbol, 1))
        self.rows.append((symbol, role, text))
        self.chars += len(role) + len(text)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def done(self, digests: bool) -> dict:
        audit, q = unroll(self.runs, START, END)
        audit += closing(q)
        repaired = _Repaired(digests)
        repaired.add(edited(audit, START, iter(self.rows)))
        cost = END
        for symbol, count in reversed(self.runs):
            cost = advance(symbol, count, cost)
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return self.counts | {"conv_id": self.conv, "gaps": _turns(low, high, len(self.turns)), "cost": cost[START], "audit": audit, "repaired": repaired.value()}

    def cut(self, part: int, no: int) -> dict:
        return self.counts | {
            "conv_id": self.conv, "part": part, "no": no, "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None,
            "distinct": len(self.turns), "first": self.first, "last": self.last, "steps": [x for row in transition(self.runs) for x in row],
            "symbols": [s for s, _, _ in self.rows], "roles": [r for _, r, _ in self.rows], "texts": [t for _, _, t in self.rows],
        }


def _repaired_type(digests: bool) -> str:
    return "repaired string" if digests else "repaired array<struct<role:string,text:string>>"


def _result(conv: str, digests: bool) -> str:
    return f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, {_repaired_type(digests)}"


def _pieces(conv: str, digests: bool) -> str:
    return f"{_result(conv, digests)}, part int, no long, low long, high long, distinct long, first int, last int, steps array<long>, symbols array<int>, roles array<string>, texts array<string>"


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about PIECE_CHARS characters at most, but for one row."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 200 + sum(len(t) for t in row.get("texts") or ()) + len(row.get("audit") or "")
        if not isinstance(row.get("repaired") or "", str):
            size += sum(len(x["text"]) for x in row["repaired"])
        if size >= PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _cutter(schema: pa.Schema, digests: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, no, piece, whole = TaskContext.get().partitionId(), 0, None, False
        for batch in batches:
            for conv, turn, symbol, role, text, present in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        yield piece.done(digests) if whole else piece.cut(part, no)
                        no += 1
                    # A conversation that began in this task and ends here, in one piece, is whole.
                    whole, piece = piece is not None, _Piece(conv)
                elif piece.full():
                    yield piece.cut(part, no)
                    no, whole, piece = no + 1, False, _Piece(conv)
                if present:
                    piece.add(symbol, turn, role, text)
        if piece is not None:
            yield piece.cut(part, no)

    return releasing(lambda batches: _batches(pieces(batches), schema))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go after each piece; pieces come from a conversation's last to its first."""

    def rows() -> Iterator[dict]:
        for _, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            after = END
            for r in own:
                yield {"part": r["part"], "no": r["no"], "after": list(after)}
                after = apply([r["steps"][k : k + 4] for k in range(0, 16, 4)], after)

    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("after", pa.list_(pa.int64()))])
    yield from _batches(rows(), schema)


def _finisher(schema: pa.Schema, digests: bool):
    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            out, q, audit, repaired = dict.fromkeys(_COUNTS, 0), START, [], _Repaired(digests)
            low = high = last = None
            distinct, cost = 0, None
            for r in own:
                for name in _COUNTS:
                    out[name] += r[name]
                if r["first"] is not None:
                    out["illegal"] += last is not None and (last, r["first"]) not in LEGAL
                    last = r["last"]
                if r["low"] is not None:
                    distinct += r["distinct"] - (high == r["low"])
                    low, high = (r["low"] if low is None else low), r["high"]
                runs = [(s, len(list(same))) for s, same in groupby(r["symbols"])]
                after = tuple(r["after"])
                if cost is None:
                    cost = apply([r["steps"][k : k + 4] for k in range(0, 16, 4)], after)[START]
                letters, then = unroll(runs, q, after)
                repaired.add(edited(letters, q, zip(r["symbols"], r["roles"], r["texts"], strict=True)))
                audit.append(letters)
                q = then
            audit.append(closing(q))
            repaired.add(edited(audit[-1], q, iter(())))
            yield out | {"conv_id": conv, "gaps": _turns(low, high, distinct), "cost": cost, "audit": "".join(audit), "repaired": repaired.value()}

    return releasing(lambda batches: _batches(settled(batches), schema))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    found = F.lit(len(INITIALS))
    for k, letter in enumerate(INITIALS):
        found = F.when(first == letter, k).otherwise(found)
    return found


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, digests: bool = False
) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    ``repaired`` holds the repaired rows, or with ``digests`` the SHA-256 of their ``role:text`` lines. Rows
    whose ``present_col`` isn't true only name their conversation.
    """
    role, text = (F.coalesce(df[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    present = F.coalesce(df[present_col], F.lit(False)) if present_col else F.lit(True)
    rows = df.select(df[conv_col].alias("conv_id"), df[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present"))
    content = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    rows = materialize(rows.select("*", F.when(F.col("present"), content).alias("content"), F.monotonically_increasing_id().alias("row_no")), "turns")
    # Contents that a conversation has more than once, with the row that comes first: the same in any order of equal rows.
    firsts = (
        rows.where("present")
        .groupBy(F.col("conv_id").alias("of"), F.col("content").alias("same"))
        .agg(F.min(F.struct("turn", "row_no")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("of", "same", F.col("first.row_no").alias("first_no"))
    )
    firsts = materialize(firsts, "firsts")
    marked = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("same")), "left")
    again = F.col("first_no").isNotNull() & (F.col("first_no") != F.col("row_no"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(again, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(SOUND)
    )
    # The range keys follow the order of role and text as far as their first characters tell.
    long_role = F.length("role") > 16
    keys = ["conv_id", "turn", F.substring("role", 1, 16), long_role, F.when(long_role, "").otherwise(F.substring("text", 1, 32))]
    dealt = (
        marked.select("conv_id", "turn", (4 * fault + _initial(F.col("role"))).cast("int").alias("symbol"), "role", "text", "present", again.alias("again"))
        .repartitionByRange(*keys)
        .sortWithinPartitions("conv_id", "turn", "role", "text", "again")
        .select("conv_id", "turn", "symbol", "role", "text", "present")
    )
    conv = dealt.schema["conv_id"].dataType.simpleString()
    result, pieces = _result(conv, digests), _pieces(conv, digests)
    cut = materialize(dealt.mapInArrow(_cutter(_arrow(df, pieces), digests), pieces), "pieces")
    names = [f.name for f in _arrow(df, result)]
    part = cut.where("part IS NOT NULL")
    narrow = part.select("conv_id", "part", "no", "steps")
    chained = (
        narrow.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("part").desc(), F.col("no").desc())
        .mapInArrow(releasing(_chain), "part int, no long, after array<long>")
    )
    finished = (
        part.join(materialize(chained, "chain"), ["part", "no"])
        .select("conv_id", "part", "no", *_COUNTS, "low", "high", "distinct", "first", "last", "steps", "symbols", "roles", "texts", "after")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "no")
        .mapInArrow(_finisher(_arrow(df, result), digests), result)
    )
    return cut.where("part IS NULL").select(*names).unionByName(finished)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with every fault that the repair knows, by the CRC-32 of ``conv_id:turn``; a dropped row stays as one that isn't present."""
    text_of = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    return df.select(
        df["conv_id"],
        df["turn"],
        F.when(fate == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")).alias("text"),
        (fate != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(True), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
