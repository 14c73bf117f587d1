"""Conversation structure repair by a run-length dynamic program.

Every row is a symbol of its role's initial and its first fault; equal neighbours are one run. The cheapest edits that give
role initials `(s?(ua)+)?` are a path through four states (nothing yet, after a system, a user, an assistant row), so a row
is a 4 x 4 min-plus matrix and a run a power of it. Powers by twos are cached for each symbol; the choices are then unrolled
forward, the least letter first.

Spark deals the symbols out by (conversation, turn), so that one long conversation is read by many tasks; each passes on
its runs. A conversation's runs meet in one task, which makes its audit, a single value. Texts travel once, when the audit is
replayed over them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, saved

#: White space, ends of sentences, costs of the edits.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Initials by code; any other is OTHER. Faults by code.
INITIALS, OTHER = "sua", 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: The state that an added or changed row leads to, and its role.
NEXT, ROLE = (2, 2, 3, 2), (None, None, "user", "assistant")
#: Costs after the last row: what inserts take to a whole (ua).
LAST = (0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0)
NEVER = float("inf")
#: Runs after which a task passes on what it has of a conversation; rows that are unrolled at once.
SEGMENT_RUNS, UNROLLED = 1 << 16, 1 << 14

Vector = tuple[float, ...]


def kept_to(symbol: int, state: int) -> int | None:
    """The state after a row that is kept as it is."""
    initial = symbol // 4
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, state after the row, cost) of a row, without inserts before it."""
    fault, out = symbol % 4, [("D", state, DELETE)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if (to := kept_to(symbol, state)) is not None:
            out.append(("K", to, more))
        out.append(("R", NEXT[state], REROLE + more))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


@lru_cache(maxsize=None)  # 16 symbols, 64 powers
def power(symbol: int, j: int) -> np.ndarray:
    """The cheapest way from state to state over 2^j rows of one symbol, inserts before each included."""
    if j:
        half = power(symbol, j - 1)
        return times(half, half)
    row, insert = np.full((4, 4), NEVER), np.full((4, 4), NEVER)
    for state in range(4):
        insert[state, state] = 0
        for _, to, cost in choices(symbol, state):
            row[state, to] = min(row[state, to], cost)
    for state in range(4):
        insert[state, NEXT[state]] = INSERT
    return times(times(times(insert, insert), insert), row)


@lru_cache(maxsize=1 << 16)
def advanced(symbol: int, length: int, after: Vector) -> Vector:
    """The costs from before a run to the end, by state, if `after` holds after it; `after` has a least cost of 0."""
    h, j = np.array(after), 0
    while length >> j:
        if length >> j & 1:
            h = (power(symbol, j) + h).min(axis=1)
        j += 1
    return tuple(h.tolist())


def over_run(symbol: int, length: int, after: Vector) -> Vector:
    least = min(after)
    return tuple(x + least for x in advanced(symbol, length, tuple(x - least for x in after)))


@lru_cache(maxsize=1 << 16)
def chosen(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The letters of one row, inserts before it first, and the state after it: at each step the least letter that keeps
    the cheapest cost."""
    here, letters = advanced(symbol, 1, after), ""
    while True:
        steps = {letter: (to, cost + after[to]) for letter, to, cost in choices(symbol, state)}
        steps["I"] = (NEXT[state], INSERT + here[NEXT[state]])
        letter = min(x for x, (_, cost) in steps.items() if cost == here[state])
        state, letters = steps[letter][0], letters + letter
        if letter != "I":
            return letters, state


def audit(symbols: list[int], lengths: list[int]) -> tuple[int, str]:
    """Least cost of a conversation of these runs, and the letters of the edits that reach it, ASCII-least."""
    afters = [LAST]
    for symbol, length in zip(reversed(symbols), reversed(lengths)):
        afters.append(over_run(symbol, length, afters[-1]))
    cost, state, letters = afters[-1][0], 0, []
    for i, (symbol, length) in enumerate(zip(symbols, lengths, strict=True)):
        after = afters[len(symbols) - 1 - i]
        least = min(after)
        after = tuple(x - least for x in after)
        for left in range(length, 0, -UNROLLED):  # `left` rows of the run are still to come
            some = min(UNROLLED, left)
            stack = [over_run(symbol, left - some, after)]
            for _ in range(some - 1):
                stack.append(over_run(symbol, 1, stack[-1]))
            for then in reversed(stack):
                least = min(then)
                more, state = chosen(symbol, state, tuple(x - least for x in then))
                letters.append(more)
    return int(cost), "".join(letters) + "I" * int(LAST[state] // INSERT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Test damage: conv_id, turn, role, text, copies. crc32 of `conv_id:turn` modulo 20 drops a row (copies 0), empties its
    text, takes its ends of sentences away, repeats it (copies 2) or makes its role user. Null roles and texts, and nulls in
    the key, are one space; a null turn stays."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind, text = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20, text_of("text")
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def symbols(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: conv_id, turn, role, digest, copies, symbol, and `later`, the symbol of all copies
    but the first. Rows without copies stand for their conversation alone."""
    core = F.rtrim("text", F.lit(SPACE))
    fault = F.when(core == "", BLANK).when(~F.substring(core, -1, 1).isin(*ENDS), CUT).otherwise(SOUND)
    is_row = F.col("copies") > 0
    only = lambda c: F.when(is_row, c)
    each = rows.select("conv_id", only(F.col("turn")).alias("turn"), only(F.col("role")).alias("role"), only(_digest(F.col("text"))).alias("digest"), F.coalesce(only(fault), F.lit(SOUND)).alias("fault"), F.col("copies").cast("long"))
    equal = saved(each.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies")), "conversation-rows")
    # A text that its role says again in another turn: only the first turn's row is no duplicate.
    said = equal.where((F.col("copies") > 0) & (F.col("fault") != BLANK)).groupBy("conv_id", "role", "digest")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = said.agg(F.min(order).alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    blank = F.col("fault") == BLANK
    return equal.join(first, same, "left").select(
        "conv_id", "turn", "role", "digest", "copies",
        (code * 4 + F.when(blank | F.col("d").isNotNull(), F.col("fault")).otherwise(DUPLICATE)).alias("symbol"), (code * 4 + F.when(blank, BLANK).otherwise(DUPLICATE)).alias("later"),
    )


def _pieces(column: list) -> Iterator[tuple[int, int]]:
    """Bounds of equal neighbours."""
    at = 0
    for i in range(1, len(column) + 1):
        if i == len(column) or column[i] != column[at]:
            yield at, i
            at = i


def segments(rows: DataFrame) -> DataFrame:
    """What tasks have of conversations, in order of (shard, part): runs as (symbol, length) arrays, first and last turn,
    number of turns."""
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string("shard int, part int, symbols binary, lengths binary, first long, last long, turns long").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, out = TaskContext.get().partitionId(), 0, []
        conv, runs, turns = None, None, [None, None, 0]

        def flush() -> None:
            nonlocal runs, turns, part
            s, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in runs)
            starts = np.flatnonzero(np.diff(s, prepend=-1))
            out.append((conv, shard, part, s[starts].astype(np.uint8).tobytes(), np.add.reduceat(n, starts).astype("<i8").tobytes() if len(s) else b"", *turns))
            runs, turns, part = ([], []), [None, None, 0], part + 1

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), target, strict=True)], schema.fieldNames())

        target = None
        for batch in batches:
            if target is None:
                target = pa.schema([batch.schema.field(0), ("shard", pa.int32()), ("part", pa.int32()), ("symbols", pa.binary()), ("lengths", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("turns", pa.int64())])
            copies, first, later = (batch.column(i).to_numpy() for i in (2, 3, 4))
            turn, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            s = np.stack([first, later], axis=1)
            n = np.stack([np.minimum(copies, 1), np.maximum(copies - 1, 0)], axis=1)
            for a, b in _pieces(names):
                if runs is None or names[a] != conv:
                    if runs is not None:
                        flush()
                    conv, runs, turns = names[a], ([], []), [None, None, 0]
                here = n[a:b].ravel() > 0
                runs[0].append(s[a:b].ravel()[here])
                runs[1].append(n[a:b].ravel()[here])
                known = [t for t in turn[a:b] if t is not None]  # rows without copies have none
                if known:
                    fresh = len(set(known)) - (known[0] == turns[1])  # they are sorted
                    turns = [turns[0] if turns[0] is not None else known[0], known[-1], turns[2] + fresh]
                if sum(map(len, runs[0])) > SEGMENT_RUNS:
                    flush()
            if len(out) > 4096:
                yield batch_of()
                out = []
        if runs is not None:
            flush()
        if out:
            yield batch_of()

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "copies", "symbol", "later")
    return dealt.mapInArrow(released(each), schema)


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: conv_id, turn, role, text (not null) and copies. Rows stand by turn, nulls first; rows of one turn by role, then by
    the SHA-256 of their text, so that equal rows are neighbours. Only their first is no duplicate. A conversation whose
    rows have no copies has zeros and an empty audit; a null conv_id is one conversation; an empty table gives no rows.
    Any role but those that begin with s, u or a has to be changed or deleted. Other columns don't matter.
    """
    pieces = segments(symbols(rows))
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(AUDIT).fields])

    def solved(held: list[tuple]) -> tuple:
        runs, gaps, turns, last = [], 0, [], None
        s = np.frombuffer(b"".join(x[3] for x in held), np.uint8).astype(np.int64)
        n = np.frombuffer(b"".join(x[4] for x in held), "<i8")
        for x in held:
            if x[5] is not None:
                turns += [x[5], x[6]]
                gaps, last = gaps + x[7] - (x[5] == last), x[6]
        gaps = turns[-1] - turns[0] + 1 - gaps if turns else 0
        starts = np.flatnonzero(np.diff(s, prepend=-1))
        s, n = s[starts], np.add.reduceat(n, starts) if len(s) else n
        faults = np.bincount(s % 4, n, 4).astype(np.int64).tolist()
        pairs = (s[:-1] // 4) * 4 + s[1:] // 4
        legal = np.isin(pairs, (1, 6, 9)).sum()  # su, ua, au
        runs = audit(s.tolist(), n.tolist())
        return (held[0][0], gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], max(0, int(n.sum()) - 1) - int(legal), *runs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out, columns = [], [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if held and held[0][0] != row[0]:
                    out.append(solved(held))
                    held = []
                held.append(row)
            yield packed(out, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if held:
            yield packed([solved(held)], kind)

    def packed(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], schema.fieldNames())

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "shard", "part").mapInArrow(released(each), schema)


def replayed(rows: DataFrame, found: DataFrame, *, texts: bool) -> DataFrame:
    """The edits of `found` (from `audits`) carried out on `rows`, in order, each conversation streamed by one task.

    texts: the repaired rows (conv_id, place, role, text; inserted ones have an empty text). Else one row a conversation:
    the columns of `audits` and repaired_sha256, of the repaired `role:text` joined by line ends; of no row, that of an empty
    text. Memory doesn't grow with the texts of a conversation, only with its audit.
    """
    names = [c for c in found.columns if c != "conv_id"]
    wanted = T._parse_datatype_string("place long, role string, text string" if texts else f"{AUDIT}, repaired_sha256 string")
    schema = T.StructType([rows.schema["conv_id"], *wanted.fields])
    body = rows.where(F.col("copies") > 0).select("conv_id", F.lit(None).cast("struct<" + AUDIT.replace(" ", ":").replace(",:", ",") + ">").alias("plan"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", F.col("copies").cast("int"))
    head = found.select("conv_id", F.struct(*names).alias("plan"), *(F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "text")), F.lit(0).alias("copies"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = head.unionByName(body).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("plan").isNull(), "turn", "role", "digest").select("conv_id", "plan", "role", "text", "copies")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, plan, at, state, place, hashed = None, None, 0, 0, 0, None
        kind, out = None, []

        def put(role: str, text: str) -> None:
            nonlocal place
            if texts:
                out.append((conv, place, role, text))
            else:
                hashed.update((("\n" if place else "") + role + ":" + text).encode())
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(plan["audit"]) and plan["audit"][at] == "I":
                at, state = at + 1, NEXT[state]
                put(ROLE[state], "")

        def ended() -> None:
            if plan is not None:
                inserts()
                if not texts:
                    out.append((conv, *(plan[c] for c in names), hashed.hexdigest()))

        def packed() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.string()] if texts else [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], schema.fieldNames())

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                for row_conv, row_plan, role, text, copies in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    if row_plan is not None:
                        ended()
                        conv, plan, at, state, place, hashed = row_conv, row_plan, 0, 0, 0, hashlib.sha256()
                        continue
                    for _ in range(copies):
                        inserts()
                        letter, at = plan["audit"][at], at + 1
                        if letter == "K":
                            state = kept_to(4 * (INITIALS.find(role[:1]) if role[:1] in INITIALS and role else OTHER), state)
                            put(role, text)
                        elif letter == "R":
                            state = NEXT[state]
                            put(ROLE[state], text)
                yield packed()
                out = []
        if plan is not None:
            ended()
            yield packed()

    return dealt.mapInArrow(released(each), schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows of all conversations: conv_id, place, role, text. `rows` as for `audits`."""
    return replayed(rows, audits(rows), texts=True)


def reports(rows: DataFrame) -> DataFrame:
    """The audit of every conversation and the digest of what it is after the repair. `rows` as for `audits`."""
    return replayed(rows, audits(rows), texts=False)
