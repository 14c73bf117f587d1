"""Secret scan by one combined automaton.

All rule patterns are compiled, reversed, into one nondeterministic automaton; subset construction and minimisation turn
it into a transition array. One backward pass over a text's bytes marks every position where a match of some rule
begins. From the leftmost free start of a rule its own small anchored automaton finds the longest match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, sliced, utf8


@dataclass(frozen=True)
class Rule:
    """`pattern`: ASCII literals, classes, groups, alternatives and repeats. `group`, `least`: a match fails when that group is shorter."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Kinds, patterns and least lengths that results must agree on.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # shorter runs fail as a whole, so the length is part of the pattern
)
#: Kinds that this operator adds: code-host tokens, chat tokens, signed web tokens and private key headers.
ADDED = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


class Nfa:
    """States with byte-set moves and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, parsed, start: int, back: bool, fold: bool = False) -> int:
        """Adds a parsed pattern after `start`, from its last part to its first if `back`; returns where it ends."""
        at = start
        for op, arg in reversed(list(parsed)) if back else parsed:
            if op in (C.LITERAL, C.IN, C.NOT_LITERAL):
                end = self.state()
                self.moves[at].append((byte_set(op, arg, fold), end))
                at = end
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, back, (fold or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
            elif op is C.BRANCH:
                end = self.state()
                for part in arg[1]:
                    self.empty[self.add(part, at, back, fold)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, part = arg
                for _ in range(low):
                    at = self.add(part, at, back, fold)
                end = self.state()
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(part, loop, back, fold)].append(loop)
                    at = loop
                else:
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(part, at, back, fold)
                self.empty[at].append(end)
                at = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def byte_set(op, arg, fold: bool) -> frozenset[int]:
    if op is C.LITERAL:
        found = {arg}
    elif op is C.NOT_LITERAL:
        found = set(range(256)) - {arg}
    else:
        found = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found.update(range(x[0], x[1] + 1))
            elif kind is not C.NEGATE:
                raise ValueError(f"not supported in a class: {kind}")
        if arg[0][0] is C.NEGATE:
            found = set(range(256)) - found
    if fold:
        found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
    return frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """next[state, byte] and, by state, the bits of the rules that accept; 0 is the start."""

    next: np.ndarray
    accepts: np.ndarray


def determinised(nfa: Nfa, starts: list[int], ends: list[int], anchored: bool) -> Dfa:
    """Subset construction over classes of bytes that all moves treat alike, then minimisation."""
    sets = list({s for moves in nfa.moves for s, _ in moves})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    kind_of = np.array([kinds[x] for x in signature])
    sample = [signature.index(x) for x in kinds]
    first = nfa.closure(starts)
    number, todo, rows = {first: 0}, [first], []
    for now in todo:
        row = []
        for b in sample:
            to = nfa.closure({t for s in now for chars, t in nfa.moves[s] if b in chars} | (set() if anchored else first))
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    accepts = np.array([sum(1 << r for r, e in enumerate(ends) if e in now) for now in todo], np.int64)
    table = np.array(rows)
    part = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while they accept alike and move alike
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = np.unique(part, return_index=True)[1]
    at = np.argsort(np.argsort(order))  # the start, which is state 0, stays 0
    new = at[part]
    kept = order[np.argsort(order)]
    return Dfa(new[table[kept]][:, kind_of], accepts[kept])


def linked(dfa: Dfa) -> list[list]:
    """Each state as a list of its successors by byte, with its accepting rules at 256."""
    states: list[list] = [[None] * 257 for _ in dfa.accepts]
    for state, row, accepts in zip(states, dfa.next.tolist(), dfa.accepts.tolist(), strict=True):
        state[:256], state[256] = [states[i] for i in row], accepts
    return states


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        parsed = [_parser.parse(r.pattern) for r in rules]
        nfa = Nfa()
        starts = [nfa.state() for _ in rules]
        self.back = determinised(nfa, starts, [nfa.add(p, s, back=True) for p, s in zip(parsed, starts, strict=True)], anchored=False)
        self.states = linked(self.back)
        self.ahead = []
        for p in parsed:
            own = Nfa()
            start = own.state()
            dfa = determinised(own, [start], [own.add(p, start, back=False)], anchored=True)
            states = linked(dfa)
            self.ahead.append((states, next((s for s in states if not s[256] and all(x is s for x in s[:256])), None)))
        self.groups = [re.compile(r.pattern.encode()) for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, rule bits) wherever matches begin, from the last to the first."""
        found, state = [], self.states[0]
        at = len(data)
        for b in reversed(data):
            state = state[b]
            at -= 1
            if state[256]:
                found.append((at, state[256]))
        return found

    def longest(self, rule: int, data: bytes, start: int) -> int:
        """End of the longest match of the rule that begins at `start`."""
        states, dead = self.ahead[rule]
        state, end = states[0], start
        for at in range(start, len(data)):
            state = state[data[at]]
            if state[256]:
                end = at + 1
            elif state is dead:
                break
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of the leftmost non-overlapping matches of each rule that don't fail."""
        free, out = [0] * len(self.rules), []
        for at, bits in reversed(self.starts(data)):
            for r, rule in enumerate(self.rules):
                if bits >> r & 1 and at >= free[r]:
                    free[r] = end = self.longest(r, data, at)
                    match = self.groups[r].fullmatch(data, at, end)
                    if match and len(match[rule.group]) >= rule.least:
                        out.append((at, r, end))
        return sorted(out)

    def text_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """The same in code points."""
        found = self.spans(data)
        if not found or data.isascii():
            return found
        points = {p: 0 for p in sorted({x for s, _, e in found for x in (s, e)})}
        last = count = 0
        for p in points:
            count += len(data[last:p].decode())
            points[p], last = count, p
        return [(points[s], r, points[e]) for s, r, e in found]


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document row: its id and `found`, an array of (kind, start, end) by start, then by the rules' order.

    Positions are code points, end exclusive. A null or empty text has no spans. Repeated rows give a row each; other
    columns don't matter. Spans of one rule never overlap; spans of different rules may.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("found array<struct<kind:string,start:long,end:long>>").fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan_one, kinds = scanner(rules).text_spans, [r.kind for r in rules]
        for batch in sliced(batches):
            found = [[{"kind": kinds[r], "start": s, "end": e} for s, r, e in scan_one(t)] for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(each), schema)


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span (overlapping ones merged) replaced by `mark`; null texts stay null."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules).spans
        for batch in sliced(batches):
            texts = []
            for text in batch.column(at).to_pylist():
                data = (text or "").encode()
                out, last = [], 0
                for s, _, e in find(data):
                    if s >= last:
                        out += [data[last:s], mark.encode()]
                    last = max(last, e)
                texts.append(text if text is None else b"".join([*out, data[last:]]).decode())
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(released(each), schema)

