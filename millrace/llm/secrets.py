"""Secret scans by one combined deterministic automaton.

The rules' regular expressions over bytes are parsed to a nondeterministic automaton and
turned around; subset construction and minimisation make one deterministic automaton of them
all, and a text's UTF-8 bytes go through its transition arrays once, from the last to the
first. A state tells which rules have a match that starts there. From the leftmost start on,
the rule's own anchored automaton finds the longest end; the next start behind it follows. So
the work is in proportion to the text, however many starts or ends a run of bytes holds.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ASSIGN_VALUE = "A-Za-z0-9+/_.=-"
#: Expressions of literals, classes [..], groups (..|..), ? * + {n} {n,} and \\ before a literal character.
RULES: dict[str, str] = {
    # Letters of the keywords in either case.
    "assign": "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?[" + _ASSIGN_VALUE + "]+",
    "access": "AKIA[A-Z0-9]+",
    # A run shorter than 8 holds no longer one; so short a count keeps the automaton small.
    "hex": "[0-9a-f]{8,}",
    "private_key": "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----",
    "web_token": "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+",
    "hosting_token": "gh[pousr]_[A-Za-z0-9]+",
    "chat_token": "xox[abprs]-[A-Za-z0-9-]+",
}
#: Least lengths of whole matches; shorter ones are dropped and not tried again.
MIN_LENGTH = {"access": 16, "hex": 32, "web_token": 40, "hosting_token": 40, "chat_token": 15}
BASE = ("assign", "access", "hex")
MIN_ASSIGN_VALUE = 8

# ---- expressions to nondeterministic automata


class _Nfa:
    """States are numbers; ``moves[s]`` lists (bytes, target), ``free[s]`` targets without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def reversed(self) -> _Nfa:
        """The same states with every move turned around."""
        out = _Nfa()
        for _ in self.moves:
            out.state()
        for s, (moves, free) in enumerate(zip(self.moves, self.free, strict=True)):
            for on, t in moves:
                out.moves[t].append((on, s))
            for t in free:
                out.free[t].append(s)
        return out

    def add(self, expression: str) -> tuple[int, int]:
        start, end, rest = self._choice(expression, 0)
        if rest != len(expression):
            raise ValueError(f"unbalanced group in {expression!r}")
        return start, end

    def _choice(self, x: str, i: int) -> tuple[int, int, int]:
        start, end = self.state(), self.state()
        while True:
            first, last, i = self._sequence(x, i)
            self.free[start].append(first)
            self.free[last].append(end)
            if i == len(x) or x[i] != "|":
                return start, end, i
            i += 1

    def _sequence(self, x: str, i: int) -> tuple[int, int, int]:
        start = end = self.state()
        while i < len(x) and x[i] not in "|)":
            begin, (low, high), i = i, (1, 1), self._atom_end(x, i)
            atom = x[begin:i]
            if i < len(x) and x[i] in "?*+{":
                if x[i] == "{":
                    close = x.index("}", i)
                    n, _, m = x[i + 1 : close].partition(",")
                    low, high = int(n), (int(m) if m else None) if "," in x[i:close] else int(n)
                    i = close
                else:
                    low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[x[i]]
                i += 1
            for _ in range(low):
                end = self._once(atom, end)
            if high is None:
                loop = self.state()
                self.free[end].append(loop)
                self.free[self._once(atom, loop)].append(loop)
                end = loop
            for _ in range((high or low) - low):
                after = self._once(atom, end)
                self.free[end].append(after)
                end = after
        return start, end, i

    def _atom_end(self, x: str, i: int) -> int:
        if x[i] == "(":
            depth = 0
            while True:
                if x[i] == "[":
                    i = x.index("]", i + 1)
                depth += {"(": 1, ")": -1}.get(x[i], 0)
                i += 1
                if not depth:
                    return i
        return x.index("]", i + 1) + 1 if x[i] == "[" else i + (2 if x[i] == "\\" else 1)

    def _once(self, atom: str, start: int) -> int:
        if atom[0] == "(":
            first, last, _ = self._choice(atom[1:-1], 0)
            self.free[start].append(first)
            return last
        end = self.state()
        self.moves[start].append((_members(atom), end))
        return end


def _members(atom: str) -> frozenset[int]:
    if atom[0] != "[":
        return frozenset(atom[-1].encode())
    body, out, i = atom[1:-1], set(), 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            out |= set(range(ord(body[i]), ord(body[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(body[i]))
            i += 1
    return frozenset(out)


# ---- deterministic automata


class Automaton:
    """A minimal deterministic automaton: ``table[state][byte]`` and what each state tells.

    ``ends[state]``: rules that end there. ``begun[state]``: rules of which something is matched.
    State 0 is the start. With ``backwards`` it reads a text from its end, every position may end
    a match, ``ends`` tells the rules that start there, and ``begun`` is not kept.
    """

    def __init__(self, rules: dict[str, str], backwards: bool):
        nfa = _Nfa()
        spans = {kind: nfa.add(x) for kind, x in rules.items()}
        if backwards:
            nfa, spans = nfa.reversed(), {kind: (end, start) for kind, (start, end) in spans.items()}
        owner = self._owners(nfa, spans)
        accept = {end: kind for kind, (_, end) in spans.items()}
        starts = frozenset(self._closure(nfa, [s for s, _ in spans.values()]))
        classes = self._byte_classes(nfa)
        members = {c: classes.index(c) for c in set(classes)}
        # Subset construction, over classes of bytes that no rule tells apart.
        number, table, todo = {starts: 0}, [], [starts]
        while todo:
            now = todo.pop(0)
            row = {}
            for c, byte in members.items():
                after = set(self._closure(nfa, [t for s in now for on, t in nfa.moves[s] if byte in on]))
                after = frozenset(after | starts if backwards else after)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row[c] = number[after]
            table.append(row)
        sets = sorted(number, key=number.get)
        ends = [frozenset(accept[s] for s in x if s in accept) for x in sets]
        begun = [frozenset() if backwards else frozenset(owner[s] for s in x) for x in sets]
        self.subset_states = len(sets)
        self._minimise(table, ends, begun, sorted(members), classes)

    @staticmethod
    def _owners(nfa: _Nfa, spans: dict[str, tuple[int, int]]) -> dict[int, str]:
        owner = {}
        for kind, (start, _) in spans.items():
            todo = [start]
            while todo:
                s = todo.pop()
                if s not in owner:
                    owner[s] = kind
                    todo += [*nfa.free[s], *(t for _, t in nfa.moves[s])]
        return owner

    @staticmethod
    def _closure(nfa: _Nfa, states: list[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += nfa.free[s]
        return out

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> list[int]:
        """The class of each byte: equal for bytes that are in the same sets of all moves."""
        kinds = sorted({on for moves in nfa.moves for on, _ in moves}, key=sorted)
        signs: dict[tuple[bool, ...], int] = {}
        return [signs.setdefault(tuple(b in on for on in kinds), len(signs)) for b in range(256)]

    def _minimise(self, table: list[dict[int, int]], ends: list, begun: list, classes: list[int], of_byte: list[int]) -> None:
        """Merge states that tell the same and lead to merged states, until nothing splits any more."""
        block: dict[object, int] = {}
        part = [block.setdefault((ends[s], begun[s]), len(block)) for s in range(len(table))]
        while True:
            block = {}
            new = [block.setdefault((part[s], *(part[table[s][c]] for c in classes)), len(block)) for s in range(len(table))]
            if len(block) == len(set(part)):
                break
            part = new
        first: dict[int, int] = {}
        for s, p in enumerate(new):
            first.setdefault(p, s)
        self.ends = [ends[s] for s in first.values()]
        self.begun = [begun[s] for s in first.values()]
        self.table = [[new[table[s][of_byte[b]]] for b in range(256)] for s in first.values()]


class Scanner:
    """All rules in one pass over bytes."""

    def __init__(self, rules: dict[str, str]):
        combined = Automaton(rules, backwards=True)
        self.states = len(combined.table)
        self.own = {kind: Automaton({kind: x}, backwards=False) for kind, x in rules.items()}
        # rows[s][b] is the row of the next state, rows[s][256] the rules that start there.
        self.rows: list[list] = [[] for _ in combined.table]
        for s, row in enumerate(self.rows):
            row.extend(self.rows[t] for t in combined.table[s])
            row.append(combined.ends[s])

    def _longest(self, kind: str, data: bytes, start: int) -> int:
        own, state, end = self.own[kind], 0, -1
        for i in range(start, len(data)):
            state = own.table[state][data[i]]
            if own.ends[state]:
                end = i + 1
            if not own.begun[state]:
                break
        return end

    def spans(self, data: bytes) -> dict[str, list[tuple[int, int]]]:
        """Leftmost, longest, non-overlapping (start, end) of each kind, in bytes."""
        starts: dict[str, list[int]] = defaultdict(list)
        row, at = self.rows[0], len(data)
        for byte in reversed(data):
            row = row[byte]
            at -= 1
            if row[256]:
                for kind in row[256]:
                    starts[kind].append(at)
        out: dict[str, list[tuple[int, int]]] = {}
        for kind, places in starts.items():
            end, found = 0, []
            for at in reversed(places):
                if at >= end:
                    end = self._longest(kind, data, at)
                    found.append((at, end))
            out[kind] = found
        return out


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[tuple[str, str], ...] = tuple(RULES.items())) -> Scanner:
    """One scanner for each worker process."""
    return Scanner(dict(rules))


def _assigned_value(data: bytes, start: int, end: int) -> int:
    """Where the value of an assignment begins."""
    i = start
    while data[i] not in b":=":
        i += 1
    i += 1
    while i < end and data[i] == 32:
        i += 1
    return i + (data[i] in b"\"'")


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of one whole text in code points, by start, then kind as in RULES.

    Null counts as empty. Spans of one kind don't overlap; those of different kinds may.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scanner().spans(data)
    if not found:
        return []
    order = {kind: i for i, kind in enumerate(RULES)}
    out = [(kind, s, e) for kind, spans in found.items() for s, e in spans if e - s >= MIN_LENGTH.get(kind, 0) and (kind != "assign" or e - _assigned_value(data, s, e) >= MIN_ASSIGN_VALUE)]
    if len(data) != len(text):  # offsets of bytes to those of code points
        marks, at, points = {}, 0, 0
        for b in sorted({x for _, s, e in out for x in (s, e)}):
            points += len(data[at:b].decode("utf-8", "surrogatepass"))
            at, marks[b] = b, points
        out = [(kind, marks[s], marks[e]) for kind, s, e in out]
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None) -> str | None:
    """The text with every secret replaced by its kind in brackets; overlapping ones by the first."""
    out, at = [], 0
    for kind, s, e in find(text):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return text if text is None else "".join([*out, text[at:]])


def _rowwise(docs: DataFrame, make: Callable[[str | None], tuple], names: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    labels = [x.split()[0] for x in names.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in names.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[make(t.as_py()) for t in batch.column(1)], strict=True)) or [[] for _ in labels]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *labels])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {names}")


def secrets_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document, repeated rows and null ids included.

    Extra columns are ignored; an empty table gives an empty result.
    """

    def row(text: str | None) -> tuple:
        spans = find(text)
        base = [x for x in spans if x[0] in BASE]
        counts = [sum(x[0] == k for x in base) for k in BASE]
        return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))

    return _rowwise(docs, row, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and the text without its secrets."""
    return _rowwise(docs, lambda t: (redact(t),), "text string")
