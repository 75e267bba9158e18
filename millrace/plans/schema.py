"""Schema graphs: tables, declared keys, order of insertion."""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql.types import DataType


class UnknownTableError(ValueError):
    pass


class CycleError(ValueError):
    pass


@dataclass(frozen=True)
class Column:
    name: str
    type: DataType
    nullable: bool = True
    identity: bool = False
    generated: bool = False
    max_length: int | None = None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str
    nullable: bool = False
    deferrable: bool = False


@dataclass(frozen=True)
class Constraint:
    kind: str  # primary_key, unique or check
    columns: tuple[str, ...] = ()
    text: str = ""


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class SchemaGraph:
    tables: tuple[Table, ...]
    keys: tuple[ForeignKey, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def filtered(self, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> SchemaGraph:
        """Only the named tables, without the keys that touch others."""
        keep = {t.name for t in self.tables if (not include or t.name in include) and t.name not in exclude}
        return replace(self, tables=tuple(t for t in self.tables if t.name in keep), keys=tuple(k for k in self.keys if k.table in keep and k.parent in keep))


@dataclass(frozen=True)
class InsertionPlan:
    order: tuple[str, ...]
    deferred: tuple[ForeignKey, ...] = ()


def _edges(graph: SchemaGraph, keys: list[ForeignKey]) -> dict[str, set[str]]:
    """Children of each table; self-references do not order anything."""
    names = {t.name for t in graph.tables}
    after: dict[str, set[str]] = defaultdict(set)
    for k in keys:
        for name in (k.table, k.parent):
            if name not in names:
                raise UnknownTableError(name)
        if k.table != k.parent:
            after[k.parent].add(k.table)
    return after


def topological_order(graph: SchemaGraph, keys: list[ForeignKey] | None = None) -> tuple[str, ...]:
    """Parents before children, by name where both could come next."""
    after = _edges(graph, list(graph.keys) if keys is None else keys)
    waits = {t.name: 0 for t in graph.tables}
    for children in after.values():
        for c in children:
            waits[c] += 1
    ready, out = [n for n, w in waits.items() if not w], []
    heapq.heapify(ready)
    while ready:
        out.append(heapq.heappop(ready))
        for c in after[out[-1]]:
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(ready, c)
    if len(out) < len(waits):
        raise CycleError(", ".join(sorted(set(waits) - set(out))))
    return tuple(out)


def cycles(graph: SchemaGraph) -> list[tuple[str, ...]]:
    """Cycles met by a depth-first walk, each from its least name, none twice."""
    after = {k: sorted(v) for k, v in _edges(graph, list(graph.keys)).items()}
    found, done = set(), set()

    def walk(name: str, path: list[str]) -> None:
        path.append(name)
        for c in after.get(name, ()):
            if c in path:
                ring = path[path.index(c):]
                at = ring.index(min(ring))
                found.add(tuple(ring[at:] + ring[:at]))
            elif c not in done:
                walk(c, path)
        path.pop()
        done.add(name)

    for t in sorted(t.name for t in graph.tables):
        if t not in done:
            walk(t, [])
    return sorted(found)


def resolve(graph: SchemaGraph) -> InsertionPlan:
    """An order of insertion; nullable or deferrable keys within a cycle are left for a second pass."""
    in_ring = [set(zip(ring, ring[1:] + ring[:1], strict=True)) for ring in cycles(graph)]
    on_cycle = set().union(*in_ring) if in_ring else set()
    deferred = [k for k in graph.keys if (k.parent, k.table) in on_cycle and (k.nullable or k.deferrable)]
    return InsertionPlan(topological_order(graph, [k for k in graph.keys if k not in deferred]), tuple(deferred))
