"""Syntax trees of queries and updates.

Expressions are tuples: ("var", name), ("term", term), ("op", name, [args]), ("call", NAME, [args]),
("fn", iri, [args]), ("in", e, [es], negated), ("exists", Group, negated),
("agg", NAME, distinct, e or None, separator), ("triple", s, p, o).
Paths: ("link", iri), ("inv", p), ("seq", [ps]), ("alt", [ps]), ("opt"|"star"|"plus", p), ("neg", [iris], [inverse iris] or None).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Triples:
    triples: list


@dataclass
class Filter:
    expr: tuple


@dataclass
class Bind:
    expr: tuple
    var: str


@dataclass
class Optional_:
    group: Group


@dataclass
class Minus:
    group: Group


@dataclass
class Union:
    groups: list


@dataclass
class GraphPattern:
    graph: object
    group: Group


@dataclass
class Service:
    target: object
    group: Group
    silent: bool


@dataclass
class Values:
    names: list
    rows: list


@dataclass
class SubSelect:
    query: Query


@dataclass
class Query:
    form: str
    items: list | None = None  # [(name, expr or None)]; None: all
    distinct: bool = False
    reduced: bool = False
    template: list | None = None
    targets: list | None = None
    default_graphs: list = field(default_factory=list)
    named_graphs: list = field(default_factory=list)
    where: Group = field(default_factory=Group)
    group_by: list | None = None  # [(name or None, expr)]
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # [(expr, ascending)]
    limit: int | None = None
    offset: int = 0
    values: Values | None = None
    base: str = ""


@dataclass
class Operation:
    kind: str
    silent: bool = False
    source: object = None  # IRI, "DEFAULT", "NAMED", "ALL"
    target: object = None
    delete: list = field(default_factory=list)  # [(graph or None, (s, p, o))]
    insert: list = field(default_factory=list)
    where: Group | None = None
    with_: object = None
    using: list = field(default_factory=list)
    using_named: list = field(default_factory=list)
    base: str = ""
