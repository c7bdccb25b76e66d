"""Triple patterns and basic graph patterns over stored quads and mapped tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake import terms as R
from quadlake.functions import values as V
from quadlake.functions.expressions import triple_part
from quadlake.functions.values import Val
from quadlake.operators.relation import Info, Rel, column_name, join, unit, union
from quadlake.plans.joinorder import PatternStats, baseline, best_order
from quadlake.sources.catalog import Catalog, Key, TableMap, key_equals, key_text, literal_kind


@dataclass(frozen=True)
class Graph:
    """The active graph: the default graph, a named one, or each named one in turn under a variable."""

    name: str | None = None
    var: str | None = None


@dataclass
class Dataset:
    """A catalog as FROM and FROM NAMED show it. ``estimator`` orders joins; None keeps the written order."""

    catalog: Catalog
    default: list[str] | None = None
    named: list[str] | None = None
    estimator: object = baseline
    _predicates: set | None = field(default=None, repr=False)

    def quads(self, graph: Graph):
        """(s, p, o[, g]) of the stored quads in the active graph; None if there are none."""
        df = self.catalog.quads
        if df is None:
            return None
        if graph.var is not None:
            df = df.where(F.col("g").isNotNull())
            return df if self.named is None else df.where(F.col("g").isin(*self.named) if self.named else F.lit(False))
        if graph.name is not None:
            seen = self.named is None or graph.name in self.named
            return df.where(F.col("g") == graph.name if seen else F.lit(False)).select("s", "p", "o")
        if self.default is None:
            return df.where(F.col("g").isNull()).select("s", "p", "o")
        if not self.default:
            return df.where(F.lit(False)).select("s", "p", "o")
        out = df.where(F.col("g").isin(*self.default)).select("s", "p", "o")
        return out if len(self.default) == 1 else out.distinct()

    def tables(self, graph: Graph) -> list[TableMap]:
        maps = self.catalog.maps
        if graph.var is not None:
            return [m for m in maps if m.graph is not None and (self.named is None or m.graph in self.named)]
        if graph.name is not None:
            return [m for m in maps if m.graph == graph.name and (self.named is None or graph.name in self.named)]
        if self.default is None:
            return [m for m in maps if m.graph is None]
        return [m for m in maps if m.graph in self.default]

    def stored_predicates(self) -> set[str]:
        """Predicates of the stored quads; a vocabulary, not data."""
        if self._predicates is None:
            df = self.catalog.quads
            self._predicates = set() if df is None else {r["p"] for r in df.select("p").distinct().collect()}
        return self._predicates

    def named_graphs(self):
        df = self.catalog.named_graphs()
        return df if self.named is None else df.where(F.col("g").isin(*self.named) if self.named else F.lit(False))


def name_of(x) -> str | None:
    """The variable a pattern position binds; blank nodes are variables that cannot be selected."""
    if isinstance(x, R.Var):
        return x.name
    return "_:" + x.label if isinstance(x, R.BNode) else None


def ground(x) -> bool:
    if isinstance(x, R.TripleTerm):
        return ground(x.s) and ground(x.p) and ground(x.o)
    return isinstance(x, (R.IRI, R.Lit))


class Binder:
    """Collects a scan's columns and conditions."""

    def __init__(self):
        self.cols: dict[str, Val] = {}
        self.conds: list = []
        self.dead = False

    def put(self, x, value: Val) -> None:
        """Bind or compare one position."""
        if isinstance(x, R.TripleTerm) and not ground(x):
            t = V.to_term(value)
            self.conds.append(t["kind"] == R.TRIPLE)
            for i, part in enumerate((x.s, x.p, x.o)):
                self.put(part, Val("term", triple_part(t, i)))
            return
        name = name_of(x)
        if name is None:
            self.conds.append(V.same_term(value, V.constant(x)))  # null counts as false, and a bare comparison reaches the scan
        elif name in self.cols:
            self.conds.append(V.same_term(self.cols[name], value))
        else:
            self.cols[name] = value
            self.conds.append(value.col.isNotNull())

    def rel(self, df) -> Rel:
        for c in self.conds:
            df = df.where(c)
        shown = [v.col.alias(column_name(n)) for n, v in self.cols.items()] or [F.lit(1).alias("_one")]
        return Rel(df.select(*shown), {n: Info(v.kind, v.prefix, True) for n, v in self.cols.items()})


def cell_value(table: TableMap, target: str | Key) -> Val | None:
    df = table.df
    if isinstance(target, Key):
        if target.blank:
            return Val("bnode", F.concat(F.lit(target.prefix), key_text(df, target)))
        if len(target.columns) == 1:
            return Val("key", F.col(f"`{target.columns[0]}`"), target.prefix)
        return Val("iri", F.concat(F.lit(target.prefix), key_text(df, target)), target.prefix)
    kind = literal_kind(df.schema[target].dataType)
    if kind is None:
        return None
    col = F.col(f"`{target}`")
    return Val(kind, col.cast("double") if isinstance(df.schema[target].dataType, T.FloatType) else col)


def bind_subject(binder: Binder, table: TableMap, s) -> None:
    if isinstance(s, R.IRI) and not table.subject.blank:
        binder.conds.append(key_equals(table.df, table.subject, s.value))
        return
    binder.put(s, cell_value(table, table.subject))


def star(table: TableMap, s, arcs: list[tuple]) -> Rel:
    """All patterns of one subject over one table: a single scan."""
    binder = Binder()
    bind_subject(binder, table, s)
    for p, o in arcs:
        if p == R.RDF_TYPE and table.class_iri and p not in table.columns:
            binder.put(o, Val("iri", F.lit(table.class_iri)))
            continue
        target = table.columns[p]
        value = cell_value(table, target)
        if value is None:
            binder.conds.append(F.lit(False))
            continue
        if isinstance(target, Key) and not target.blank and isinstance(o, R.IRI):
            binder.conds.append(key_equals(table.df, target, o.value))
            continue
        binder.put(o, value)
    return binder.rel(table.df)


def has(table: TableMap, predicate: str) -> bool:
    return predicate in table.columns or (predicate == R.RDF_TYPE and table.class_iri is not None)


def can_be(table: TableMap, p: str, o) -> bool:
    """False if the pattern asks for another class than the table's."""
    return p != R.RDF_TYPE or p in table.columns or not ground(o) or o == R.IRI(table.class_iri)


def narrowed(table: TableMap, s: list, o: list) -> TableMap | None:
    """The table with those predicates whose triples can meet values of `s` and of `o` (lists of Infos or Vals that all
    hold), by kinds and prefixes; None if there are none. Triples of the others have no solution."""

    def fits(value, held: list) -> bool:
        return value is not None and not any(V.apart(value, h) for h in held)

    if not fits(cell_value(table, table.subject), s):
        return None
    columns = {p: c for p, c in table.columns.items() if fits(cell_value(table, c), o)}
    class_iri = table.class_iri if table.class_iri and fits(Info("iri", table.class_iri), o) else None
    return replace(table, columns=columns, class_iri=class_iri) if columns or class_iri else None


def _held(x, held: dict[str, list[Info]] | None) -> list:
    """What is known of the values of a pattern's position."""
    if isinstance(x, R.IRI):
        return [Info("iri", x.value)]
    if isinstance(x, R.Lit):
        return [V.constant(x)]
    return (held or {}).get(name_of(x), [])


def pattern(data: Dataset, graph: Graph, s, p, o, held: dict[str, list[Info]] | None = None) -> Rel:
    """One triple pattern over every source. `held` says what the solutions to join with bind variables to: if the predicate
    is a variable, triples of mapped tables that cannot join are not made."""
    rels = []
    quads = data.quads(graph)
    tables = data.tables(graph)
    if quads is not None:
        binder = Binder()
        if isinstance(p, R.IRI):
            quads = quads.where(F.col("p") == p.value)
        binder.put(s, Val("term", F.col("s")))
        if not isinstance(p, R.IRI):
            binder.put(p, Val("iri", F.col("p")))
        binder.put(o, Val("term", F.col("o")))
        if graph.var is not None:
            binder.put(R.Var(graph.var), Val("iri", F.col("g")))
        rels.append(binder.rel(quads))
    for table in tables:
        if isinstance(p, R.IRI):
            if has(table, p.value) and can_be(table, p.value, o):
                rels.append(_in_graph(star(table, s, [(p.value, o)]), table, graph))
            continue
        binder = Binder()
        if isinstance(s, R.IRI) and (table.subject.blank or not s.value.startswith(table.subject.prefix)):
            continue
        table = narrowed(table, _held(s, held), _held(o, held))
        if table is None:
            continue
        df = data.catalog.triples_of(table, key_equals(table.df, table.subject, s.value) if isinstance(s, R.IRI) else None)
        binder.put(s, Val("term", F.col("s")))
        binder.put(p, Val("iri", F.col("p")))
        binder.put(o, Val("term", F.col("o")))
        rels.append(_in_graph(binder.rel(df), table, graph))
    if not rels:
        return nothing(data, [n for x in (s, p, o) for n in _names(x)] + ([graph.var] if graph.var else []))
    return rels[0] if len(rels) == 1 else union(rels)


def _in_graph(rel: Rel, table: TableMap, graph: Graph) -> Rel:
    if graph.var is None:
        return rel
    value = Val("iri", F.lit(table.graph))
    if graph.var in rel.vars:
        return rel.where(F.coalesce(V.same_term(rel.val(graph.var), value), F.lit(False)))
    return rel.extend(graph.var, value, True)


def _names(x) -> list[str]:
    if isinstance(x, R.TripleTerm):
        return [n for y in (x.s, x.p, x.o) for n in _names(y)]
    name = name_of(x)
    return [name] if name else []


def nothing(data: Dataset, names: list[str]) -> Rel:
    """No solutions, over the given variables."""
    names = list(dict.fromkeys(names))
    base = data.catalog.spark.range(1).where(F.lit(False))
    cols = [F.lit(None).cast(R.TERM).alias(column_name(n)) for n in names] or [F.lit(1).alias("_one")]
    return Rel(base.select(*cols), {n: Info("term") for n in names})


def stats_of(data: Dataset, part: Rel, s, arcs: list[tuple], table: TableMap | None) -> PatternStats:
    """Estimates for a scan: from the catalog's hook, from the table's size, or from what is constant."""
    name = repr((s, sorted(map(repr, arcs))))
    hook = data.catalog.statistics
    given = hook(s, arcs, table) if hook is not None else None
    if given is not None:
        return PatternStats(name, given.rows, {v: given.distinct.get(v, given.rows) for v in part.vars})
    total = table.rows() if table is not None else data.catalog.triples(arcs[0][0])
    rows, distinct = total, {}
    if ground(s):
        rows = min(rows, len(arcs))
    elif name_of(s):
        distinct[name_of(s)] = total
    for p, o in arcs:
        target = table.columns.get(p) if table is not None and isinstance(p, str) else None
        values = max(1.0, total**0.5)
        if isinstance(target, Key):  # a reference has at most as many values as the table it leads to
            values = min(total, *(m.rows() for m in data.catalog.maps if m.subject.prefix == target.prefix), total)
        if ground(o):
            rows /= values
        elif name_of(o):
            distinct.setdefault(name_of(o), values)
    rows = max(rows, 1.0)
    return PatternStats(name, rows, {v: min(distinct.get(v, rows), rows) for v in part.vars})


def basic(data: Dataset, graph: Graph, triples: list[tuple], path_scan, context: Rel | None = None) -> Rel:
    """A basic graph pattern: stars collapse to scans, joins go by estimated size, paths come last.

    ``path_scan(s, path, o, seeds)`` evaluates a property path; `seeds` has solutions that hold its bound ends. `context` are
    solutions that the pattern will be joined with: they seed paths too.
    """
    if not triples:
        return unit(data.catalog.spark)
    parts: list[tuple[Rel, PatternStats] | None] = []
    later: list[tuple] = []
    any_predicate: list[tuple] = []
    stars: dict = {}
    tables = data.tables(graph)
    stored = data.stored_predicates() if tables and data.catalog.quads is not None else None

    def one(s, p, o, held: dict[str, list[Info]] | None = None) -> tuple[Rel, PatternStats]:
        rel = pattern(data, graph, s, p, o, held)
        fits = [m for m in tables if isinstance(p, R.IRI) and has(m, p.value)]
        return rel, stats_of(data, rel, s, [(p.value if isinstance(p, R.IRI) else None, o)], fits[0] if len(fits) == 1 and data.catalog.quads is None else None)

    for s, p, o in triples:
        if isinstance(p, tuple):
            later.append((s, p, o))
            continue
        if not isinstance(p, R.IRI):
            any_predicate.append((len(parts), s, p, o))
            parts.append(None)  # made below: the other patterns tell which tables it can join
            continue
        mine = [m for m in tables if has(m, p.value)]
        alone = data.catalog.quads is None or (stored is not None and p.value not in stored)
        if mine and alone:
            stars.setdefault(s, []).append((p.value, o, mine))
        else:
            parts.append(one(s, p, o))
    for s, arcs in stars.items():
        fits = [m for m in tables if all(any(m is x for x in mine) for _, _, mine in arcs)]
        # Subjects of mapped tables have prefixes of their own, so one predicate that only one table has settles the table.
        if len(fits) == 1 and any(len(mine) == 1 for _, _, mine in arcs):
            rel = _in_graph(star(fits[0], s, [(p, o) for p, o, _ in arcs]), fits[0], graph)
            parts.append((rel, stats_of(data, rel, s, [(p, o) for p, o, _ in arcs], fits[0])))
        else:
            for p, o, _ in arcs:
                parts.append(one(s, R.IRI(p), o))
    held: dict[str, list[Info]] = {}
    for r in (*(part[0] for part in parts if part is not None), *([context] if context is not None else [])):
        for v, info in r.vars.items():
            if info.certain:
                held.setdefault(v, []).append(info)
    for at, s, p, o in any_predicate:
        parts[at] = one(s, p, o, held)
    out = ordered(data, parts) if parts else None
    while later:
        # A path with an end that is bound already starts there; of several the first written comes first.
        known = {v for r in (out, context) if r is not None for v, i in r.vars.items() if i.certain}
        at = next((k for k, (s, _, o) in enumerate(later) if {name_of(s), name_of(o)} & known), 0)
        s, p, o = later.pop(at)
        ends = [n for n in (name_of(s), name_of(o)) if n is not None]
        seeds = next((r for r in (out, context) if r is not None and any(n in r.vars and r.vars[n].certain for n in ends)), None)
        found = path_scan(s, p, o, seeds)
        out = found if out is None else join(out, found)
    return out.project(written_vars(triples, out))


def written_vars(triples: list[tuple], rel: Rel) -> list[str]:
    """Variables in the order they were written in, whatever the order of the joins."""
    names = [n for t in triples for x in t if not isinstance(x, tuple) for n in _names(x)]
    return list(dict.fromkeys([*(n for n in names if n in rel.vars), *rel.vars]))


def ordered(data: Dataset, parts: list[tuple[Rel, PatternStats]]) -> Rel:
    """Join by estimated size; without an estimator in written order, but connected parts before others."""
    if data.estimator is not None:
        rels = [parts[i][0] for i in best_order([s for _, s in parts], data.estimator)]
        out = rels.pop(0)
        for r in rels:
            out = join(out, r)
        return out
    rest = [r for r, _ in parts]
    out = rest.pop(0)
    while rest:
        at = next((i for i, r in enumerate(rest) if set(r.vars) & set(out.vars)), 0)
        out = join(out, rest.pop(at))
    return out
