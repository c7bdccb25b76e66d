"""Property paths as relations of pairs; closures as semi-naive fixpoints.

A closure grows from its bound end: a constant, or the distinct values that other patterns bind there (seeds). Every round
writes the pairs it found first and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.functions import values as V
from quadlake.operators.relation import Info, Rel, column_name, join, union
from quadlake.operators.scan import Dataset, Graph, ground, name_of, nothing, pattern
from quadlake.scratch import drop, together, written

FROM, TO, MID = "path from", "path to", "path mid"
_FROM, _TO = R.Var(FROM), R.Var(TO)
MAX_ROUNDS = 10_000


def scan(data: Dataset, graph: Graph, s, path, o, distinct_alternatives: bool = True, seeds: Rel | None = None, nodes: bool = False) -> Rel:
    """Solutions of `s path o` that may join with `seeds`; with `nodes`, what these bind are nodes of the active graph."""
    ends = [x if ground(x) else None for x in (s, o)]
    if seeds is not None and ends == [None, None] and _has_closure(path):
        at = next(i for i, x in enumerate((s, o)) if name_of(x) in seeds.vars and seeds.vars[name_of(x)].certain)
        name = name_of((s, o)[at])
        found = seeds.select({FROM: (seeds.val(name), True)}).distinct()
        ends[at] = Seeds(Rel(written(found.df), found.vars), nodes)
    rel = _Paths(data, graph, distinct_alternatives).pairs(path, *ends)
    cols, conds = {}, []
    for end, x in ((FROM, s), (TO, o)):
        value = rel.val(end)
        name = name_of(x)
        if name is None:
            conds.append(F.coalesce(V.same_term(value, V.constant(x)), F.lit(False)))
        elif name in cols:
            conds.append(F.coalesce(V.same_term(cols[name][0], value), F.lit(False)))
        else:
            cols[name] = (value, True)
    if graph.var is not None:
        g = rel.val(graph.var)
        if graph.var in cols:
            conds.append(F.coalesce(V.same_term(cols[graph.var][0], g), F.lit(False)))
        else:
            cols[graph.var] = (g, True)
    df = rel.df
    for c in conds:
        df = df.where(c)
    return Rel(df, rel.vars).select(cols)


@dataclass
class Seeds:
    """Distinct values of a path's end, as FROM; `nodes`: all of them are nodes of the graph."""

    rel: Rel
    nodes: bool

    def of(self, rel: Rel) -> Rel:
        """Rows of `rel` that start at a seed."""
        at = self.rel.df.select(F.col(f"`{column_name(FROM)}`").alias("seed"))
        info = self.rel.vars[FROM]
        return Rel(rel.df.join(at, V.same_term(rel.val(FROM), V.Val(info.kind, F.col("seed"), info.prefix)), "left_semi"), rel.vars)


def _has_closure(path) -> bool:
    if path[0] in ("star", "plus", "opt"):
        return True
    return path[0] in ("inv", "seq", "alt") and any(_has_closure(p) for p in (path[1] if isinstance(path[1], list) else [path[1]]))


def _rename(rel: Rel, names: dict[str, str]) -> Rel:
    return rel.select({names.get(v, v): (rel.val(v), rel.vars[v].certain) for v in rel.vars})


class _Paths:
    def __init__(self, data: Dataset, graph: Graph, distinct_alternatives: bool):
        self.data, self.graph, self.distinct_alternatives = data, graph, distinct_alternatives

    def pairs(self, path, s=None, o=None) -> Rel:
        """(from, to[, graph variable]) of a path; constant ends seed closures."""
        kind = path[0]
        if kind == "link":
            return pattern(self.data, self.graph, _FROM, R.IRI(path[1]), _TO)
        if kind == "inv":
            return _rename(self.pairs(path[1], o, s), {FROM: TO, TO: FROM})
        if kind == "seq":
            parts = path[1]
            out = self.pairs(parts[0], s, None if len(parts) > 1 else o)
            for i, step in enumerate(parts[1:], 1):
                following = _rename(self.pairs(step, None, o if i == len(parts) - 1 else None), {FROM: MID})
                out = join(_rename(out, {TO: MID}), following)
                out = out.project([v for v in out.vars if v != MID])
            return out
        if kind == "alt":
            out = union([self.pairs(p, s, o) for p in path[1]])
            return out.distinct() if self.distinct_alternatives else out
        if kind == "neg":
            return self._negated(path[1], path[2])
        if kind == "opt":
            step = self.pairs(path[1], s, o)
        else:
            step = self._closure(self.pairs(path[1]), s, o, _has_closure(path[1]))
        if kind == "plus":
            return step  # pairs are distinct already
        return union([step, self._identity(s, o)]).distinct()

    def _negated(self, direct, inverse) -> Rel:
        rels = []
        for iris, swap in ((direct, False), (inverse, True)):
            if iris is None:
                continue
            found = pattern(self.data, self.graph, _FROM, R.Var("path via"), _TO)
            if iris:
                found = found.where(~V.text_of(found.val("path via")).isin(*iris))
            found = found.project([v for v in found.vars if v != "path via"])
            rels.append(_rename(found, {FROM: TO, TO: FROM}) if swap else found)
        return rels[0] if len(rels) == 1 else union(rels)

    def _identity(self, s, o) -> Rel:
        """Zero steps: every node of the graph, and a constant end even if it is not in the graph."""
        anchor = s if s is not None else o
        seeds = anchor if isinstance(anchor, Seeds) else None
        constant = anchor if seeds is None else None
        spark = self.data.catalog.spark
        if seeds is not None and seeds.nodes and self.graph.var is None:
            return seeds.rel.extend(TO, seeds.rel.val(FROM), True)
        if constant is not None and self.graph.var is None:
            value = V.constant(constant)
            return Rel(spark.range(1), {}).select({FROM: (value, True), TO: (value, True)})
        all_ = pattern(self.data, self.graph, _FROM, R.Var("path via"), _TO)
        graph = [self.graph.var] if self.graph.var is not None else []
        ends = [_rename(all_.project([e, *graph]), {e: FROM}) for e in (FROM, TO)]
        nodes = union(ends).distinct()
        if constant is not None:
            nodes = nodes.where(F.coalesce(V.same_term(nodes.val(FROM), V.constant(constant)), F.lit(False)))
        if seeds is not None:
            nodes = seeds.of(nodes)
        return nodes.extend(TO, nodes.val(FROM), True)

    def _closure(self, step: Rel, s, o, costly: bool) -> Rel:
        """One or more steps, each pair once. A bound end restricts the first frontier; otherwise all pairs grow. A costly step is written once."""
        if step.vars[FROM] != step.vars[TO]:  # ends must be comparable
            kind, prefix = V.common([step.val(FROM), step.val(TO)])
            cols = {v: (V.Val(kind, V.lift(step.val(v), kind), prefix) if v in (FROM, TO) else step.val(v), True) for v in step.vars}
            step = step.select(cols)
        back = s is None and o is not None
        if back:
            step = _rename(step, {FROM: TO, TO: FROM})
        anchor = o if back else s
        edges = Rel(written(step.df.distinct()), step.vars) if costly else step
        start = edges
        if isinstance(anchor, Seeds):
            start = anchor.of(edges)
        elif anchor is not None:
            start = edges.where(F.coalesce(V.same_term(edges.val(FROM), V.constant(anchor)), F.lit(False)))
        names = [column_name(v) for v in edges.vars]
        found = [written(start.df.distinct())]
        for _ in range(MAX_ROUNDS):
            frontier = Rel(found[-1], edges.vars)
            grown = join(_rename(frontier, {TO: MID}), _rename(edges, {FROM: MID}))
            grown = grown.project([v for v in edges.vars]).distinct()
            known = together(found).select(*[F.col(f"`{n}`").alias("k_" + n) for n in names])
            fits = F.lit(True)
            for n in names:
                fits = fits & (F.col(f"`{n}`") == F.col(f"`k_{n}`"))
            fresh = written(grown.df.join(known, fits, "left_anti"))
            if fresh.isEmpty():
                drop(fresh)
                break
            found.append(fresh)
        else:
            raise RuntimeError(f"a closure did not end in {MAX_ROUNDS} rounds")
        if costly:
            drop(edges.df)
        reached = Rel(together(found), edges.vars)
        return _rename(reached, {FROM: TO, TO: FROM}) if back else reached


__all__ = ["scan", "nothing", "Info"]
