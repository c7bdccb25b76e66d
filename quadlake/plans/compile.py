"""Graph patterns and queries to relations: one lazy DataFrame plan per query (closures are written on the way)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.functions import values as V
from quadlake.functions.expressions import Context, Expressions, freeze
from quadlake.functions.values import Val
from quadlake.operators import paths, relation
from quadlake.operators.relation import Info, Rel, column_name, join, left_join, minus, semi_join, union, unit
from quadlake.operators.scan import Dataset, Graph, basic
from quadlake.parser import ast as A
from quadlake.parser.sparql import aggregates_in, expr_vars, in_scope, pattern_vars
from quadlake.scratch import written


@dataclass
class Compiler:
    data: Dataset
    context: Context
    distinct_alternatives: bool = True
    services: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.data.catalog.spark

    # ---- patterns
    def group(self, g: A.Group, graph: Graph, start: Rel | None = None, filters: bool = True) -> Rel:
        """A group's parts in order, its filters at the end. `start` seeds variables of an outer query."""
        rel = start or unit(self.spark)
        late = [part.expr for part in g.parts if isinstance(part, A.Filter)]
        for part in g.parts:
            if not isinstance(part, A.Filter):
                rel = self.part(rel, part, graph, late if filters else [])
        if filters:
            for e in late:
                rel = self.filter(rel, e, graph)
        return rel

    def part(self, rel: Rel, part, graph: Graph, late: list[tuple] = ()) -> Rel:
        if isinstance(part, A.Triples):
            context = rel if rel.vars else None

            def path(s, p, o, seeds):
                inside = seeds is not None and seeds is not context
                return paths.scan(self.data, graph, s, p, o, self.distinct_alternatives, self.narrowed(seeds, late), inside)

            return join(rel, basic(self.data, graph, part.triples, path, context))
        if isinstance(part, A.Group):
            return join(rel, self.group(part, graph))
        if isinstance(part, A.Optional_):
            return self.optional(rel, part.group, graph)
        if isinstance(part, A.Minus):
            return minus(rel, self.group(part.group, graph))
        if isinstance(part, A.Union):
            return join(rel, union([self.group(g, graph) for g in part.groups]))
        if isinstance(part, A.Values):
            return join(rel, relation.local(self.spark, part.names, part.rows))
        if isinstance(part, A.GraphPattern):
            return join(rel, self.graph(part))
        if isinstance(part, A.Service):
            return join(rel, self.service(part, graph))
        if isinstance(part, A.SubSelect):
            return join(rel, self.select(part.query, graph))
        if isinstance(part, A.Bind):
            return self.bind(rel, part.var, part.expr, graph)
        raise ValueError(f"unknown pattern {type(part).__name__}")

    def narrowed(self, rel: Rel | None, late: list[tuple]) -> Rel | None:
        """`rel` under those of a group's filters that read only what it binds for certain: fewer seeds, the same result."""
        for e in late if rel is not None else []:
            if not _exists_in(e) and not _needs_row(e) and all(v in rel.vars and rel.vars[v].certain for v in expr_vars(e)):
                rel = rel.where(Expressions(rel.env(), self.context).truth(e))
        return rel

    def optional(self, rel: Rel, g: A.Group, graph: Graph) -> Rel:
        """LeftJoin: the filters at the top of the optional group belong to the join and see both sides."""
        plain = [p.expr for p in g.parts if isinstance(p, A.Filter) and not _exists_in(p.expr)]
        rest = A.Group([p for p in g.parts if not isinstance(p, A.Filter) or _exists_in(p.expr)])
        inner = self.group(rest, graph)
        condition = None
        if plain:

            def condition(env):
                out = F.lit(True)
                for e in plain:
                    out = out & F.coalesce(Expressions(env, self.context).truth(e), F.lit(False))
                return out

        return left_join(rel, inner, condition)

    def graph(self, part: A.GraphPattern) -> Rel:
        if isinstance(part.graph, R.Var):
            name = part.graph.name
            inner = self.group(part.group, Graph(var=name))
            names = self.data.named_graphs().select(F.col("g").alias(column_name(name)))
            graphs = Rel(names, {name: Info("iri")})
            # Groups that scan nothing hold in every named graph.
            return join(graphs, inner)
        return self.group(part.group, Graph(name=part.graph.value))

    def service(self, part: A.Service, graph: Graph) -> Rel:
        """A registered catalog under that IRI; otherwise the pattern is evaluated here. SILENT turns failure into one empty solution."""
        try:
            target = part.target.value if isinstance(part.target, R.IRI) else None
            if target in self.services:
                other = Compiler(Dataset(self.services[target]), self.context, self.distinct_alternatives, self.services)
                return other.group(part.group, Graph())
            return self.group(part.group, graph)
        except Exception:
            if part.silent:
                return unit(self.spark)
            raise

    def bind(self, rel: Rel, name: str, e: tuple, graph: Graph) -> Rel:
        rel, value, hidden = self.value(rel, e, graph)
        if name in rel.vars:
            old = rel.val(name)
            kind, prefix = V.common([old, value])
            value = Val(kind, F.coalesce(V.lift(old, kind), V.lift(value, kind)), prefix)
        return _drop(rel.extend(name, value, False), hidden)

    # ---- filters and EXISTS
    def filter(self, rel: Rel, e: tuple, graph: Graph) -> Rel:
        for part in _conjuncts(e):
            negated = part[0] == "op" and part[1] == "!" and part[2][0][0] == "exists"
            found = part[2][0] if negated else part
            if found[0] == "exists":
                rel = self.exists(rel, found[1], graph, anti=found[2] != negated)
                continue
            kept = rel
            rel, flags, hidden = self.flags(rel, part, graph)
            cond = Expressions(rel.env(), self.context, flags).truth(part)
            rel = Rel(rel.df.where(cond), kept.vars if not hidden else rel.vars)
            rel = _drop(rel, hidden)
        return rel

    def exists(self, rel: Rel, g: A.Group, graph: Graph, anti: bool) -> Rel:
        """Semi- or anti-join. Filters at the top of the group become join conditions; other references to outer
        variables are served by seeding the group with their distinct values."""
        plain = [p.expr for p in g.parts if isinstance(p, A.Filter) and not _exists_in(p.expr)]
        rest = A.Group([p for p in g.parts if not (isinstance(p, A.Filter) and not _exists_in(p.expr))])
        own = in_scope(rest)
        seeds = [v for v in sorted(_free(rest) - own) if v in rel.vars]
        if graph.var is not None and graph.var in rel.vars and graph.var not in own and rest.parts:
            own = own | {graph.var}
        start = rel.project(seeds).distinct() if seeds else None
        inner = self.group(rest, graph, start)
        extra = None
        if plain:

            def extra(env):
                out = F.lit(True)
                for e in plain:
                    out = out & F.coalesce(Expressions(env, self.context).truth(e), F.lit(False))
                return out

        shared = set(rel.vars) & set(inner.vars)
        if not shared and extra is None:  # uncorrelated
            probe = Rel(inner.df.limit(1).select(F.lit(1).alias("_one")), {})
            return Rel(rel.df.join(probe.df.select(F.lit(True).alias("r_hit")), F.lit(True), "left_anti" if anti else "left_semi"), rel.vars)
        return semi_join(rel, inner, extra, anti)

    def flags(self, rel: Rel, e: tuple, graph: Graph):
        """Columns that say of each EXISTS inside an expression whether it holds: (relation, {id: column}, hidden columns)."""
        flags, hidden = {}, []
        for g in _exists_in(e):
            shared = [v for v in sorted(pattern_vars(g)) if v in rel.vars]
            domain = rel.project(shared).distinct()
            hits = self.exists(domain, g, graph, anti=False)
            name = f"_flag{len(hidden)}_{id(g)}"
            if not shared:
                hit = hits.df.limit(1).select(F.lit(True).alias(name))
                rel = Rel(rel.df.join(F.broadcast(hit), F.lit(True), "left"), rel.vars)  # one row
            else:
                cols = [F.col(f"`{column_name(v)}`").alias("d_" + column_name(v)) for v in shared]
                right = hits.df.select(*cols, F.lit(True).alias(name))
                cond = F.lit(True)
                for v in shared:
                    mine, other = F.col(f"`{column_name(v)}`"), F.col(f"`d_{column_name(v)}`")
                    cond = cond & (mine == other if rel.vars[v].certain else mine.eqNullSafe(other))
                rel = Rel(rel.df.join(right, cond, "left").drop(*["d_" + column_name(v) for v in shared]), rel.vars)
            flags[id(g)] = F.col(name)
            hidden.append(name)
        return rel, flags, hidden

    def value(self, rel: Rel, e: tuple, graph: Graph, aggregates: dict | None = None):
        """(relation, value of an expression, hidden columns to drop afterwards)."""
        rel, flags, hidden = self.flags(rel, e, graph)
        if _needs_row(e) and "_row" not in rel.df.columns:
            rel = with_rows(rel)
        return rel, Expressions(rel.env(), self.context, flags, aggregates).value(e), hidden

    # ---- SELECT
    def select(self, q: A.Query, graph: Graph = Graph()) -> Rel:
        rel = self.solutions(q, graph)
        names = [n for n, _ in q.items] if q.items is not None else [v for v in rel.vars if not v.startswith("_:") and not v.startswith("path ")]
        if graph.var is not None and graph.var in rel.vars and graph.var not in names:
            names.append(graph.var)
        return self.modify(q, rel, names, graph)

    def solutions(self, q: A.Query, graph: Graph) -> Rel:
        """Pattern, trailing VALUES, grouping, HAVING and SELECT expressions."""
        rel = self.group(q.where, graph)
        if q.values is not None:
            rel = join(rel, relation.local(self.spark, q.values.names, q.values.rows))
        aggs = _unique([a for e in [*(e for _, e in q.items or [] if e is not None), *q.having, *(e for e, _ in q.order_by)] for a in aggregates_in(e)])
        made: dict[tuple, Val] = {}
        if q.group_by is not None or aggs:
            rel, made = self.aggregate(rel, q, aggs, graph)
        for e in q.having:
            rel, flags, hidden = self.flags(rel, e, graph)
            rel = _drop(rel.where(Expressions(rel.env(), self.context, flags, made).truth(e)), hidden)
        for name, e in q.items or []:
            if e is not None:
                rel, value, hidden = self.value(rel, e, graph, made)
                rel = _drop(rel.extend(name, value), hidden)
        self._made = made
        return rel

    def modify(self, q: A.Query, rel: Rel, names: list[str], graph: Graph) -> Rel:
        keys = []
        made = getattr(self, "_made", {})
        for i, (e, ascending) in enumerate(q.order_by):
            rel, value, hidden = self.value(rel, e, graph, made)
            rel = Rel(rel.df.withColumn(f"_key{i}", value.col), rel.vars)
            keys.append((f"_key{i}", value.kind, value.prefix, ascending))
        rel = rel.project(names, tuple(k for k, *_ in keys))
        plain = [F.col(f"`{column_name(n)}`") for n in names]
        if q.distinct or q.reduced:
            if keys:
                # One row per solution, at its first place in the order.
                aggs = [(F.min if ascending else F.max)(F.col(k)).alias(k) for k, _, _, ascending in keys]
                rel = Rel(rel.df.groupBy(*plain).agg(*aggs) if plain else rel.df.limit(1), rel.vars)
            else:
                rel = rel.distinct()
        if keys:
            order = [c for k, kind, prefix, ascending in keys for c in V.order_keys(Val(kind, F.col(k), prefix), ascending)]
            rel = Rel(rel.df.orderBy(*order), rel.vars)
        if q.offset:
            rel = Rel(rel.df.offset(q.offset), rel.vars)
        if q.limit is not None:
            rel = Rel(rel.df.limit(q.limit), rel.vars)
        if keys:
            rel = Rel(rel.df.select(*plain or [F.lit(1).alias("_one")]), rel.vars)
        return rel

    # ---- grouping
    def aggregate(self, rel: Rel, q: A.Query, aggs: list[tuple], graph: Graph) -> tuple[Rel, dict]:
        keys: list[tuple[str, Val, bool]] = []
        if graph.var is not None and graph.var in rel.vars:
            keys.append((graph.var, rel.val(graph.var), True))
        for i, (name, e) in enumerate(q.group_by or []):
            rel, value, hidden = self.value(rel, e, graph)
            certain = e[0] == "var" and e[1] in rel.vars and rel.vars[e[1]].certain
            keys.append((name or f"_:group {i}", value, certain))
        everything = [F.col(f"`{column_name(v)}`") for v in rel.vars if not v.startswith("_:")]
        outs, made = [], {}
        df = rel.df
        for i, agg in enumerate(aggs):
            _, name, distinct, e, separator = agg
            if e is None:
                col = F.count_distinct(F.struct(*everything)) if distinct and everything else F.count(F.lit(1))
                value = Val("int", col)
            else:
                work = Rel(df, rel.vars)
                work, inner, _ = self.value(work, e, graph)
                if self.context.exact_integers and inner.kind == "int" and name == "SUM":
                    inner = Val("term", V.to_term(inner))
                df = work.df.withColumn(f"_arg{i}", inner.col)
                value = AGGREGATES[name](Val(inner.kind, F.col(f"_arg{i}"), inner.prefix), distinct, separator)
            outs.append(value.col.alias(f"_agg{i}"))
            made[freeze(agg)] = Val(value.kind, F.col(f"_agg{i}"), value.prefix)
        cols = [v.col.alias(column_name(n)) for n, v, _ in keys]
        rows = df.groupBy(*cols) if cols else df.groupBy()
        out = rows.agg(*outs) if outs else (df.select(*cols).distinct() if cols else unit(self.spark).df)
        return Rel(out, {n: Info(v.kind, v.prefix, c) for n, v, c in keys}), made


def with_rows(rel: Rel) -> Rel:
    """`rel`, written, with a column _row that tells its rows apart: fresh terms must not change on a retry."""
    return Rel(written(rel.df.withColumn("_row", F.uuid())), rel.vars)


# ---- aggregates: (argument, distinct, separator) -> value
def _count(v: Val, distinct: bool, _):
    return Val("int", F.count_distinct(v.col) if distinct else F.count(v.col))


def _sum(v: Val, distinct: bool, _):
    total = F.sum_distinct if distinct else F.sum
    if v.kind == "int":
        # Summed without overflow; a sum that a 64-bit integer cannot hold is unbound, as in arithmetic.
        whole = F.coalesce(total(v.col.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))
        return Val("int", whole.try_cast("bigint"))
    if v.kind == "dbl":
        return Val("dbl", F.coalesce(total(v.col), F.lit(0.0)))
    if v.kind == "dec":
        return Val("dec", F.coalesce(total(v.col), F.lit(0)).cast(V.DECIMAL_TYPE))
    t = V.to_term(v)
    number, exact = V.bind([t], V.number), V.bind([t], V.exact)
    wrong = F.coalesce(F.bool_or(t.isNotNull() & number.isNull()), F.lit(False))
    place = F.coalesce(F.max(F.when(t.isNotNull(), V.rank(t))), F.lit(0))
    if distinct:  # by term: the set of terms, then their values
        terms = F.collect_set(t)
        fast = F.aggregate(F.transform(terms, V.number), F.lit(0.0), lambda a, x: a + x)
        slow = F.aggregate(F.transform(terms, lambda x: V.exact(x)), F.lit(0).cast(V.DECIMAL_TYPE), lambda a, x: (a + x).cast(V.DECIMAL_TYPE))
    else:
        fast, slow = F.sum(number), F.coalesce(F.sum(exact), F.lit(0)).cast(V.DECIMAL_TYPE)
    whole = F.when(place == 0, R.literal(slow.cast("decimal(26,0)").cast("string"), R.INTEGER)).otherwise(R.literal(V.decimal_text(slow), R.DECIMAL))
    return Val("term", F.when(~wrong, F.when(place >= 2, V.from_number(fast, place)).otherwise(whole)))


def _avg(v: Val, distinct: bool, _):
    if v.kind == "dbl":
        mean = F.try_divide(F.sum_distinct(v.col), F.count_distinct(v.col)) if distinct else F.avg(v.col)
        return Val("dbl", F.coalesce(mean, F.lit(0.0)))
    if v.kind in ("int", "dec"):
        total = (F.sum_distinct if distinct else F.sum)(v.col.cast(V.DECIMAL_TYPE))
        n = F.count_distinct(v.col) if distinct else F.count(v.col)
        return Val("dec", F.when(n > 0, F.try_divide(total.cast(V.DECIMAL_TYPE), n.cast("decimal(20,0)"))).otherwise(F.lit(0)).cast(V.DECIMAL_TYPE))
    t = V.to_term(v)
    total = _sum(v, distinct, None).col
    n = (F.count_distinct(t) if distinct else F.count(t)).cast("bigint")
    def mean(total, n):
        return F.when(n == 0, R.term_lit(R.Lit("0", R.INTEGER))).otherwise(V.arithmetic("/", Val("term", total), Val("int", n)).col)

    return Val("term", V.bind([total, n], mean))


def _extreme(v: Val, largest: bool):
    if v.kind != "term":
        if v.kind in ("key", "iri", "bnode"):
            v = Val("iri" if v.kind != "bnode" else "bnode", V.text_of(v))
        return Val(v.kind, (F.max if largest else F.min)(v.col), v.prefix)
    t = v.col
    key = F.when(t.isNotNull(), V.bind([t], V.term_key))
    return Val("term", (F.max_by if largest else F.min_by)(t, key))


def _sample(v: Val, distinct: bool, _):
    return Val(v.kind, F.first(v.col, ignorenulls=True), v.prefix)


def _group_concat(v: Val, distinct: bool, separator: str | None):
    """Sorted, so that reruns agree; blank nodes are left out."""
    text = F.when(v.col["kind"] != R.BNODE, v.col["lex"]) if v.kind == "term" else F.lit(None).cast("string") if v.kind == "bnode" else V.text_of(v)
    return Val("str", F.array_join(F.sort_array((F.collect_set if distinct else F.collect_list)(text)), " " if separator is None else separator))


AGGREGATES = {"COUNT": _count, "SUM": _sum, "AVG": _avg, "MIN": lambda v, d, s: _extreme(v, False), "MAX": lambda v, d, s: _extreme(v, True), "SAMPLE": _sample, "GROUP_CONCAT": _group_concat}


# ---- helpers
def _conjuncts(e: tuple) -> list[tuple]:
    if e[0] == "op" and e[1] == "&&":
        return [x for part in e[2] for x in _conjuncts(part)]
    return [e]


def _exists_in(e) -> list[A.Group]:
    if not isinstance(e, tuple):
        return []
    if e[0] == "exists":
        return [e[1]]
    return [g for x in e[1:] for y in (x if isinstance(x, list) else [x]) for g in _exists_in(y)]


def _free(p) -> set[str]:
    """Variables that parts of a pattern read from outside themselves."""
    if isinstance(p, A.Group):
        return set().union(*(_free(x) for x in p.parts)) if p.parts else set()
    if isinstance(p, A.Filter):
        return expr_vars(p.expr)
    if isinstance(p, A.Bind):
        return expr_vars(p.expr)
    if isinstance(p, (A.Optional_, A.Minus, A.GraphPattern, A.Service)):
        return _free(p.group) - in_scope(p.group)
    if isinstance(p, A.Union):
        return set().union(*(_free(g) - in_scope(g) for g in p.groups))
    return set()


def _needs_row(e) -> bool:
    if not isinstance(e, tuple):
        return False
    if e[0] == "call" and e[1] == "BNODE":
        return True
    return any(_needs_row(y) for x in e[1:] for y in (x if isinstance(x, list) else [x]))


def _drop(rel: Rel, hidden: list[str]) -> Rel:
    return Rel(rel.df.drop(*hidden), rel.vars) if hidden else rel


def _unique(aggs: list[tuple]) -> list[tuple]:
    out = {}
    for a in aggs:
        out.setdefault(freeze(a), a)
    return list(out.values())
