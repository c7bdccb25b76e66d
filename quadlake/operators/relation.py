"""Solution sequences: a DataFrame with one column a variable, and what is known of each variable.

Unbound is NULL. A variable is *certain* if it is bound in every row. SPARQL joins are natural joins
in which an unbound variable fits anything, so certain variables give equi-joins and the others residuals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.functions import values as V
from quadlake.functions.values import Val


@dataclass(frozen=True)
class Info:
    kind: str
    prefix: str = ""
    certain: bool = True


def column_name(var: str) -> str:
    """Spark compares names without case; SPARQL does not. Capitals are marked."""
    return "v_" + "".join("^" + c.lower() if c.isupper() else c for c in var)


def quote(name: str) -> str:
    return f"`{name}`"


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, Info]

    def val(self, var: str, prefix: str = "") -> Val:
        info = self.vars[var]
        return Val(info.kind, F.col(quote(prefix + column_name(var))), info.prefix)

    def env(self) -> dict[str, Val]:
        out = {v: self.val(v) for v in self.vars}
        if "_row" in self.df.columns:
            out["_row"] = Val("str", F.col("_row"))
        return out

    def select(self, cols: dict[str, tuple[Val, bool]], keep: tuple[str, ...] = ()) -> Rel:
        """Only the given variables: {name: (value, certain)}."""
        shown = [v.col.alias(column_name(n)) for n, (v, _) in cols.items()]
        extra = [F.col(quote(c)) for c in keep]
        if not shown and not extra:
            shown = [F.lit(1).alias("_one")]
        return Rel(self.df.select(*shown, *extra), {n: Info(v.kind, v.prefix, c) for n, (v, c) in cols.items()})

    def project(self, names: list[str], keep: tuple[str, ...] = ()) -> Rel:
        cols = {n: ((self.val(n), self.vars[n].certain) if n in self.vars else (V.null(), False)) for n in names}
        return self.select(cols, keep)

    def extend(self, name: str, value: Val, certain: bool = False) -> Rel:
        return Rel(self.df.withColumn(column_name(name), value.col), {**self.vars, name: Info(value.kind, value.prefix, certain)})

    def where(self, cond: Column) -> Rel:
        return Rel(self.df.where(cond), self.vars)

    def distinct(self) -> Rel:
        return Rel(self.df.distinct(), self.vars)


def unit(spark: SparkSession) -> Rel:
    """One solution that binds nothing."""
    return Rel(spark.range(1).select(F.lit(1).alias("_one")), {})


def is_unit(rel: Rel) -> bool:
    return not rel.vars and rel.df.columns == ["_one"]


def _renamed(r: Rel) -> DataFrame:
    """Right side under other names, so that both sides' columns can be told apart."""
    return r.df.select(*[F.col(quote(column_name(v))).alias("r_" + column_name(v)) for v in r.vars] or [F.lit(1).alias("r_one")])


def _right(r: Rel, v: str) -> Val:
    return r.val(v, "r_")


def _merge(l: Rel, r: Rel, outer: bool) -> dict[str, tuple[Val, bool]]:
    """Values after a join; in an outer join the right side may be missing."""
    cols: dict[str, tuple[Val, bool]] = {}
    for v in (*l.vars, *(x for x in r.vars if x not in l.vars)):
        left, right = l.vars.get(v), r.vars.get(v)
        if right is None:
            cols[v] = (l.val(v), left.certain)
        elif left is None:
            cols[v] = (_right(r, v), right.certain and not outer)
        elif left.certain:
            a, b = l.val(v), _right(r, v)
            cols[v] = (b if a.kind == "term" and b.kind != "term" and right.certain and not outer else a, True)
        else:
            a, b = l.val(v), _right(r, v)
            kind, prefix = V.common([a, b])
            cols[v] = (Val(kind, F.coalesce(V.lift(a, kind), V.lift(b, kind)), prefix), right.certain and not outer)
    return cols


def _condition(l: Rel, r: Rel, loose: list[str] | None = None) -> tuple[list[Column], list[Column]]:
    """(equalities of certain variables, compatibility of the others)."""
    exact, residual = [], []
    for v in l.vars:
        if v not in r.vars:
            continue
        a, b = l.val(v), _right(r, v)
        same = V.same_term(a, b)
        if l.vars[v].certain and r.vars[v].certain:
            exact.append(same)
        else:
            residual.append(a.col.isNull() | b.col.isNull() | F.coalesce(same, F.lit(False)))
            if loose is not None:
                loose.append(v)
    return exact, residual


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def join(l: Rel, r: Rel) -> Rel:
    """Natural join under compatibility."""
    if is_unit(l):
        return r
    if is_unit(r):
        return l
    loose: list[str] = []
    exact, residual = _condition(l, r, loose)
    right = _renamed(r)
    merged = _merge(l, r, False)
    if exact or not residual:
        df = l.df.join(right, _all([*exact, *residual]), "inner") if exact else l.df.crossJoin(right)
        return Rel(df, l.vars).select(merged)
    # No variable is certain on both sides: cases instead of one cross product with a disjunction.
    out = None
    for arm in _pairs(l, r, loose, residual, []):
        part = Rel(arm, l.vars).select(merged)
        out = part if out is None else Rel(out.df.unionByName(part.df), out.vars)
    return out


def _cases(l: Rel, r: Rel, var: str):
    """(left with, left without, right with, right without) a value of `var`; None for the rest of a side that always has one."""
    a, b, right = l.val(var).col, _right(r, var).col, _renamed(r)
    left = (l.df, None) if l.vars[var].certain else (l.df.where(a.isNotNull()), l.df.where(a.isNull()))
    return *left, *((right, None) if r.vars[var].certain else (right.where(b.isNotNull()), right.where(b.isNull())))


def _without_match(l: Rel, r: Rel, loose: list[str], residual: list[Column], extra: list[Column]) -> DataFrame:
    """Rows of `l` that no row of `r` fits, where no shared variable is certain on both sides: anti-joins by case instead of one with a disjunction."""
    with_, without, held, open_ = _cases(l, r, loose[0])
    rest = _all([*residual[1:], *extra])
    out = with_.join(held, V.same_term(l.val(loose[0]), _right(r, loose[0])) & rest, "left_anti")
    if open_ is not None:
        out = out.join(open_, rest, "left_anti")
    if without is not None:
        out = out.unionByName(without.join(_renamed(r), rest, "left_anti"))
    return out


def _with_match(l: Rel, r: Rel, loose: list[str], residual: list[Column], extra: list[Column]) -> DataFrame:
    """Rows of `l` that some row of `r` fits, each once; by case like ``_without_match``."""
    with_, without, held, open_ = _cases(l, r, loose[0])
    rest = _all([*residual[1:], *extra])
    equal = V.same_term(l.val(loose[0]), _right(r, loose[0])) & rest
    out = with_.join(held, equal, "left_semi")
    if open_ is not None:
        out = out.unionByName(with_.join(held, equal, "left_anti").join(open_, rest, "left_semi"))
    if without is not None:
        out = out.unionByName(without.join(_renamed(r), rest, "left_semi"))
    return out


def _pairs(l: Rel, r: Rel, loose: list[str], residual: list[Column], extra: list[Column]) -> list[DataFrame]:
    """Compatible pairs, by case."""
    with_, without, held, open_ = _cases(l, r, loose[0])
    rest = _all([*residual[1:], *extra])
    arms = [with_.join(held, V.same_term(l.val(loose[0]), _right(r, loose[0])) & rest)]
    if open_ is not None:
        arms.append(with_.crossJoin(open_).where(rest))
    if without is not None:
        arms.append(without.crossJoin(_renamed(r)).where(rest))
    return arms


def left_join(l: Rel, r: Rel, condition=None) -> Rel:
    """OPTIONAL: `condition(env)` sees the merged row and is part of the join."""
    loose: list[str] = []
    exact, residual = _condition(l, r, loose)
    merged = _merge(l, r, False)
    extra = []
    if condition is not None:
        extra.append(F.coalesce(condition({n: v for n, (v, _) in merged.items()}), F.lit(False)))
    shown = _merge(l, r, True)
    if exact or not loose:
        return Rel(l.df.join(_renamed(r), _all([*exact, *residual, *extra]), "left"), l.vars).select(shown)
    out = None
    for arm in _pairs(l, r, loose, residual, extra):
        part = Rel(arm, l.vars).select(shown)
        out = part if out is None else Rel(out.df.unionByName(part.df), out.vars)
    alone = _without_match(l, r, loose, residual, extra)
    right = _renamed(r)
    alone = alone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    return Rel(out.df.unionByName(Rel(alone, l.vars).select(shown).df), out.vars)


def minus(l: Rel, r: Rel) -> Rel:
    """Drop solutions compatible with one on the right that shares a bound variable."""
    shared = [v for v in l.vars if v in r.vars]
    if not shared:
        return l
    exact, residual = _condition(l, r)
    if exact:
        return Rel(l.df.join(_renamed(r), _all([*exact, *residual]), "left_anti"), l.vars)
    out = l.df  # a shared bound variable has equal values: one anti-join on each
    for v in shared:
        out = out.join(_renamed(r), V.same_term(l.val(v), _right(r, v)) & _all(residual), "left_anti")
    return Rel(out, l.vars)


def semi_join(l: Rel, r: Rel, extra=None, anti: bool = False) -> Rel:
    """EXISTS and NOT EXISTS; `extra(env)` may read variables of both sides."""
    loose: list[str] = []
    exact, residual = _condition(l, r, loose)
    more = []
    if extra is not None:
        env = {n: v for n, (v, _) in _merge(l, r, False).items()}
        more.append(F.coalesce(extra(env), F.lit(False)))
    if not exact and loose:
        return Rel((_without_match if anti else _with_match)(l, r, loose, residual, more), l.vars)
    return Rel(l.df.join(_renamed(r), _all([*exact, *residual, *more]), "left_anti" if anti else "left_semi"), l.vars)


def union(rels: list[Rel]) -> Rel:
    """Bag union; a variable that a branch lacks is unbound there."""
    names = list(dict.fromkeys(v for r in rels for v in r.vars))
    if not names:
        df = rels[0].df
        for r in rels[1:]:
            df = df.unionByName(r.df)
        return Rel(df, {})
    kinds = {n: V.common([r.val(n) for r in rels if n in r.vars]) for n in names}
    out = None
    for r in rels:
        cols = []
        for n in names:
            kind = kinds[n][0]
            cols.append((V.lift(r.val(n), kind) if n in r.vars else F.lit(None)).alias(column_name(n)))
        part = r.df.select(*cols)
        if out is None:
            out = part
        else:
            out = out.unionByName(part)
    infos = {n: Info(*kinds[n], all(n in r.vars and r.vars[n].certain for r in rels)) for n in names}
    return Rel(out, infos)


def local(spark: SparkSession, names: list[str], rows: list[list]) -> Rel:
    """VALUES: driver-side rows of terms, None for UNDEF."""
    from pyspark.sql import types as T

    natives = [_native_kind([row[i] for row in rows]) for i in range(len(names))]
    types = {"int": T.LongType(), "str": T.StringType(), "iri": T.StringType(), "term": R.TERM}
    schema = T.StructType([T.StructField(column_name(n), types[k]) for n, k in zip(names, natives, strict=True)])
    data = [tuple(None if x is None else _plain(x, k) for x, k in zip(row, natives, strict=True)) for row in rows]
    if not names:
        return Rel(spark.range(len(rows)).select(F.lit(1).alias("_one")), {})
    df = spark.createDataFrame(data, schema)
    return Rel(df, {n: Info(k, "", all(row[i] is not None for row in rows)) for i, (n, k) in enumerate(zip(names, natives, strict=True))})


def _native_kind(terms: list) -> str:
    given = [t for t in terms if t is not None]
    if given and all(isinstance(t, R.IRI) for t in given):
        return "iri"
    if given and all(isinstance(t, R.Lit) and t.dt == R.STRING for t in given):
        return "str"
    if given and all(isinstance(t, R.Lit) and t.dt == R.INTEGER and t.lex.lstrip("-").isdigit() and str(int(t.lex)) == t.lex and abs(int(t.lex)) < 2**63 for t in given):
        return "int"
    return "term"


def _plain(term, kind: str):
    if kind == "iri":
        return term.value
    if kind == "str":
        return term.lex
    return int(term.lex) if kind == "int" else R.parts(term)
