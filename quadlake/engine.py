"""The engine: SPARQL text in, DataFrames, booleans, graphs or a new catalog out."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.functions import values as V
from quadlake.functions.expressions import Context
from quadlake.operators.relation import Rel, column_name, join, local
from quadlake.operators.scan import Dataset, Graph, ground, name_of, nothing
from quadlake.parser import ast as A
from quadlake.parser.sparql import parse_query
from quadlake.plans.compile import Compiler, with_rows
from quadlake.plans.joinorder import Estimator, baseline
from quadlake.sources.catalog import QUADS, Catalog

PARSED = 128


@dataclass
class Engine:
    """Queries and updates over a catalog.

    ``functions``: IRI to a function of term columns. ``services``: IRI to a Catalog for SERVICE.
    ``distinct_alternatives``: `p|q` gives each pair once. ``timeout`` (seconds) cancels the jobs of ``run``.
    ``exact_integers``: integers of more than 64 bits stay exact, as terms; without it they are unbound and all others native.
    ``estimator`` orders the joins of a basic graph pattern (see ``plans.joinorder``); None keeps the written order.
    """

    catalog: Catalog
    base: str = ""
    functions: dict[str, Callable] = field(default_factory=dict)
    services: dict[str, Catalog] = field(default_factory=dict)
    distinct_alternatives: bool = True
    timeout: float | None = None
    estimator: Estimator | None = baseline
    exact_integers: bool = False
    _parsed: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    def parse(self, text: str) -> A.Query:
        """Parsed queries are kept, the oldest go first."""
        if text not in self._parsed:
            if len(self._parsed) >= PARSED:
                self._parsed.pop(next(iter(self._parsed)))
            self._parsed[text] = parse_query(text, self.base)
        return self._parsed[text]

    def compiler(self, q: A.Query) -> Compiler:
        named = q.default_graphs or q.named_graphs
        data = Dataset(self.catalog, q.default_graphs if named else None, q.named_graphs if named else None, self.estimator)
        return Compiler(data, Context(q.base, functions=self.functions, exact_integers=self.exact_integers), self.distinct_alternatives, self.services)

    # ---- query forms
    def select(self, text: str, decode: str = "native") -> DataFrame:
        """Solutions. ``native``: typed columns, IRIs as text. ``term``: term structs."""
        q = self.parse(text)
        if q.form != "SELECT":
            raise ValueError(f"{q.form} is not a SELECT query")
        rel = self.compiler(q).select(q)
        return show(rel, self.columns(q, rel), decode)

    def columns(self, q: A.Query, rel: Rel) -> list[str]:
        return [n for n, _ in q.items] if q.items is not None else list(rel.vars)

    def ask(self, text: str) -> bool:
        return not self.ask_frame(text).where("result").isEmpty()

    def ask_frame(self, text: str) -> DataFrame:
        """One row: result."""
        q = self.parse(text)
        if q.form != "ASK":
            raise ValueError(f"{q.form} is not an ASK query")
        compiler = self.compiler(q)
        rel = compiler.solutions(q, Graph())
        rel = compiler.modify(q, rel, list(rel.vars), Graph())
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def construct(self, text: str) -> DataFrame:
        """Triples (s, p, o) of a CONSTRUCT query, each once."""
        q = self.parse(text)
        if q.form != "CONSTRUCT":
            raise ValueError(f"{q.form} is not a CONSTRUCT query")
        compiler = self.compiler(q)
        rel = compiler.solutions(q, Graph())
        rel = compiler.modify(q, rel, list(rel.vars), Graph())
        return instantiate(rel, [(None, t) for t in q.template]).select("s", "p", "o").distinct()

    def describe(self, text: str) -> DataFrame:
        """Outgoing triples of the resources, over all graphs, each once."""
        q = self.parse(text)
        if q.form != "DESCRIBE":
            raise ValueError(f"{q.form} is not a DESCRIBE query")
        compiler = self.compiler(q)
        found = []
        constants = [t for t in q.targets or [] if isinstance(t, R.IRI)]
        if constants:
            found.append(local(self.spark, ["x"], [[t] for t in constants]).df.select(R.iri(F.col("v_x")).alias("x")))
        if q.targets is None or any(isinstance(t, R.Var) for t in q.targets):
            rel = compiler.solutions(q, Graph())
            rel = compiler.modify(q, rel, list(rel.vars), Graph())
            names = [t.name for t in q.targets if isinstance(t, R.Var)] if q.targets is not None else [v for v in rel.vars if not v.startswith("_:")]
            for n in names:
                if n in rel.vars:
                    found.append(rel.df.select(V.to_term(rel.val(n)).alias("x")))
        if not found:
            return self.catalog.all_quads().select("s", "p", "o").where(F.lit(False))
        resources = found[0]
        for f in found[1:]:
            resources = resources.unionByName(f)
        resources = resources.where(F.col("x.kind").isin(R.IRI_KIND, R.BNODE)).distinct()
        only = None if len(found) > 1 or not constants else [t.value for t in constants]
        return self.catalog.outgoing(resources, only).select("s", "p", "o").distinct()

    def query(self, text: str):
        """A DataFrame for SELECT (term columns), a bool for ASK, triples for CONSTRUCT and DESCRIBE."""
        form = self.parse(text).form
        return {"SELECT": lambda t: self.select(t, "term"), "ASK": self.ask, "CONSTRUCT": self.construct, "DESCRIBE": self.describe}[form](text)

    def run(self, action: Callable):
        """Run an action under the engine's timeout: its jobs are cancelled when time is up."""
        if self.timeout is None:
            return action()
        context, tag = self.spark.sparkContext, f"quadlake-{id(action)}"
        context.addJobTag(tag)
        timer = threading.Timer(self.timeout, lambda: context.cancelJobsWithTag(tag))
        timer.start()
        try:
            return action()
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def update(self, text: str) -> Engine:
        """An engine over the updated catalog; this one is unchanged."""
        from quadlake.update import apply

        return Engine(apply(self, text), self.base, self.functions, self.services, self.distinct_alternatives, self.timeout, self.estimator, self.exact_integers)


def show(rel: Rel, names: list[str], decode: str) -> DataFrame:
    cols = []
    for n in names:
        v = rel.val(n) if n in rel.vars else V.null()
        if decode == "term":
            cols.append(V.to_term(v).alias(n))
        else:
            cols.append((v.col if v.kind in ("int", "dbl", "dec", "bool", "ts", "date", "str") else V.text_of(v)).alias(n))
    return rel.df.select(*cols)


def instantiate(rel: Rel, template: list[tuple]) -> DataFrame:
    """(s, p, o, g) of a template over solutions; fresh blank nodes a solution; incomplete triples are left out."""
    if any(_has_bnode(x) for _, t in template for x in t):
        rel = with_rows(rel)

    def term(x):
        if isinstance(x, R.Var):
            return V.to_term(rel.val(x.name)) if x.name in rel.vars else F.lit(None).cast(R.TERM)
        if isinstance(x, R.BNode):
            return R.bnode(F.concat(F.lit("c"), F.md5(F.concat_ws(" ", F.lit(x.label), F.col("_row")))))
        if isinstance(x, R.TripleTerm) and not ground(x):
            key = F.concat(F.lit("<<( "), R.nt_column(term(x.s)), F.lit(" "), R.nt_column(term(x.p)), F.lit(" "), R.nt_column(term(x.o)), F.lit(" )>>"))
            e = F.lit("")
            return F.when(key.isNotNull(), R.make(F.lit(R.TRIPLE), key, e, e, e))
        return R.term_lit(x)

    if not template:
        return rel.df.sparkSession.createDataFrame([], QUADS)
    cells = []
    for graph, (s, p, o) in template:
        g = F.lit(None).cast("string") if graph is None else F.lit(graph.value) if isinstance(graph, R.IRI) else F.when(term(graph)["kind"] == R.IRI_KIND, term(graph)["lex"])
        cells.append(F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o"), g.alias("g"), F.lit(graph is not None).alias("named")))
    rows = rel.df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    fits = F.col("s.kind").isin(R.IRI_KIND, R.BNODE) & (F.col("p.kind") == R.IRI_KIND) & F.col("o").isNotNull() & (~F.col("named") | F.col("g").isNotNull())
    return rows.where(fits).select("s", F.col("p.lex").alias("p"), "o", "g")


def _has_bnode(x) -> bool:
    if isinstance(x, R.TripleTerm):
        return _has_bnode(x.s) or _has_bnode(x.p) or _has_bnode(x.o)
    return isinstance(x, R.BNode)


__all__ = ["Engine", "column_name", "instantiate", "join", "name_of", "nothing", "show"]
