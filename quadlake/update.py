"""SPARQL Update: a fold of operations over immutable catalogs. Nothing changes until the result is used or committed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.functions.expressions import Context
from quadlake.operators.relation import local
from quadlake.operators.scan import Dataset, Graph
from quadlake.parser.sparql import parse_update
from quadlake.plans.compile import Compiler
from quadlake.scratch import written
from quadlake.sources.catalog import QUADS, Catalog


def apply(engine, text: str) -> Catalog:
    """The catalog after all operations; an error leaves the engine's catalog as it was."""
    catalog = engine.catalog
    for op in parse_update(text, engine.base):
        try:
            catalog = _operation(engine, catalog, op)
        except Exception:
            if not op.silent:
                raise
    return catalog


def _operation(engine, catalog: Catalog, op) -> Catalog:
    kind = op.kind
    if kind == "INSERT DATA":
        return catalog.add(_data(catalog, op.insert, fresh=True))
    if kind == "DELETE DATA":
        _refuse_mapped(catalog, op.delete)
        return catalog.remove(_data(catalog, op.delete, fresh=False))
    if kind == "MODIFY":
        return _modify(engine, catalog, op)
    if kind in ("CLEAR", "DROP"):
        _refuse_graph(catalog, op.target)
        return catalog.with_quads(_stored(catalog).where(~_selected(op.target)))
    if kind == "CREATE":
        return catalog
    if kind in ("ADD", "COPY", "MOVE"):
        return _transfer(catalog, op)
    if kind == "LOAD":
        from quadlake.sources.rdf import load

        quads = load(catalog.spark, op.source)
        if op.target is not None:
            if not quads.where(F.col("g").isNotNull()).isEmpty():
                raise ValueError("a document with named graphs cannot be loaded into one graph")
            quads = quads.withColumn("g", F.lit(op.target))
        return catalog.add(quads)
    raise ValueError(f"unknown operation {kind}")


def _stored(catalog: Catalog) -> DataFrame:
    return catalog.quads if catalog.quads is not None else catalog.spark.createDataFrame([], QUADS)


def _data(catalog: Catalog, quads: list, fresh: bool) -> DataFrame:
    scope = uuid.uuid4().hex[:8]

    def term(x):
        if isinstance(x, R.BNode):
            return R.BNode(f"{x.label.lstrip('.')}x{scope}") if fresh else x
        return R.TripleTerm(term(x.s), term(x.p), term(x.o)) if isinstance(x, R.TripleTerm) else x

    return Catalog.of(catalog.spark, [(term(s), p, term(o), g) for g, (s, p, o) in quads]).quads


def _selected(target):
    g = F.col("g")
    if target == "DEFAULT":
        return g.isNull()
    if target == "NAMED":
        return g.isNotNull()
    if target == "ALL":
        return F.lit(True)
    return F.coalesce(g == target.value, F.lit(False))


def _mapped_graphs(catalog: Catalog, target) -> list:
    """Mapped tables in the graphs of a target."""
    inside = {"DEFAULT": lambda g: g is None, "NAMED": lambda g: g is not None, "ALL": lambda g: True}.get(target if isinstance(target, str) else "", lambda g: not isinstance(target, str) and g == target.value)
    return [m for m in catalog.maps if inside(m.graph)]


def _refuse_graph(catalog: Catalog, target) -> None:
    """Mapped tables are read-only: an update that would have to remove their triples is an error."""
    held = _mapped_graphs(catalog, target)
    if held:
        raise ValueError(f"the graph holds the mapped table {held[0].name}, which is read-only")


def _refuse_mapped(catalog: Catalog, quads: list) -> None:
    """The same for single triples: a predicate that a mapped table of the graph has, or any predicate."""
    for g, (_, p, _) in quads:
        for m in catalog.maps:
            same = m.graph is None if g is None else not isinstance(g, R.IRI) or m.graph == g.value
            if same and (not isinstance(p, R.IRI) or p.value in m.columns or (p.value == R.RDF_TYPE and m.class_iri)):
                raise ValueError(f"triples of the mapped table {m.name} cannot be deleted: it is read-only")


def _transfer(catalog: Catalog, op) -> Catalog:
    if op.source == op.target:
        return catalog
    if op.kind != "ADD":
        _refuse_graph(catalog, op.target)
    if op.kind == "MOVE":
        _refuse_graph(catalog, op.source)
    quads = _stored(catalog)
    name = F.lit(None if op.target == "DEFAULT" else op.target.value).cast("string")
    moved = quads.where(_selected(op.source)).withColumn("g", name)
    kept = quads
    if op.kind != "ADD":
        kept = kept.where(~_selected(op.target))
    if op.kind == "MOVE":
        kept = kept.where(~_selected(op.source))
    return catalog.with_quads(kept).add(moved)


def _modify(engine, catalog: Catalog, op) -> Catalog:
    """WHERE once, then all deletes, then all inserts."""
    from quadlake.engine import instantiate

    if op.using or op.using_named:
        data, graph = Dataset(catalog, op.using, op.using_named), Graph()
    else:
        data, graph = Dataset(catalog), Graph(name=op.with_)
    compiler = Compiler(data, Context(op.base, functions=engine.functions, exact_integers=engine.exact_integers), engine.distinct_alternatives, engine.services)
    rel = compiler.group(op.where, graph)
    rel.df = written(rel.df)
    default = R.IRI(op.with_) if op.with_ else None
    if op.delete:
        _refuse_mapped(catalog, [(g or default, t) for g, t in op.delete])
        gone = instantiate(rel, [(g or default, t) for g, t in op.delete]).distinct()
        catalog = catalog.remove(gone)
    if op.insert:
        catalog = catalog.add(instantiate(rel, [(g or default, t) for g, t in op.insert]))
    return catalog


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


def _versions(spark, path: str) -> list[str]:
    """Names of the committed versions, oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []


def commit(catalog: Catalog, path: str, expected: int | None = None) -> int:
    """Write the stored quads as a new snapshot under `path`, partitioned by predicate, and add a version that names it.

    The version appears by one rename to a name that must be free: readers and crashes find the old version or the new
    one. With `expected`, it must follow that version, else Conflict is raised.
    """
    spark = catalog.spark
    name = f"snapshot-{uuid.uuid4().hex}"
    _stored(catalog).withColumn("predicate", F.col("p")).write.partitionBy("predicate").parquet(f"{path}/{name}")
    held = _versions(spark, path)
    version = (int(held[-1]) if held else 0) + 1
    if expected is not None and version != expected + 1:
        raise Conflict(f"version {version - 1} has followed version {expected} of {path}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version:012d}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(fresh, at):
        fs.delete(fresh, False)
        raise Conflict(f"version {version} of {path} has been committed by another writer")
    return version


def snapshot(spark, path: str, version: int | None = None) -> Catalog:
    """The catalog that was committed last, or an earlier one; patterns with a constant predicate read its partition only."""
    held = _versions(spark, path)
    if not held:
        raise FileNotFoundError(f"nothing has been committed to {path}")
    name = spark.read.text(f"{path}/versions/{held[-1] if version is None else f'{version:012d}'}").first()[0]
    df = spark.read.parquet(f"{path}/{name}")
    return Catalog(spark, df.drop("p").withColumnRenamed("predicate", "p").select("s", "p", "o", "g"))


class Transaction:
    """Updates that are committed together, or not at all: ``with Transaction(spark, path) as t: t.update(...)``.

    An exception rolls back. A commit that another writer has overtaken raises Conflict and changes nothing.
    """

    def __init__(self, spark, path: str, **options):
        self.spark, self.path, self.options = spark, path, options
        self.engine, self.version = None, 0

    def __enter__(self) -> Transaction:
        from quadlake.engine import Engine

        held = _versions(self.spark, self.path)
        self.version = int(held[-1]) if held else 0
        self.engine = Engine(snapshot(self.spark, self.path) if held else Catalog(self.spark), **self.options)
        return self

    def update(self, text: str) -> None:
        self.engine = self.engine.update(text)

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.version = commit(self.engine.catalog, self.path, self.version)


__all__ = ["Conflict", "Transaction", "apply", "commit", "local", "snapshot"]
