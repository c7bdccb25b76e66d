"""Datasets: stored quads, and relational tables mapped to virtual triples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake import terms as R

QUADS = T.StructType([T.StructField("s", R.TERM), T.StructField("p", T.StringType()), T.StructField("o", R.TERM), T.StructField("g", T.StringType())])


@dataclass(frozen=True)
class Key:
    """An IRI or blank node made of a prefix and key columns (joined by '/'): prefix + value."""

    prefix: str
    columns: tuple[str, ...]
    blank: bool = False


@dataclass
class TableMap:
    """A table as triples: one subject a row, one predicate a column.

    ``columns``: predicate IRI to a column name (a literal of the column's type) or a Key (a reference).
    NULL gives no triple. ``subject`` must be unique in the table; a table without a key takes a blank node
    whose label hashes the whole row.
    """

    name: str
    df: DataFrame
    subject: Key
    columns: dict[str, str | Key]
    class_iri: str | None = None
    graph: str | None = None

    def rows(self) -> float:
        """Estimated rows: the plan's size in bytes over a width of eight bytes a column. No job runs."""
        return max(1.0, plan_bytes(self.df) / (8.0 * max(1, len(self.df.columns))))


#: Assumed triples where nothing is known, in all and of one predicate.
ALL_TRIPLES, PREDICATE_TRIPLES = 1e6, 1e5
#: Assumed size of a stream.
STREAM_BYTES = 1e15


@dataclass
class Catalog:
    """An immutable dataset. ``quads``: (s, p, o, g), g null for the default graph; maps add virtual graphs.

    ``predicates``: triples by predicate, where ``analyze`` has counted them. ``statistics``: a hook
    (subject, [(predicate, object)], table or None) -> PatternStats or None. Both only order joins.
    """

    spark: SparkSession
    quads: DataFrame | None = None
    maps: list[TableMap] = field(default_factory=list)
    predicates: dict[str, int] | None = None
    statistics: Callable | None = None

    @staticmethod
    def of(spark: SparkSession, quads: list[tuple]) -> Catalog:
        """From driver-side quads (s, p, o, graph or None). For small graphs."""
        rows = sorted({(R.parts(s), p.value, R.parts(o), _graph_name(g)) for s, p, o, g in quads}, key=repr)
        return Catalog(spark, spark.createDataFrame(rows, QUADS))

    def with_quads(self, quads: DataFrame | None) -> Catalog:
        return replace(self, quads=quads, predicates=None)

    def analyze(self) -> Catalog:
        """This catalog with its stored triples counted by predicate; one row a predicate comes to the driver."""
        found = {} if self.quads is None else {r["p"]: r["count"] for r in self.quads.groupBy("p").count().collect()}
        return replace(self, predicates=found)

    def triples(self, predicate: str | None) -> float:
        """Estimated triples of a predicate, or in all."""
        if self.predicates is None:
            return ALL_TRIPLES if predicate is None else PREDICATE_TRIPLES
        return float(sum(self.predicates.values()) if predicate is None else self.predicates.get(predicate, 1))

    def map_tables(self, maps: list[TableMap]) -> Catalog:
        return replace(self, maps=[*self.maps, *maps])

    def triples_of(self, table: TableMap, rows=None) -> DataFrame:
        """All triples of a mapped table, in quad form; of the rows that a condition selects, if there is one."""
        df = table.df if rows is None else table.df.where(rows)
        subject = key_term(df, table.subject)
        cells = [F.struct(F.lit(p).alias("p"), (key_term(df, c) if isinstance(c, Key) else native_term(F.col(f"`{c}`"), df.schema[c].dataType)).alias("o")) for p, c in table.columns.items() if isinstance(c, Key) or literal_kind(df.schema[c].dataType)]
        if table.class_iri:
            cells.append(F.struct(F.lit(R.RDF_TYPE).alias("p"), R.term_lit(R.IRI(table.class_iri)).alias("o")))
        graph = F.lit(table.graph).cast("string")
        return df.select(subject.alias("s"), F.explode(F.array(*cells)).alias("c")).select("s", "c.p", "c.o", graph.alias("g")).where("o is not null")

    def all_quads(self) -> DataFrame:
        """Stored and virtual quads."""
        out = self.quads if self.quads is not None else self.spark.createDataFrame([], QUADS)
        for table in self.maps:
            out = out.unionByName(self.triples_of(table))
        return out

    def outgoing(self, resources: DataFrame, only: list[str] | None = None) -> DataFrame:
        """Quads whose subject is among `resources` (x: distinct terms). Rows of mapped tables are selected by key before
        they become triples; `only` names all resources where they are constants, so that scans can be filtered."""
        out = self.spark.createDataFrame([], QUADS) if self.quads is None else self.quads.join(resources, F.col("s") == F.col("x"), "left_semi")
        for table in self.maps:
            key = table.subject
            if only is not None:
                mine = [iri for iri in only if not key.blank and iri.startswith(key.prefix)]
                if not mine:
                    continue
                rows = key_equals(table.df, key, mine[0])
                for iri in mine[1:]:
                    rows = rows | key_equals(table.df, key, iri)
                out = out.unionByName(self.triples_of(table, rows))
                continue
            kind = R.BNODE if key.blank else R.IRI_KIND
            wanted = resources.where((F.col("x.kind") == kind) & F.col("x.lex").startswith(key.prefix)).select(F.col("x.lex").substr(F.lit(len(key.prefix) + 1), F.length("x.lex")).alias("_wanted"))
            held = table.df.join(wanted, key_text(table.df, key) == F.col("_wanted"), "left_semi")
            out = out.unionByName(self.triples_of(replace(table, df=held)))
        return out

    # The store's interface: match, count, add, remove.
    def match(self, s=None, p=None, o=None, g=...) -> DataFrame:
        out = self.all_quads()
        if s is not None:
            out = out.where(F.col("s") == R.term_lit(s))
        if p is not None:
            out = out.where(F.col("p") == p.value)
        if o is not None:
            out = out.where(F.col("o") == R.term_lit(o))
        if g is not ...:
            out = out.where(F.col("g").isNull() if g is None else F.col("g") == g.value)
        return out

    def count(self, s=None, p=None, o=None, g=...) -> int:
        return self.match(s, p, o, g).count()

    def add(self, quads: DataFrame) -> Catalog:
        """Set insert."""
        held = self.quads.unionByName(quads) if self.quads is not None else quads
        return self.with_quads(held.dropDuplicates(["s", "p", "o", "g"]))

    def remove(self, quads: DataFrame) -> Catalog:
        """Set delete; quads that are not there are ignored."""
        if self.quads is None:
            return self
        gone = quads.select(*(F.col(c).alias(f"x{c}") for c in "spog"))
        on = (F.col("s") == F.col("xs")) & (F.col("p") == F.col("xp")) & (F.col("o") == F.col("xo")) & F.col("g").eqNullSafe(F.col("xg"))
        return self.with_quads(self.quads.join(gone, on, "left_anti"))

    def remove_matches(self, s=None, p=None, o=None, g=...) -> Catalog:
        return self.remove(self.with_quads(self.quads).match(s, p, o, g)) if self.quads is not None else self

    def named_graphs(self) -> DataFrame:
        out = self.quads.select("g").where("g is not null").distinct() if self.quads is not None else self.spark.createDataFrame([], "g string")
        names = {m.graph for m in self.maps if m.graph}
        for name in sorted(names):
            out = out.unionByName(self.spark.range(1).select(F.lit(name).alias("g")))
        return out.distinct() if names else out


def _graph_name(g) -> str | None:
    if g is None:
        return None
    return g.value if isinstance(g, R.IRI) else "_:" + g.label


def plan_bytes(df: DataFrame) -> float:
    """The optimizer's estimate of a DataFrame's size, asked once."""
    held = getattr(df, "_plan_bytes", None)
    if held is None and df.isStreaming:
        held = df._plan_bytes = STREAM_BYTES
    if held is None:
        held = df._plan_bytes = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return held


def key_equals(df: DataFrame, key: Key, iri: str):
    """Rows whose key is an IRI, compared on the native columns, so that the filter reaches the scan."""
    if not iri.startswith(key.prefix):
        return F.lit(False)
    texts = iri[len(key.prefix) :].split("/", len(key.columns) - 1) if len(key.columns) > 1 else [iri[len(key.prefix) :]]
    if len(texts) != len(key.columns):
        return F.lit(False)
    out = F.lit(True)
    for name, text in zip(key.columns, texts, strict=True):
        col, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(kind)]
            exact = text.lstrip("-").isdigit() and str(int(text)) == text and -(1 << bits) <= int(text) < 1 << bits
            out = out & (col == F.lit(int(text)).cast(kind)) if exact else F.lit(False)
        elif len(key.columns) > 1 and isinstance(kind, T.StringType):
            # A text key may hold the separator: the whole key decides.
            return key_text(df, key) == iri[len(key.prefix) :]
        else:
            out = out & (col == text if isinstance(kind, T.StringType) else col.cast("string") == text)
    return out


def key_text(df: DataFrame, key: Key):
    """The key's value as it follows the prefix; null if a column is."""
    return F.concat_ws("/", *[F.col(f"`{c}`").cast("string") for c in key.columns]) if len(key.columns) > 1 else F.col(f"`{key.columns[0]}`").cast("string")


def key_term(df: DataFrame, key: Key):
    text = F.concat(F.lit(key.prefix), key_text(df, key))
    return R.bnode(text) if key.blank else R.iri(text)


def literal_kind(dt: T.DataType) -> str | None:
    """The native kind of a column type; None if no RDF datatype fits."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "dbl"
    if isinstance(dt, T.DecimalType):
        return "dec"
    if isinstance(dt, T.StringType):
        return "str"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return "ts"
    if isinstance(dt, T.DateType):
        return "date"
    return None


def native_term(col, dt: T.DataType):
    from quadlake.functions.values import Val, to_term

    return to_term(Val(literal_kind(dt), col))


def row_key(df: DataFrame) -> DataFrame:
    """`df` with a column _row that tells whole rows apart: the subject of a table without a key."""
    return df.withColumn("_row", F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
