"""The star-schema tables as a virtual graph: no copy, native columns, references as IRIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadlake.sources.catalog import Catalog, Key, TableMap, row_key

NS = "urn:t:"
GEO, LOG = "urn:g:geo", "urn:g:log"
#: table: (key columns, {predicate: (foreign table, column)}, graph copies)
LAYOUT = {
    "region": (("r_regionkey",), {}, (GEO,)),
    "nation": (("n_nationkey",), {"n_region": ("region", "n_regionkey")}, (GEO,)),
    "customer": (("c_custkey",), {"c_nation": ("nation", "c_nationkey")}, ()),
    "supplier": (("s_suppkey",), {"s_nation": ("nation", "s_nationkey")}, ()),
    "part": (("p_partkey",), {}, ()),
    "orders": (("o_orderkey",), {"o_cust": ("customer", "o_custkey")}, ()),
    "lineitem": (None, {"l_order": ("orders", "l_orderkey"), "l_part": ("part", "l_partkey"), "l_supp": ("supplier", "l_suppkey")}, ()),
    "events": (("event_id",), {}, (LOG,)),
    "documents": (("doc_id",), {}, ()),
    "labels": (("doc_id",), {}, ()),
    "pages": (("page_id",), {}, ()),
    "benchmark": (("item_id",), {}, ()),
    "conversations": (("conv_id", "turn"), {}, ()),
    "embeddings": (("vec_id",), {}, ()),
}


#: Tables already opened, by session and path: opening one reads file footers.
_OPEN: dict[tuple[int, str, bool], DataFrame] = {}


def open_table(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """The table at a path, `keyed` with a column that tells rows apart. A session opens a path once; tables that change need a new session or ``forget``."""
    key = (id(spark), path, keyed)
    held = _OPEN.get(key)
    if held is None or held.sparkSession is not spark:
        held = _OPEN[key] = row_key(open_table(spark, path)) if keyed else spark.read.parquet(path)
    return held


def forget() -> None:
    _OPEN.clear()


def subject(table: str) -> str:
    return f"{NS}{table}/"


def star_schema(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> Catalog:
    """Predicates are NS + column name; columns that several tables have get the table's name before them."""
    maps = []
    for name, (key, refs, graphs) in LAYOUT.items():
        if tables is not None and name not in tables:
            continue
        df = open_table(spark, f"{sf_dir}/{name}.parquet")
        plain = df.columns
        if key is None:
            df, key_ = open_table(spark, f"{sf_dir}/{name}.parquet", keyed=True), Key(f"{name}_", ("_row",), blank=True)
        else:
            key_ = Key(subject(name), key)
        columns: dict = {NS + (c if "_" in c and not c.endswith("_id") else f"{name}_{c}"): c for c in plain}
        columns |= {NS + p: Key(subject(t), (c,)) for p, (t, c) in refs.items()}
        for graph in (None, *graphs):
            maps.append(TableMap(name, df, key_, columns, NS + name.capitalize(), graph))
    return Catalog(spark, None, maps)
