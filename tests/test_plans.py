"""Plans: order of joins, filters that reach scans, joins by case, seeded closures."""

import random
import re

import pytest

from quadlake import queries
from quadlake.engine import Engine
from quadlake.operators import paths, scan
from quadlake.parser.turtle import parse_turtle
from quadlake.plans.joinorder import PatternStats, best_order
from quadlake.sources.catalog import Catalog, Key, TableMap
from quadlake.sources.star_schema import star_schema

SF = "/root/testdata/sf0.001"


def explain(spark, df):
    return spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shape(plan):
    """A plan without the numbers of its expressions."""
    return re.sub(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]|_row|v_\S+", "", plan)


def select(spark, text, **options):
    return Engine(star_schema(spark, SF), **options).select(queries.PREFIX + text)


PATTERNS = ['?r :r_name "ASIA" .', "?n :n_region ?r .", "?n :n_name ?nn .", "?c :c_nation ?n .", "?s :s_nation ?n .", "?o :o_cust ?c .", "?l :l_order ?o .", "?l :l_supp ?s .", "?l :l_extendedprice ?p ."]


def test_written_order_does_not_matter(spark):
    rng, shapes, rows = random.Random(3), set(), set()
    for _ in range(4):
        text = "SELECT ?nn (COUNT(?p) AS ?k) { " + " ".join(rng.sample(PATTERNS, len(PATTERNS))) + " } GROUP BY ?nn"
        df = select(spark, text)
        scans = re.findall(r"Location: InMemoryFileIndex \[file:\S*/(\w+)\.parquet\]", explain(spark, df))
        shapes.add(tuple(scans))
        rows.add(tuple(sorted(map(tuple, df.collect()))))
    assert len(shapes) == 1 and len(rows) == 1
    written = select(spark, text, estimator=None)
    assert tuple(sorted(map(tuple, written.collect()))) in rows


def test_star_keeps_the_written_order_of_variables(spark):
    assert select(spark, "SELECT * { ?l :l_order ?o . ?o :o_cust ?c . ?c :c_name ?n }").columns == ["l", "o", "c", "n"]


def test_order_search():
    stats = [PatternStats("big", 1e6, {"a": 1e6, "b": 1e3}), PatternStats("mid", 1e3, {"b": 1e3, "c": 10}), PatternStats("one", 1, {"c": 1}), PatternStats("apart", 5, {"z": 5})]
    assert best_order(stats[:3]) == [2, 1, 0] and best_order(stats)[-1] == 0
    many = [PatternStats(f"p{i}", 10.0 * (i + 1), {f"v{i}": 10.0 * (i + 1), f"v{i + 1}": 5}) for i in range(12)]
    order = best_order(many)
    assert sorted(order) == list(range(12)) and order == best_order(many)
    chain = [PatternStats("x", 10, {"a": 10}), PatternStats("y", 20, {"a": 10}), PatternStats("z", 30, {"a": 10})]
    assert best_order(chain) == [0, 1, 2] and best_order(chain, lambda p, bound, rows: rows * (9 if p.name == "y" else 1)) == [1, 0, 2]  # a caller's estimator decides


def test_statistics_hook_and_counts(spark):
    seen = []
    catalog = star_schema(spark, SF)
    catalog.statistics = lambda s, arcs, table: seen.append(table.name) or PatternStats("", 7.0)
    assert Engine(catalog).select(queries.PREFIX + "SELECT ?n { ?n :n_region ?r . ?r :r_name ?x }").count() > 0 and sorted(seen) == ["nation", "region"]
    quads = Catalog.of(spark, parse_turtle("@prefix : <urn:x:> . :a :p :b , :c . :b :q :c .")).analyze()
    assert quads.predicates == {"urn:x:p": 2, "urn:x:q": 1} and quads.triples("urn:x:p") == 2.0
    assert quads.add(quads.quads).predicates is None


@pytest.mark.parametrize(
    ("text", "pushed"),
    [
        ("SELECT ?n { ?n :n_region <urn:t:region/1> }", "EqualTo(n_regionkey,1)"),
        ("SELECT ?n { <urn:t:nation/3> :n_name ?n }", "EqualTo(n_nationkey,3)"),
        ('SELECT ?c { ?c :c_mktsegment "BUILDING" }', "EqualTo(c_mktsegment,BUILDING)"),
        ("SELECT ?l { ?l :labels_toxic 1 }", "EqualTo(toxic,1)"),
        ("SELECT ?t { <urn:t:conversations/3/1> :conversations_text ?t }", "EqualTo(turn,1)"),
        ("SELECT ?p ?o { <urn:t:region/1> ?p ?o }", "EqualTo(r_regionkey,1)"),
    ],
)
def test_constants_reach_the_scan(spark, text, pushed):
    assert pushed in re.sub(r"\s", "", explain(spark, select(spark, text)))


FEW = ("region", "nation", "supplier", "lineitem", "conversations", "embeddings")


@pytest.mark.parametrize(
    ("where", "read"),
    [
        ("?s ?p ?o . ?s a :Nation", "nation"),
        ("?s a :Nation . ?s ?p ?o . ?s ?q ?x", "nation"),
        ("{ ?s a :Conversations } ?s ?p ?o", "conversations"),
        ("?s ?p ?o . ?s :l_tax 0.03e0", "lineitem"),
        ("?s ?p ?o . ?o :r_name ?n", "nation region"),
        ("?s ?p ?o . ?s :s_name ?n . ?o :n_region ?r", "nation supplier"),
        ("?s ?p ?o . ?s :s_name ?n . ?o :r_name ?r", ""),
        ("?s ?p <urn:t:nation/3>", "supplier"),
        ("?s ?p <urn:t:Region>", "region"),
        ('?s ?p "ASIA"', "conversations lineitem nation region supplier"),
        ("?s a :Nation , :Region . ?s ?p ?o", ""),
    ],
)
def test_any_predicate_makes_only_triples_that_can_join(spark, monkeypatch, where, read):
    """Tables whose keys no solution can hold are not read, and the solutions are those of reading all."""
    text = queries.PREFIX + "SELECT * { " + where + " }"
    catalog = star_schema(spark, SF, FEW)
    df = Engine(catalog).select(text)
    assert set(re.findall(r"Location: InMemoryFileIndex \[file:\S*/(\w+)\.parquet\]", explain(spark, df))) == set(read.split())
    monkeypatch.setattr(scan, "narrowed", lambda table, s, o: table)
    whole = Engine(catalog).select(text)
    assert df.columns == whole.columns and sorted(map(str, df.collect())) == sorted(map(str, whole.collect()))


def test_any_predicate_keeps_what_may_join(spark):
    """A prefix may begin another one, and stored quads may give a subject of any table any class."""
    one = TableMap("one", spark.createDataFrame([("x", 1), ("b/y", 2)], "k string, v int"), Key("urn:a/", ("k",)), {"urn:k": "k", "urn:v": "v"}, "urn:One")
    two = TableMap("two", spark.createDataFrame([("y", 3)], "k string, w int"), Key("urn:a/b/", ("k",)), {"urn:w": "w"}, "urn:Two")
    text = "SELECT ?s ?p { ?s ?p ?o . ?s a <urn:Two> }"
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    rows = [("urn:a/b/y", p) for p in (kind, kind, "urn:k", "urn:v", "urn:w")]
    assert sorted(map(tuple, Engine(Catalog(spark, None, [one, two])).select(text).collect())) == rows
    stored = Catalog.of(spark, parse_turtle("<urn:a/x> a <urn:Two> .")).map_tables([one, two])
    more = [("urn:a/x", p) for p in (kind, kind, "urn:k", "urn:v")]
    assert sorted(map(tuple, Engine(stored).select(text).collect())) == rows + more
    loose = "SELECT ?s ?p { <urn:n> <urn:none> ?x . OPTIONAL { <urn:n> <urn:is> ?s } ?s ?p ?o }"  # not bound for certain: nothing is left out
    held = Catalog.of(spark, parse_turtle("<urn:n> <urn:none> 1 .")).map_tables([one, two])
    assert Engine(held).select(loose).count() == 8 + 1


def test_describe_reads_rows_by_key(spark):
    plan = re.sub(r"\s", "", explain(spark, Engine(star_schema(spark, SF)).describe("DESCRIBE <urn:t:region/1>")))
    assert "EqualTo(r_regionkey,1)" in plan and "customer.parquet" not in plan


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * { { ?x :c_name ?n } UNION { ?y :s_name ?n } OPTIONAL { ?x :c_acctbal ?b } }",
        "SELECT * { { ?x :c_name ?n } UNION { ?y :s_name ?n } MINUS { ?x :c_acctbal ?b FILTER(?b < 0) } }",
        "SELECT * { { ?x :c_name ?n } UNION { ?y :s_name ?n } FILTER EXISTS { { ?x :c_acctbal ?b } UNION { ?y :s_acctbal ?b } } }",
        "SELECT * { { ?x :c_name ?n } UNION { ?y :s_name ?n } FILTER NOT EXISTS { ?x :c_acctbal ?b FILTER(?b < 0) } }",
    ],
)
def test_uncertain_keys_join_by_equality(spark, text):
    """Rows that bind the variable meet in equi-joins; nested loops are left only for rows that bind nothing to compare."""
    df = select(spark, text)
    plan = explain(spark, df)
    assert re.search(r"(SortMerge|ShuffledHash|BroadcastHash)Join", plan)
    if "MINUS" in text:
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.count() > 0


def test_closures_grow_from_what_is_bound(spark, monkeypatch):
    made = []
    real = paths.written
    monkeypatch.setattr(paths, "written", lambda df: made.append(real(df)) or made[-1])
    rows = select(spark, "SELECT ?c ?x { ?c :c_custkey ?k . ?c (:c_nation|:n_region)+ ?x FILTER(?k <= 4) }").collect()
    assert len(rows) == 10 and sum(t.count() for t in made if _there(spark, t)) <= 5 + 10
    made.clear()
    rows = select(spark, "SELECT ?c ?x { VALUES ?k { 1 2 } ?c :c_custkey ?k . ?c (:c_nation/:n_region)* ?x }").collect()
    assert sorted(r.x for r in rows if "customer" in r.x) == ["urn:t:customer/1", "urn:t:customer/2"]


def _there(spark, table):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._paths[0])
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def test_mapped_tables_are_read_only(spark):
    e = Engine(star_schema(spark, SF, ("region", "nation")))
    for text in ("CLEAR ALL", "CLEAR DEFAULT", "DROP GRAPH <urn:g:geo>", "DELETE WHERE { ?s :r_name ?n }", "DELETE DATA { <urn:t:region/1> :r_name \"x\" }", "DELETE WHERE { ?s ?p ?o }", "MOVE <urn:g:geo> TO <urn:g:b>"):
        with pytest.raises(ValueError, match="read-only"):
            e.update(queries.PREFIX + text)
    assert e.update("CLEAR SILENT ALL").catalog.maps and e.update("CLEAR GRAPH <urn:g:none>")
    more = e.update(queries.PREFIX + "INSERT DATA { <urn:t:region/1> :note 1 } ; DELETE DATA { <urn:t:region/1> :note 1 }")
    assert not more.ask(queries.PREFIX + "ASK { ?s :note ?n }")
