import random
from collections import Counter

import pytest

from quadlake.engine import Engine
from quadlake.parser.sparql import parse_query
from quadlake.parser.turtle import parse_turtle
from quadlake.sources import results
from quadlake.sources.catalog import Catalog
from quadlake.terms import IRI, Lit
from tests import naive

P = "PREFIX : <urn:x:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
GRAPH = """@prefix : <urn:x:> . :a :p :b . :b :p :c . :a :p :d . :d :p :c . :x :p :y . :y :p :x . :c :q :w .
:a :name "Al"@en, "Bo" ; :age 30 . :b :age 3.5 ; :name "Cy" . :c :age "x" .
:g1 { :a :in :g . :k :in :h } :g2 { :z :in :g } << :a :p :b >> :said :k ."""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(Catalog.of(spark, parse_turtle(GRAPH)))


def rows(engine, text):
    return sorted((tuple(r) for r in engine.select(P + text).collect()), key=repr)


def u(*names):
    return tuple(n if n is None else "urn:x:" + n for n in names)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT ?o { :a :p+ ?o }", [u("b"), u("c"), u("d")]),
        ("SELECT ?o { :x :p* ?o }", [u("x"), u("y")]),
        ("SELECT ?o { :nowhere :p* ?o }", [u("nowhere")]),
        ("SELECT ?o { :a :p/:p ?o }", [u("c"), u("c")]),
        ("SELECT ?s { ?s :p+ :c }", [u("a"), u("b"), u("d")]),
        ('SELECT ?n { :a :name ?n FILTER(lang(?n) = "en") }', [("Al",)]),
        ('SELECT ?s ?n { ?s :age ?a OPTIONAL { ?s :name ?n FILTER(lang(?n) = "") } }', [("urn:x:a", "Bo"), ("urn:x:b", "Cy"), ("urn:x:c", None)]),
        ("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s :in ?o } } GROUP BY ?g", [("urn:x:g1", 2), ("urn:x:g2", 1)]),
        ("SELECT ?s FROM :g1 { ?s :in ?o }", [u("a"), u("k")]),
        ('SELECT ?s { ?s :age ?a MINUS { ?s :name "Cy" } }', [u("a"), u("c")]),
        ("SELECT (SUM(?a) AS ?t) { ?s :age ?a }", [(None,)]),
        ("SELECT (SUM(?a) AS ?t) (AVG(?a) AS ?v) { ?s :age ?a FILTER isNumeric(?a) }", [("33.5", "16.75")]),
        ("SELECT ?s { ?s :age ?a FILTER(?a > 3) FILTER NOT EXISTS { ?s :name ?n FILTER(?n = \"Cy\") } }", [u("a")]),
        ("SELECT ?x ?y { VALUES (?x ?y) { (1 UNDEF) (UNDEF 2) } VALUES ?x { 1 3 } }", [(1, 2), (1, None), (3, 2)]),
        ("SELECT ?k { << :a :p ?b >> :said ?k }", [u("k")]),
        ("SELECT ?b { ?r <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> ?t BIND(OBJECT(?t) AS ?b) }", [u("b")]),
        ('SELECT (SUBSTR("motor car", 7) AS ?a) (REPLACE("abcd", "b", "Z") AS ?b) (STRBEFORE("abc", "c") AS ?c) {}', [("car", "aZcd", "ab")]),
        ('SELECT (xsd:integer("7") + 1 AS ?a) (xsd:boolean("0") AS ?b) (xsd:double("1e3") AS ?c) (STR(1.50) AS ?d) {}', [(8, False, 1000.0, "1.5")]),
        ('SELECT (IF(?nope, 1, 2) AS ?a) (COALESCE(?nope, 3) AS ?b) (1 / 0 AS ?c) {}', [(None, 3, None)]),
        ('SELECT (LANGMATCHES("en-GB", "EN") AS ?a) (hasLANG("x"@en) AS ?b) (LANGDIR("x"@en--rtl) AS ?c) {}', [(True, True, "rtl")]),
        ('SELECT (SECONDS("2020-01-02T03:04:05.5Z"^^xsd:dateTime) = 5.5 AS ?a) (STR(TIMEZONE("2020-01-02T03:04:05-08:00"^^xsd:dateTime)) AS ?b) {}', [(True, "-PT8H")]),
    ],
)
def test_select(engine, text, expected):
    assert rows(engine, text) == sorted(expected, key=repr)


def test_forms(engine):
    assert engine.ask(P + "ASK { :a :p :b }") and not engine.ask(P + "ASK { :a :p :zz }")
    made = engine.construct(P + "CONSTRUCT { ?o :inv ?s . ?s :has [ :v ?o ] } { ?s :p ?o }")
    assert made.count() == 18
    assert engine.describe(P + "DESCRIBE :a").count() == 6


def test_results_round_trip(engine):
    found = engine.select(P + "SELECT ?s ?a { ?s :age ?a } ORDER BY ?a", "term")
    names, back = results.from_json(results.to_json(found))
    assert names == ["s", "a"] and back == results.solutions(found)
    assert [r["a"] for r in back] == [Lit("3.5", "http://www.w3.org/2001/XMLSchema#decimal"), Lit("30", "http://www.w3.org/2001/XMLSchema#integer"), Lit("x")]
    assert "<uri>urn:x:a</uri>" in results.to_xml(found) and "<boolean>true</boolean>" in results.to_xml(True)


def test_own_function_and_fresh_nodes(engine, spark):
    from pyspark.sql import functions as F

    from quadlake.functions.values import Val

    own = Engine(engine.catalog, functions={"urn:f": lambda t: Val("int", F.length(t["lex"]).cast("bigint"))})
    assert rows(own, 'SELECT (<urn:f>(?n) AS ?k) { :b :name ?n }') == [(2,)]
    with pytest.raises(ValueError, match="unknown function"):
        engine.select("SELECT (<urn:f>(1) AS ?k) {}")
    ids = engine.select(P + 'SELECT (BNODE("x") AS ?b) (BNODE("x") AS ?c) { ?s :p ?o }').collect()
    assert all(r["b"] == r["c"] for r in ids) and len({r["b"] for r in ids}) == len(ids)


def test_random_patterns_match_naive(spark):
    rng = random.Random(5)
    nodes = [IRI(f"urn:x:n{i}") for i in range(4)]
    preds = [IRI(f"urn:x:p{i}") for i in range(3)]
    graph = sorted({(rng.choice(nodes), rng.choice(preds), rng.choice(nodes)) for _ in range(14)}, key=repr)
    engine = Engine(Catalog.of(spark, [(*t, None) for t in graph]))

    def triple():
        def pick():
            return rng.choice([f"?{v}" for v in "abcd"] + [":n1"])

        return f"{pick()} :p{rng.randrange(3)} {pick()} ."

    for _ in range(6):
        text = f"SELECT * {{ {triple()} OPTIONAL {{ {triple()} }} {{ {triple()} }} UNION {{ {triple()} {triple()} }} {rng.choice(['MINUS', 'OPTIONAL'])} {{ {triple()} }} }}"
        expected = Counter(frozenset((k, v.value) for k, v in m.items()) for m in naive.group(graph, parse_query(P + text).where))
        found = engine.select(P + text)
        got = Counter(frozenset((k, v) for k, v in r.asDict().items() if v is not None and k != "_one") for r in found.collect())
        assert got == expected, text
