"""Registered queries over a small graph of stored quads: terms, functions, patterns and updates that tables do not have.

The graph is the same at every scale; the SQL lists the rows that the language's rules give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.engine import Engine
from quadlake.functions.values import Val
from quadlake.parser.turtle import parse_turtle
from quadlake.scratch import shared_folder
from quadlake.sources import rdf, results
from quadlake.sources.catalog import Catalog
from quadlake.update import Transaction, commit, snapshot

PREFIX = "PREFIX : <urn:x:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>\n"
GRAPH = """@prefix : <urn:x:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :name "Al"@en , "Bo" ; :age 30 ; :knows :b ; :born "1990-05-06T07:08:09.5Z"^^xsd:dateTime .
:b :name "Cy"@fr-ca ; :age 3.5 ; :knows :c , :a ; :says <<( :a :knows :c )>> .
:c :age "x" ; :height 1.5e0 ; :label "hi"@ar--rtl ; :knows :d .
:d :list ( 1 2 3 ) ; :part [ :of :whole ] ; :born "2001-02-03T04:05:06-08:00"^^xsd:dateTime .
:a :knows :b {| :since 2020 |} .
:n :v 1 , 2.5 , 3.0e0 , "4"^^xsd:integer , 0.1 , 0.2 .
:g1 { :a :in :k . :b :in :k . } :g2 { :z :in :k . :a :near :z . }"""


def _rows(*rows: tuple) -> str:
    """A SELECT of literal rows; the first row has the column names."""
    names, *values = rows
    if not values:
        return "SELECT " + ", ".join(f"NULL AS {n}" for n in names) + " WHERE false"

    def spell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(spell(x) for x in row) + ")" for row in values)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def u(name: str) -> str:
    return "urn:x:" + name


#: name: (SPARQL, SQL)
SELECTS: dict[str, tuple[str, str]] = {
    "lang_tags": ("SELECT ?s (LANG(?n) AS ?l) (STR(?n) AS ?t) { ?s :name ?n }", _rows(("s", "l", "t"), (u("a"), "en", "Al"), (u("a"), "", "Bo"), (u("b"), "fr-ca", "Cy"))),
    "lang_matches": ('SELECT ?s { ?s :name ?n FILTER LANGMATCHES(LANG(?n), "FR") }', _rows(("s",), (u("b"),))),
    "lang_direction": ("SELECT (LANGDIR(?l) AS ?d) (hasLANGDIR(?l) AS ?h) (LANG(?l) AS ?g) { :c :label ?l }", _rows(("d", "h", "g"), ("rtl", True, "ar"))),
    "has_lang": ('SELECT ?s (hasLANG(?n) AS ?h) (hasLANG(?n, "en") AS ?e) { ?s :name ?n }', _rows(("s", "h", "e"), (u("a"), True, True), (u("a"), False, False), (u("b"), True, False))),
    "str_lang": ('SELECT (LANG(STRLANG("x", "de")) AS ?l) (LANGDIR(STRLANGDIR("x", "he", "rtl")) AS ?d) {}', _rows(("l", "d"), ("de", "rtl"))),
    "str_dt": ('SELECT (STRDT("7", xsd:integer) + 1 AS ?n) (DATATYPE(STRDT("q", :t)) AS ?t) {}', _rows(("n", "t"), ("8", u("t")))),
    "iri_resolution": ('BASE <http://h/p/q> SELECT (IRI("r") AS ?a) (URI("#f") AS ?b) (<s> AS ?c) (isIRI(IRI("r")) AS ?d) {}', _rows(("a", "b", "c", "d"), ("http://h/p/r", "http://h/p/q#f", "http://h/p/s", True))),
    "bnode_function": ('SELECT (COUNT(DISTINCT ?x) AS ?n) (COUNT(DISTINCT ?y) AS ?m) (MIN(?same) AS ?every) { SELECT (BNODE() AS ?x) (BNODE("k") AS ?y) (BNODE("k") = BNODE("k") AS ?same) { ?s :name ?n } }', _rows(("n", "m", "every"), (3, 3, True))),
    "uuid_functions": ("SELECT (isIRI(UUID()) AS ?i) (STRSTARTS(STR(UUID()), \"urn:uuid:\") AS ?p) (STRLEN(STRUUID()) AS ?n) {}", _rows(("i", "p", "n"), (True, True, 36))),
    "rand_now": ("SELECT (RAND() >= 0 AS ?a) (RAND() < 1 AS ?b) (YEAR(NOW()) > 2000 AS ?c) (DATATYPE(NOW()) AS ?t) {}", _rows(("a", "b", "c", "t"), (True, True, True, "http://www.w3.org/2001/XMLSchema#dateTime"))),
    "time_zones": ("SELECT ?s (TZ(?t) AS ?z) (STR(TIMEZONE(?t)) AS ?d) (HOURS(?t) AS ?h) { ?s :born ?t }", _rows(("s", "z", "d", "h"), (u("a"), "Z", "PT0S", 7), (u("d"), "-08:00", "-PT8H", 4))),
    "seconds": ("SELECT ?s (xsd:double(SECONDS(?t)) AS ?x) { ?s :born ?t }", _rows(("s", "x"), (u("a"), 9.5), (u("d"), 6.0))),
    "zoned_comparison": ("SELECT ?s { ?s :born ?t FILTER(?t < \"2001-02-03T12:05:07Z\"^^xsd:dateTime && ?t > \"2001-02-03T12:05:05Z\"^^xsd:dateTime) }", _rows(("s",), (u("d"),))),
    "long_hashes": ('SELECT (STRLEN(SHA384("abc")) AS ?a) (SUBSTR(SHA384("abc"), 1, 8) AS ?b) (SUBSTR(SHA512("abc"), 1, 8) AS ?c) (SHA512("") = SHA512("") AS ?d) {}', _rows(("a", "b", "c", "d"), (96, "cb00753f", "ddaf35a1", True))),
    "triple_functions": ("SELECT (isTRIPLE(?t) AS ?i) (SUBJECT(?t) AS ?s) (PREDICATE(?t) AS ?p) (OBJECT(?t) AS ?o) (TRIPLE(:a, :knows, :c) = ?t AS ?e) { :b :says ?t }", _rows(("i", "s", "p", "o", "e"), (True, u("a"), u("knows"), u("c"), True))),
    "triple_term_pattern": ("SELECT ?who ?x { ?who :says <<( :a :knows ?x )>> }", _rows(("who", "x"), (u("b"), u("c")))),
    "reified_triple": ("SELECT ?y { << :a :knows :b >> :since ?y }", _rows(("y",), ("2020",))),
    "reifies_join": ("SELECT ?s ?o { ?r rdf:reifies <<( ?s :knows ?o )>> }", _rows(("s", "o"), (u("a"), u("b")))),
    "annotation_pattern": ("SELECT ?o ?y { :a :knows ?o {| :since ?y |} }", _rows(("o", "y"), (u("b"), "2020"))),
    "values_triple_terms": ("SELECT ?who { VALUES ?t { <<( :a :knows :c )>> <<( :c :knows :a )>> } ?who :says ?t }", _rows(("who",), (u("b"),))),
    "collection_pattern": ("SELECT ?x { :d :list ( 1 ?x 3 ) }", _rows(("x",), ("2",))),
    "list_members": ("SELECT ?m { :d :list/rdf:rest*/rdf:first ?m }", _rows(("m",), ("1",), ("2",), ("3",))),
    "bnode_property_list": ("SELECT ?w { :d :part [ :of ?w ] }", _rows(("w",), (u("whole"),))),
    "same_term": ('SELECT (sameTerm(1, 1.0) AS ?a) (1 = 1.0 AS ?b) (sameTerm("x", "x") AS ?c) (sameTerm("x", "x"@en) AS ?d) {}', _rows(("a", "b", "c", "d"), (False, True, True, False))),
    "cast_decimal": ('SELECT (STR(xsd:decimal("1.50")) AS ?a) (STR(xsd:decimal(2)) AS ?b) (xsd:decimal("no") AS ?c) {}', _rows(("a", "b", "c"), ("1.5", "2.0", None))),
    "cast_float": ('SELECT (xsd:float("2.5") = 2.5 AS ?a) (DATATYPE(xsd:float("1")) AS ?t) (xsd:float("x") AS ?n) {}', _rows(("a", "t", "n"), (True, "http://www.w3.org/2001/XMLSchema#float", None))),
    "cast_datetime": ('SELECT (YEAR(xsd:dateTime("2020-03-04T05:06:07Z")) AS ?y) (BOUND(?q) AS ?b) { BIND(xsd:dateTime("nope") AS ?q) }', _rows(("y", "b"), (2020, False))),
    "function_alias": ("SELECT (isIRI(<http://www.w3.org/ns/sparql#uuid>()) AS ?a) (<http://www.w3.org/ns/sparql#strlen>(\"abc\") AS ?n) {}", _rows(("a", "n"), (True, 3))),
    "numeric_forms": ("SELECT (1 AS ?i) (STR(1.0) AS ?d) (1.0e2 AS ?e) (STR(-0.5) AS ?m) (DATATYPE(.5) AS ?t) {}", _rows(("i", "d", "e", "m", "t"), (1, "1.0", 100.0, "-0.5", "http://www.w3.org/2001/XMLSchema#decimal"))),
    "string_escapes": (r"""SELECT ("a\tb" AS ?t) ('q\'s' AS ?q) ("é" AS ?u) (STRLEN('''x"y''') AS ?n) {}""", _rows(("t", "q", "u", "n"), ("a\tb", "q's", "é", 3))),
    "exact_decimal_sum": ("SELECT (STR(SUM(?x)) AS ?t) { :n :v ?x FILTER(DATATYPE(?x) = xsd:decimal) }", _rows(("t",), ("2.8",))),
    "promoted_sum": ("SELECT (SUM(?x) AS ?t) { :n :v ?x }", _rows(("t",), ("1.08E1",))),
    "promoted_avg": ("SELECT (AVG(?x) AS ?t) { :n :v ?x FILTER(DATATYPE(?x) != xsd:double) }", _rows(("t",), ("1.56",))),
    "extremes_of_terms": ("SELECT (MIN(?x) AS ?low) (MAX(?x) AS ?high) { :n :v ?x }", _rows(("low", "high"), ("0.1", "4"))),
    "sum_type_error": ("SELECT (SUM(?x) AS ?t) (COUNT(?x) AS ?n) { ?s :age ?x }", _rows(("t", "n"), (None, 3))),
    "integer_overflow": ("SELECT (9223372036854775807 + 1 AS ?a) (SUM(?x) AS ?s) { VALUES ?x { 9223372036854775807 9223372036854775807 } }", _rows(("a", "s"), (None, None)).replace("(NULL, NULL)", "(CAST(NULL AS BIGINT), CAST(NULL AS BIGINT))")),
    "order_of_terms": ('SELECT ?x { VALUES ?x { "b" 2 :i 1.5 "a" UNDEF } } ORDER BY ?x OFFSET 1 LIMIT 1', _rows(("x",), (u("i"),))),
    "order_of_literals": ("SELECT (GROUP_CONCAT(?t; SEPARATOR=\"|\") AS ?every) { SELECT (STR(?x) AS ?t) { :n :v ?x FILTER(?x > 0.15) } ORDER BY DESC(?x) LIMIT 3 }", _rows(("every",), ("2.5|3.0e0|4",))),
    "group_by_unbound": ("SELECT ?n (COUNT(*) AS ?k) { ?s :age ?a OPTIONAL { ?s :name ?n FILTER(LANG(?n) = \"\") } } GROUP BY ?n", _rows(("n", "k"), ("Bo", 1), (None, 2))),
    "optional_uncertain_key": ("SELECT ?s ?k { ?s :age ?a OPTIONAL { ?s :height ?h . ?s :knows ?k } OPTIONAL { ?k :name \"Bo\" } }", _rows(("s", "k"), (u("a"), u("a")), (u("b"), u("a")), (u("c"), u("d")))),
    "minus_uncertain_key": ("SELECT ?s ?k { ?s :age ?a OPTIONAL { ?s :height ?h . ?s :knows ?k } MINUS { ?k :list ?l } }", _rows(("s", "k"), (u("a"), None), (u("b"), None))),
    "exists_uncertain_key": ("SELECT ?s { ?s :age ?a OPTIONAL { ?s :height ?h . ?s :knows ?k } FILTER EXISTS { ?k :list ?l } }", _rows(("s",), (u("a"),), (u("b"),), (u("c"),))),
    "not_exists_uncertain_key": ("SELECT ?s { ?s :age ?a OPTIONAL { ?s :height ?h . ?s :knows ?k } FILTER NOT EXISTS { ?k :name ?l } }", _rows(("s",), (u("c"),))),
    "exists_path": ("SELECT ?s { ?s :age ?a FILTER EXISTS { ?s :knows+ :d } }", _rows(("s",), (u("a"),), (u("b"),), (u("c"),))),
    "exists_graph": ("SELECT ?s { ?s :age ?a FILTER EXISTS { GRAPH :g1 { ?s :in ?k } } }", _rows(("s",), (u("a"),), (u("b"),))),
    "exists_bind": ("SELECT ?s { ?s :age ?a FILTER EXISTS { ?s :knows ?o BIND(STR(?o) AS ?t) FILTER(STRENDS(?t, \"d\")) } }", _rows(("s",), (u("c"),))),
    "exists_values": ("SELECT ?s { ?s :age ?a FILTER EXISTS { VALUES ?s { :a :c } } }", _rows(("s",), (u("a"),), (u("c"),))),
    "exists_optional": ("SELECT ?s { ?s :age ?a FILTER EXISTS { ?s :knows ?o OPTIONAL { ?o :height ?h } FILTER(BOUND(?h)) } }", _rows(("s",), (u("b"),))),
    "exists_minus": ("SELECT ?s { ?s :age ?a FILTER EXISTS { ?s :knows ?o MINUS { ?o :name ?n } } }", _rows(("s",), (u("b"),), (u("c"),))),
    "exists_union": ("SELECT ?s { ?s :age ?a FILTER EXISTS { { ?s :height ?h } UNION { ?s :says ?t } } }", _rows(("s",), (u("b"),), (u("c"),))),
    "exists_subquery": ("SELECT ?s { ?s :age ?a FILTER EXISTS { { SELECT ?s { ?s :knows ?o } GROUP BY ?s HAVING(COUNT(*) > 1) } } }", _rows(("s",), (u("b"),))),
    "exists_group": ("SELECT ?s { ?s :age ?a FILTER EXISTS { { ?s :knows ?o } { ?o :knows ?p FILTER(?p = :d) } } }", _rows(("s",), (u("b"),))),
    "service_silent": ("SELECT ?s { ?s :height ?h SERVICE SILENT <urn:svc:none> { ?s :age ?a } }", _rows(("s",), (u("c"),))),
    "path_zero_length": ("SELECT ?x { :nowhere :knows* ?x }", _rows(("x",), (u("nowhere"),))),
    "path_cycle": ("SELECT ?x { :a :knows+ ?x }", _rows(("x",), (u("a"),), (u("b"),), (u("c"),), (u("d"),))),
    "path_from_bound_end": ("SELECT ?s ?x { ?s :height ?h . ?s :knows* ?x }", _rows(("s", "x"), (u("c"), u("c")), (u("c"), u("d")))),
    "path_to_bound_end": ("SELECT ?s ?x { ?x :height ?h . ?s :knows+ ?x }", _rows(("s", "x"), (u("a"), u("c")), (u("b"), u("c")))),
    "path_in_graph": ("SELECT ?g ?x { GRAPH ?g { :a (:in|:near)+ ?x } }", _rows(("g", "x"), (u("g1"), u("k")), (u("g2"), u("z")), (u("g2"), u("k")))),
    "path_negated_inverse": ("SELECT ?x { :b !(:name|:age|:says|:knows|^:in) ?x }", _rows(("x",), (u("a"),))),
    "regex_invalid": ('SELECT ?s (REGEX(?n, "[") AS ?bad) (REGEX(?n, "^a", "i") AS ?ok) { ?s :name ?n FILTER(LANG(?n) != "") }', _rows(("s", "bad", "ok"), (u("a"), None, True), (u("b"), None, False)).replace("NULL", "CAST(NULL AS BOOLEAN)")),
    "regex_of_data": ('SELECT ?p (REGEX("abc", ?p) AS ?m) { VALUES ?p { "b" "(" "^c" } }', _rows(("p", "m"), ("b", True), ("(", None), ("^c", False))),
    "replace_dollars": ('SELECT (REPLACE("cat", "a", "[$&]") AS ?x) (REPLACE("cat", "(c)(a)", "$2$1$9") AS ?y) (REPLACE("a.b", ".", "$$", "q") AS ?z) (REPLACE("cat", "(", "x") AS ?w) {}', _rows(("x", "y", "z", "w"), ("c[a]t", "ac$9t", "a$b", None))),
    "strings_keep_language": ('SELECT (LANG(UCASE(?n)) AS ?u) (LANG(SUBSTR(?n, 1, 1)) AS ?s) (STR(CONCAT(?n, ?n)) AS ?c) (LANG(STRBEFORE(?n, "l")) AS ?b) { :a :name ?n FILTER(LANG(?n) = "en") }', _rows(("u", "s", "c", "b"), ("en", "en", "AlAl", "en"))),
    "encode_unicode": ('SELECT (ENCODE_FOR_URI("é/ä b") AS ?v) {}', _rows(("v",), ("%C3%A9%2F%C3%A4%20b",))),
    "decimal_rounding": ("SELECT (STR(CEIL(?x)) AS ?c) (STR(FLOOR(?x)) AS ?f) (STR(ROUND(?x)) AS ?r) (STR(ABS(-?x)) AS ?a) { :b :age ?x }", _rows(("c", "f", "r", "a"), ("4.0", "3.0", "4.0", "3.5"))),
    "kinds_of_terms": ("SELECT ?p (isIRI(?o) AS ?i) (isBLANK(?o) AS ?b) (isLITERAL(?o) AS ?l) (isNUMERIC(?o) AS ?n) { ?s ?p ?o . FILTER(?s = :d) }", _rows(("p", "i", "b", "l", "n"), (u("list"), False, True, False, False), (u("part"), False, True, False, False), (u("born"), False, False, True, False))),
    "errors_in_lists": ("SELECT (2 IN (1/0, 2) AS ?a) (COALESCE(1/0, ?no, 5) AS ?b) (IF(1/0, 1, 2) AS ?c) {}", _rows(("a", "b", "c"), (True, "5", None))),
    "values_undef_join": ("SELECT ?x ?y { VALUES (?x ?y) { (1 UNDEF) (UNDEF 2) (3 4) } VALUES (?x ?y) { (1 5) (UNDEF 2) } }", _rows(("x", "y"), (1, 5), (1, 2), (None, 2))),
    "graph_union_dataset": ("SELECT ?s FROM :g1 FROM :g2 { ?s :in ?k }", _rows(("s",), (u("a"),), (u("b"),), (u("z"),))),
    "dataset_named_only": ("SELECT ?g ?s FROM NAMED :g2 { GRAPH ?g { ?s :in ?k } }", _rows(("g", "s"), (u("g2"), u("z")))),
    "concat_distinct": ("SELECT (GROUP_CONCAT(DISTINCT ?k; SEPARATOR=\",\") AS ?every) { SELECT (STR(?o) AS ?k) { GRAPH ?g { ?s :in ?o } } }", _rows(("every",), (u("k"),))),
    "count_distinct_terms": ("SELECT (COUNT(DISTINCT ?p) AS ?n) (COUNT(DISTINCT ?s) AS ?m) { ?s ?p ?o FILTER(?s IN (:a, :b, :c)) }", _rows(("n", "m"), (7, 3))),
}


def graph(spark: SparkSession) -> Engine:
    return Engine(Catalog.of(spark, parse_turtle(GRAPH)))


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: graph(spark).select(PREFIX + SELECTS[name][0])


def _after(update: str, query: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """A query after an update."""
    return lambda spark, sf_dir: Engine(graph(spark).catalog, **options).update(PREFIX + update).select(PREFIX + query)


#: name: (update, query, SQL)
UPDATES: dict[str, tuple[str, str, str]] = {
    "insert_data": ("INSERT DATA { :q :r 1 . :q :r 1 . GRAPH :g3 { :q :r 2 } }", "SELECT ?g ?o { { :q :r ?o } UNION { GRAPH ?g { :q :r ?o } } }", _rows(("g", "o"), (None, "1"), (u("g3"), "2"))),
    "delete_data": ("DELETE DATA { :a :age 30 . :a :age 99 }", "SELECT ?s { ?s :age ?x }", _rows(("s",), (u("b"),), (u("c"),))),
    "update_with": ("WITH :g1 DELETE { ?s :in ?k } INSERT { ?s :was ?k } WHERE { ?s :in ?k FILTER(?s = :a) }", "SELECT ?s ?p { GRAPH :g1 { ?s ?p ?o } }", _rows(("s", "p"), (u("a"), u("was")), (u("b"), u("in")))),
    "update_using": ("INSERT { ?s :seen true } USING :g2 WHERE { ?s :in ?k }", "SELECT ?s { ?s :seen true }", _rows(("s",), (u("z"),))),
    "update_using_named": ("INSERT { ?s :seen ?g } USING NAMED :g1 WHERE { GRAPH ?g { ?s :in ?k } }", "SELECT ?s ?g { ?s :seen ?g }", _rows(("s", "g"), (u("a"), u("g1")), (u("b"), u("g1")))),
    "delete_graph_variable": ("DELETE { GRAPH ?g { ?s :in ?k } } WHERE { GRAPH ?g { ?s :in ?k . ?s :in :k FILTER(?s != :b) } }", "SELECT ?g ?s { GRAPH ?g { ?s :in ?k } }", _rows(("g", "s"), (u("g1"), u("b")))),
    "delete_where_pattern": ("DELETE WHERE { ?s :knows ?o ; :height ?h }", "SELECT ?s ?o { ?s :knows|:height ?o }", _rows(("s", "o"), (u("a"), u("b")), (u("b"), u("a")), (u("b"), u("c")))),
    "insert_fresh_nodes": ("INSERT { ?s :tag [ :at ?x ] } WHERE { ?s :age ?x }", "SELECT (COUNT(DISTINCT ?t) AS ?n) { ?s :tag ?t . ?t :at ?x }", _rows(("n",), (3,))),
    "insert_unbound_skipped": ("INSERT { ?s :h ?h } WHERE { ?s :age ?x OPTIONAL { ?s :height ?h } }", "SELECT ?s { ?s :h ?h }", _rows(("s",), (u("c"),))),
    "insert_triple_terms": ("INSERT { ?s :heard <<( ?s :knows ?o )>> } WHERE { ?s :knows ?o FILTER(?s = :c) }", "SELECT ?o { :c :heard <<( :c :knows ?o )>> }", _rows(("o",), (u("d"),))),
    "clear_graph": ("CLEAR GRAPH :g1", "SELECT ?g { GRAPH ?g { ?s :in ?k } }", _rows(("g",), (u("g2"),))),
    "clear_default": ("CLEAR DEFAULT", "SELECT (COUNT(*) AS ?n) { { ?s ?p ?o } UNION { GRAPH ?g { ?s ?p ?o } } }", _rows(("n",), (4,))),
    "drop_named": ("DROP NAMED ; DROP SILENT GRAPH :none", "SELECT (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } }", _rows(("n",), (0,))),
    "create_graph": ("CREATE GRAPH :new ; CREATE SILENT GRAPH :g1 ; INSERT DATA { GRAPH :new { :q :in :k } }", "SELECT ?s { GRAPH :new { ?s :in ?k } }", _rows(("s",), (u("q"),))),
    "move_to_itself": ("MOVE :g1 TO :g1 ; COPY :g2 TO :g2", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", _rows(("g", "n"), (u("g1"), 2), (u("g2"), 2))),
    "add_graph": ("ADD :g1 TO :g2", "SELECT (COUNT(*) AS ?n) { GRAPH :g2 { ?s ?p ?o } }", _rows(("n",), (4,))),
}


def custom_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the caller's, which wins over a built-in of the same name."""
    own = {"urn:f:twice": lambda t: Val("str", F.concat(t["lex"], t["lex"])), "http://www.w3.org/2001/XMLSchema#integer": lambda t: Val("int", F.lit(-1).cast("bigint"))}
    return Engine(graph(spark).catalog, functions=own).select(PREFIX + "SELECT (<urn:f:twice>(?n) AS ?t) (xsd:integer(?n) AS ?i) { ?s :name ?n }")


def exact_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and products beyond 64 bits."""
    text = "SELECT (9223372036854775807 * 4 + 1 AS ?a) (SUM(?x) AS ?s) { VALUES ?x { 9223372036854775807 9223372036854775807 } }"
    return Engine(graph(spark).catalog, exact_integers=True).select(PREFIX + text)


def construct_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph(spark).construct(PREFIX + "CONSTRUCT { ?s :told <<( ?s :likes ?o )>> } WHERE { ?s :knows ?o } ORDER BY ?s ?o LIMIT 2")
    return out.select(R.nt_column(F.col("s")).alias("s"), R.nt_column(F.col("o")).alias("o"))


def construct_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph(spark).construct(PREFIX + "CONSTRUCT WHERE { ?s :height ?h }")
    return out.select(R.nt_column(F.col("s")).alias("s"), F.col("p"), R.nt_column(F.col("o")).alias("o"))


def construct_fresh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph(spark).construct(PREFIX + "CONSTRUCT { _:x :of ?s . _:x :is ?a } WHERE { ?s :age ?a }")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("nodes"))


def describe_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph(spark).describe(PREFIX + "DESCRIBE ?s WHERE { ?s :height ?h }")
    return out.groupBy("p").count().select("p", F.col("count").alias("n"))


def describe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph(spark).describe(PREFIX + "DESCRIBE * WHERE { ?s :height ?h . ?s :knows ?o }")
    return out.groupBy("s").count().select(R.nt_column(F.col("s")).alias("s"), F.col("count").alias("n"))


def ask_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASK with grouping, and with an offset beyond all solutions."""
    e = graph(spark)
    yes = e.ask_frame(PREFIX + "ASK { ?s :knows ?o } GROUP BY ?s HAVING(COUNT(*) > 1)")
    no = e.ask_frame(PREFIX + "ASK { ?s :knows ?o } LIMIT 1 OFFSET 100")
    return yes.select(F.lit("having").alias("q"), "result").unionByName(no.select(F.lit("offset").alias("q"), "result"))


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Quads written in parallel, loaded again into a catalog."""
    path = f"{shared_folder(spark)}/load-{id(spark)}-{spark.sparkContext.applicationId}.nq"
    quads = graph(spark).catalog.quads
    rdf.write_lines(quads, path, mode="overwrite")
    return Engine(Catalog(spark)).update(f"LOAD <{path}>").select(PREFIX + "SELECT ?g (COUNT(*) AS ?n) { { ?s ?p ?o } UNION { GRAPH ?g { ?s ?p ?o } } } GROUP BY ?g")


def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON document of a result, read back."""
    found = graph(spark).select(PREFIX + "SELECT ?n ?t { ?s :name ?n OPTIONAL { ?s :says ?t } } ORDER BY ?n", "term")
    names, rows = results.from_json(results.to_json(found))
    spelled = [(", ".join(names), R.to_nt(r["n"]), R.to_nt(r["t"]) if "t" in r else None) for r in rows]
    return spark.createDataFrame(spelled, "vars string, n string, t string")


def results_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = results.to_xml(graph(spark).select(PREFIX + "SELECT ?l { ?s :label ?l }", "term"))
    return spark.createDataFrame([(text[text.index("<literal") : text.index("</literal>") + 10],)], "literal string")


def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle text of the graph, parsed again."""
    quads = rdf.collect(graph(spark).catalog.quads)
    again = Catalog.of(spark, parse_turtle(rdf.write_turtle(quads, {"": "urn:x:"})))
    return again.quads.groupBy("g").count().select("g", F.col("count").alias("n"))


def store_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match, count, add, remove and remove_matches of a catalog."""
    c = graph(spark).catalog
    more = c.add(Catalog.of(spark, [(R.IRI(u("q")), R.IRI(u("age")), R.Lit("1", R.INTEGER), None)]).quads)
    counts = [("age", c.count(p=R.IRI(u("age")))), ("graph", c.count(g=R.IRI(u("g1")))), ("added", more.count(p=R.IRI(u("age")))), ("removed", more.remove_matches(s=R.IRI(u("a")), g=None).count(p=R.IRI(u("age"))))]
    return spark.createDataFrame(counts, "what string, n long")


def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed updates are seen together; a failed transaction leaves nothing."""
    import uuid

    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    commit(graph(spark).catalog, path)
    with Transaction(spark, path) as t:
        t.update(PREFIX + "INSERT DATA { :t :p 1 }")
        t.update(PREFIX + "DELETE DATA { :a :age 30 }")
    try:
        with Transaction(spark, path) as t:
            t.update(PREFIX + "INSERT DATA { :t :p 2 }")
            raise KeyError("rolled back")
    except KeyError:
        pass
    return Engine(snapshot(spark, path)).select(PREFIX + "SELECT ?s ?o { ?s :p|:age ?o }")


OTHERS: dict[str, tuple[Callable, str]] = {
    "custom_function": (custom_function, _rows(("t", "i"), ("AlAl", -1), ("BoBo", -1), ("CyCy", -1))),
    "exact_integers": (exact_integers, _rows(("a", "s"), ("36893488147419103229", "18446744073709551614"))),
    "construct_nested": (construct_nested, _rows(("s", "o"), ("<urn:x:a>", "<<( <urn:x:a> <urn:x:likes> <urn:x:b> )>>"), ("<urn:x:b>", "<<( <urn:x:b> <urn:x:likes> <urn:x:a> )>>"))),
    "construct_short": (construct_short, _rows(("s", "p", "o"), ("<urn:x:c>", u("height"), '"1.5e0"^^<http://www.w3.org/2001/XMLSchema#double>'))),
    "construct_fresh_nodes": (construct_fresh_nodes, _rows(("n", "nodes"), (6, 3))),
    "describe_variable": (describe_variable, _rows(("p", "n"), (u("age"), 1), (u("height"), 1), (u("knows"), 1), (u("label"), 1))),
    "describe_all": (describe_all, _rows(("s", "n"), ("<urn:x:c>", 4), ("<urn:x:d>", 3))),
    "ask_modifiers": (ask_modifiers, _rows(("q", "result"), ("having", True), ("offset", False))),
    "load_documents": (load_documents, _rows(("g", "n"), (None, 32), (u("g1"), 2), (u("g2"), 2))),
    "results_json": (results_json, _rows(("vars", "n", "t"), ("n, t", '"Bo"', None), ("n, t", '"Al"@en', None), ("n, t", '"Cy"@fr-ca', "<<( <urn:x:a> <urn:x:knows> <urn:x:c> )>>"))),
    "results_xml": (results_xml, _rows(("literal",), ('<literal xml:lang="ar" its:dir="rtl">hi</literal>',))),
    "turtle_round_trip": (turtle_round_trip, _rows(("g", "n"), (None, 32), (u("g1"), 2), (u("g2"), 2))),
    "store_interface": (store_interface, _rows(("what", "n"), ("age", 3), ("graph", 2), ("added", 4), ("removed", 3))),
    "transaction_commit": (transaction_commit, _rows(("s", "o"), (u("t"), "1"), (u("b"), "3.5"), (u("c"), "x"))),
}

QUERIES = {name: _select(name) for name in SELECTS} | {name: _after(up, q) for name, (up, q, _) in UPDATES.items()} | {name: f for name, (f, _) in OTHERS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in SELECTS.items()} | {name: sql for name, (_, _, sql) in UPDATES.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
