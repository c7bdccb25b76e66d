"""Registered queries over the star schema: SPARQL, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadlake import terms as R
from quadlake.engine import Engine
from quadlake.sources.catalog import Catalog
from quadlake.sources.star_schema import star_schema

PREFIX = "PREFIX : <urn:t:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
_DAY = '"{}T00:00:00"^^xsd:dateTime'

#: name: (SPARQL, SQL)
SELECTS: dict[str, tuple[str, str]] = {
    "star_q1": (
        'SELECT ?rf ?ls (SUM(?q) AS ?sum_qty) (SUM(?p) AS ?sum_base) (SUM(?p * (1 - ?d)) AS ?sum_disc) (AVG(?q) AS ?avg_qty) (COUNT(*) AS ?n) WHERE { ?l :l_returnflag ?rf ; :l_linestatus ?ls ; :l_quantity ?q ; :l_extendedprice ?p ; :l_discount ?d ; :l_shipdate ?s FILTER(?s <= "1998-09-02T00:00:00"^^xsd:dateTime) } GROUP BY ?rf ?ls ORDER BY ?rf ?ls',
        "SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "scan_filter": ("SELECT ?o ?t WHERE { ?o :o_totalprice ?t ; :o_orderstatus \"F\" FILTER(?t > 300000) }", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000"),
    "join_fk_chain": (
        "SELECT ?rn (COUNT(*) AS ?n) (SUM(?p) AS ?total) WHERE { ?l :l_order ?o ; :l_extendedprice ?p . ?o :o_cust ?c . ?c :c_nation ?na . ?na :n_region ?r . ?r :r_name ?rn } GROUP BY ?rn",
        "SELECT r_name AS rn, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "q3_topk": (
        'SELECT ?o (SUM(?p * (1 - ?d)) AS ?revenue) ?od WHERE { ?c :c_mktsegment "BUILDING" . ?o :o_cust ?c ; :o_orderdate ?od . ?l :l_order ?o ; :l_extendedprice ?p ; :l_discount ?d ; :l_shipdate ?s FILTER(?od < "1995-03-15T00:00:00"^^xsd:dateTime && ?s > "1995-03-15T00:00:00"^^xsd:dateTime) } GROUP BY ?o ?od ORDER BY DESC(?revenue) ?o LIMIT 10',
        "SELECT 'urn:t:orders/' || o_orderkey AS o, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate AS od FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1, 3 ORDER BY revenue DESC, o LIMIT 10",
    ),
    "q5_region": (
        'SELECT ?nn (SUM(?p * (1 - ?d)) AS ?revenue) WHERE { ?r :r_name "ASIA" . ?n :n_region ?r ; :n_name ?nn . ?c :c_nation ?n . ?s :s_nation ?n . ?o :o_cust ?c . ?l :l_order ?o ; :l_supp ?s ; :l_extendedprice ?p ; :l_discount ?d } GROUP BY ?nn',
        "SELECT n_name AS nn, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey WHERE r_name = 'ASIA' GROUP BY 1",
    ),
    "q6_sum_filter": (
        'SELECT (SUM(?p * ?d) AS ?revenue) WHERE { ?l :l_shipdate ?s ; :l_discount ?d ; :l_quantity ?q ; :l_extendedprice ?p FILTER(?s >= "1994-01-01T00:00:00"^^xsd:dateTime && ?s < "1995-01-01T00:00:00"^^xsd:dateTime && ?d >= 5.0e-2 && ?d <= 7.0e-2 && ?q < 24) }',
        "SELECT coalesce(sum(l_extendedprice * l_discount), 0) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24",
    ),
    "optional_left": ("SELECT ?cn ?o WHERE { ?c :c_name ?cn ; :c_acctbal ?b OPTIONAL { ?o :o_cust ?c } FILTER(?b < 0) }", "SELECT c_name AS cn, 'urn:t:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0"),
    "optional_filter_cond": ("SELECT ?c ?o WHERE { ?c :c_custkey ?k ; :c_acctbal ?b OPTIONAL { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > ?b * 40) } }", "SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40"),
    "optional_nested": ("SELECT ?nn ?sn ?q WHERE { ?n :n_name ?nn OPTIONAL { ?s :s_nation ?n ; :s_name ?sn ; :s_acctbal ?b FILTER(?b > 5000) OPTIONAL { ?l :l_supp ?s ; :l_quantity ?q FILTER(?q >= 50) } } }", "SELECT n_name AS nn, s_name AS sn, l_quantity AS q FROM nation LEFT JOIN (supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity >= 50) ON s_nationkey = n_nationkey AND s_acctbal > 5000"),
    "minus_anti": ("SELECT ?c WHERE { ?c :c_name ?n MINUS { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > 300000) } }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "minus_disjoint_noop": ("SELECT ?r WHERE { ?r :r_name ?n MINUS { ?x :n_name ?y } }", "SELECT 'urn:t:region/' || r_regionkey AS r FROM region"),
    "exists_semi": ('SELECT ?pr (COUNT(*) AS ?n) WHERE { ?o :o_orderpriority ?pr FILTER EXISTS { ?l :l_order ?o ; :l_returnflag "R" } } GROUP BY ?pr', "SELECT o_orderpriority AS pr, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1"),
    "not_exists_anti": ("SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?total) WHERE { ?c :c_acctbal ?b FILTER NOT EXISTS { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > 100000) } }", "SELECT count(*) AS n, coalesce(sum(c_acctbal), 0) AS total FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    "exists_correlated_filter": ("SELECT ?s WHERE { ?s :s_acctbal ?b FILTER EXISTS { ?x :s_acctbal ?y ; :s_nation ?n . ?s :s_nation ?n FILTER(?y > ?b) } }", "SELECT 'urn:t:supplier/' || s.s_suppkey AS s FROM supplier s WHERE EXISTS (SELECT 1 FROM supplier x WHERE x.s_nationkey = s.s_nationkey AND x.s_acctbal > s.s_acctbal)"),
    "exists_in_or": ("SELECT ?c WHERE { ?c :c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > 400000) }) }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "exists_in_projection": ("SELECT ?n (EXISTS { ?s :s_nation ?x ; :s_acctbal ?b FILTER(?b < 0) } AS ?has) WHERE { ?x :n_name ?n }", "SELECT n_name AS n, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS has FROM nation"),
    "exists_nested": ("SELECT ?n WHERE { ?x :n_name ?n FILTER EXISTS { ?c :c_nation ?x FILTER NOT EXISTS { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > 250000) } } }", "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000))"),
    "union_bag": ("SELECT ?name WHERE { { ?x :n_name ?name } UNION { ?y :r_name ?name } UNION { ?z :n_name ?name } }", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation"),
    "union_hetero_vars": ("SELECT ?a ?b WHERE { { ?x :s_name ?a ; :s_acctbal ?v FILTER(?v > 9000) } UNION { ?y :c_name ?b ; :c_acctbal ?w FILTER(?w > 9900) } }", "SELECT s_name AS a, CAST(NULL AS VARCHAR) AS b FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT NULL, c_name FROM customer WHERE c_acctbal > 9900"),
    "union_joined": ("SELECT ?k (COUNT(*) AS ?n) WHERE { { ?c :c_nation ?na } UNION { ?c :s_nation ?na } ?na :n_name ?k } GROUP BY ?k", "SELECT n_name AS k, count(*) AS n FROM (SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON x = n_nationkey GROUP BY 1"),
    "values_join": ('SELECT ?n ?r WHERE { VALUES ?r { "ASIA" "EUROPE" } ?x :n_region ?y ; :n_name ?n . ?y :r_name ?r }', "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')"),
    "values_undef": ('SELECT ?st ?pr (COUNT(*) AS ?n) WHERE { ?o :o_orderstatus ?st ; :o_orderpriority ?pr } GROUP BY ?st ?pr HAVING(COUNT(*) > 0) VALUES (?st ?pr) { ("F" UNDEF) (UNDEF "1-URGENT") }', "SELECT o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n FROM orders JOIN (VALUES ('F', NULL), (NULL, '1-URGENT')) AS v(a, b) ON (a IS NULL OR a = o_orderstatus) AND (b IS NULL OR b = o_orderpriority) GROUP BY 1, 2"),
    "bind_extend": ("SELECT ?p ?w WHERE { ?x :p_partkey ?p ; :p_retailprice ?r ; :p_size ?z BIND(?r * ?z AS ?w) FILTER(?w > 20000) }", "SELECT p_partkey AS p, p_retailprice * p_size AS w FROM part WHERE p_retailprice * p_size > 20000"),
    "bind_error_unbound": ("SELECT ?r ?v WHERE { ?x :r_name ?r ; :r_regionkey ?k BIND(10 / ?k AS ?q) BIND(xsd:double(?q) AS ?v) }", "SELECT r_name AS r, CASE WHEN r_regionkey <> 0 THEN round(10.0 / r_regionkey, 12)::DOUBLE END AS v FROM region"),
    "distinct": ("SELECT DISTINCT ?st ?pr WHERE { ?o :o_orderstatus ?st ; :o_orderpriority ?pr }", "SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS pr FROM orders"),
    "reduced": ("SELECT REDUCED ?m WHERE { ?c :c_mktsegment ?m }", "SELECT DISTINCT c_mktsegment AS m FROM customer"),
    "distinct_order_hidden": ("SELECT DISTINCT ?m WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b } ORDER BY DESC(?b) LIMIT 2", "SELECT c_mktsegment AS m FROM customer GROUP BY 1 ORDER BY max(c_acctbal) DESC LIMIT 2"),
    "order_desc_nulls": ("SELECT ?c ?t WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_cust ?c ; :o_totalprice ?t } } ORDER BY DESC(?t) ?k LIMIT 30", "SELECT 'urn:t:customer/' || c_custkey AS c, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey ORDER BY t DESC NULLS LAST, c_custkey LIMIT 30"),
    "limit_offset": ("SELECT ?k ?n WHERE { ?c :c_custkey ?k ; :c_name ?n } ORDER BY ?k LIMIT 20 OFFSET 35", "SELECT c_custkey AS k, c_name AS n FROM customer ORDER BY k LIMIT 20 OFFSET 35"),
    "subquery_agg_join": ("SELECT ?n ?top WHERE { { SELECT ?x (MAX(?b) AS ?top) WHERE { ?c :c_nation ?x ; :c_acctbal ?b } GROUP BY ?x } ?x :n_name ?n }", "SELECT n_name AS n, top FROM (SELECT c_nationkey AS x, max(c_acctbal) AS top FROM customer GROUP BY 1) JOIN nation ON x = n_nationkey"),
    "subquery_limit": ("SELECT ?cn ?o WHERE { { SELECT ?c ?b WHERE { ?c :c_acctbal ?b ; :c_custkey ?k } ORDER BY DESC(?b) ?k LIMIT 5 } ?c :c_name ?cn . ?o :o_cust ?c }", "SELECT c_name AS cn, 'urn:t:orders/' || o_orderkey AS o FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) JOIN orders ON o_custkey = c_custkey"),
    "having": ("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :o_cust ?c ; :o_totalprice ?t } GROUP BY ?c HAVING(COUNT(?o) > 15 && MAX(?t) > 200000)", "SELECT 'urn:t:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 200000"),
    "group_expr_alias": ("SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y) (MONTH(?d) AS ?m)", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2"),
    "implicit_group_empty": ('SELECT (COUNT(*) AS ?n) (SUM(?t) AS ?s) (MIN(?t) AS ?low) WHERE { ?o :o_totalprice ?t ; :o_orderstatus "none" }', "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS s, min(o_totalprice) AS low FROM orders WHERE o_orderstatus = 'none'"),
    "group_empty": ('SELECT ?st (COUNT(*) AS ?n) WHERE { ?o :o_orderstatus ?st FILTER(?st = "none") } GROUP BY ?st', "SELECT o_orderstatus AS st, count(*) AS n FROM orders WHERE o_orderstatus = 'none' GROUP BY 1"),
    "count_distinct": ("SELECT ?st (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :o_orderstatus ?st ; :o_cust ?c } GROUP BY ?st", "SELECT o_orderstatus AS st, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "count_distinct_star": ("SELECT (COUNT(DISTINCT *) AS ?n) WHERE { { ?o :o_orderstatus ?st ; :o_orderpriority ?pr } { SELECT ?o WHERE { ?o :o_totalprice ?t FILTER(?t > 100000) } } }", "SELECT count(DISTINCT (o_orderkey, o_orderstatus, o_orderpriority)) AS n FROM orders WHERE o_totalprice > 100000"),
    "sum_avg_min_max": ("SELECT ?b (SUM(?z) AS ?s) (xsd:double(AVG(?r)) AS ?a) (MIN(?r) AS ?low) (MAX(?r) AS ?high) (SUM(DISTINCT ?z) AS ?ds) WHERE { ?p :p_brand ?b ; :p_size ?z ; :p_retailprice ?r } GROUP BY ?b", "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS s, avg(p_retailprice) AS a, min(p_retailprice) AS low, max(p_retailprice) AS high, CAST(sum(DISTINCT p_size) AS BIGINT) AS ds FROM part GROUP BY 1"),
    "sample_single": ("SELECT ?r (SAMPLE(?n) AS ?name) WHERE { ?r :r_name ?n } GROUP BY ?r", "SELECT 'urn:t:region/' || r_regionkey AS r, min(r_name) AS name FROM region GROUP BY r_regionkey"),
    "group_concat_sorted": ('SELECT ?rn (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?names) WHERE { ?x :n_region ?r ; :n_name ?n . ?r :r_name ?rn } GROUP BY ?rn', "SELECT r_name AS rn, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_expression": ("SELECT ?m ((SUM(?b) - MIN(?b)) / COUNT(?b) AS ?v) WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b } GROUP BY ?m", "SELECT c_mktsegment AS m, (sum(c_acctbal) - min(c_acctbal)) / count(*) AS v FROM customer GROUP BY 1"),
    "str_functions": ("SELECT ?n (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (SUBSTR(?n, 2, 3) AS ?sub) (CONCAT(?n, \"-\", STR(?k)) AS ?c) WHERE { ?x :n_name ?n ; :n_nationkey ?k }", "SELECT n_name AS n, CAST(length(n_name) AS BIGINT) AS len, upper(n_name) AS up, lower(n_name) AS low, substr(n_name, 2, 3) AS sub, n_name || '-' || n_nationkey AS c FROM nation"),
    "contains_starts_ends": ('SELECT ?t WHERE { ?p :p_type ?t FILTER(CONTAINS(?t, "A") && (STRSTARTS(?t, "S") || STRENDS(?t, "L"))) }', "SELECT p_type AS t FROM part WHERE contains(p_type, 'A') AND (starts_with(p_type, 'S') OR ends_with(p_type, 'L'))"),
    "strbefore_after": ('SELECT ?n (STRBEFORE(?n, "#") AS ?a) (STRAFTER(?n, "#") AS ?b) (STRBEFORE(?n, "zzz") AS ?none) WHERE { ?c :c_name ?n }', "SELECT c_name AS n, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS a, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS b, '' AS none FROM customer"),
    "regex": ('SELECT ?n WHERE { ?x :n_name ?n FILTER REGEX(?n, "^n.*_1[0-9]$", "i") }', "SELECT n_name AS n FROM nation WHERE regexp_matches(n_name, '^n.*_1[0-9]$', 'i')"),
    "replace": ('SELECT ?n (REPLACE(?n, "([AEIOU])", "<$1>") AS ?v) WHERE { ?x :n_name ?n }', "SELECT n_name AS n, regexp_replace(n_name, '([AEIOU])', '<\\1>', 'g') AS v FROM nation"),
    "encode_uri": ('SELECT ?v WHERE { ?x :r_name ?n BIND(ENCODE_FOR_URI(CONCAT(?n, " a/b~*")) AS ?v) }', "SELECT replace(r_name, ' ', '%20') || '%20a%2Fb~%2A' AS v FROM region"),
    "hashes": ("SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x :n_name ?n }", "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "date_components": ("SELECT ?e (YEAR(?t) AS ?y) (MONTH(?t) AS ?mo) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?mi) (TZ(?t) AS ?tz) WHERE { GRAPH <urn:g:log> { ?x :events_event_id ?e ; :events_ts ?t } }", "SELECT event_id AS e, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, '' AS tz FROM events"),
    "date_range_filter": ('SELECT (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d FILTER(?d >= "1996-01-01T00:00:00"^^xsd:dateTime && ?d < "1996-04-01T00:00:00"^^xsd:dateTime) }', "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'"),
    "casts": ("SELECT ?k (xsd:integer(?r) AS ?i) (xsd:double(STR(?k)) AS ?d) (xsd:string(?k) AS ?s) (xsd:boolean(?z - 1) AS ?b) WHERE { ?p :p_partkey ?k ; :p_retailprice ?r ; :p_size ?z }", "SELECT p_partkey AS k, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_partkey AS DOUBLE) AS d, CAST(p_partkey AS VARCHAR) AS s, p_size - 1 <> 0 AS b FROM part"),
    "round_family": ("SELECT ?k (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ABS(?b) AS ?a) WHERE { ?x :c_custkey ?k ; :c_acctbal ?b }", "SELECT c_custkey AS k, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, abs(c_acctbal) AS a FROM customer"),
    "arithmetic": ("SELECT ?k (?z * 2 + 1 AS ?i) (xsd:double(?z / 4) AS ?q) (-?r AS ?m) WHERE { ?p :p_partkey ?k ; :p_size ?z ; :p_retailprice ?r }", "SELECT p_partkey AS k, CAST(p_size * 2 + 1 AS BIGINT) AS i, p_size / 4.0::DOUBLE AS q, -p_retailprice AS m FROM part"),
    "if_coalesce": ('SELECT ?k (IF(?b < 0, "debt", "ok") AS ?v) (COALESCE(?t, -1.0e0) AS ?w) WHERE { ?c :c_custkey ?k ; :c_acctbal ?b OPTIONAL { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > 350000) } }', "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS v, coalesce(o_totalprice, -1.0) AS w FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000"),
    "in_notin": ('SELECT ?n WHERE { ?x :n_nationkey ?k ; :n_name ?n FILTER(?k IN (1, 3, 5, 7) || (?k > 15 && ?k NOT IN (20, 21))) }', "SELECT n_name AS n FROM nation WHERE n_nationkey IN (1, 3, 5, 7) OR (n_nationkey > 15 AND n_nationkey NOT IN (20, 21))"),
    "logic_3vl": ("SELECT ?c WHERE { ?c :c_custkey ?k ; :c_acctbal ?b OPTIONAL { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > 380000) } FILTER(?t > 0 || ?b > 9500) FILTER(!(?b < 0 && ?t < 0)) }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 380000 WHERE (o_totalprice > 0 OR c_acctbal > 9500) AND NOT (c_acctbal < 0 AND o_totalprice < 0)"),
    "bound_filter": ("SELECT ?c WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_cust ?c ; :o_totalprice ?t FILTER(?t > 300000) } FILTER(!BOUND(?o)) }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "term_tests": ("SELECT (isIRI(?c) AS ?i) (isLITERAL(?n) AS ?l) (isNUMERIC(?b) AS ?m) (isBLANK(?c) AS ?k) (DATATYPE(?b) AS ?t) (LANG(?n) AS ?g) (COUNT(*) AS ?cnt) WHERE { ?c :c_name ?n ; :c_acctbal ?b } GROUP BY (isIRI(?c) AS ?i) (isLITERAL(?n) AS ?l) (isNUMERIC(?b) AS ?m) (isBLANK(?c) AS ?k) (DATATYPE(?b) AS ?t) (LANG(?n) AS ?g)".replace("(isIRI(?c) AS ?i) (isLITERAL(?n) AS ?l) (isNUMERIC(?b) AS ?m) (isBLANK(?c) AS ?k) (DATATYPE(?b) AS ?t) (LANG(?n) AS ?g) (COUNT", "?i ?l ?m ?k ?t ?g (COUNT", 1), "SELECT true AS i, true AS l, true AS m, false AS k, 'http://www.w3.org/2001/XMLSchema#double' AS t, '' AS g, count(*) AS cnt FROM customer"),
    "type_pattern": ("SELECT ?x WHERE { ?x a :Region }", "SELECT 'urn:t:region/' || r_regionkey AS x FROM region"),
    "constant_subject": ("SELECT ?n ?r WHERE { <urn:t:nation/7> :n_name ?n ; :n_region ?r }", "SELECT n_name AS n, 'urn:t:region/' || n_regionkey AS r FROM nation WHERE n_nationkey = 7"),
    "variable_predicate": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a :Nation } GROUP BY ?p", "SELECT p, count(*) AS n FROM nation, (VALUES ('urn:t:n_nationkey'), ('urn:t:n_name'), ('urn:t:n_regionkey'), ('urn:t:n_region'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type')) AS v(p) GROUP BY 1"),
    "cross_join": ("SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b FILTER(?a < ?b) }", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y WHERE x.r_name < y.r_name"),
    "path_seq": ("SELECT ?o ?rn WHERE { ?o :o_cust/:c_nation/:n_region/:r_name ?rn }", "SELECT 'urn:t:orders/' || o_orderkey AS o, r_name AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "join_order_shuffled": (
        'SELECT ?nn (SUM(?p * (1 - ?d)) AS ?revenue) WHERE { ?l :l_discount ?d ; :l_extendedprice ?p . ?s :s_nation ?n . ?l :l_supp ?s . ?o :o_cust ?c . ?l :l_order ?o . ?n :n_name ?nn . ?c :c_nation ?n . ?r :r_name "ASIA" . ?n :n_region ?r } GROUP BY ?nn',
        "SELECT n_name AS nn, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey WHERE r_name = 'ASIA' GROUP BY 1",
    ),
    "constant_object": ("SELECT ?c ?b WHERE { ?c :c_nation <urn:t:nation/3> ; :c_acctbal ?b }", "SELECT 'urn:t:customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_nationkey = 3"),
    "constant_composite_subject": ("SELECT ?r ?t WHERE { <urn:t:conversations/1/0> :conversations_role ?r ; :conversations_text ?t }", "SELECT role AS r, text AS t FROM conversations WHERE conv_id = 1 AND turn = 0"),
    "path_alt": ("SELECT ?x ?n WHERE { ?x (:n_name|:r_name) ?n }", "SELECT 'urn:t:nation/' || n_nationkey AS x, n_name AS n FROM nation UNION SELECT 'urn:t:region/' || r_regionkey, r_name FROM region"),
    "path_inverse": ("SELECT ?r ?n WHERE { ?r ^:n_region/:n_name ?n }", "SELECT 'urn:t:region/' || n_regionkey AS r, n_name AS n FROM nation"),
    "path_plus": ("SELECT ?c ?x WHERE { ?c :c_acctbal ?b FILTER(?b < 0) ?c (:c_nation|:n_region)+ ?x }", "SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:nation/' || c_nationkey AS x FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'urn:t:customer/' || c_custkey, 'urn:t:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0"),
    "path_star": ("SELECT ?x WHERE { <urn:t:nation/3> (:n_region|^:n_region)* ?x }", "SELECT 'urn:t:nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) UNION SELECT 'urn:t:region/' || n_regionkey FROM nation WHERE n_nationkey = 3"),
    "path_optional": ("SELECT ?x WHERE { <urn:t:nation/4> :n_region? ?x }", "SELECT 'urn:t:nation/4' AS x UNION SELECT 'urn:t:region/' || n_regionkey FROM nation WHERE n_nationkey = 4"),
    "path_negated": ("SELECT ?v WHERE { <urn:t:region/2> !(:r_name|:r_regionkey) ?v }", "SELECT 'urn:t:Region' AS v"),
    "path_recursive_chain": ("SELECT (COUNT(*) AS ?n) WHERE { ?a (^:n_region/:n_region)+ ?b }", "SELECT count(DISTINCT n_regionkey) AS n FROM nation"),
    "graph_named": ("SELECT ?n WHERE { GRAPH <urn:g:geo> { ?x :n_name ?n } }", "SELECT n_name AS n FROM nation"),
    "graph_var": ("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x a ?t } } GROUP BY ?g", "SELECT 'urn:g:geo' AS g, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'urn:g:log', count(*) FROM events"),
    "from_merge": ("SELECT ?n ?r FROM <urn:g:geo> WHERE { ?x :n_name ?n ; :n_region/:r_name ?r }", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "from_named": ("SELECT ?g ?n FROM NAMED <urn:g:geo> WHERE { GRAPH ?g { ?x :r_name ?n } }", "SELECT 'urn:g:geo' AS g, r_name AS n FROM region"),
    "service_local": ("SELECT ?n WHERE { SERVICE <urn:svc:none> { ?x :r_name ?n } }", "SELECT r_name AS n FROM region"),
    "documents_lang": ("SELECT ?lang (COUNT(*) AS ?n) (SUM(?c) AS ?chars) WHERE { ?d :documents_lang ?lang ; :n_chars ?c } GROUP BY ?lang", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1"),
    "labels_join_docs": ("SELECT ?s (COUNT(*) AS ?n) WHERE { ?l :labels_doc_id ?i ; :labels_toxic 1 . ?d :documents_doc_id ?i ; :documents_source ?s } GROUP BY ?s", "SELECT source AS s, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY 1"),
    "events_hourly": ("SELECT ?t ?h (COUNT(*) AS ?n) (AVG(?v) AS ?mean) WHERE { ?e :events_ts ?ts ; :events_value ?v ; :event_type ?t } GROUP BY ?t (HOURS(?ts) AS ?h)", "SELECT event_type AS t, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2"),
    "conversation_turns": ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?a :conversations_conv_id ?c ; :conversations_turn ?i ; :conversations_role \"user\" . ?b :conversations_conv_id ?c ; :conversations_turn ?j ; :conversations_role \"assistant\" FILTER(?j = ?i + 1) } GROUP BY ?c", "SELECT a.conv_id AS c, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' GROUP BY 1"),
    "pages_hosts": ('SELECT ?h (COUNT(*) AS ?n) WHERE { ?p :pages_url ?u BIND(REPLACE(?u, "^[a-z]+://([^/?#]*).*$", "$1") AS ?h) } GROUP BY ?h', "SELECT regexp_replace(url, '^[a-z]+://([^/?#]*).*$', '\\1') AS h, count(*) AS n FROM pages GROUP BY 1"),
}

#: Result columns that SPARQL makes integers where SQL keeps narrower ones.
WIDE = {"group_expr_alias": ("y", "m"), "date_components": ("y", "mo", "d", "h", "mi"), "events_hourly": ()}


def run_select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Engine(star_schema(spark, sf_dir)).select(PREFIX + text)


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_select(spark, sf_dir, SELECTS[name][0])


def _spell(triples: DataFrame) -> DataFrame:
    return triples.select(R.nt_column(triples["s"]).alias("s"), triples["p"].alias("p"), R.nt_column(triples["o"]).alias("o"))


def ask_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(star_schema(spark, sf_dir)).ask_frame(PREFIX + "ASK { ?c :c_acctbal ?b FILTER(?b < -900) }")


def construct_spo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spell(Engine(star_schema(spark, sf_dir)).construct(PREFIX + "CONSTRUCT { ?r :has ?n } WHERE { ?n :n_region ?r }"))


def describe_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spell(Engine(star_schema(spark, sf_dir, ("region", "nation"))).describe("DESCRIBE <urn:t:region/1>"))


def _geo_quads(spark: SparkSession, sf_dir: str) -> Engine:
    """Nations and regions as stored quads: the update and generic-term paths."""
    virtual = star_schema(spark, sf_dir, ("region", "nation"))
    return Engine(Catalog(spark, virtual.map_tables([]).all_quads().where("g is null")))


def quads_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geo_quads(spark, sf_dir).select(PREFIX + "SELECT ?n (STR(?k + 1) AS ?next) WHERE { ?x :n_name ?n ; :n_nationkey ?k ; :n_region/:r_name \"ASIA\" FILTER(?k > 1) }")


def update_insert_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _geo_quads(spark, sf_dir).update(PREFIX + "INSERT { ?r :size ?c } WHERE { { SELECT ?r (COUNT(*) AS ?c) WHERE { ?n :n_region ?r } GROUP BY ?r } }")
    return done.select(PREFIX + "SELECT ?n (xsd:integer(?c) AS ?size) WHERE { ?r :r_name ?n ; :size ?c }")


def update_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _geo_quads(spark, sf_dir).update(PREFIX + 'DELETE { ?r :r_name ?n } INSERT { ?r :r_name ?m } WHERE { ?r :r_name ?n BIND(LCASE(?n) AS ?m) FILTER(STRSTARTS(?n, "A")) } ; DELETE WHERE { ?x :n_regionkey ?k } ; CLEAR GRAPH <urn:g:none>')
    return done.select(PREFIX + "SELECT ?n (COUNT(?k) AS ?keys) WHERE { ?r :r_name ?n OPTIONAL { ?x :n_regionkey ?k } } GROUP BY ?n")


def update_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _geo_quads(spark, sf_dir).update("ADD DEFAULT TO <urn:g:a> ; MOVE <urn:g:a> TO <urn:g:b> ; COPY <urn:g:b> TO <urn:g:c> ; DROP GRAPH <urn:g:b>")
    return done.select("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


OTHERS: dict[str, tuple[Callable, str]] = {
    "ask_bool": (ask_bool, "SELECT count(*) > 0 AS result FROM customer WHERE c_acctbal < -900"),
    "construct_spo": (construct_spo, "SELECT '<urn:t:region/' || n_regionkey || '>' AS s, 'urn:t:has' AS p, '<urn:t:nation/' || n_nationkey || '>' AS o FROM nation"),
    "describe_iri": (describe_iri, """SELECT '<urn:t:region/1>' AS s, p, o FROM (SELECT 'urn:t:r_name' AS p, '"' || r_name || '"' AS o FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'urn:t:r_regionkey', '"1"^^<http://www.w3.org/2001/XMLSchema#integer>' UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '<urn:t:Region>')"""),
    "quads_select": (quads_select, "SELECT n_name AS n, CAST(n_nationkey + 1 AS VARCHAR) AS next FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey > 1"),
    "update_insert_where": (update_insert_where, "SELECT r_name AS n, count(*) AS size FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "update_delete_insert": (update_delete_insert, "SELECT CASE WHEN r_name LIKE 'A%' THEN lower(r_name) ELSE r_name END AS n, CAST(0 AS BIGINT) AS keys FROM region"),
    "update_graphs": (update_graphs, "SELECT 'urn:g:c' AS g, 5 * (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM region) AS n"),
}

QUERIES = {name: _select(name) for name in SELECTS} | {name: f for name, (f, _) in OTHERS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in SELECTS.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
