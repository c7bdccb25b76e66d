import math

import duckdb
import pytest

import __spark_entry__
from quadlake import queries, term_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "star_q1 scan_filter join_fk_chain q5_region optional_filter_cond minus_anti exists_correlated_filter exists_in_or exists_nested union_hetero_vars values_undef bind_error_unbound "
    "distinct_order_hidden subquery_agg_join having count_distinct_star group_concat_sorted str_functions casts logic_3vl variable_predicate path_plus path_star graph_var from_merge "
    "construct_spo describe_iri update_delete_insert events_hourly"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v if not isinstance(v, float) else "nan" if math.isnan(v) else round(v, 3)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    expected = duck.execute(queries.ORACLE_SQL[name])
    assert df.columns == [d[0] for d in expected.description]
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(term_queries.QUERIES))
def test_term_query_matches_rows(spark, duck, name):
    df = term_queries.QUERIES[name](spark, SF)
    expected = duck.execute(term_queries.ORACLE_SQL[name])
    want = sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)
    assert df.columns == [d[0] for d in expected.description] and want
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.queries())


def test_star_is_one_scan(spark):
    execution = queries.QUERIES["star_q1"](spark, SF)._jdf.queryExecution()
    plan = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")
    scans = [x for x in plan.splitlines() if x.startswith("ReadSchema")]
    assert len(scans) == 1 and "l_quantity" in scans[0] and "l_tax" not in scans[0]
    assert "PushedFilters: [IsNotNull(" in plan and "l_shipdate" in plan
