import duckdb
import pytest

import __spark_entry__ as entry
from ravelin.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.sql(plans.SQL[name])
    assert sorted(expected.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.SQL) <= set(entry.oracle_sql())


def test_no_python_in_the_plans(spark):
    for name in ("city_stars", "frequent_k2", "similar_pairs", "user_cf_predict"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
