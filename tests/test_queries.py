"""Every registered query against its SQL counterpart."""

import duckdb
import pytest

import __spark_entry__ as driver
from dossier.plans.oracles import ORACLES
from dossier.plans.queries import QUERIES as OWN
from dossier.plans.standins import TABLES

QUERIES = {name: query for name, query in driver.queries().items() if name in OWN}
DUCK_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(OWN) == set(QUERIES) == set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    answer = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in answer.description}
    assert {c: DUCK_TYPES[t] for c, t in frame.dtypes} == types
    order = [list(types).index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in answer.fetchall())
    assert want
    assert got == want


def test_school_lines_read_no_orders(spark, sf_dir):
    plan = QUERIES["education_lines"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


@pytest.mark.parametrize("name", ["intake_gates", "run_summary"])
def test_uploads_are_read_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1


def test_stated_columns_equal_the_files(spark, sf_dir):
    for name, columns in TABLES.items():
        stated = spark.read.schema(columns).parquet(f"{sf_dir}/{name}.parquet").dtypes
        assert stated == spark.read.parquet(f"{sf_dir}/{name}.parquet").dtypes, name


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["person_id", "card_set", "card_1", "card_2", "card_3", "card_4"]
    assert frame.count() == 160
