"""Every registered operator with an oracle against DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quern import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("key", sorted(catalog.oracle_sql()))
def test_operator_matches_oracle(spark, duck, key):
    got = catalog.queries()[key](spark, SF)
    want = duck.sql(catalog.oracle_sql()[key])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_entry_runs_without_the_training_data_package(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_outer_joins_and_exists_over_whole_tables(spark, duck):
    run = lambda key: [tuple(r) for r in catalog.queries()[key](spark, SF).collect()]
    customers = {r[0] for r in duck.sql("select c_custkey from customer").fetchall()}
    orders = {r[0] for r in duck.sql("select o_orderkey from orders").fetchall()}
    left, right, full = run("join_left"), run("join_right"), run("join_full")
    assert {c for c, _ in left} == {c for _, c in right} == customers and any(o is None for _, o in left)
    assert {o for o, _ in full} - {None} == orders and {c for _, c in full} - {None} == customers
    assert sum(c is None for _, c in full) == len(orders) - sum(o is not None for _, o in left) > 0
    assert {r[0] for r in run("pred_exists")} == customers


@pytest.mark.parametrize("key,table", [("sort_multi", "orders"), ("sort_expr", "orders"), ("sort_nulls", "orders"), ("sorter", "lineitem"), ("scan_reverse", "orders")])
def test_sorts_return_whole_tables_in_order(spark, duck, key, table):
    got = [tuple(r) for r in catalog.queries()[key](spark, SF).collect()]
    assert got == duck.sql(catalog.oracle_sql()[key]).fetchall()
    assert len(got) == duck.sql(f"select count(*) from {table}").fetchall()[0][0]


def test_unicode_of_odd_texts_matches_its_sql(spark, tmp_path):
    texts = ["", None, " ", "a", "\u00e9", "e\u0301", "\u0301e", "\ufeffx", "\U0001f600", "\x00a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["fn_unicode"]).fetchall()
    got = catalog.queries()["fn_unicode"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("a", "int"), ("b", "int")]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert want[:2] == [(0, -1, None), (1, None, None)]
