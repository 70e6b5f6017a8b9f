"""Every registered query that has SQL gives the rows of its SQL; plans keep their shape."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_point
from sitelens import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")
    return value


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    want = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    rows = entry_point.queries()[name](spark, sf_dir)
    assert rows.columns and rows.count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert {r["field"] for r in df.collect()} == set(plans.documents.C.FIELDS)


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plans.QUERIES["url_canonical"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan and "Python" not in plan
    plan = plans.QUERIES["ledger_find"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_provenance_limit_is_applied_before_the_shuffle(spark, sf_dir):
    df = plans.QUERIES["doc_email_top10_provenance"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)
