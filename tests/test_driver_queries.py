"""Registered queries against their DuckDB oracles on the smallest driver data
(the full catalogue runs with ``tools/compare.py`` at sf0.01), plus the
contract functions of ``__spark_entry__``."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, canon
from wardlake.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["income_summary", "refills_due", "stock_ledger_apply", "outstanding_balances", "monthly_visit_trends",
          "ingest_visits", "license_apply", "export_csv_visits", "visit_receipts", "trends_bundle",
          "ai_quota_admission", "needs_attention", "dashboard_summary_by_clinic", "stock_ledger_by_clinic",
          "license_feed_entries"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(ocols, res.fetchall())


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() == 1
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
    assert set(all_queries()) <= set(o)   # every query of the catalogue has an oracle
