"""Plan-shape guards for the scale properties (read from explain output)."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from wardlake.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    """The operator tree of the formatted physical plan (without the details)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0]


def details(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    q = all_queries()
    return {name: plan(fn(spark, SF)) for name, (fn, _) in q.items() if not name.startswith("stream_")}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_date_window_reaches_the_scan(spark):
    p = details(E.queries()["income_summary"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,2001-07-01" in p
    assert "o_orderpriority" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_top_n_is_limited_before_the_shuffle(plans):
    for name in ("top_illnesses_week_by_clinic", "ai_quota_admission", "trends_bundle_top"):
        assert plans[name].count("WindowGroupLimit") >= 2, name


def test_latest_per_key_is_an_aggregate_not_a_window(plans):
    for name in ("latest_order_per_medication", "refills_due", "settings_upsert", "apply_appointment_status"):
        assert "Window" not in plans[name], name


def test_ledger_result_reads_the_written_pass(plans):
    p = plans["stock_ledger_apply"]
    assert "MapInPandas" not in p and "Window" not in p and p.count("MapInArrow") <= 1
