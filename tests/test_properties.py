"""Property tests for the semantics layer: column forms agree with the scalar
rules on random inputs (each example is one batch in one DataFrame)."""

import datetime as dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlake.functions import semantics as S

dates = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2040, 12, 31))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(dates, st.integers(min_value=-24, max_value=24)), min_size=1, max_size=200))
def test_month_overflow_column_equals_scalar(spark, pairs):
    df = spark.createDataFrame(pairs, "d date, n int")
    got = [r[0] for r in df.select(S.col_add_months_overflow(F.col("d"), F.col("n"))).collect()]
    assert got == [S.add_months_overflow(d, n) for d, n in pairs]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=2, allow_nan=False), min_size=1, max_size=200))
def test_decimal_text_round_trips_without_trailing_zeros(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,2)")
    got = [r[0] for r in df.select(S.js_decimal_text(F.col("x"))).collect()]
    for v, text in zip(values, got):
        assert Decimal(text) == v
        assert "e" not in text.lower() and not (("." in text) and text.endswith("0")) and not text.endswith(".")


@settings(max_examples=5, deadline=None)
@given(st.lists(dates, min_size=1, max_size=50))
def test_week_start_is_the_monday_on_or_before(spark, ds):
    for d in ds:
        w = S.week_start(d)
        assert w.weekday() == 0 and 0 <= (d - w).days <= 6
