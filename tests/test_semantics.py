"""Edge rules of dates, text matching and number printing."""

import datetime as dt

from pyspark.sql import functions as F

from wardlake.functions import semantics as S


def test_week_starts_monday_and_sunday_belongs_to_previous_week():
    assert S.week_start(dt.date(2026, 8, 14)) == dt.date(2026, 8, 10)   # Friday
    assert S.week_start(dt.date(2026, 8, 10)) == dt.date(2026, 8, 10)   # Monday
    assert S.week_start(dt.date(2026, 8, 16)) == dt.date(2026, 8, 10)   # Sunday


def test_month_arithmetic_overflows_like_the_application():
    assert S.add_months_overflow(dt.date(2026, 8, 31), -6) == dt.date(2026, 3, 3)
    assert S.add_months_overflow(dt.date(2026, 10, 31), 1) == dt.date(2026, 12, 1)
    assert S.add_months_overflow(dt.date(2026, 1, 15), 10) == dt.date(2026, 11, 15)
    assert S.month_labels(dt.date(2026, 2, 10), 6) == ["2025-09", "2025-10", "2025-11", "2025-12", "2026-01",
                                                        "2026-02"]


def test_column_month_overflow_matches_scalar(spark):
    df = spark.createDataFrame([(dt.date(2026, 8, 31), -6), (dt.date(2026, 10, 31), 1), (dt.date(2024, 1, 31), 1)],
                               "d date, n int")
    got = [r[0] for r in df.select(S.col_add_months_overflow(F.col("d"), F.col("n"))).collect()]
    assert got == [dt.date(2026, 3, 3), dt.date(2026, 12, 1), dt.date(2024, 3, 2)]


def test_like_folds_ascii_only_and_keeps_wildcards(spark):
    df = spark.createDataFrame([("MARY",), ("Émile",), ("émile",), ("a_b",), ("axb",), ("c\\d",)], "s string")

    def hits(term):
        return sorted(r[0] for r in df.where(S.like_ascii(F.col("s"), term)).collect())

    assert hits(" mar ") == ["MARY"]
    assert hits("émile") == ["émile"]             # É is not folded
    assert hits("a_b") == ["a_b", "axb"]            # _ stays a wildcard
    assert hits("c\\d") == ["c\\d"]                 # backslash is literal


def test_required_optional_and_numbers(spark):
    df = spark.createDataFrame([("  ",), (" ",), (" x ",), ("",), (None,), (" 12.5 ",), ("abc",)], "s string")
    got = df.select(S.present(F.col("s")).alias("p"), S.opt_text(F.col("s")).alias("o"),
                    S.number_or_zero(F.col("s")).alias("z"), S.number_or_null(F.col("s")).alias("n")).collect()
    assert [r.p for r in got] == [False, False, True, False, False, True, True]
    assert [r.o for r in got] == ["  ", " ", " x ", None, None, " 12.5 ", "abc"]
    assert [float(r.z) for r in got] == [0, 0, 0, 0, 0, 12.5, 0]
    assert [r.n for r in got] == [None, None, None, None, None, 12.5, None]


def test_number_and_money_text(spark):
    df = spark.createDataFrame([(38.0, "38.00", "-5"), (38.5, "15.50", "12"), (65.4, "1234567.80", "0.1")],
                               "d double, m string, b string")
    got = df.select(S.js_number_text(F.col("d")).alias("n"),
                    S.js_decimal_text(F.col("m").cast("decimal(18,2)")).alias("j"),
                    S.money_text(F.col("b").cast("decimal(18,2)")).alias("money")).collect()
    assert [r.n for r in got] == ["38", "38.5", "65.4"]
    assert [r.j for r in got] == ["38", "15.5", "1234567.8"]
    assert [r.money for r in got] == ["$-5.00", "$12.00", "$0.10"]
