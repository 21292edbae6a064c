"""Counts, sums, top-k and month spines.

Windows follow the application's calendar: the week starts on Monday, "this
week" and "this month" have no upper bound (future-dated rows count), and the
trend window starts on the first of the month five months back. Bounds are
computed once on the driver from ``as_of``; the predicates compare the raw
date column to a literal so they reach the parquet scan.

Every aggregate here is partial-aggregated before its shuffle, so a hot
clinic or complaint costs one row per map task, not one task's worth of rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import add_months_overflow, local_datetime, month_labels, month_start, week_start
from ..schemas import TOP_ILLNESSES_6M, TOP_ILLNESSES_WEEK, TREND_MONTHS


def _money(c):
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(28,2)"))


def fill_clinics(numbers: DataFrame, clinics: DataFrame | None, tenant: Sequence[str]) -> DataFrame:
    """``numbers`` (one row per tenant) with a row of zeros for every clinic that has none. Facts
    without an owner keep their row under a NULL tenant."""
    if clinics is None or not tenant:
        return numbers
    kinds = [(c, t) for c, t in numbers.dtypes if c not in tenant]
    zeros = clinics.select(*tenant, *[F.lit(0).cast(t).alias(c) for c, t in kinds])
    return numbers.unionByName(zeros).groupBy(*tenant).agg(*[F.sum(c).cast(t).alias(c) for c, t in kinds])


def income_summary(visits: DataFrame, as_of: dt.date, tenant: Sequence[str] = (), clinics: DataFrame | None = None) -> DataFrame:
    """Paid today / this week / this month (0 when nothing), one pass over visits;
    with ``clinics`` every clinic has its row."""
    ws, ms = week_start(as_of), month_start(as_of)
    lo = min(ws, ms)
    v = visits.where(F.col("visit_date") >= F.lit(lo))
    d, amt = F.col("visit_date"), F.col("payment_amount")
    return fill_clinics(v.groupBy(*tenant).agg(
        _money(F.when(d == F.lit(as_of), amt)).alias("today"),
        _money(F.when(d >= F.lit(ws), amt)).alias("this_week"),
        _money(F.when(d >= F.lit(ms), amt)).alias("this_month"),
    ), clinics, tenant)


def patients_seen(visits: DataFrame, as_of: dt.date, tenant: Sequence[str] = (), clinics: DataFrame | None = None) -> DataFrame:
    """Distinct patients with a visit today / this week (exact).

    First reduced to one row per (clinic, patient), then counted, so the
    distinct count never expands rows per filter."""
    ws = week_start(as_of)
    per_patient = (visits.where(F.col("visit_date") >= F.lit(ws))
                   .groupBy(*tenant, "patient_id")
                   .agg(F.max((F.col("visit_date") == F.lit(as_of)).cast("int")).alias("_today")))
    seen = per_patient.groupBy(*tenant).agg(
        F.sum("_today").cast("long").alias("patients_today"),
        F.count(F.lit(1)).alias("patients_week"),
    ).select(*tenant, F.coalesce("patients_today", F.lit(0)).alias("patients_today"), "patients_week")
    return fill_clinics(seen, clinics, tenant)


def appointments_today(appointments: DataFrame, as_of: dt.date, tenant: Sequence[str] = (), clinics: DataFrame | None = None) -> DataFrame:
    a = appointments.where((F.col("status") == "Scheduled") & (F.col("appointment_date") == F.lit(as_of)))
    return fill_clinics(a.groupBy(*tenant).agg(F.count(F.lit(1)).alias("appointments_today")), clinics, tenant)


def active_staff_count(staff: DataFrame, tenant: Sequence[str] = (), clinics: DataFrame | None = None) -> DataFrame:
    return fill_clinics(staff.where(F.col("active") == 1).groupBy(*tenant).agg(F.count(F.lit(1)).alias("active_staff")), clinics, tenant)


def top_complaints(visits: DataFrame, since: dt.date, k: int, tenant: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-blank complaints since a date: count desc, then name.
    Grouping is on the raw text (case and padding kept)."""
    v = visits.where((F.col("visit_date") >= F.lit(since)) & F.col("complaint").isNotNull()
                     & (F.trim(F.col("complaint")) != ""))
    counts = v.groupBy(*tenant, "complaint").agg(F.count(F.lit(1)).alias("n"))
    if not tenant:
        return counts.orderBy(F.desc("n"), "complaint").limit(k)
    w = Window.partitionBy(*tenant).orderBy(F.desc("n"), "complaint")
    return counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def top_illnesses_week(visits: DataFrame, as_of: dt.date, k: int = TOP_ILLNESSES_WEEK,
                       tenant: Sequence[str] = ()) -> DataFrame:
    return top_complaints(visits, week_start(as_of), k, tenant)


def trend_window_start(as_of: dt.date, months: int = TREND_MONTHS) -> dt.date:
    return add_months_overflow(month_start(as_of), -(months - 1))


def top_illnesses_6m(visits: DataFrame, as_of: dt.date, k: int = TOP_ILLNESSES_6M,
                     tenant: Sequence[str] = ()) -> DataFrame:
    return top_complaints(visits, trend_window_start(as_of), k, tenant)


def month_spine(spark: SparkSession, as_of: dt.date, months: int = TREND_MONTHS,
                clinics: DataFrame | None = None, tenant: Sequence[str] = ()) -> DataFrame:
    """The last ``months`` month labels (per clinic when a tenant is given).
    The labels are a fixed-size literal array, exploded next to each clinic."""
    pairs = F.array(*[F.struct(F.lit(i).alias("month_index"), F.lit(m).alias("month"))
                      for i, m in enumerate(month_labels(as_of, months))])
    if not tenant:
        return spark.range(1).select(F.inline(pairs))
    return clinics.select(*tenant).distinct().select(*tenant, F.inline(pairs))


def monthly_visit_trends(visits: DataFrame, as_of: dt.date, months: int = TREND_MONTHS,
                         tenant: Sequence[str] = (), clinics: DataFrame | None = None) -> DataFrame:
    """Visits and income per month for exactly ``months`` months, oldest first,
    zero-filled. Months after as_of are not in the spine and drop out."""
    spark = visits.sparkSession
    after = add_months_overflow(month_start(as_of), 1)
    v = visits.where((F.col("visit_date") >= F.lit(trend_window_start(as_of, months))) & (F.col("visit_date") < F.lit(after)))
    agg = v.groupBy(*tenant, F.date_format("visit_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("visit_count"), F.sum("payment_amount").alias("income"))
    spine = month_spine(spark, as_of, months, clinics if clinics is not None else visits, tenant)
    return (spine.join(agg, [*tenant, "month"], "left")
            .select(*tenant, "month_index", "month",
                    F.coalesce("visit_count", F.lit(0)).alias("visit_count"),
                    F.coalesce("income", F.lit(0).cast("decimal(28,2)")).alias("income"))
            .orderBy(*tenant, "month_index"))


def new_patients_by_month(patients: DataFrame, now: dt.datetime, tz: str = "UTC", months: int = TREND_MONTHS,
                          tenant: Sequence[str] = (), clinics: DataFrame | None = None) -> DataFrame:
    """Registrations per local month for the last ``months`` months, zero-filled.

    The cut-off is an instant (now minus six months, overflowing like the
    application's date arithmetic), the bucket is the clinic's local month."""
    spark = patients.sparkSession
    cut_date = add_months_overflow(now.date(), -months)
    cutoff = dt.datetime.combine(cut_date, now.time())
    local = F.from_utc_timestamp(F.col("created_at"), tz)
    # The cut-off is read in the session time zone, like every stored timestamp (not the Python process's zone).
    p = patients.where(F.col("created_at") >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp"))
    agg = p.groupBy(*tenant, F.date_format(local, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    local_today = local_datetime(now, tz).date()
    spine = month_spine(spark, local_today, months, clinics if clinics is not None else patients, tenant)
    return (spine.join(agg, [*tenant, "month"], "left")
            .select(*tenant, "month_index", "month", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy(*tenant, "month_index"))


def outstanding_total(visits: DataFrame, patients: DataFrame, tenant: Sequence[str] = (), clinics: DataFrame | None = None) -> DataFrame:
    """Count and sum of open balances over the outstanding list (visits of known patients)."""
    v = visits.where(F.col("charge_amount") > F.col("payment_amount"))
    v = v.join(patients.select(*tenant, F.col("id").alias("patient_id")), [*tenant, "patient_id"], "left_semi")
    return fill_clinics(v.groupBy(*tenant).agg(
        F.count(F.lit(1)).alias("outstanding_count"),
        _money(F.col("charge_amount") - F.col("payment_amount")).alias("outstanding_total")), clinics, tenant)
