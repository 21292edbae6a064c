"""Sinks (exact CSV bytes, JSON lines), streams (state across micro-batches
equals the batch answer) and tenant runs (per clinic == all at once)."""

import datetime as dt
import glob
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import AS_OF, rows
from wardlake.operators import aggregates as agg
from wardlake.operators import changes, ledger
from wardlake.sources import sinks
from wardlake.sources.driver import load_driver_tables
from wardlake.session import checkpoint_dir
from wardlake.streaming import streams

SF = "/root/testdata/sf0.001"


def _scratch(spark):
    d = checkpoint_dir(spark)
    d = d[len("file:"):] if d.startswith("file:") else d
    os.makedirs(d, exist_ok=True)
    return d


def _csv_reference(header, records):
    """The application's CSV text for string cells (test-side restatement)."""
    def cell(v):
        if v is None:
            return ""
        return '"' + v.replace('"', '""') + '"' if any(ch in v for ch in ',"\r\n') else v
    return "\r\n".join([",".join(cell(h) for h in header)] + [",".join(cell(v) for v in r) for r in records])


def _bytes(folder):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{folder}/part-*"))).decode()


def test_csv_exact_bytes(spark, tmp_path):
    from wardlake.sources.part_files import read_csv_records
    recs = [(None, "plain"), ("42", "has, comma"), ('say "hi"', "line\nbreak"), (" lead", "cr\rhere"), ("x", ""), (None, None), ("two\r\nends", "é")]
    df = spark.createDataFrame(recs, "`Name` string, `Notes, extra` string")
    out = str(tmp_path / "csv")
    for n in (1, 3):
        sinks.write_csv(df.coalesce(n), out)          # the second run replaces the first
        assert _bytes(out) == _csv_reference(["Name", "Notes, extra"], recs)
        assert len(glob.glob(f"{out}/part-*")) == n + 1 and os.listdir(out).count("_SUCCESS") == 1
    want = [_csv_reference(r, []) for r in [("Name", "Notes, extra"), *recs]]
    got = read_csv_records(spark, out).collect()
    assert sorted((r.value, r.file_bytes) for r in got) == sorted((v, len(v.encode()) + 2 * bool(i)) for i, v in enumerate(want))
    none = str(tmp_path / "none")
    sinks.write_csv(df.where("false"), none)
    assert _bytes(none) == _csv_reference(["Name", "Notes, extra"], []) and read_csv_records(spark, none).count() == 1


def test_csv_failed_task_leaves_no_part(spark, tmp_path):
    out = str(tmp_path / "csv")
    good = spark.createDataFrame([("a",), ("b",)], "x string")
    sinks.write_csv(good.coalesce(1), out)
    before = {p: open(p, "rb").read() for p in glob.glob(f"{out}/*")}
    bad = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_csv(bad, out)
    assert {p: open(p, "rb").read() for p in glob.glob(f"{out}/*")} == before
    with pytest.raises(Exception, match="stop"):
        sinks.write_csv(bad, str(tmp_path / "new"))
    assert glob.glob(f"{tmp_path}/new/*") == []
    with pytest.raises(Exception, match="not empty"):
        sinks.write_csv(good, out, mode="append")
    assert {p: open(p, "rb").read() for p in glob.glob(f"{out}/*")} == before


def test_snapshot_has_one_read_point_and_finds_damage(spark, tmp_path):
    live, root = str(tmp_path / "live"), str(tmp_path / "snapshots")
    for t in ("a", "b"):
        spark.createDataFrame([(i, f"{t}{i}", None) for i in range(50)], "id long, name string, note string").write.parquet(f"{live}/{t}")
    tables = {t: spark.read.parquet(f"{live}/{t}") for t in ("a", "b")}
    for t in ("a", "b"):                          # rows that come after the tables were listed
        spark.createDataFrame([(99, "late", "x")], "id long, name string, note string").write.mode("append").parquet(f"{live}/{t}")
    name = sinks.snapshot_write(tables, root, dt.datetime(2026, 8, 14, 9, 0, 0))
    assert all(spark.read.parquet(f"{root}/{name}/{t}").count() == 50 for t in ("a", "b"))
    assert not glob.glob(f"{root}/_draft-*")
    assert spark.read.parquet(f"{root}/{name}/_files").groupBy("table_name").count().count() == 2
    check = sinks.snapshot_check(spark, root, name)
    assert check.count() == 8 and check.where("not same").count() == 0
    swapped = [(0, "b1", None), (1, "b0", None), *((i, f"b{i}", None) for i in range(2, 50))]
    spark.createDataFrame(swapped, "id long, name string, note string").write.mode("overwrite").parquet(f"{root}/{name}/b")
    assert rows(sinks.snapshot_check(spark, root, name).where("not same"), "table_name", "column_name") == [("b", "*")]
    with pytest.raises(FileExistsError):
        sinks.snapshot_write(tables, root, dt.datetime(2026, 8, 14, 9, 0, 0))
    assert rows(sinks.snapshot_names(spark, root)) == [(name,)]


def test_upgrade_finds_layouts_by_itself(spark, tmp_path):
    from wardlake.sources.tables import layouts, upgrade_folder
    folder = str(tmp_path / "visits")
    day, paid = dt.date(2026, 8, 14), Decimal("5.00")
    base = "id long, patient_id long, visit_date date, payment_amount "
    for schema, row in ((base + "double", (1, 7, day, 5.0)), (base + "decimal(18,2), temperature_c double", (2, 7, day, paid, 38.5)),
                        (base + "decimal(18,2), charge_amount decimal(18,2)", (3, 7, day, paid, Decimal("9.00"))),
                        (base + "decimal(18,2), charge_amount decimal(18,2), created_by_staff_id long", (4, 7, day, paid, None, 3))):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    assert len({tuple(r.layout) for r in layouts(spark, folder).collect()}) == 4
    got = rows(upgrade_folder(spark, folder), "id", "charge_amount", "payment_amount", "temperature_c", "created_by_staff_id")
    assert got == [(1, paid, paid, None, None), (2, paid, paid, 38.5, None), (3, Decimal("9.00"), paid, None, None), (4, None, paid, None, 3)]
    os.makedirs(tmp_path / "empty")
    assert upgrade_folder(spark, str(tmp_path / "empty")).collect() == []


def test_csv_lines_keep_embedded_newlines(spark):
    df = spark.createDataFrame([("a\nb", None)], "a string, b string")
    assert [r.value for r in sinks.csv_lines(df).collect()] == ["a,b", '"a\nb",']


def test_json_lines_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id long, note string")
    assert sinks.to_json_lines(df).collect()[0].value == '{"id":1,"note":null}'


def _split_write(spark, df, root, key):
    """Write ``df`` as one file per value of ``key``, oldest first (arrival order)."""
    for i, v in enumerate(sorted(r[0] for r in df.select(key).distinct().collect())):
        df.where(F.col(key) == v).coalesce(1).write.parquet(f"{root}/part_{i:04d}")


def test_stream_ledger_state_across_batches_equals_batch(spark):
    t = load_driver_tables(spark, SF)
    req = t["stock_requests"].withColumn("_month", F.date_format("requested_at", "yyyy"))
    root = tempfile.mkdtemp(prefix="wardlake-req-", dir=_scratch(spark))
    _split_write(spark, req, root, "_month")
    order = ["requested_at", "src_order", "src_line", "quantity", "src_price", "src_flag"]
    src = (spark.readStream.schema(spark.read.parquet(f"{root}/part_0000").schema)
           .option("maxFilesPerTrigger", 1).parquet(f"{root}/part_*"))
    s = streams.stream_stock_ledger(src.drop("_month"), t["drugs"], order)
    got = streams.run_available_now(s, "test_ledger")
    batch = ledger.stock_ledger_apply(t["drugs"], t["stock_requests"], order)
    cols = ["drug_id", "src_order", "src_line", "src_flag", "accepted", "reason", "balance_after"]
    assert rows(got, *cols) == rows(batch, *cols)


def test_stream_quota_equals_batch(spark):
    m = spark.createDataFrame([(c, i, dt.datetime(2026, 8, 14, 0, 0) + dt.timedelta(minutes=7 * i))
                               for c in (1, 2) for i in range(400)], "clinic_id int, message_id long, sent_at timestamp")
    root = tempfile.mkdtemp(prefix="wardlake-msg-", dir=_scratch(spark))
    _split_write(spark, m.withColumn("_h", F.date_format("sent_at", "yyyy-MM-dd HH")), root, "_h")
    src = (spark.readStream.schema(spark.read.parquet(f"{root}/part_0000").schema)
           .option("maxFilesPerTrigger", 3).parquet(f"{root}/part_*"))
    got = streams.run_available_now(streams.stream_quota(src.drop("_h"), limit=50), "test_quota")
    want = changes.ai_quota_admission(m, limit=50)
    assert rows(got, "clinic_id", "message_id", "admitted") == rows(want, "clinic_id", "message_id", "admitted")


def test_stream_daily_income_complete_mode(spark):
    v = spark.createDataFrame([(1, AS_OF, Decimal("10.00")), (2, AS_OF, Decimal("5.50")),
                               (3, dt.date(2026, 8, 13), Decimal("1.00"))],
                              "id long, visit_date date, payment_amount decimal(18,2)")
    root = tempfile.mkdtemp(prefix="wardlake-vis-", dir=_scratch(spark))
    v.write.parquet(f"{root}/v")
    src = spark.readStream.schema(v.schema).parquet(f"{root}/v")
    got = streams.run_available_now(streams.stream_daily_income(src), "test_income", mode="complete")
    assert rows(got, "day", "income", "visits") == [(dt.date(2026, 8, 13), Decimal("1.00"), 1),
                                                    (AS_OF, Decimal("15.50"), 2)]


def test_tenant_run_equals_per_clinic_runs(spark):
    t = load_driver_tables(spark, SF)
    v = t["visits"].join(t["patients"].select(F.col("id").alias("patient_id"), "clinic_id"), "patient_id")
    as_of = dt.date(2001, 7, 31)
    together = rows(agg.top_complaints(v, dt.date(2001, 1, 1), 3, tenant=["clinic_id"]), "clinic_id", "complaint", "n")
    apart = []
    for c in sorted(r[0] for r in v.select("clinic_id").distinct().collect()):
        apart += [(c, *r) for r in rows(agg.top_complaints(v.where(F.col("clinic_id") == c), dt.date(2001, 1, 1), 3),
                                        "complaint", "n")]
    assert together == sorted(apart, key=lambda t: tuple((x is None, str(x)) for x in t))
    inc = rows(agg.income_summary(v, as_of, tenant=["clinic_id"]), "clinic_id", "this_month")
    total = agg.income_summary(v, as_of).collect()[0].this_month
    assert sum(r[1] for r in inc) == total


def test_csv_lf_mode_uses_spark_writer_with_same_quoting(spark, tmp_path):
    recs = [(None, "plain"), ("42", "has, comma"), ('say "hi"', "line\nbreak"), (" lead", "cr\rhere"), ("x", "")]
    df = spark.createDataFrame(recs, "`Name` string, `Notes` string").coalesce(1)
    out = str(tmp_path / "csv_lf")
    sinks.write_csv(df, out, crlf=False)
    text = "".join(open(p, newline="").read() for p in sorted(glob.glob(out + "/part-*")))
    assert text == _csv_reference(["Name", "Notes"], recs).replace("\r\n", "\n") + "\n"


def test_daily_income_has_every_day_once_and_returns_late_rows(spark):
    d = dt.date
    arrivals = [[(1, d(2026, 8, 10), Decimal("1.00"), 1), (2, d(2026, 8, 12), Decimal("2.00"), 2)], [(3, d(2026, 8, 11), Decimal("4.00"), 1), (4, d(2026, 8, 10), Decimal("9.00"), 1)],
                [(5, d(2026, 8, 20), Decimal("5.00"), 1), (6, None, Decimal("3.00"), 1)], [(7, d(2026, 8, 12), Decimal("7.00"), 2), (8, d(2026, 8, 20), None, 1), (9, d(2026, 8, 19), Decimal("6.00"), 2)]]
    root = tempfile.mkdtemp(prefix="wardlake-inc-", dir=_scratch(spark))
    for i, own in enumerate(arrivals):
        spark.createDataFrame(own, "id long, visit_date date, payment_amount decimal(18,2), clinic_id int").coalesce(1).write.parquet(f"{root}/part_{i}")
    schema = spark.read.parquet(f"{root}/part_0").schema
    for tenant in ((), ("clinic_id",)):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/part_*")
        days, late = streams.run_daily_income(src, "test_income", tenant=tenant)
        got = rows(days, "day", "income", "visits")
        if not tenant:
            assert got == [(d(2026, 8, 10), Decimal("1.00"), 1), (d(2026, 8, 11), Decimal("4.00"), 1), (d(2026, 8, 12), Decimal("2.00"), 1),
                           (d(2026, 8, 19), Decimal("6.00"), 1), (d(2026, 8, 20), Decimal("5.00"), 2)]
        assert len(days.select(*tenant, "day").distinct().collect()) == len(got)
        assert rows(late, "id", "batch") == [(4, 1), (6, 2), (7, 3)] and late.columns == [*schema.fieldNames(), "batch"]


def test_quota_state_holds_open_days_only_and_late_messages_have_a_reason(spark):
    day = dt.datetime(2026, 8, 1)
    arrivals = [[(1, i, day + dt.timedelta(minutes=i)) for i in range(5)], [(1, 10 + i, day + dt.timedelta(days=1, minutes=i)) for i in range(2)],
                [(1, 20, day + dt.timedelta(days=9)), (2, 30, day)], [(1, 40, day + dt.timedelta(hours=5)), (1, 41, day + dt.timedelta(days=8)), (2, 42, day), (1, 43, None)]]
    root = tempfile.mkdtemp(prefix="wardlake-quota-", dir=_scratch(spark))
    for i, own in enumerate(arrivals):
        spark.createDataFrame(own, "clinic_id int, message_id long, sent_at timestamp").coalesce(1).write.parquet(f"{root}/part_{i}")
    src = spark.readStream.schema(spark.read.parquet(f"{root}/part_0").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/part_*")
    base = tempfile.mkdtemp(prefix="wardlake-quota-run-", dir=_scratch(spark))
    got = {r.message_id: (r.admitted, r.reason) for r in streams.run_available_now(streams.stream_quota(src, limit=3), "q", base=base).collect()}
    assert [got[i] for i in range(5)] == [(True, None)] * 3 + [(False, "daily limit reached")] * 2
    assert all(got[i] == (True, None) for i in (10, 11, 20, 30, 41, 42)) and got[40] == got[43] == (False, "day is closed")
    state = spark.read.format("statestore").option("stateVarName", "counts").load(f"{base}/checkpoint")
    held = sorted((r.key.clinic_id, r.user_map_key.day - (day.date() - dt.date(1970, 1, 1)).days, r.user_map_value.n) for r in state.collect())
    assert held == [(1, 8, 1), (1, 9, 1), (2, 0, 2)]          # days 0 and 1 of clinic 1 are gone


def test_stream_daily_income_per_clinic(spark):
    v = spark.createDataFrame([(1, AS_OF, Decimal("10.00"), 1), (2, AS_OF, Decimal("5.50"), 2),
                               (3, AS_OF, Decimal("1.00"), 1)],
                              "id long, visit_date date, payment_amount decimal(18,2), clinic_id int")
    root = tempfile.mkdtemp(prefix="wardlake-vis2-", dir=_scratch(spark))
    v.write.parquet(f"{root}/v")
    src = spark.readStream.schema(v.schema).parquet(f"{root}/v")
    got = streams.run_available_now(streams.stream_daily_income(src, tenant=["clinic_id"]), "test_income_clinic",
                                    mode="complete")
    assert rows(got, "clinic_id", "day", "income", "visits") == [(1, AS_OF, Decimal("11.00"), 2),
                                                                 (2, AS_OF, Decimal("5.50"), 1)]


def test_tenant_trends_and_refills_equal_per_clinic_runs(spark):
    from wardlake.operators import refills
    t = load_driver_tables(spark, SF)
    v = t["visits"].join(t["patients"].select(F.col("id").alias("patient_id"), "clinic_id"), "patient_id")
    as_of = dt.date(2001, 7, 31)
    clinics = sorted(r[0] for r in v.select("clinic_id").distinct().collect())[:6]
    together = {(r.clinic_id, r.month): (r.visit_count, r.income)
                for r in agg.monthly_visit_trends(v, as_of, tenant=["clinic_id"]).collect()}
    for c in clinics:
        alone = agg.monthly_visit_trends(v.where(F.col("clinic_id") == c), as_of).collect()
        assert [(r.visit_count, r.income) for r in alone] == [together[(c, r.month)] for r in alone]
    h = t["subscription_history"].join(
        t["subscription_clients"].select(F.col("id").alias("client_id"), "clinic_id"), "client_id")
    due = rows(refills.refills_due(h, t["subscription_clients"], dt.date(2024, 1, 28), tenant=["clinic_id"]),
               "clinic_id", "id", "days_until_due")
    plain = rows(refills.refills_due(t["subscription_history"], t["subscription_clients"], dt.date(2024, 1, 28)),
                 "id", "days_until_due")
    assert sorted((i, d) for _, i, d in due) == sorted(plain)


def test_stream_ledger_replays_many_drugs_in_a_call_over_parallel_arrivals(spark):
    """Each arrival is written by several tasks and is one micro-batch; a group's balances go on from one to the next."""
    from wardlake.plans.catalog_streams import arriving
    drugs = spark.createDataFrame([(i, f"d{i}", "box", Decimal(5)) for i in range(6)], "id long, name string, unit string, quantity_on_hand decimal(18,3)")
    start, made = dt.datetime(2026, 8, 14), []
    for i in range(240):
        made.append((None if i % 41 == 0 else i % 7, "restock" if i % 3 == 0 else "dispense", Decimal(i % 5), start + dt.timedelta(hours=i // 12), i // 2, i % 2))
    req = spark.createDataFrame(made, "drug_id long, type string, quantity decimal(18,3), requested_at timestamp, src_order long, src_line int").repartition(3)
    order = ["requested_at", "src_order", "src_line"]
    src, arrivals = arriving(req, "requested_at", 3)
    base = tempfile.mkdtemp(prefix="wardlake-arr-", dir=_scratch(spark))
    got = streams.run_available_now(streams.stream_stock_ledger(src, drugs, order, groups=1), "test_groups", base=base, arrivals=arrivals)
    cols = ["drug_id", "src_order", "src_line", "accepted", "reason", "balance_after"]
    assert rows(got, *cols) == rows(ledger.stock_ledger_apply(drugs, req, order), *cols)
    assert len(glob.glob(f"{base}/out/batch=*")) == 3
    files = [f for f in glob.glob(f"{_scratch(spark)}/arrivals-*/part=*/*.parquet")]
    assert max(sum(os.path.dirname(f) == d for f in files) for d in {os.path.dirname(f) for f in files}) == 3


def test_ledger_sort_looks_at_later_columns_for_ties_alone():
    import pandas as pd
    pdf = pd.DataFrame({"k": [2, 1, 1, 1, 2, 1], "a": [1, 1, 1, 1, 1, 0], "b": [1, 5, 5, 5, 0, 9], "c": ["x", "z", None, "y", "q", "m"], "t": list("abcdef")})
    got = streams.in_order(pdf, ["k"], ["a", "b", "c", "t"])
    pd.testing.assert_frame_equal(got, pdf.sort_values(["k", "a", "b", "c", "t"]))


def test_csv_parts_are_read_in_pieces():
    import io

    from wardlake.sources.part_files import csv_pieces
    recs = [("plain", None), ('say "hi"', "two\r\nends, é"), ("", ""), ("x" * 300, 'q"'), ("last", "")]
    text = _csv_reference(["Name", "Notes, extra"], recs)
    want = [_csv_reference(r, []) for r in [("Name", "Notes, extra"), *recs]]

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            Counted.most = max(Counted.most, n)
            return super().read(n)

    for data, headed, told in ((text, True, want), (text[len(want[0]):], False, want[1:]), ("", True, [""]), ("", False, [])):
        for piece in (1, 7, 1 << 20):
            got = [r for b in csv_pieces("part", io.BytesIO(data.encode()), headed, piece) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert [v for v, _ in got] == told
            assert sum(n for _, n in got) == len(data.encode())
    many = ("\r\n" + "a,b" * 5) * 5000
    assert sum(b.num_rows for b in csv_pieces("part", Counted(many.encode()), False, 64)) == 5000 and Counted.most <= 64
    with pytest.raises(ValueError, match="not a record at 4"):
        list(csv_pieces("part", io.BytesIO(b'\r\nab"c'), False, 2))
