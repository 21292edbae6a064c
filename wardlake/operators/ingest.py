"""Validate and normalise incoming batches; quarantine instead of throwing.

Each ``ingest_*`` takes a batch of raw records (strings as typed into a form)
and returns the normalised record plus ``reasons array<string>``: empty for
an accepted row; otherwise the application's error messages, in the order
it checks them (the first one is the error it would have raised).
``accepted(df)`` / ``rejected(df)`` split the result.

Existence checks are joins against the current table (one shuffle each,
partial-aggregated key lists; AQE broadcasts the key side when it is small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import js_trim, number_or_null, number_or_zero, number_too_large, opt_text, present
from ..schemas import APPOINTMENT_STATUSES, CLIENT_STATUSES, ENTRY_TYPES, MONEY, MOVEMENT_TYPES, QTY


FORM_FIELDS = {
    "patients": ("first_name", "last_name", "date_of_birth", "gender", "phone", "address", "created_by_staff_id"),
    "visits": ("patient_id", "visit_date", "complaint", "treatment", "temperature_c", "blood_pressure", "pulse_bpm",
               "weight_kg", "charge_amount", "payment_amount", "payment_method", "notes", "created_by_staff_id"),
    "drugs": ("name", "unit", "quantity_on_hand", "reorder_level", "expiry_date", "notes", "created_by_staff_id"),
    "appointments": ("patient_id", "appointment_date", "appointment_time", "reason", "notes", "created_by_staff_id"),
    "staff": ("name", "role", "username", "password"),
    "clients": ("name", "phone", "sponsor", "sponsor_contact", "created_by_staff_id"),
    "history": ("client_id", "entry_date", "entry_type", "medication", "indication", "quantity", "day_supply",
                "note", "created_by_staff_id"),
}


def _form(batch: DataFrame, kind: str) -> DataFrame:
    """Fields a form left out arrive as NULL (absent), like an omitted property."""
    missing = [f for f in FORM_FIELDS[kind] if f not in batch.columns]
    return batch.select("*", *[F.lit(None).cast("string").alias(f) for f in missing]) if missing else batch


def _reasons(*checks: tuple[Column, Column | str]) -> Column:
    """Array of messages for the failed checks (``cond`` true means failed)."""
    msgs = [F.when(cond, msg if isinstance(msg, Column) else F.lit(msg)) for cond, msg in checks]
    return F.array_compact(F.array(*msgs))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") == 0).drop("reasons")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") > 0)


def _falsy_id(c: Column) -> Column:
    """JS ``!id``: NULL, empty or zero."""
    return c.isNull() | (c.cast("string") == "") | (F.coalesce(c.cast("string").try_cast("long"), F.lit(-1)) == 0)


def _date(c: Column) -> Column:
    return F.try_to_date(opt_text(c), "yyyy-MM-dd")


def _bad_date(c: Column) -> Column:
    """Non-blank text that is not a yyyy-MM-dd date (stored as text by the
    application; quarantined here so dates can be typed)."""
    return present(c) & _date(c).isNull()


def _exists(batch: DataFrame, ref: DataFrame, fk: str, tenant: Sequence[str], flag: str) -> DataFrame:
    """Flag batch rows whose ``fk`` exists in ``ref.id``. The reference table
    is first cut down to the keys the batch asks for (a semi join against the
    batch's distinct keys, small enough for AQE to broadcast), so a small
    batch never shuffles a large table."""
    b = batch.withColumn(fk, F.col(fk).cast("string").try_cast("long"))
    wanted = b.select(*tenant, fk).where(F.col(fk).isNotNull()).distinct()
    keys = (ref.select(*tenant, F.col("id").cast("long").alias(fk))
            .join(wanted, [*tenant, fk], "left_semi").distinct().withColumn(flag, F.lit(True)))
    none = b.where(F.col(fk).isNull()).withColumn(flag, F.lit(False))   # kept apart: they would all meet in one partition
    some = b.where(F.col(fk).isNotNull()).join(keys, [*tenant, fk], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return some.unionByName(none)


def _author(c: str = "created_by_staff_id") -> Column:
    return F.when(_falsy_id(F.col(c)), F.lit(None).cast("long")).otherwise(F.col(c).cast("string").try_cast("long"))


def ingest_patients(batch: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    batch = _form(batch, "patients")
    fn, ln, dob = F.col("first_name"), F.col("last_name"), F.col("date_of_birth")
    return batch.select(
        *tenant, "row_key",
        js_trim(fn).alias("first_name"), js_trim(ln).alias("last_name"), _date(dob).alias("date_of_birth"),
        opt_text(F.col("gender")).alias("gender"), opt_text(F.col("phone")).alias("phone"),
        opt_text(F.col("address")).alias("address"), _author().alias("created_by_staff_id"),
        _reasons((~present(fn), "firstName is required"), (~present(ln), "lastName is required"),
                 (_bad_date(dob), "dateOfBirth is not a date")).alias("reasons"))


def ingest_visits(batch: DataFrame, patients: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Paid is a number or 0; a blank charge means charged what was paid;
    vitals left blank stay NULL (never 0)."""
    batch = _form(batch, "visits")
    b = _exists(batch.withColumn("_raw_pid", F.col("patient_id").cast("string")), patients, "patient_id", tenant,
                "_patient_known")
    paid = number_or_zero(F.col("payment_amount"), "decimal(18,2)")
    charge_raw = F.col("charge_amount")
    charged = F.when(charge_raw.isNull() | (charge_raw.cast("string") == ""), paid).otherwise(
        number_or_zero(charge_raw, "decimal(18,2)"))
    return b.select(
        *tenant, "row_key", "patient_id", _date(F.col("visit_date")).alias("visit_date"),
        opt_text(F.col("complaint")).alias("complaint"), opt_text(F.col("treatment")).alias("treatment"),
        number_or_null(F.col("temperature_c"), "double").alias("temperature_c"),
        opt_text(F.col("blood_pressure")).alias("blood_pressure"),
        number_or_null(F.col("pulse_bpm")).alias("pulse_bpm"),
        number_or_null(F.col("weight_kg"), "double").alias("weight_kg"),
        charged.cast(MONEY).alias("charge_amount"), paid.cast(MONEY).alias("payment_amount"),
        opt_text(F.col("payment_method")).alias("payment_method"), opt_text(F.col("notes")).alias("notes"),
        _author().alias("created_by_staff_id"),
        _reasons((_falsy_id(F.col("_raw_pid")), "patientId is required"),
                 (~present(F.col("visit_date")), "visitDate is required"),
                 (~_falsy_id(F.col("_raw_pid")) & ~F.col("_patient_known"),
                  F.concat(F.lit("No patient with id "), F.col("_raw_pid"))),
                 (_bad_date(F.col("visit_date")), "visitDate is not a date"),
                 *[(number_too_large(F.col(c), t), f"{n} is too large") for c, n, t in (
                     ("payment_amount", "paymentAmount", "decimal(18,2)"), ("charge_amount", "chargeAmount", "decimal(18,2)"),
                     ("temperature_c", "temperatureC", "double"), ("pulse_bpm", "pulseBpm", "double"),
                     ("weight_kg", "weightKg", "double"))]).alias("reasons"))


def ingest_drugs(batch: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    batch = _form(batch, "drugs")
    name = F.col("name")
    return batch.select(
        *tenant, "row_key", js_trim(name).alias("name"), opt_text(F.col("unit")).alias("unit"),
        number_or_zero(F.col("quantity_on_hand"), "decimal(18,3)").cast(QTY).alias("quantity_on_hand"),
        number_or_zero(F.col("reorder_level"), "decimal(18,3)").cast(QTY).alias("reorder_level"),
        _date(F.col("expiry_date")).alias("expiry_date"), opt_text(F.col("notes")).alias("notes"),
        _author().alias("created_by_staff_id"),
        _reasons((~present(name), "name is required"),
                 (_bad_date(F.col("expiry_date")), "expiryDate is not a date"),
                 (number_too_large(F.col("quantity_on_hand"), "decimal(18,3)"), "quantityOnHand is too large"),
                 (number_too_large(F.col("reorder_level"), "decimal(18,3)"), "reorderLevel is too large")).alias("reasons"))


def ingest_appointments(batch: DataFrame, patients: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    batch = _form(batch, "appointments")
    b = _exists(batch.withColumn("_raw_pid", F.col("patient_id").cast("string")), patients, "patient_id", tenant,
                "_patient_known")
    d = F.col("appointment_date")
    return b.select(
        *tenant, "row_key", "patient_id", _date(d).alias("appointment_date"),
        opt_text(F.col("appointment_time")).alias("appointment_time"), opt_text(F.col("reason")).alias("reason"),
        F.lit("Scheduled").alias("status"), opt_text(F.col("notes")).alias("notes"),
        _author().alias("created_by_staff_id"),
        _reasons((_falsy_id(F.col("_raw_pid")), "patientId is required"),
                 (~present(d), "appointmentDate is required"),
                 (~_falsy_id(F.col("_raw_pid")) & ~F.col("_patient_known"),
                  F.concat(F.lit("No patient with id "), F.col("_raw_pid"))),
                 (_bad_date(d), "appointmentDate is not a date")).alias("reasons"))


def ingest_staff(batch: DataFrame, existing: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Four required fields; username trimmed and lower-cased and unique,
    counting inactive accounts and earlier rows of the same batch (``row_key``
    order). The password is checked for presence only and never kept."""
    batch = _form(batch, "staff")
    uname = F.lower(js_trim(F.col("username")))
    b = batch.withColumn("_u", uname)
    asked = b.select(*tenant, "_u").distinct()
    taken = (existing.select(*tenant, F.col("username").alias("_u")).join(asked, [*tenant, "_u"], "left_semi")
             .distinct().withColumn("_taken", F.lit(True)))
    first = (b.where(present(F.col("username")))
             .groupBy(*tenant, "_u").agg(F.min("row_key").alias("_first")))
    b = (b.join(taken, [*tenant, "_u"], "left").join(first, [*tenant, "_u"], "left"))
    dup = present(F.col("username")) & (F.coalesce(F.col("_taken"), F.lit(False)) | (F.col("row_key") != F.col("_first")))
    return b.select(
        *tenant, "row_key", js_trim(F.col("name")).alias("name"), js_trim(F.col("role")).alias("role"),
        F.col("_u").alias("username"), F.lit(1).alias("active"),
        _reasons((~present(F.col("name")), "name is required"), (~present(F.col("role")), "role is required"),
                 (~present(F.col("username")), "username is required"),
                 (~present(F.col("password")), "password is required"),
                 (dup, F.concat(F.lit('Username "'), F.col("username"), F.lit('" is already taken')))).alias("reasons"))


def ingest_clients(batch: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    batch = _form(batch, "clients")
    name = F.col("name")
    return batch.select(
        *tenant, "row_key", js_trim(name).alias("name"), opt_text(F.col("phone")).alias("phone"),
        opt_text(F.col("sponsor")).alias("sponsor"), opt_text(F.col("sponsor_contact")).alias("sponsor_contact"),
        F.lit("Active").alias("status"), _author().alias("created_by_staff_id"),
        _reasons((~present(name), "name is required")).alias("reasons"))


def ingest_history(batch: DataFrame, clients: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    batch = _form(batch, "history")
    b = _exists(batch, clients, "client_id", tenant, "_client_known")
    ds = F.col("day_supply")
    d = F.col("entry_date")
    return b.select(
        *tenant, "row_key", "client_id", _date(d).alias("entry_date"), F.col("entry_type"),
        opt_text(F.col("medication")).alias("medication"), opt_text(F.col("indication")).alias("indication"),
        opt_text(F.col("quantity")).alias("quantity"), number_or_null(ds).alias("day_supply"),
        opt_text(F.col("note")).alias("note"), _author().alias("created_by_staff_id"),
        _reasons((~F.col("_client_known"), "Client not found"),
                 (~present(d), "entryDate is required"),
                 (~F.coalesce(F.col("entry_type").isin(*ENTRY_TYPES), F.lit(False)),
                  "entryType must be Order, Note, or Contact"),
                 (_bad_date(d), "entryDate is not a date"),
                 (number_too_large(ds, "double") | (F.abs(number_or_null(ds)) > 1_000_000), "daySupply is too large")).alias("reasons"))


# CHECK constraints of the stored tables (table, column, allowed values).
ENUM_RULES = (
    ("drug_movements", "type", MOVEMENT_TYPES),
    ("appointments", "status", APPOINTMENT_STATUSES),
    ("subscription_clients", "status", CLIENT_STATUSES),
    ("subscription_history", "entry_type", ENTRY_TYPES),
)

# Foreign keys of the stored tables (child, column, parent). NULL is always allowed.
FK_EDGES = (
    ("patients", "created_by_staff_id", "staff"),
    ("visits", "patient_id", "patients"),
    ("visits", "created_by_staff_id", "staff"),
    ("drugs", "created_by_staff_id", "staff"),
    ("drug_movements", "drug_id", "drugs"),
    ("drug_movements", "created_by_staff_id", "staff"),
    ("appointments", "patient_id", "patients"),
    ("appointments", "created_by_staff_id", "staff"),
    ("subscription_clients", "created_by_staff_id", "staff"),
    ("subscription_history", "client_id", "subscription_clients"),
    ("subscription_history", "created_by_staff_id", "staff"),
)


def enum_check(tables: dict[str, DataFrame], rules=ENUM_RULES, tenant: Sequence[str] = ()) -> DataFrame:
    """Value counts (per tenant) of every constrained column with a ``valid`` flag."""
    parts = []
    for table, col, allowed in rules:
        if table not in tables:
            continue
        parts.append(tables[table].groupBy(*tenant, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
                     .select(*tenant, F.lit(table).alias("table_name"), F.lit(col).alias("column_name"), "value", "n",
                             F.coalesce(F.col("value").isin(*allowed), F.lit(False)).alias("valid")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_audit(tables: dict[str, DataFrame], edges=FK_EDGES, tenant: Sequence[str] = ()) -> DataFrame:
    """Per edge (and tenant): child rows with a non-NULL key, and how many point nowhere.

    Each child is read once: its keys go out as (edge, parent, key) and are counted per key before the
    one join, whose other side has the ids of all parents tagged by table. The edge is
    part of what the rows are dealt by, so a frequent key is one counted row there."""
    children = list(dict.fromkeys(c for c, _, p in edges if c in tables and p in tables))
    keyed, ids = None, None
    for child in children:
        own = [(col, parent) for c, col, parent in edges if c == child and parent in tables]
        each = F.array(*[F.struct(F.lit(f"{child}.{col}").alias("edge"), F.lit(parent).alias("parent"), F.col(col).cast("long").alias("_k")) for col, parent in own])
        part = tables[child].select(*tenant, F.inline(each)).where(F.col("_k").isNotNull())
        keyed = part if keyed is None else keyed.unionByName(part)
    for parent in dict.fromkeys(p for c, _, p in edges if c in tables and p in tables):
        part = tables[parent].select(*tenant, F.lit(parent).alias("parent"), F.col("id").cast("long").alias("_k"))
        ids = part if ids is None else ids.unionByName(part)
    counted = keyed.groupBy(*tenant, "edge", "parent", "_k").agg(F.count(F.lit(1)).alias("_n"))
    if not tenant:   # an edge without references has its row too
        used = [(f"{c}.{col}", p) for c, col, p in edges if c in tables and p in tables]
        counted = counted.unionByName(counted.sparkSession.createDataFrame([(e, p, None, 0) for e, p in used], counted.schema))
    hits = counted.join(ids.distinct().withColumn("_hit", F.lit(1)), [*tenant, "parent", "_k"], "left")
    return hits.groupBy(*tenant, "edge", "parent").agg(
        F.sum("_n").alias("references"), F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"))
