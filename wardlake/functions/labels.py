"""Text and label columns as the screens print them.

All are column expressions (``concat_ws`` skips NULL parts, which is how the
screens skip absent values), so they run inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BANNER_WARNING_DAYS
from .semantics import js_decimal_text, js_number_text, money_text, plural, present

SEP = " · "


def fmt_money(c: Column) -> Column:
    return money_text(c)


def fmt_vitals(temperature: Column, bp: Column, pulse: Column, weight: Column) -> Column:
    """'T: 38.5°C · BP: 120/80 · P: 72bpm · W: 65kg', absent parts skipped;
    an empty blood pressure counts as absent."""
    return F.concat_ws(
        SEP,
        F.when(temperature.isNotNull(), F.concat(F.lit("T: "), js_number_text(temperature), F.lit("°C"))),
        F.when(F.coalesce(bp, F.lit("")) != "", F.concat(F.lit("BP: "), bp)),
        F.when(pulse.isNotNull(), F.concat(F.lit("P: "), js_number_text(pulse), F.lit("bpm"))),
        F.when(weight.isNotNull(), F.concat(F.lit("W: "), js_number_text(weight), F.lit("kg"))),
    )


def _nonblank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def patient_card(p: DataFrame) -> DataFrame:
    """Name line and 'DOB: … · gender · phone · address' meta line."""
    return p.select(
        "*",
        F.concat_ws(" ", F.col("first_name"), F.col("last_name")).alias("display_name"),
        F.concat_ws(SEP,
                    F.when(F.col("date_of_birth").isNotNull(),
                           F.concat(F.lit("DOB: "), F.col("date_of_birth").cast("string"))),
                    F.when(_nonblank(F.col("gender")), F.col("gender")),
                    F.when(_nonblank(F.col("phone")), F.col("phone")),
                    F.when(_nonblank(F.col("address")), F.col("address"))).alias("meta"))


def client_card(c: DataFrame) -> DataFrame:
    """'phone · Sponsor: … · status'."""
    return c.select(
        "*",
        F.concat_ws(SEP,
                    F.when(_nonblank(F.col("phone")), F.col("phone")),
                    F.when(_nonblank(F.col("sponsor")), F.concat(F.lit("Sponsor: "), F.col("sponsor"))),
                    F.col("status")).alias("meta"),
        F.when(F.col("status") == "Active", F.lit("Mark Inactive")).otherwise(F.lit("Mark Active")).alias("toggle_label"))


def drug_card(d: DataFrame) -> DataFrame:
    """'N unit on hand · reorder at R · expires D'."""
    return d.select(
        "*",
        F.concat_ws(SEP,
                    F.concat(js_decimal_text(F.col("quantity_on_hand")), F.lit(" "),
                             F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.lit("unit(s)")), F.lit(" on hand")),
                    F.concat(F.lit("reorder at "), js_decimal_text(F.col("reorder_level"))),
                    F.when(F.col("expiry_date").isNotNull(),
                           F.concat(F.lit("expires "), F.col("expiry_date").cast("string")))).alias("meta"))


def history_labels(h: DataFrame) -> DataFrame:
    """'Medication (quantity)' and 'N days' as the history list prints them."""
    med = F.when(_nonblank(F.col("medication")),
                 F.concat(F.col("medication"),
                          F.when(_nonblank(F.col("quantity")), F.concat(F.lit(" ("), F.col("quantity"), F.lit(")")))
                          .otherwise(F.lit("")))).otherwise(F.lit(""))
    days = F.when(F.coalesce(F.col("day_supply"), F.lit(0)) != 0,
                  F.concat(js_number_text(F.col("day_supply")), F.lit(" days"))).otherwise(F.lit(""))
    return h.select("*", med.alias("medication_label"), days.alias("supply_label"))


def visit_receipts(v: DataFrame) -> DataFrame:
    """One row per printed receipt line: (visit id, line_no, label, value).
    Optional lines only when present; 'Balance Owed' only when positive. The
    print time line is left out (it is the wall clock). ``v`` needs
    first_name, last_name and recorded_by_name next to the visit columns."""
    bal = F.col("charge_amount") - F.col("payment_amount")
    vit = fmt_vitals(F.col("temperature_c"), F.col("blood_pressure"), F.col("pulse_bpm"), F.col("weight_kg"))
    paid = F.concat(money_text(F.col("payment_amount")),
                    F.when(_nonblank(F.col("payment_method")), F.concat(F.lit(" ("), F.col("payment_method"), F.lit(")")))
                    .otherwise(F.lit("")))

    def line(label: str, value: Column, when: Column | None = None) -> Column:
        s = F.struct(F.lit(label).alias("label"), value.alias("value"))
        return s if when is None else F.when(when, s)

    lines = F.array(
        line("Patient", F.concat_ws(" ", F.col("first_name"), F.col("last_name"))),
        line("Visit Date", F.coalesce(F.col("visit_date").cast("string"), F.lit(""))),
        line("Complaint", F.col("complaint"), _nonblank(F.col("complaint"))),
        line("Treatment", F.col("treatment"), _nonblank(F.col("treatment"))),
        line("Vitals", vit, vit != ""),
        line("Amount Charged", money_text(F.col("charge_amount"))),
        line("Amount Paid", paid),
        line("Balance Owed", money_text(bal), bal > 0),
        line("Served By", F.col("recorded_by_name"), _nonblank(F.col("recorded_by_name"))),
    )
    return (v.select(F.col("id").alias("visit_id"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())))
            .select("visit_id", (F.col("pos") + 1).alias("line_no"), F.col("col.label").alias("label"),
                    F.col("col.value").alias("value")))


def license_banner(expires_at: Column, as_of: dt.date) -> Column:
    """struct(css_class, text): NULL class = hidden. Expired: days ago;
    within seven days: warning; otherwise hidden."""
    has = present(expires_at)
    days = F.datediff(F.try_to_date(expires_at, "yyyy-MM-dd"), F.lit(as_of))
    ago = F.abs(days)
    expired_text = F.concat(F.lit("Your subscription expired on "), expires_at, F.lit(" ("), plural(ago, "day"),
                            F.lit(" ago) — please contact your provider to renew."))
    warn_text = F.concat(F.lit("Your subscription expires in "), plural(days, "day"), F.lit(" ("), expires_at,
                         F.lit(") — please contact your provider to renew."))
    cls = (F.when(~has | days.isNull(), F.lit(None))
           .when(days < 0, F.lit("banner-expired"))
           .when(days <= BANNER_WARNING_DAYS, F.lit("banner-warning")))
    text = (F.when(~has | days.isNull(), F.lit(None))
            .when(days < 0, expired_text)
            .when(days <= BANNER_WARNING_DAYS, warn_text))
    return F.struct(cls.alias("css_class"), text.alias("text"), days.alias("days"))
