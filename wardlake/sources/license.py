"""License feed: ``{clinicId: {expiresAt, plan?}}`` documents as fetched.

Parsing rules (any failure means "no update", never an error):
malformed JSON, a top level that is not an object, an unknown clinic id, or
an ``expiresAt`` that is missing or not a JSON string give no row; a plan
other than the known ones becomes NULL.

The text is parsed once into a VARIANT; the entry of each clinic is read by
path, and its JSON type is checked with ``schema_of_variant`` (a plain
``from_json`` would turn the number 5 into the string "5").
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PLANS


def license_feed(docs: DataFrame, text: str = "text", clinic_key: str = "clinic_key",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Parse each document for its clinic. ``docs`` holds the document text
    and the clinic id (string) to look up in it; returns (keep..., clinic_key,
    expires_at, plan)."""
    v = F.try_parse_json(F.col(text))
    d = docs.select(*keep, clinic_key, v.alias("_v"))
    is_obj = F.schema_of_variant(F.col("_v")).startswith("OBJECT")
    # variant_get takes a literal path, so the clinic's entry is reached through a map view of the object.
    as_map = F.try_variant_get(F.col("_v"), "$", "map<string,variant>")
    e = F.element_at(as_map, F.col(clinic_key))
    exp = F.try_variant_get(e, "$.expiresAt", "variant")
    plan = F.try_variant_get(e, "$.plan", "variant")
    out = d.where(F.col("_v").isNotNull() & is_obj).select(
        *keep, clinic_key, exp.alias("_exp"), plan.alias("_plan"))
    out = out.where(F.col("_exp").isNotNull() & (F.schema_of_variant(F.col("_exp")) == "STRING"))
    plan_s = F.when(F.schema_of_variant(F.col("_plan")) == "STRING", F.try_variant_get(F.col("_plan"), "$", "string"))
    return out.select(*keep, clinic_key,
                      F.try_variant_get(F.col("_exp"), "$", "string").alias("expires_at"),
                      F.when(plan_s.isin(*PLANS), plan_s).alias("plan"))


def license_feed_entries(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Every valid entry of every document: (keep..., clinic_key, expires_at,
    plan). The feed is one object for all clinics; exploding its entries once
    (then an equi-join on the clinic id) serves every clinic without pairing
    the document with each clinic. Same rules as :func:`license_feed`."""
    v = F.try_parse_json(F.col(text))
    d = docs.select(*keep, v.alias("_v")).where(
        F.col("_v").isNotNull() & F.schema_of_variant(F.col("_v")).startswith("OBJECT"))
    e = d.select(*keep, F.explode(F.try_variant_get(F.col("_v"), "$", "map<string,variant>")).alias("clinic_key", "_e"))
    e = e.select(*keep, "clinic_key", F.try_variant_get(F.col("_e"), "$.expiresAt", "variant").alias("_exp"),
                 F.try_variant_get(F.col("_e"), "$.plan", "variant").alias("_plan"))
    e = e.where(F.col("_exp").isNotNull() & (F.schema_of_variant(F.col("_exp")) == "STRING"))
    plan_s = F.when(F.schema_of_variant(F.col("_plan")) == "STRING", F.try_variant_get(F.col("_plan"), "$", "string"))
    return e.select(*keep, "clinic_key", F.try_variant_get(F.col("_exp"), "$", "string").alias("expires_at"),
                    F.when(plan_s.isin(*PLANS), plan_s).alias("plan"))
