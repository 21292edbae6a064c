"""Exports and sinks: CSV, nested JSON, sync documents, dated snapshots.

Writers run in parallel (one file per partition); nothing is gathered on the
driver or in one task. Export frames are built first (string cells exactly as
the files print them) so they can be checked without writing.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import js_decimal_text, js_number_text
from ..operators.joins import visits_enriched
from ..schemas import DRUG_COLUMNS, PATIENT_COLUMNS, VISIT_COLUMNS, SNAPSHOT_PREFIX, SNAPSHOTS_KEPT
from ..session import shared_table
from .part_files import write_parts

# ------------------------------------------------------------------ CSV
SQL_DATETIME = "yyyy-MM-dd HH:mm:ss"
ISO_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _cell(df: DataFrame, name: str) -> Column:
    """A value as the export prints it (String(value) in the application)."""
    t = dict(df.dtypes)[name]
    c = F.col(name)
    if t.startswith("decimal"):
        return js_decimal_text(c)
    if t in ("double", "float", "int", "bigint", "smallint"):
        return js_number_text(c)
    if t.startswith("timestamp"):
        return F.date_format(c, SQL_DATETIME)
    return c.cast("string")


def export_frame(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """String cells under the export's headers, in the frame's order."""
    return df.select(*[_cell(df, k).alias(h) for k, h in columns])


def export_csv_patients(patients: DataFrame) -> DataFrame:
    p = patients.orderBy("last_name", "first_name", "id")
    return export_frame(p, PATIENT_COLUMNS)


def export_csv_visits(visits: DataFrame, patients: DataFrame, staff: DataFrame) -> DataFrame:
    v = (visits_enriched(visits, patients, staff).orderBy("visit_date", "id")
         .withColumn("patient_name", F.concat_ws(" ", F.col("first_name"), F.col("last_name")))
         .withColumn("balance", F.col("charge_amount") - F.col("payment_amount")))
    return export_frame(v, VISIT_COLUMNS)


def export_csv_drugs(drugs: DataFrame) -> DataFrame:
    return export_frame(drugs.orderBy("name", "id"), DRUG_COLUMNS)


def csv_value(c: Column) -> Column:
    """Quote only when the value holds a comma, quote, CR or LF; double the
    quotes inside; NULL prints as empty."""
    s = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.isNull(), F.lit("")).when(s.rlike('[",\r\n]'), quoted).otherwise(s)


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as one CSV line (column ``value``), header line first."""
    return df.sparkSession.createDataFrame([(_csv_header(df),)], "value string").union(_csv_body(df))


def _csv_header(df: DataFrame) -> str:
    return ",".join(_csv_text(c) for c in df.columns)


def _csv_body(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_value(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def _csv_text(v: str) -> str:
    return '"' + v.replace('"', '""') + '"' if re.search(r'[",\r\n]', v) else v


def write_csv(df: DataFrame, path: str, crlf: bool = True, mode: str = "overwrite") -> None:
    """Write an export frame as CSV part files.

    ``crlf=True`` writes the application's exact bytes: records separated by
    CRLF, none after the last, while CR/LF inside a quoted value stay as they are (the built-in CSV
    writer's ``lineSep`` would rewrite those too). The header is ``part-00000``; every other record has its
    separator before it, so concatenating the parts in name order gives the whole file. Parts appear when the
    whole job is done (``part_files``). ``crlf=False``
    uses Spark's CSV writer with options that keep quotes, spaces and NULLs
    identical, separating records with LF."""
    if crlf:
        write_parts(_csv_body(df), path, opening=_csv_header(df), before="\r\n", mode=mode)
    else:
        (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", "").option("emptyValue", "").option("lineSep", "\n").csv(path))


# ------------------------------------------------------------------ nested JSON
def entry_json() -> Column:
    """One history entry as the nested export prints it."""
    return F.to_json(F.struct(
        F.col("id").alias("id"), F.col("entry_date").cast("string").alias("entryDate"),
        F.col("entry_type").alias("entryType"), F.col("medication").alias("medication"),
        F.col("day_supply").alias("daySupply"),
        F.date_format(F.col("reminder_sent_at"), ISO_INSTANT).alias("reminderSentAt")), {"ignoreNullFields": "false"})


def _nested(owners: DataFrame, entries: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(keys, entry_id, row, text): the JSON documents of ``owners(keys, open, close)`` with their ``entries(keys, entry_id,
    json, order)``, a piece of text for each entry (one for an owner without any); in the order of ``row`` the pieces are the documents.

    Pieces are range-partitioned by (owner, order), written once and numbered. A document may run over many
    partitions: its first and last piece are found by an aggregate over the numbers and get its opening and
    its end by a join on the number, which is unique, so an owner of any size is spread over tasks."""
    held = entries.join(owners.select(*keys), list(keys), "left_semi")
    bare = owners.select(*keys).join(entries.select(*keys).distinct(), list(keys), "left_anti")
    both = held.unionByName(bare, allowMissingColumns=True)
    pieces = shared_table(both.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                          .withColumn("row", F.monotonically_increasing_id()), "nested-pieces")
    ends = shared_table(pieces.groupBy(*keys).agg(F.min("row").alias("first"), F.max("row").alias("last")).join(owners, list(keys)), "nested-ends")
    told = (pieces.join(ends.select(F.col("first").alias("row"), "open"), "row", "left")
            .join(ends.select(F.col("last").alias("row"), "close"), "row", "left"))
    lead = F.when(F.col("open").isNull(), F.lit(",")).otherwise(F.col("open"))
    return told.select(*keys, "entry_id", "row", F.concat(lead, F.coalesce("json", F.lit("")), F.coalesce("close", F.lit(""))).alias("text"))


def _entries(history: DataFrame, tenant: Sequence[str]) -> DataFrame:
    return history.select(*tenant, F.col("client_id").alias("id"), F.col("id").alias("entry_id"), "entry_date", entry_json().alias("json"))


NEWEST = ("entry_date", "entry_id")


def export_clients_nested(clients: DataFrame, history: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Every client (any status) as one JSON document with its history, newest first (entry_date, id; entries without a
    date last), ``[]`` without any: pieces (tenant, id, entry_id, row, text) whose texts in the order of ``row`` are the
    documents, one a line. No row or task holds a client's history. Entries whose client is NULL or unknown are
    left out; client ids are unique, as the tables declare."""
    head = F.to_json(F.struct("id", "name", "phone", "status"), {"ignoreNullFields": "false"})
    owners = clients.select(*tenant, "id", F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"history":[')).alias("open"), F.lit("]}\n").alias("close"))
    return _nested(owners, _entries(history, tenant), [*tenant, "id"], [F.desc(c) for c in NEWEST])


def write_nested(pieces: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write nested documents as JSON lines: the parts' bytes in name order, where a part may begin inside a document."""
    write_parts(pieces.repartitionByRange("row").sortWithinPartitions("row").select("text"), path, mode=mode)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON document (NULL fields kept as null)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    to_json_lines(df).write.mode(mode).text(path)


# ------------------------------------------------------------------ sync documents
def sync_envelope(settings: DataFrame, clients: DataFrame, history: DataFrame,
                  tenant: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """Cloud-sync payload of the clinics that opted in (reminders enabled and
    an SMS username and key set), one document per (clinic, client) carrying the
    clinic id and SMS sender settings, in pieces like ``export_clients_nested``. API keys and sync tokens are never
    emitted."""
    from ..operators.changes import settings_pivot
    s = settings_pivot(settings, ["refillRemindersEnabled", "smsUsername", "smsApiKey", "smsSenderId"], tenant)
    opted = s.where((F.col("refillRemindersEnabled") == "1") & (F.coalesce(F.col("smsUsername"), F.lit("")) != "")
                    & (F.coalesce(F.col("smsApiKey"), F.lit("")) != ""))
    if not set(tenant) <= set(history.columns):   # history rows take their client's clinic
        history = history.join(clients.select(F.col("id").alias("client_id"), *tenant), "client_id", "left")
    keep = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(F.col(tenant[0]).alias("clinicId"), F.struct(F.col("smsUsername").alias("username"), F.col("smsSenderId").alias("senderId")).alias("smsSettings"),
                              F.struct("id", "name", "phone", "status").alias("client")), keep)
    owners = (clients.join(opted.select(*tenant, "smsUsername", "smsSenderId"), list(tenant))
              .select(*tenant, "id", F.concat(F.substr(head, F.lit(1), F.length(head) - 2), F.lit(',"history":[')).alias("open"), F.lit("]}}\n").alias("close")))
    return _nested(owners, _entries(history, tenant), [*tenant, "id"], [F.desc(c) for c in NEWEST])


# ------------------------------------------------------------------ snapshots
SNAPSHOT_NAME = re.compile(r"^" + re.escape(SNAPSHOT_PREFIX) + r"\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$")


MANIFEST = "name string, taken_at timestamp, tables array<string>, dropped boolean"


def snapshot_name(at: dt.datetime) -> str:
    """Names sort in time order: snapshot-yyyy-MM-dd_HH-mm-ss."""
    return SNAPSHOT_PREFIX + at.strftime("%Y-%m-%d_%H-%M-%S")


TABLE_CHECK = "table_name string, column_name string, records long, filled long, checksum long"
WHOLE_ROW = "*"


def _sums(df: DataFrame) -> dict[str, Column]:
    """Aggregates that name what a table holds: rows, and for each column (and for whole rows) the filled values and a sum
    of their texts' digests; independent of order and files."""
    def digest(text: Column) -> Column:
        return F.coalesce(F.sum(F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("long")), F.lit(0))
    texts = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    out = {"records": F.count(F.lit(1))}
    for c, text in {**texts, WHOLE_ROW: F.concat_ws("|", *(F.coalesce(t, F.lit("-")) for t in texts.values()))}.items():
        out[f"filled {c}"] = F.count(text)
        out[f"checksum {c}"] = digest(text)
    return out


def _check_rows(table: str, columns: Sequence[str], got: dict) -> list[tuple]:
    return [(table, c, got["records"], got[f"filled {c}"], got[f"checksum {c}"]) for c in (*columns, WHOLE_ROW)]


def _move_folder(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if fs.exists(path(target)) or not fs.rename(path(source), path(target)):
        raise FileExistsError(f"cannot publish {target}")


def snapshot_write(tables: dict[str, DataFrame], root: str, at: dt.datetime) -> str:
    """A copy of all ``tables`` as of one read point, under ``root/<name>/<table>`` (parquet).

    The read point: a DataFrame over files reads those that were listed when it was made, so with all
    tables made before the call, rows that are appended while the snapshot runs are in none of its
    tables. The pinned file names are kept in ``_files``; rows and checksums of every column, taken from what was
    read in the pass that writes it, in ``_columns`` (``snapshot_check`` compares them with the copy). Tables are
    written by parallel jobs into a draft folder, which one rename publishes; the manifest row comes last, so a
    listed snapshot is whole and an unlisted one is not there."""
    name = snapshot_name(at)
    spark = next(iter(tables.values())).sparkSession
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    pinned = {t: df.inputFiles() for t, df in tables.items()}
    checks = []
    for t, df in tables.items():
        seen = Observation()
        df.observe(seen, *(c.alias(k) for k, c in _sums(df).items())).write.parquet(f"{draft}/{t}")
        checks += _check_rows(t, df.columns, seen.get)
    spark.createDataFrame([(t, f) for t, files in pinned.items() for f in files], "table_name string, file string").write.parquet(f"{draft}/_files")
    spark.createDataFrame(checks, TABLE_CHECK).coalesce(1).write.parquet(f"{draft}/_columns")
    _move_folder(spark, draft, f"{root}/{name}")
    manifest = spark.createDataFrame([(name, at, sorted(tables), False)], MANIFEST)
    manifest.write.mode("append").parquet(f"{root}/_manifest")
    return name


def snapshot_check(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Every column of a snapshot's tables (and ``*``, its whole rows) as the files have it now, with ``same``: whether that is what was read
    when the snapshot was taken. A damaged, lost or added value shows in its column."""
    told = spark.read.schema(TABLE_CHECK).parquet(f"{root}/{name}/_columns")
    now = None
    for r in told.select("table_name").distinct().collect():      # one row a table
        copy = spark.read.parquet(f"{root}/{name}/{r.table_name}")
        one = copy.agg(*(c.alias(k) for k, c in _sums(copy).items()))
        columns = F.array(*(F.struct(F.lit(r.table_name).alias("table_name"), F.lit(c).alias("column_name"), F.col("records"),
                                     F.col(f"`filled {c}`").alias("filled"), F.col(f"`checksum {c}`").alias("checksum")) for c in (*copy.columns, WHOLE_ROW)))
        one = one.select(F.inline(columns))
        now = one if now is None else now.unionByName(one)
    kept = told.select("table_name", "column_name", F.struct("records", "filled", "checksum").alias("told"))
    return (now.join(kept, ["table_name", "column_name"], "full")
            .withColumn("same", F.coalesce(F.struct("records", "filled", "checksum") == F.col("told"), F.lit(False))).drop("told"))


def snapshots_to_drop(manifest: DataFrame, keep: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Names beyond the newest ``keep`` (by name); foreign names and names that
    already have a tombstone are ignored. The manifest has one row per snapshot."""
    own = manifest.where(F.col("name").rlike(SNAPSHOT_NAME.pattern))
    if "dropped" in manifest.columns:
        gone = own.where("dropped").select("name")
        own = own.join(gone, "name", "left_anti")
    own = own.select("name").distinct()
    newest = own.orderBy(F.desc("name")).limit(keep)
    return own.join(newest, "name", "left_anti")


def snapshot_retention(spark: SparkSession, root: str, keep: int = SNAPSHOTS_KEPT) -> int:
    """Delete snapshots beyond the newest ``keep``; returns how many went.

    The manifest is only ever appended to: a tombstone row is written for each name before its folder is
    deleted, so a stop in between loses no entry, and folders that a stopped run left behind are
    deleted by the next. Folders go through the Hadoop file system of ``root``
    (works for local, HDFS and object stores alike)."""
    manifest = spark.read.option("mergeSchema", "true").parquet(f"{root}/_manifest")
    names = [r["name"] for r in snapshots_to_drop(manifest, keep).collect()]  # bounded: <= snapshots taken
    if names:
        rows = [(n, None, None, True) for n in names]
        spark.createDataFrame(rows, MANIFEST).write.mode("append").parquet(f"{root}/_manifest")
    manifest = spark.read.option("mergeSchema", "true").parquet(f"{root}/_manifest")
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    for r in manifest.where("dropped").select("name").distinct().collect():   # one per snapshot ever dropped
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{r['name']}")
        if fs.exists(path):
            fs.delete(path, True)
    return len(names)


def snapshot_names(spark: SparkSession, root: str) -> DataFrame:
    """Names of the snapshots that are kept."""
    manifest = spark.read.option("mergeSchema", "true").parquet(f"{root}/_manifest")
    return manifest.groupBy("name").agg(F.max("dropped").alias("d")).where("not d").select("name")
