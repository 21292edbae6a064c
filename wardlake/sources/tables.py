"""Table scans with the declared schema, and the schema upgrade of old files.

``scan_table`` reads parquet with the declared StructType (no inference, so
a missing column reads as NULL and pruning/pushdown stay intact). Old files
that predate a column are brought up to date the way the application did it:
columns are only added, never dropped or rewritten, and a visit file without
``charge_amount`` takes it from ``payment_amount`` (a visit was paid in full
before charges were recorded). ``upgrade_folder`` finds each file's layout by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES
from ..session import ship_package
from .part_files import open_folder


def conform(df: DataFrame, table: str, keep_extra: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """Cast to the declared schema; declared columns the frame lacks are NULL.
    Columns outside the schema are dropped except ``keep_extra`` (tenant)."""
    schema: T.StructType = TABLES[table]
    have = set(df.columns)
    cols = [*[c for c in keep_extra if c in have]]
    for f in schema.fields:
        src = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(src.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def scan_table(spark: SparkSession, path: str, table: str, tenant: Sequence[str] = ()) -> DataFrame:
    """Read one clinic table stored as parquet under its declared schema."""
    schema = TABLES[table]
    for t in tenant:
        schema = schema.add(t, T.IntegerType())
    return spark.read.schema(schema).parquet(path)


def schema_upgrade(current: DataFrame, *older: DataFrame, table: str = "visits") -> DataFrame:
    """Union files of older layouts with current ones under the current schema.

    Only files that lack ``charge_amount`` get it from ``payment_amount``;
    a NULL charge in a current-layout file stays as it is. Missing author and
    vitals columns stay NULL (unknown, never guessed)."""
    out = conform(current, table)
    for old in older:
        out = out.unionByName(_upgraded(old, table))
    return out


def _upgraded(df: DataFrame, table: str) -> DataFrame:
    if table == "visits" and "charge_amount" not in df.columns:
        df = df.withColumn("charge_amount", F.col("payment_amount"))
    return conform(df, table)


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """(path, layout) of every Parquet file below ``path``: its columns and their types as the file's own footer tells,
    the footers read by tasks. A file without a Parquet footer raises an error."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                system, place = open_folder(name)
                with system.open_input_file(place) as f:
                    found.append([f"{c.name} {c.type}" for c in pq.ParquetFile(f).schema_arrow])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["path", "layout"])

    return files.repartition("path").mapInArrow(read, "path string, layout array<string>")


def upgrade_folder(spark: SparkSession, path: str, table: str = "visits") -> DataFrame:
    """All files below ``path``, of whatever layouts, under the current schema.

    Files of one layout are read together, each layout by the rules of ``schema_upgrade``: what a file does not
    have is NULL, and only a visit file without a ``charge_amount`` column takes it from ``payment_amount``; a NULL
    charge that a file does have stays. The driver holds the files' names, as for any scan. An empty folder gives no rows."""
    by: dict[tuple[str, ...], list[str]] = {}
    for r in layouts(spark, path).collect():
        by.setdefault(tuple(r.layout), []).append(r.path)
    if not by:
        return spark.createDataFrame([], TABLES[table])
    parts = [spark.read.parquet(*sorted(files)) for _, files in sorted(by.items())]
    out = None
    for p in parts:
        one = _upgraded(p, table)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
