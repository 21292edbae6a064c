"""Stored Parquet tables: lookups and changes that read and rewrite only the part they concern.

``key_ranges`` describes a batch of keys by at most ``RANGES`` ranges, cut at the batch's quantiles, and ``within`` turns
them into a filter that reaches the Parquet scan: row groups and pages whose smallest and largest key lie outside
all ranges are not read. The filter only narrows a scan; the join that follows decides, so results are exact for any batch.

``merge_changes`` is a copy-on-write merge: it finds the partitions of the stored table that hold a changed
key (reading keys only), and writes those again by dynamic partition overwrite. Other partitions' files are neither read
nor touched. Tasks write to a staging folder and the partitions are exchanged when all tasks are done, so a lost
executor costs its tasks and a failed job leaves the table as it was. One writer at a time is assumed; if a driver is
lost while partitions are exchanged, running the same batch again completes it, as the last change wins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 64   # bounds the size of the filter, not the number of keys


def key_ranges(keys: DataFrame, key: str) -> list[tuple]:
    """At most ``RANGES`` (lowest, highest) pairs that together hold every key of the batch, two small jobs over it.
    NULL keys belong to none; keys that are not numbers are described by one range; no keys, no ranges."""
    asked = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull())
    place = F.lit(0)
    if isinstance(asked.schema["key"].dataType, (T.IntegralType, T.FractionalType)):
        cuts = asked.agg(F.percentile_approx("key", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts")).first().cuts
        if cuts is None:
            return []
        place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("key")))
    found = asked.groupBy(place.alias("place")).agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    return sorted((r.low, r.high) for r in found)


def within(key: Column, ranges: Sequence[tuple]) -> Column:
    """True where ``key`` lies in one of the ranges; false everywhere if there are none."""
    out = None
    for low, high in ranges:
        one = (key >= F.lit(low)) & (key <= F.lit(high))
        out = one if out is None else out | one
    return F.lit(False) if out is None else out


def lookup_stored(table: DataFrame, keys: DataFrame, key: str = "id", tenant: Sequence[str] = ()) -> DataFrame:
    """``search.lookup_by_keys`` on a stored table: every record whose key is in ``keys``, once, reading only
    the row groups that can hold one."""
    asked = keys.select(*tenant, key).distinct()
    return table.where(within(F.col(key), key_ranges(asked, key))).join(asked, [*tenant, key], "left_semi")


def _write(df: DataFrame, path: str, part: str, key: str, mode: str) -> None:
    # ranges of (partition, key): a large partition is written by several tasks, and each file covers few keys
    (df.repartitionByRange(part, key).sortWithinPartitions(part, key).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))


def store_table(df: DataFrame, path: str, part: str, key: str = "id") -> None:
    """Write ``df`` to a new folder, a sub-folder for each value of the column ``part``, keys in order."""
    _write(df, path, part, key, "errorifexists")


def touched_parts(table: DataFrame, changes: DataFrame, part: str, key: str = "id", tenant: Sequence[str] = ()) -> list:
    """The values of ``part`` (NULL among them, if so) whose rows hold a key of ``changes``."""
    held = lookup_stored(table.select(part, *tenant, key), changes, key, tenant)
    return [r[0] for r in held.select(part).distinct().collect()]   # as many as partition folders, which the driver lists anyway


def merge_changes(spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame,
                  change: Callable[[DataFrame, DataFrame], DataFrame], part: str, key: str = "id",
                  tenant: Sequence[str] = ()) -> list:
    """Apply ``change(rows, changes) -> rows`` to the stored table at ``path`` and store the outcome; returns the values of
    ``part`` that were written again.

    ``change`` is one of the ``changes.apply_*`` functions: it keeps every row it is given, with the same ``part``. Keys that
    the table does not hold change nothing; a batch without keys of the table writes nothing. DataFrames made
    from the path before have to be made again, since their files are gone."""
    base = spark.read.schema(schema).parquet(path)
    parts = touched_parts(base, changes, part, key, tenant)
    if parts:
        known = [p for p in parts if p is not None]
        here = F.col(part).isin(known) if known else F.lit(False)
        if len(known) < len(parts):
            here = here | F.col(part).isNull()
        _write(change(base.where(here), changes).select(*base.columns), path, part, key, "overwrite")
        spark.catalog.refreshByPath(path)
    return parts
