"""Stored tables: pruned lookups and copy-on-write merges touch only the part they concern."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import rows
from wardlake.operators import changes, search
from wardlake.session import checkpoint_dir
from wardlake.sources import stored

SCHEMA = "id long, status string, note string, month string"


def appointments(spark, n=4000):
    return spark.range(n).select("id", F.lit("Scheduled").alias("status"), F.concat(F.lit("n"), "id").alias("note"),
                                 F.when(F.col("id") % 1000 != 999, F.format_string("2024-%02d", F.expr("id div 400 + 1"))).alias("month"))


def new_path(spark):
    return f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


def files(path):
    """Data files below ``path`` with what tells a new version of a file."""
    place = path.removeprefix("file:")
    return {os.path.relpath(os.path.join(d, f), place): os.stat(os.path.join(d, f)).st_ino
            for d, _, names in os.walk(place) for f in names if f.endswith(".parquet")}


def rows_scanned(df):
    """Rows that the Parquet scans of a plan handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    if "Adaptive" in plan.getClass().getSimpleName():
        plan = plan.finalPhysicalPlan()
    leaves, total, todo = [], 0, [plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
        if below.size() == 0:
            leaves.append(node)
    for leaf in leaves:
        total += leaf.metrics().apply("numOutputRows").value() if leaf.metrics().contains("numOutputRows") else 0
    return total


@pytest.mark.parametrize("keys", [[], [7], [7, 7, 3999, None], [10**15, -5, 2**62 + 1], list(range(0, 4000, 3)), "random"])
def test_pruned_lookup_equals_the_plain_one(spark, keys):
    table = appointments(spark).unionByName(spark.createDataFrame([(2**62, "x", "big", "m"), (2**62 + 1, "x", "bigger", "m"), (None, "x", "none", "m")], SCHEMA))
    keys = random.Random(3).choices(range(-50, 4100), k=700) if keys == "random" else keys
    asked = spark.createDataFrame([(k, "z") for k in keys], "id long, status string")
    assert rows(stored.lookup_stored(table, asked)) == rows(search.lookup_by_keys(table, asked))


def test_ranges_hold_every_key_and_are_few(spark):
    keys = sorted(random.Random(1).sample(range(10**12), 3000)) + [0] * 3000
    ranges = stored.key_ranges(spark.createDataFrame([(k,) for k in keys] + [(None,)], "id long"), "id")
    assert 32 <= len(ranges) <= stored.RANGES and all(sum(a <= k <= b for a, b in ranges) == 1 for k in set(keys))
    assert stored.key_ranges(spark.createDataFrame([("b",), ("a",), (None,)], "id string"), "id") == [("a", "b")]


def test_lookup_reads_few_row_groups(spark):
    path = new_path(spark)
    appointments(spark).repartitionByRange(40, "id").sortWithinPartitions("id").write.parquet(path)
    table = spark.read.schema(SCHEMA).parquet(path)
    asked = spark.createDataFrame([(5,), (3990,)], "id long")
    got = stored.lookup_stored(table, asked)
    assert rows(got, "id") == [(3990,), (5,)]
    assert rows_scanned(table.where(stored.within(F.col("id"), stored.key_ranges(asked, "id")))) <= 300
    assert rows_scanned(table) == 4000


def test_merge_writes_touched_partitions_only(spark):
    path, base = new_path(spark), appointments(spark)
    stored.store_table(base, path, "month")
    before, schema = files(path), base.schema
    batch = spark.createDataFrame([(3, "Cancelled", 1), (3, "Completed", 2), (5, "Nonsense", 3), (1999, "No-Show", 1), (10**9, "Completed", 1), (None, "Completed", 1)],
                                  "id long, status string, seq int")

    def change(some, ch):
        return changes.apply_appointment_status(some, ch)[0]

    want = rows(change(base, batch), "id", "status", "note", "month")
    parts = stored.merge_changes(spark, path, schema, batch, change, "month")
    assert set(parts) == {"2024-01", None}             # id 1999 has no month
    after = files(path)
    assert rows(spark.read.schema(schema).parquet(path), "id", "status", "note", "month") == want
    untouched = {f: i for f, i in before.items() if "month=2024-01" not in f and "HIVE_DEFAULT" not in f}
    assert len(untouched) >= 9 and untouched.items() <= after.items() and not (before.items() - untouched.items()) & after.items()
    assert stored.merge_changes(spark, path, schema, batch, change, "month") and rows(spark.read.schema(schema).parquet(path), "id", "status", "note", "month") == want
    again = files(path)
    assert stored.merge_changes(spark, path, schema, batch.where("id > 1000000"), change, "month") == [] and files(path) == again
    assert stored.merge_changes(spark, path, schema, batch.where("false"), change, "month") == [] and files(path) == again


def test_failed_merge_leaves_the_table(spark):
    path, base = new_path(spark), appointments(spark, 900)
    stored.store_table(base, path, "month")
    before = files(path)
    with pytest.raises(Exception, match="stop here"):
        stored.merge_changes(spark, path, base.schema, spark.createDataFrame([(1,)], "id long"),
                             lambda some, _: some.withColumn("note", F.when(F.col("id") == 300, F.raise_error(F.lit("stop here"))).otherwise(F.col("note"))), "month")
    assert files(path) == before and spark.read.schema(base.schema).parquet(path).count() == 900
