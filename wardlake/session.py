"""Spark session and shared-storage helpers.

Library functions never create sessions; callers pass one in. This module
only serves entry points (bench, tests, CLI) and the checkpoint folder rule:
the folder comes from ``spark.checkpoint.dir`` as the cluster sets it, and a
private one is chosen only when the session has none (local runs, tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "wardlake", extra: dict | None = None) -> SparkSession:
    """Session for local runs. On a cluster, use the session the platform gives."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("WARDLAKE_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``, as the cluster sets it),
    else the folder already given to ``setCheckpointDir``. Only when neither
    exists (local runs, tests) a private folder is made and registered with
    ``setCheckpointDir``; on a cluster without the setting this raises an error,
    so jobs never fall back to a machine-local folder. The setting itself is a core config that
    cannot change at runtime, so it is never written here."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    sc = spark.sparkContext
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="wardlake-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back, so
    that later steps see one version of it and lost executors cost nothing."""
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: list[bool] = []


def ship_package(spark: SparkSession) -> None:
    """Make the pandas functions of the ledger and the streams runnable in
    Python workers that do not have ``wardlake`` installed: functions of this
    package are pickled by value (with what they reference from it) instead
    of by module path. No files are written or shipped."""
    if _SHIPPED:
        return
    from pyspark import cloudpickle

    import wardlake
    cloudpickle.register_pickle_by_value(wardlake)
    _SHIPPED.append(True)
