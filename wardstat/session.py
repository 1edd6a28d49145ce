"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; ``configure`` only
fills settings that are not set yet.  ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session and only invents a folder when the
setting is absent (local tests).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lookups we broadcast are literal tables of at most a few hundred rows;
    # everything data-sized goes through sort-merge / AQE re-planning.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; wide
    # projections (50-column adapter, one-pass profiles) would otherwise run
    # interpreted.  Above this size Spark splits the stage out of whole-stage
    # codegen instead (recommended value for HotSpot in Spark's docs).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app: str = "wardstat", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill unset defaults on an existing session (never overrides)."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only with a local master (tests) a scratch folder is made where the
    setting is absent; on a cluster its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        # executors of a cluster do not see a folder of the driver's machine
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="wardstat-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    else:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
    return d


_STAGE_TABLES: list = []


def release_stage_tables(spark: SparkSession | None = None) -> int:
    """Delete the stage tables this process wrote under the checkpoint
    folder (through the Hadoop FileSystem API, so any shared file system
    works).  DataFrames read from them are invalid afterwards."""
    spark = spark or SparkSession.getActiveSession()
    n = 0
    if spark is None:
        return n
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGE_TABLES:
        p = jvm.org.apache.hadoop.fs.Path(_STAGE_TABLES.pop())
        try:
            if p.getFileSystem(conf).delete(p, True):
                n += 1
        except Exception:  # noqa: BLE001 - best effort clean-up
            pass
    return n


def _release_at_exit():
    try:
        release_stage_tables()
    except Exception:  # noqa: BLE001
        pass


atexit.register(_release_at_exit)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder for a table that several
    jobs append to; ``release_stage_tables`` deletes it with the others."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _STAGE_TABLES.append(path)
    return path


def materialize(df, spark: SparkSession, name: str):
    """Cut lineage by writing ``df`` as Parquet under the checkpoint folder.

    A written table survives executor loss (unlike a local checkpoint) and
    the re-read plan starts from files, so later stages do not recompute the
    upstream joins.
    """
    path = stage_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cut_lineage(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as a Parquet table under the shared
    checkpoint folder and reading it back: one job (an eager RDD checkpoint
    would compute the plan twice), survives executor loss, and the re-read
    gets column pruning and filter pushdown."""
    return materialize(df, df.sparkSession, name)
