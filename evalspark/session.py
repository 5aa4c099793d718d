"""Session helpers: build a tuned session and locate the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _default_driver_mem() -> str:
    """Half of the machine's memory, at most 16 GiB (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total / 2 ** 30 * 0.5)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "evalspark") -> SparkSession:
    """Return a session configured for evaluation workloads.

    AQE is on so shuffle partitions coalesce and skewed joins split at runtime; the UI is
    off (no server). On a cluster ``master`` and memory come from spark-submit.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    local = bool(master) or not os.environ.get("SPARK_MASTER_URL")
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # coalesce small shuffle outputs by size, not to keep every core busy
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if local:
        # one machine: size shuffles to the cores; on a cluster the submit config decides
        builder = (builder.master(master or f"local[{cpus}]")
                   .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
                   .config("spark.driver.memory", os.environ.get("EVALSPARK_DRIVER_MEM", _default_driver_mem())))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    We only set our own (a fresh temp folder) when the session has none, as in local tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            # executors on other machines cannot see a local temp folder
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS / object store)")
        base = tempfile.mkdtemp(prefix="evalspark-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the session's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage of a table that several branches of a plan read (e.g. a split).

    The table is written once as parquet under the session's shared checkpoint folder
    (reliable storage that survives executor loss, unlike a local checkpoint) and read
    back, so the branches scan files — with column pruning and statistics — instead of
    recomputing the split each time.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows up to which a written table is sent to every executor.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, name: str = "small") -> DataFrame:
    """The small side of a join, written once and broadcast if its rows, then known, are few.

    Spark cannot tell the size of an aggregate before it has run: it shuffles the large side
    too, by a key of few values, before it learns that it need not. A table of more rows than
    :data:`BROADCAST_ROWS` is joined as any other."""
    table = materialize(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
