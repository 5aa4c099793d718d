"""Incremental scoring as Structured Streaming.

The reference's incremental behaviours (skip units already scored, append per seed, an
observed-only preview) become file-source streams run with ``availableNow`` triggers:
each run processes exactly the files that arrived since the last one (tracked in the
checkpoint), and sinks are idempotent per micro-batch. All results are tables in the shared
folder, dealt to ``BUCKETS`` by a hash of the unit, so that a batch reads and rewrites the
buckets of its own units only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits

UNIT = ["seed", "key", "model"]
#: Parts of a table that is kept by unit.
BUCKETS = 64


def bucket_of(cols: list[str]) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def _touched(batch: DataFrame) -> list[int]:
    """Buckets of a batch: at most ``BUCKETS`` numbers."""
    return sorted(r[0] for r in batch.select("bucket").distinct().collect())


def score_new_units(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str,
                    max_files_per_trigger: int | None = None) -> None:
    """Score newly arrived metric/prediction rows once per unit.

    ``foreachBatch`` keeps one row per unit (the least by all columns, whatever the order of
    arrival inside a batch), leaves out units of earlier epochs and writes micro-batch ``e``
    to ``out/epoch=e`` with overwrite, so a replayed batch rewrites its own folder. What has
    been scored is looked up in ``out`` by one scan, pruned to earlier epochs and to the
    buckets that the batch touches, so the stream holds no state and its plan does not grow.
    Read ``out`` as one table (``epoch`` tells when a unit was scored).
    """
    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in UNIT]
        new = batch.groupBy(*UNIT).agg(F.min(F.struct(*rest)).alias("r")).select(*UNIT, "r.*", bucket_of(UNIT).alias("bucket"))
        new = new.persist()
        try:
            fresh = new
            if epoch and any(n.startswith("epoch=") for n in commits.names(spark, out)):
                known = f"seed {dict(batch.dtypes)['seed']}, key string, model string, epoch int, bucket int"
                seen = spark.read.schema(known).option("basePath", out).parquet(out).filter(
                    (F.col("epoch") < epoch) & F.col("bucket").isin(_touched(new)))
                fresh = new.join(seen.select(*UNIT), UNIT, "left_anti")
            fresh.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/epoch={epoch}")
        finally:
            new.unpersist()

    _run(_files(spark, schema, max_files_per_trigger).parquet(source), write, checkpoint)


def _files(spark: SparkSession, schema: str, max_files_per_trigger: int | None = None):
    r = spark.readStream.schema(schema)
    return r.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else r


def _run(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, batch by batch, and end."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()


def _log_totals(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Add the totals that each batch changes to ``out/epoch=<e>``; a replayed batch rewrites its own folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _run(stream, write, checkpoint, "update")


def _latest_totals(spark: SparkSession, out: str, keys: list[str], value: str) -> DataFrame:
    """The newest total of each key."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))


def status_totals(spark: SparkSession, source: str, schema: str, checkpoint: str, out: str) -> DataFrame:
    """Live status totals, kept in the shared table ``out`` and returned from it.

    The stream's state holds one count per status; each batch adds the totals that it changed
    (update mode), so any session can read the present totals."""
    s = _files(spark, schema).json(source).groupBy("status").agg(F.count(F.lit(1)).alias("n_units"))
    _log_totals(s, out, checkpoint)
    return _latest_totals(spark, out, ["status"], "n_units")


def latest_status(records: DataFrame, order=("ts",)) -> DataFrame:
    """Z03 (batch form): the latest record per unit wins (a rerun replaces ``retry``).

    ``max_by`` inside a hash aggregate — no sort of a unit's history."""
    cols = [c for c in records.columns if c not in UNIT]
    agg = records.groupBy(*UNIT).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return agg.select(*UNIT, "r.*")


def _folders(spark: SparkSession, out: str, before: int | None = None) -> dict[str, str]:
    """Folder of each bucket in the newest version of an upserted table (older than ``before``)."""
    found = [n for n in commits.names(spark, f"{out}/versions") if n.isdigit() and (before is None or int(n) < before)]
    return json.loads(commits.read_text(spark, f"{out}/versions/{found[-1]}")) if found else {}


def read_latest_version(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest version of an upserted table, or None."""
    folders = _folders(spark, out)
    return spark.read.parquet(*(f"{out}/{f}" for f in folders.values())) if folders else None


def upsert_latest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str,
                  max_files_per_trigger: int | None = None) -> None:
    """Z03 (stream form): each micro-batch is merged with the version of the epochs before it;
    of a unit's records the latest by ``ts`` stays, so a late older record changes nothing.

    Only the buckets that the batch touches are read and written, to ``out/epoch=<e>``; the version
    file of the epoch then names the folder of every bucket, so readers see a batch whole or
    not at all. A replayed epoch reads earlier versions only and rewrites its own folder."""
    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("bucket", bucket_of(UNIT)).persist()
        try:
            touched, folders = _touched(rows), _folders(spark, out, before=epoch)
            old = [f"{out}/{folders[str(b)]}" for b in touched if str(b) in folders]
            merged = rows.drop("bucket")
            if old:
                merged = merged.unionByName(spark.read.schema(batch.schema).parquet(*old))
            latest_status(merged).withColumn("bucket", bucket_of(UNIT)).repartition("bucket") \
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/epoch={epoch}")
            folders |= {str(b): f"epoch={epoch}/bucket={b}" for b in touched}
            commits.make_folder(spark, f"{out}/versions")
            commits.create_exclusive(spark, f"{out}/versions/{epoch:09d}", json.dumps(folders))     # a replay's is the same
        finally:
            rows.unpersist()

    _run(_files(spark, schema, max_files_per_trigger).json(source), merge, checkpoint)


def progress(spark: SparkSession, source: str, schema: str, checkpoint: str, out: str,
             window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Units per status and event-time window, kept in the shared table ``out``.

    The watermark bounds the state: a window that ends before it is dropped from the state, and
    a record of such a window that comes later is left out (see :func:`late_records`). The
    driver's timestamps load as TIMESTAMP_NTZ, which watermarks reject; the wall clock is turned
    into an epoch instant field by field (no session-zone dependence).
    """
    # event time = the wall clock read as UTC, built from its date/time fields, so the
    # epoch-aligned windows are wall-clock days whatever the session time zone is
    wall = F.col("ts")
    secs = (F.datediff(F.to_date(wall), F.lit("1970-01-01").cast("date")).cast("long") * 86400
            + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall))
    s = (_files(spark, schema).json(source)
         .withColumn("ts", F.timestamp_seconds(secs))
         .withWatermark("ts", watermark)
         .groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")))
    days = F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    _log_totals(s.select(day.alias("day"), "status", "n"), out, checkpoint)
    return _latest_totals(spark, out, ["day", "status"], "n")


def late_records(spark: SparkSession, source: str, schema: str, totals: DataFrame) -> DataFrame:
    """``n_late``, the records that came too late: those that arrived less those that a window counted."""
    arrived = spark.read.schema(schema).json(source).agg(F.count(F.lit(1)).alias("arrived"))
    counted = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    return arrived.withColumn("counted", counted.scalar()).select((F.col("arrived") - F.col("counted")).alias("n_late"))
