"""Queries: incremental scoring as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..session import scratch_dir
from ..streaming import streams as Z
from .oracles import with_ctes
from .registry import query

METRIC_SCHEMA = "seed int, key string, model string, f1_macro double, accuracy double, rmse double"
STATUS_SCHEMA = "seed int, key string, model string, status string, reason string, ts timestamp_ntz"


@query("stream_scored_units", with_ctes("SELECT seed, key, model, f1_macro FROM metrics_run", "metrics_run"))
def q_stream_scored(spark, d):
    src, out, ck = scratch_dir(spark, "in"), scratch_dir(spark, "scored"), scratch_dir(spark, "ck")
    m = C.metrics_run(spark, d)
    m.filter("seed <= 2").write.mode("append").parquet(src)
    m.filter("seed >= 2").write.mode("append").parquet(src)      # seed 2 arrives twice
    Z.score_new_units(spark, src, METRIC_SCHEMA, out, ck, max_files_per_trigger=4)
    return spark.read.parquet(out).select(F.col("seed").cast("int"), "key", "model", "f1_macro")


def _status_log(spark, d):
    s = C.status(spark, d)
    base = s.select("seed", "key", "model", "status", "reason", F.col("ts").cast("timestamp_ntz").alias("ts"))
    rerun = (base.filter("status = 'retry'").withColumn("status", F.lit("pass")).withColumn("reason", F.lit(""))
             .withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")))
    late = (base.filter("status <> 'retry'").withColumn("status", F.lit("fail")).withColumn("reason", F.lit("stale"))
            .withColumn("ts", F.col("ts") - F.expr("INTERVAL 2 DAY")))
    return base, rerun, late


@query("stream_status_totals", with_ctes("SELECT status, count(*) AS n_units FROM status GROUP BY 1", "status"))
def q_stream_totals(spark, d):
    src, ck = scratch_dir(spark, "status"), scratch_dir(spark, "ck")
    base, _, _ = _status_log(spark, d)
    base.write.json(src)
    return Z.status_totals(spark, src, STATUS_SCHEMA, ck, scratch_dir(spark, "totals"))


LATEST_SQL = with_ctes("""
SELECT seed, key, model, CASE WHEN status = 'retry' THEN 'pass' ELSE status END AS status,
       CASE WHEN status = 'retry' THEN '' ELSE reason END AS reason FROM status""", "status")


@query("latest_status", LATEST_SQL)
def q_latest(spark, d):
    base, rerun, late = _status_log(spark, d)
    return Z.latest_status(base.unionByName(rerun).unionByName(late)).select("seed", "key", "model", "status", "reason")


@query("stream_latest_status", LATEST_SQL)
def q_stream_latest(spark, d):
    src, out, ck = scratch_dir(spark, "log"), scratch_dir(spark, "latest"), scratch_dir(spark, "ck")
    base, rerun, late = _status_log(spark, d)       # late: older records that arrive last
    for part in (base, rerun, late):
        part.write.mode("append").json(src)
    Z.upsert_latest(spark, src, STATUS_SCHEMA, out, ck, max_files_per_trigger=1)
    return Z.read_latest_version(spark, out).select("seed", "key", "model", "status", "reason")


@query("stream_progress", with_ctes("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
       CASE WHEN k < 70 THEN 'pass' WHEN k < 85 THEN 'fail' WHEN k < 95 THEN 'skip' ELSE 'retry' END AS status,
       count(*) AS n
FROM event_units GROUP BY 1, 2""", "event_units"))
def q_progress(spark, d):
    src, ck = scratch_dir(spark, "events"), scratch_dir(spark, "ck")
    u = C._event_units(spark, d)
    st = F.when(F.col("k") < 70, "pass").when(F.col("k") < 85, "fail").when(F.col("k") < 95, "skip").otherwise("retry")
    u.select("seed", "key", "model", st.alias("status"), F.lit("").alias("reason"),
             F.col("ts").cast("timestamp_ntz").alias("ts")).write.json(src)
    return Z.progress(spark, src, STATUS_SCHEMA, ck, scratch_dir(spark, "totals"))


@query("stream_late_data", with_ctes("""
WITH e AS (SELECT CAST(ts AS DATE) AS d, max(CAST(ts AS DATE)) OVER () AS last,
           CASE WHEN k < 70 THEN 'pass' WHEN k < 85 THEN 'fail' WHEN k < 95 THEN 'skip' ELSE 'retry' END AS status FROM event_units)
SELECT strftime(d, '%Y-%m-%d') AS day, status, count(*) * CASE WHEN d = last THEN 2 ELSE 1 END AS n,
       (SELECT count(*) FROM e WHERE d <= last - INTERVAL 3 DAY) AS n_late
FROM e GROUP BY d, last, status""", "event_units"))
def q_late_data(spark, d):
    """Every event of the last day and of all but the last three comes a second time, after the watermark has moved:
    the former are counted again, the latter are late, and counted as such."""
    src, ck, out = scratch_dir(spark, "events"), scratch_dir(spark, "ck"), scratch_dir(spark, "totals")
    u = C._event_units(spark, d)
    st = F.when(F.col("k") < 70, "pass").when(F.col("k") < 85, "fail").when(F.col("k") < 95, "skip").otherwise("retry")
    rows = u.select("seed", "key", "model", st.alias("status"), F.lit("").alias("reason"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    last = F.to_date(u.agg(F.max("ts").alias("ts")).scalar())
    rows.write.json(src)
    Z.progress(spark, src, STATUS_SCHEMA, ck, out)
    day = F.to_date("ts")
    rows.filter((day == last) | (day <= F.date_sub(last, 3))).write.mode("append").json(src)
    totals = Z.progress(spark, src, STATUS_SCHEMA, ck, out)
    late = Z.late_records(spark, src, STATUS_SCHEMA, totals)
    return totals.withColumn("n_late", late.scalar())
