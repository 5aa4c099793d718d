"""Incremental sinks: one version a batch, touched buckets alone are written, late records are counted."""

from pyspark.sql import functions as F

from evalspark.session import scratch_dir
from evalspark.sources import commits
from evalspark.streaming import streams as Z

STATUS = "seed int, key string, model string, status string, reason string, ts timestamp_ntz"


def _records(spark, rows):
    return spark.createDataFrame([(0, "k", m, s, "", t) for m, s, t in rows], "seed int, key string, model string, status string, reason string, t string") \
        .select("seed", "key", "model", "status", "reason", F.col("t").cast("timestamp_ntz").alias("ts"))


def test_upsert_rewrites_touched_buckets_only(spark):
    src, out, ck = (scratch_dir(spark, n) for n in ("in", "out", "ck"))
    first = [(f"m{i}", "retry", "2024-01-01 00:00:00") for i in range(200)]
    _records(spark, first).write.json(src)
    Z.upsert_latest(spark, src, STATUS, out, ck)
    _records(spark, [("m7", "pass", "2024-01-02 00:00:00")]).write.mode("append").json(src)
    Z.upsert_latest(spark, src, STATUS, out, ck)
    _records(spark, [("m7", "fail", "2023-01-02 00:00:00")]).write.mode("append").json(src)       # late and older
    Z.upsert_latest(spark, src, STATUS, out, ck)
    epochs = [n for n in commits.names(spark, out) if n.startswith("epoch=")]
    assert [len([b for b in commits.names(spark, f"{out}/{e}") if b.startswith("bucket=")]) for e in epochs[1:]] == [1, 1]
    got = {r.model: r.status for r in Z.read_latest_version(spark, out).collect()}
    assert len(got) == 200 and got["m7"] == "pass" and set(got.values()) == {"pass", "retry"}


def test_units_are_scored_once(spark):
    src, out, ck = (scratch_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "seed int, key string, model string, f1 double"
    for part in ([(0, "a", "m", .5), (0, "a", "n", .6)], [(0, "a", "m", .9), (1, "a", "m", .7)], [(0, "a", "n", .1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        Z.score_new_units(spark, src, schema, out, ck)
    got = sorted((r.seed, r.model, r.f1) for r in spark.read.parquet(out).collect())
    assert got == [(0, "m", .5), (0, "n", .6), (1, "m", .7)]


def test_totals_outlive_the_session_and_count_late_records(spark):
    src, ck, out = (scratch_dir(spark, n) for n in ("in", "ck", "out"))
    _records(spark, [("a", "pass", "2024-01-01 05:00:00"), ("b", "pass", "2024-01-09 05:00:00")]).write.json(src)
    Z.progress(spark, src, STATUS, ck, out)
    _records(spark, [("c", "pass", "2024-01-02 05:00:00"), ("d", "pass", "2024-01-09 06:00:00")]).write.mode("append").json(src)
    totals = Z.progress(spark.newSession(), src, STATUS, ck, out)
    assert {(r.day, r.n) for r in totals.collect()} == {("2024-01-01", 1), ("2024-01-09", 2)}
    assert Z.late_records(spark, src, STATUS, Z._latest_totals(spark, out, ["day", "status"], "n")).first()["n_late"] == 1
