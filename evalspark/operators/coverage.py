"""Coverage and completeness (V01-V07): status counts, failure imputation, missing units.

Set logic is written as joins: semi joins to restrict to tasks with results, anti joins
for "not already there", an equi join to the baseline rows. Nothing loops over units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = ["seed", "key", "model"]
STATUSES = ("pass", "fail", "skip", "retry")
TERMINAL = ("pass", "fail", "skip")


def coverage_counts(status: DataFrame) -> DataFrame:
    """Units per model by status, 0-filled: n_passed / n_failed / n_skipped / n_retry."""
    s = F.col("status")
    return status.groupBy(F.col("model").alias("model_id")).agg(
        F.count_if(s == "pass").alias("n_passed"), F.count_if(s == "fail").alias("n_failed"),
        F.count_if(s == "skip").alias("n_skipped"), F.count_if(s == "retry").alias("n_retry"))


def impute_failures(metrics: DataFrame, status: DataFrame, baseline: str,
                    unit=UNIT, strict: bool = True) -> DataFrame:
    """Every failed unit without metrics, on a (seed, key) that has results, gets a
    copy of the baseline model's metric row with ``imputed = true``.

    The job that reads the result fails when a failed unit's task has no baseline row: the unit
    could be neither scored at chance nor reported as missing. With ``strict=False`` such units stay absent.
    """
    split_keys = [u for u in unit if u != "model"]
    tasks = metrics.select(*split_keys).distinct()
    fails = (status.filter(F.col("status") == "fail").select(*unit)
             .join(tasks, split_keys, "left_semi")
             .join(metrics.select(*unit), list(unit), "left_anti"))
    base = metrics.filter(F.col("model") == baseline).drop("model")
    if strict:
        # checked where the rows are made; a generator is never pruned, as an unread column would be
        base = base.withColumn("__found", F.lit(True))
        missing = F.raise_error(f"baseline {baseline!r} has no result on a failed unit's task").cast("boolean")
        imputed = fails.join(base, split_keys, "left").withColumn(
            "imputed", F.explode(F.array(F.when(F.col("__found"), F.lit(True)).otherwise(missing))))
    else:
        imputed = fails.join(base, split_keys).withColumn("imputed", F.lit(True))
    out = metrics.withColumn("imputed", F.lit(False))
    return out.unionByName(imputed.select(*out.columns))


def missing_units(metrics: DataFrame, status: DataFrame, seeds: list[int], keys: DataFrame,
                  models: list[str], unit=UNIT) -> DataFrame:
    """Scheduled units (seeds × keys × models) with neither metrics nor a terminal
    status. Seeds and models come from the run definition (V05): each expected key row
    fans out over them; the schedule is anti-joined by the unit key."""
    grid = (keys.select("key").distinct()
            .withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
            .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))))
    return missing_from_schedule(metrics, status, grid, unit)


def schedule(definition: DataFrame) -> DataFrame:
    """Every scheduled unit (seed, key, model) of a run definition, rows of lists ``(seeds, keys, models)``."""
    return (definition.select(F.explode("keys").alias("key"), "seeds", "models")
            .select("key", F.explode("seeds").alias("seed"), "models")
            .select("seed", "key", F.explode("models").alias("model")).distinct())


def missing_from_schedule(metrics: DataFrame, status: DataFrame, grid: DataFrame, unit=UNIT) -> DataFrame:
    """The units of a schedule with neither metrics nor a terminal status."""
    terminal = status.filter(F.col("status").isin(*TERMINAL)).select(*unit)
    return (grid.join(metrics.select(*unit), list(unit), "left_anti")
            .join(terminal, list(unit), "left_anti"))


def completeness_report(missing: DataFrame) -> DataFrame:
    """Per key, how many models have missing units (the gate's message table)."""
    return missing.groupBy("key").agg(F.countDistinct("model").alias("n_models"),
                                      F.count(F.lit(1)).alias("n_units"))


def assert_complete(missing: DataFrame) -> None:
    """V04 gate: raise when any scheduled unit has neither metrics nor a terminal status."""
    rows = completeness_report(missing).orderBy(F.col("n_models").desc(), "key").collect()
    if rows:        # every key, so that none is missed: one row a key
        lines = "\n".join(f"{r['key']}: {r['n_models']}" for r in rows)
        raise AssertionError(f"scheduled units have neither metrics nor a status record:\n{lines}")


def seed_summary(status: DataFrame) -> DataFrame:
    """Units per (seed, status)."""
    return status.groupBy("seed", "status").agg(F.count(F.lit(1)).alias("n_units"))


def run_cost(status: DataFrame) -> DataFrame:
    """Mean train time, inference ms / sample and peak memory over passing units."""
    p = status.filter(F.col("status") == "pass")
    return p.groupBy(F.col("model").alias("model_id")).agg(
        F.round(F.avg("train_time_s"), 3).alias("train_time_s"),
        F.round(F.avg("inference_time_per_sample_ms"), 3).alias("inference_ms_per_sample"),
        F.round(F.avg("train_peak_memory_mb"), 1).alias("peak_memory_mb"),
        F.count(F.lit(1)).alias("n_units"))
