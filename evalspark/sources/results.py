"""Result-tree scans and sinks.

Result trees are partitioned folders; metadata that lives in paths (seed, key, cell axes)
is read back from ``_metadata.file_path`` with regular expressions, so a scan of a whole
tree is one distributed read, not a loop over folders.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_side
from . import commits

STATUS_DDL = ("key string, model string, status string, reason string, error string, n_train int, "
              "n_test int, train_time_s double, inference_time_per_sample_ms double, "
              "train_peak_memory_mb double, llm_unparsed int, llm_unparsed_frac double")


def write_status_tree(status: DataFrame, root: str) -> None:
    """Status records as JSON under ``root/seed_dir=seed_<n>/`` (the seed lives in the path)."""
    (status.withColumn("seed_dir", F.concat(F.lit("seed_"), F.col("seed").cast("string")))
     .drop("seed", "ts", "k").write.mode("overwrite").partitionBy("seed_dir").json(root))


def status_scan(spark: SparkSession, root: str) -> DataFrame:
    """Every status record of a tree → (seed, key, model, status, reason); the seed is
    taken from the file path; a missing reason becomes ''."""
    df = spark.read.schema(STATUS_DDL).option("recursiveFileLookup", True).json(root)
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"seed_(\d+)", 1).cast("int")
    return df.select(seed.alias("seed"), "key", "model", "status", F.coalesce("reason", F.lit("")).alias("reason"))


def path_keys(spark: SparkSession, root: str, pattern: str = r"key=([^/]+)") -> DataFrame:
    """The keys present in a tree, read from file paths only (no content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return (files.select(F.regexp_extract("path", pattern, 1).alias("key")).filter(F.col("key") != "")
            .distinct())


def cell_axes_from_path(spark: SparkSession, root: str) -> DataFrame:
    """Cell axes from directory names; a non-integer sample size drops the cell."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    ax = files.select(*[F.regexp_extract("path", rf"{a}=([^/]+)", 1).alias(a)
                        for a in ("reasoning", "labels", "feature_cap", "n_train")]).distinct()
    return ax.withColumn("n", F.col("n_train").try_cast("int")).filter(F.col("n").isNotNull())


def write_predictions(preds: DataFrame, root: str) -> None:
    """Predictions partitioned by unit, rows sorted by row id inside each file. Tasks take
    ranges of row ids, so a large unit is several files."""
    unit = ("seed", "key", "model")
    (preds.repartitionByRange(*unit, "row_id").sortWithinPartitions(*unit, "row_id")
     .write.mode("overwrite").partitionBy("seed", "key", "model").parquet(root))


def write_probabilities(proba: DataFrame, root: str) -> None:
    """Class probabilities ``(seed, key, model, row_id, proba map)``, partitioned by unit, rows sorted by row id.

    A unit's classes are put in label order once, and each row's probabilities follow that order;
    a class that a row does not name has probability 0."""
    unit = ["seed", "key", "model"]
    classes = proba.groupBy(*unit).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.map_keys("proba"))))).alias("classes"))
    rows = proba.join(small_side(classes, "classes"), unit).select(*unit, "row_id", "classes", F.transform(
        "classes", lambda c: F.coalesce(F.try_element_at(F.col("proba"), c), F.lit(0.0))).alias("proba"))
    (rows.repartitionByRange(*unit, "row_id").sortWithinPartitions(*unit, "row_id")
     .write.mode("overwrite").partitionBy(*unit).parquet(root))


def write_truth_once(spark: SparkSession, truth: DataFrame, root: str) -> list[str]:
    """Truth ``(seed, key, row_id, target)`` as ``root/seed=/key=`` folders, each written by its first writer alone.

    All folders are staged by one Spark job and then renamed one by one to names that must be
    free, so that any number of models may race: of a (seed, key) that is there, the later
    truth is dropped whole. Returns the folders that this writer won."""
    stage = f"{root}/_stage-{uuid.uuid4().hex}"
    (truth.repartitionByRange("seed", "key", "row_id").sortWithinPartitions("seed", "key", "row_id")
     .write.partitionBy("seed", "key").parquet(stage))
    won = []
    try:
        for seed in (n for n in commits.names(spark, stage) if n.startswith("seed=")):
            commits.make_folder(spark, f"{root}/{seed}")
            won += [f"{seed}/{key}" for key in commits.names(spark, f"{stage}/{seed}")
                    if commits.rename_new(spark, f"{stage}/{seed}/{key}", f"{root}/{seed}/{key}")]
    finally:
        commits.delete(spark, stage)
    return won


def write_metrics(metrics: DataFrame, root: str, overwrite_touched: bool = False) -> None:
    """Metric rows partitioned by seed; with ``overwrite_touched`` only the seeds present
    in ``metrics`` are replaced (dynamic partition overwrite), others stay as they are."""
    w = metrics.write.partitionBy("seed")
    if overwrite_touched:
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("overwrite")
    w.parquet(root)


def save_metrics(spark: SparkSession, new: DataFrame, root: str, summarize: Callable[[DataFrame], DataFrame]) -> int:
    """Add metric rows and rewrite the summary of all of them, both at once. Returns the version's number.

    A save writes the new rows, partitioned by seed, and the summary into folders of its own,
    and then creates the next version file, which names the folders of all seeds' rows and the
    summary. Only one writer can create it; one that comes second takes its summary again over
    the other's rows too. Earlier rows are not rewritten. Readers follow one version file, so
    they never see new rows with an old summary."""
    part = f"rows-{uuid.uuid4().hex}"
    new.write.partitionBy("seed").parquet(f"{root}/{part}")
    while True:
        number, last = _last_version(spark, root)
        parts = [*last["rows"], part]
        summary = f"summary-{uuid.uuid4().hex}"
        summarize(_read_rows(spark, root, parts)).write.parquet(f"{root}/{summary}")
        commits.make_folder(spark, f"{root}/versions")
        if commits.create_exclusive(spark, f"{root}/versions/{number + 1:09d}", json.dumps({"rows": parts, "summary": summary})):
            return number + 1
        commits.delete(spark, f"{root}/{summary}")


def _last_version(spark: SparkSession, root: str) -> tuple[int, dict]:
    found = [n for n in commits.names(spark, f"{root}/versions") if n.isdigit()]
    while found:
        text = commits.read_text(spark, f"{root}/versions/{found[-1]}")
        if text:                    # else its writer is still at it
            return int(found[-1]), json.loads(text)
        time.sleep(0.1)
    return 0, {"rows": [], "summary": None}


def _read_rows(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{root}/{p}") for p in parts))


def read_metrics(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Metric rows and their summary, of one version (the newest unless one is named); None before the first save."""
    if version is None:
        state = _last_version(spark, root)[1]
    else:
        state = json.loads(commits.read_text(spark, f"{root}/versions/{version:09d}"))
    if state["summary"] is None:
        return None
    return _read_rows(spark, root, state["rows"]), spark.read.parquet(f"{root}/{state['summary']}")


def split_fingerprint(params: DataFrame, cols: list[str]) -> DataFrame:
    """Cache key = md5 of the JSON of every split parameter."""
    return params.withColumn("split_hash", F.md5(F.to_json(F.struct(*cols))))


def report_sink(df: DataFrame, root: str) -> None:
    """One JSON object per row as text (small report frames; one file)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(root)
