"""Report frames (R01-R09): heatmap, breakdown, dataset overview, Pareto front, panels.

Each frame is small by construction (models × keys or one row per dataset); the work is
in the aggregates that feed them, which run over the fact tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_bucket


def score_heatmap(metrics: DataFrame, metric: str = "f1_macro", higher_is_better: bool = True,
                  order: DataFrame | None = None) -> DataFrame:
    """Min-max normalized seed-mean per (model, key) on a dense models × keys grid.

    Unlike the leaderboard, a key with a single model (or all tied) scores 1.0; absent
    pairs stay NULL. ``order`` (model_id, position) sorts rows, e.g. by rating.
    """
    v = metrics.groupBy("model", "key").agg(F.avg(metric).alias("value")).filter(F.col("value").isNotNull())
    e = F.col("value") if higher_is_better else -F.col("value")
    w = Window.partitionBy("key")
    s = v.withColumn("e", e).withColumn("lo", F.min("e").over(w)).withColumn("hi", F.max("e").over(w))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    s = s.select("model", "key", norm.alias("norm"))
    # each key's cells over the roster (NULL = not played); any number of keys, no pivot
    roster = v.agg(F.array_sort(F.collect_set("model")).alias("roster")).scalar()
    cells = s.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("model", "norm"))).alias("__cells"))
    out = cells.withColumn("model", F.explode(roster)).select(
        "model", "key", F.round(F.try_element_at("__cells", F.col("model")), 9).alias("norm"))
    if order is not None:
        out = out.join(order.withColumnRenamed("model_id", "model"), "model", "left")
    return out


def breakdown(norm_scores: DataFrame, profile: DataFrame, axes: list[str]) -> DataFrame:
    """Mean normalized score by model × profile bucket, for every profile axis, in
    one pass (unpivot of the axes, one group-by)."""
    j = norm_scores.join(profile, "key")
    long = j.unpivot(["model", "key", "norm"], axes, "axis", "bucket")
    return long.groupBy("axis", "bucket", "model").agg(F.round(F.avg("norm"), 9).alias("mean_score"),
                                                        F.countDistinct("key").alias("n_keys"))


def dataset_overview(from_results: DataFrame, native: DataFrame) -> DataFrame:
    """Sizes from results, else native; classes only for classification keys.

    ``from_results``: (key, n_samples, n_classes); ``native``: (key, task, n_samples, n_classes).
    """
    r = from_results.select("key", F.col("n_samples").alias("r_n"), F.col("n_classes").alias("r_k"))
    n = native.select("key", "task", F.col("n_samples").alias("n_n"), F.col("n_classes").alias("n_k"))
    j = r.join(n, "key", "full_outer")
    return j.select("key", F.coalesce("r_n", "n_n").alias("n_samples"),
                    F.when(F.coalesce(F.col("task"), F.lit("classification")) == "classification",
                           F.coalesce("r_k", "n_k")).alias("n_classes"),
                    F.when(F.col("r_n").isNotNull(), "results").otherwise("native").alias("source"))


def key_sizes(status: DataFrame, truth: DataFrame) -> DataFrame:
    """samples = n_train + n_test of any record of the key (first by model id);
    classes = distinct truth labels."""
    s = status.groupBy("key").agg(F.min_by(F.col("n_train") + F.col("n_test"),
                                           F.struct("model", "seed")).alias("n_samples"))
    k = truth.groupBy("key").agg(F.countDistinct("target").alias("n_classes"))
    return s.join(k, "key", "full_outer")


def pareto_front(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A point is on the front when no other has x ≤ and y ≥ with one strict.

    Per distinct x only the best y can be on the front; it is on the front when it beats the
    best y of all smaller x. That prefix maximum is taken in ranges of x: over the powers of two
    (some thousand at most, whatever the table, sent along as one array), over 4,096 steps
    inside each, and over the values of one step, each window in a range of its own.
    """
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = p.groupBy(x).agg(F.max(y).alias("__best")).withColumns(
        {"__p": order_bucket(F.col(x), 1), "__s": order_bucket(F.col(x), 4096)})
    steps = best.groupBy("__p", "__s").agg(F.max("__best").alias("__m"))
    powers = steps.groupBy("__p").agg(F.max("__m").alias("__m")).agg(F.collect_list(F.struct("__p", "__m")).alias("all"))
    before = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("__of_steps", F.max("__m").over(before(["__p"], "__s"))).drop("__m")
    best = best.withColumn("__of_values", F.max("__best").over(before(["__p", "__s"], x))).join(steps, ["__p", "__s"])
    of_powers = F.array_max(F.transform(F.filter("__all", lambda e: e["__p"] < F.col("__p")), lambda e: e["__m"]))
    best = best.withColumn("__all", powers.scalar()).select(
        x, "__best", F.greatest("__of_values", "__of_steps", of_powers).alias("__prev"))
    j = p.join(best, x)
    return j.withColumn("pareto", (F.col(y) == F.col("__best")) &
                        (F.col("__prev").isNull() | (F.col(y) > F.col("__prev")))).drop("__best", "__prev")


def score_vs_cost(board: DataFrame, cost: DataFrame, time_col: str = "train_time_s") -> DataFrame:
    """(model, score, time) points with a positive time only."""
    return board.join(cost, "model_id").filter(F.col(time_col) > 0).select("model_id", "score", time_col)


def characteristics(datasets: DataFrame, size_col: str = "n_samples") -> DataFrame:
    """Dataset panel rows sorted by size desc (non-numeric sizes last)."""
    n = F.col(size_col).try_cast("long")
    w = Window.orderBy(n.desc_nulls_last(), F.col("dataset"))
    return datasets.withColumn("position", F.row_number().over(w))


def shape_points(datasets: DataFrame, reference: DataFrame) -> DataFrame:
    """(samples, features) points of our datasets (both > 0) plus reference collections."""
    ours = datasets.filter((F.col("n_samples") > 0) & (F.col("n_features") > 0)).select(
        "dataset", "modality", "n_samples", "n_features", F.lit(False).alias("reference"))
    return ours.unionByName(reference.withColumn("reference", F.lit(True)))


def axis_options(values: DataFrame, axis: str, canonical: list[str]) -> DataFrame:
    """The options present in the data, in canonical order (then unknown ones sorted)."""
    canon = F.array(*[F.lit(c) for c in canonical])
    present = values.agg(F.array_sort(F.collect_set(axis)).alias("present"))
    ordered = present.select(F.concat(F.array_intersect(canon, F.col("present")),
                                      F.array_except(F.col("present"), canon)).alias("opts"))
    return ordered.select(F.lit(axis).alias("axis"), F.posexplode("opts").alias("position", "option"))
