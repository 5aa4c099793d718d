"""Leaderboard (B01-B13): seed means, per-key min-max scores, ranks, model aggregates.

The whole leaderboard is one lazy plan: aggregate → window over the (model, key) table
→ aggregate. The windows run over the already aggregated per-(model, key) table, whose
size is models × keys, never over metric rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import UNIT


def seed_mean(metrics: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Mean of the metric over seeds per (model, key); NULL means dropped."""
    return (metrics.groupBy("model", "key").agg(F.avg(metric).alias("value"))
            .filter(F.col("value").isNotNull()))


def minmax_scores(per_key: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """B02 + B03: per key e = ±value; norm = (e − min)/(max − min), 1 when all tie; keys
    with fewer than two models dropped; rank = SQL ``rank()`` on e descending."""
    e = F.col("value") if higher_is_better else -F.col("value")
    w = Window.partitionBy("key")
    s = (per_key.withColumn("e", e)
         .withColumn("__n", F.count(F.lit(1)).over(w))
         .withColumn("__lo", F.min("e").over(w)).withColumn("__hi", F.max("e").over(w))
         .filter(F.col("__n") >= 2))
    norm = F.when(F.col("__hi") > F.col("__lo"),
                  (F.col("e") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(1.0)
    return s.select("model", "key", "value", norm.alias("norm_score"),
                    F.rank().over(w.orderBy(F.col("e").desc())).cast("double").alias("rank"))


def leaderboard_agg(scores: DataFrame) -> DataFrame:
    """Score = avg norm (4 d.p.), Avg Rank (1 d.p.), # Targets, Improvability =
    round(100·(1 − unrounded Score), 1)."""
    a = scores.groupBy(F.col("model").alias("model_id")).agg(
        F.avg("norm_score").alias("__s"), F.avg("rank").alias("__r"),
        F.countDistinct("key").alias("n_targets"))
    return a.select("model_id", F.round("__s", 4).alias("score"), F.round("__r", 1).alias("avg_rank"),
                    F.round((1 - F.col("__s")) * 100, 1).alias("improvability"), "n_targets")


def leaderboard(metrics: DataFrame, metric: str = "f1_macro", higher_is_better: bool = True) -> DataFrame:
    """B01-B04 chained."""
    return leaderboard_agg(minmax_scores(seed_mean(metrics, metric), higher_is_better))


def leaderboard_overall(clf_metrics: DataFrame, reg_metrics: DataFrame,
                        clf_metric: str = "f1_macro", reg_metric: str = "rmse") -> DataFrame:
    """Overall board = union of classification and (lower-is-better) regression scores."""
    s = minmax_scores(seed_mean(clf_metrics, clf_metric), True).unionByName(
        minmax_scores(seed_mean(reg_metrics, reg_metric), False))
    return leaderboard_agg(s)


def leaderboard_rank(board: DataFrame, n_top: int | None = None) -> DataFrame:
    """Position by Score desc (tie: model id); optional top-n (the feature here)."""
    w = Window.orderBy(F.col("score").desc(), F.col("model_id"))
    out = board.withColumn("position", F.row_number().over(w))
    return out.filter(F.col("position") <= n_top) if n_top else out


def leaderboard_meta(board: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach display metadata; a missing display name falls back to the model id."""
    j = board.join(meta, board.model_id == meta.model_id, "left").drop(meta.model_id)
    return j.withColumn("display_name", F.coalesce(F.col("display_name"), F.col("model_id")))


def meta_upsert(meta: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Replace the metadata rows of the models in ``new_rows``, keep the others."""
    return meta.join(new_rows.select("model_id"), "model_id", "left_anti").unionByName(
        new_rows, allowMissingColumns=True)


def leaderboard_add(metrics: DataFrame, new_metrics: DataFrame, metric: str = "f1_macro",
                    columns=("seed", "key", "model", "f1_macro")) -> DataFrame:
    """Add a model's metric rows (column whitelist, NULL primary dropped), re-rank all."""
    keep = list(dict.fromkeys(list(columns) + [metric]))
    add = new_metrics.select(*keep).filter(F.col(metric).isNotNull())
    return leaderboard(metrics.select(*keep).unionByName(add), metric)


def leaderboard_text(board: DataFrame) -> DataFrame:
    """One summary line per model."""
    return board.select("model_id", F.format_string(
        "%s: Score=%.4f, Avg Rank=%.1f, Targets=%d", F.col("model_id"), F.col("score"),
        F.col("avg_rank"), F.col("n_targets")).alias("line"))


def mean_metrics(metrics: DataFrame, cols: list[str], group=("model",)) -> DataFrame:
    """Mean of chosen metric columns per model."""
    return metrics.groupBy(*group).agg(*[F.round(F.avg(c), 4).alias(c) for c in cols])


def clf_only_mark(board: DataFrame, clf_models: DataFrame, reg_models: DataFrame) -> DataFrame:
    """Models seen only in classification get a `` *`` suffix on their display name."""
    only = clf_models.select("model").distinct().join(reg_models.select("model").distinct(),
                                                      "model", "left_anti")
    j = board.join(only.withColumn("__only", F.lit(True)),
                   board.model_id == only.model, "left").drop("model")
    return j.withColumn("display_name", F.when(F.col("__only"), F.concat(F.col("model_id"), F.lit(" *")))
                        .otherwise(F.col("model_id"))).drop("__only")


def leaderboard_e2e(metrics: DataFrame, status: DataFrame, baseline: str,
                    metric: str = "f1_macro") -> DataFrame:
    """Results → imputed metrics (V02) → leaderboard."""
    from .coverage import impute_failures
    return leaderboard(impute_failures(metrics, status, baseline, unit=UNIT), metric)
