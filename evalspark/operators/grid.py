"""Grid slicing (G01-G10): the 4-axis cell plan, collection, summaries and cell choice.

Every result table carries the cell axes (reasoning, labels, feature_cap, n_train) as
plain columns, so slicing is filtering and grouping; the plan is a cross product of small
axis tables filtered by semantic predicates (a cap arm only for datasets wider than the
cap), which Catalyst could not infer by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import values

AXES = ["reasoning", "labels", "feature_cap", "n_train"]


def axis_token(tok: Column) -> Column:
    """``all`` / ``full`` → NULL (no limit), else the integer."""
    return F.when(F.lower(tok).isin("all", "full"), F.lit(None).cast("int")).otherwise(tok.try_cast("int"))


def grid_plan(datasets: DataFrame, reasoning: list[str], labels: list[str], caps: list[str],
              samples_real: list[str], samples_synth: list[str]) -> DataFrame:
    """Scheduled (cell, dataset) rows.

    ``datasets``: (dataset, suite, n_features). Visible labels only for the real suite; a cap
    arm only for datasets wider than the cap; the synthetic suite has its own n axis.
    """
    spark = datasets.sparkSession
    ns = values(spark, [("real", n) for n in samples_real] + [("synthetic", n) for n in samples_synth],
                "suite string, n_train string")

    def lits(xs):
        return F.array(*[F.lit(x) for x in xs])
    # each dataset row fans out over the fixed axis values (bounded by the axis lengths)
    plan = (datasets.join(ns, "suite").withColumn("reasoning", F.explode(lits(reasoning)))
            .withColumn("labels", F.explode(lits(labels))).withColumn("feature_cap", F.explode(lits(caps))))
    cap = axis_token(F.col("feature_cap"))
    keep = ((F.col("labels") != "visible") | (F.col("suite") == "real")) & \
        (cap.isNull() | (F.col("n_features") > cap))
    return plan.filter(keep).select(*AXES, "dataset", "suite").dropDuplicates()


def grid_collect(results: DataFrame, plan: DataFrame) -> DataFrame:
    """Keep only scheduled (cell, dataset) result rows."""
    return results.join(plan.select(*AXES, "dataset"), AXES + ["dataset"], "left_semi")


def grid_summary(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean / sample std / count per (dataset, model, 4 axes) for each metric."""
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(m), 9).alias(f"{m}__mean"), F.round(F.stddev_samp(m), 9).alias(f"{m}__std"),
                 F.count(m).alias(f"{m}__count")]
    return results.groupBy("dataset", "model", *AXES).agg(*aggs)


def axis_order(values: DataFrame, axis_col: str = "axis", value_col: str = "value") -> DataFrame:
    """Per axis, numeric values ascending, then non-numeric (``full`` last)."""
    num = F.col(value_col).try_cast("double")
    w = Window.partitionBy(axis_col).orderBy(num.isNull(), num, F.col(value_col))
    return values.select(axis_col, value_col).distinct().withColumn("position", F.row_number().over(w))


def perf_surface(results: DataFrame, metric: str, mode_cols=("reasoning",), x: str = "n_train",
                 y: str = "labels") -> DataFrame:
    """Dataset → mode → model → [x][y] surface with NULL gaps (dense grid), of the
    cells without a feature cap.

    Each model's cells are spread over the x and y values present in the results (grid
    axes: a handful each); models with no row in a dataset are dropped.
    """
    unit = ["dataset", *mode_cols, "model"]
    full = results.filter(F.col("feature_cap") == "full")
    axes = full.agg(F.struct(F.collect_set(x).alias("x"), F.collect_set(y).alias("y")).alias("axes")).scalar()
    mean = full.groupBy(*unit, x, y).agg(F.avg(metric).alias("value"))
    cells = mean.groupBy(*unit).agg(F.map_from_entries(F.collect_list(
        F.struct(F.struct(x, y), "value"))).alias("__cells"))
    dense = cells.withColumn(x, F.explode(axes.getField("x"))).withColumn(y, F.explode(axes.getField("y")))
    return dense.select(*unit, x, y, F.round(F.try_element_at("__cells", F.struct(x, y)), 9).alias("value"))


def default_cell(cells: DataFrame, suite_col: str = "suite") -> DataFrame:
    """Per suite, the first present cell by preference: reasoning off, hidden labels,
    full features, n = 10 (then smaller n first)."""
    n = axis_token(F.col("n_train"))
    w = Window.partitionBy(suite_col).orderBy(
        (F.col("reasoning") != "off"), (F.col("labels") != "hidden"), (F.col("feature_cap") != "full"),
        (F.col("n_train") != "10"), n.isNull(), n.asc())
    return cells.select(suite_col, *AXES).distinct().withColumn("__r", F.row_number().over(w)) \
        .filter("__r = 1").drop("__r")


def reference_cell(cells: DataFrame) -> DataFrame:
    """Hidden labels and n = 100, else hidden labels, else the largest n."""
    n = axis_token(F.col("n_train"))
    w = Window.orderBy((F.col("labels") != "hidden") | (F.col("n_train") != "100"),
                       F.col("labels") != "hidden", n.isNotNull(), n.desc(), *AXES)
    return cells.select(*AXES).distinct().withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def run_state(status: DataFrame) -> DataFrame:
    """Observed status totals and the sorted set of observed models."""
    from pyspark.sql import Window
    per = status.groupBy("status").agg(F.count(F.lit(1)).alias("n_units"),
                                       F.collect_set("model").alias("__m"))
    # the statuses are a fixed set (pass / fail / skip / retry): a window over them is tiny
    allm = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__m").over(Window.partitionBy()))))
    return per.select("status", "n_units", F.array_join(allm, ",").alias("models"),
                      F.size(allm).cast("long").alias("n_models"))
