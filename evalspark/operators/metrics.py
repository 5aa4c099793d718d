"""Per-unit metrics.

Every metric is an aggregate over ``truth ⋈ predictions`` grouped by the unit
``(seed, key, model)``. Classification metrics come from one small base frame — the
confusion counts ``(unit, y, p, n)`` — so the row-level work is a single partial hash
aggregate however many metrics are asked for. Labels are compared as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side

UNIT = ["seed", "key", "model"]
EPS = 2.220446049250313e-16  # float64 machine epsilon (log-loss clipping)
DIGITS = 9


def _div(a: Column, b: Column) -> Column:
    """a / b, NULL when b = 0 (safe under ANSI mode)."""
    return F.when(b != 0, a / b)


def _r(c: Column, name: str, digits: int = DIGITS) -> Column:
    return F.round(c, digits).alias(name)


# ------------------------------------------------------------------ alignment
def align_check(truth: DataFrame, preds: DataFrame, unit=UNIT) -> DataFrame:
    """Per unit, rows present on one side only. A unit is aligned when both are 0.

    The model set of each (seed, key) is taken from the predictions, so truth rows are
    expected once per model.
    """
    split_keys = [u for u in unit if u != "model"]
    models = preds.select(*unit).distinct()
    t = truth.join(models, split_keys).select(*unit, "row_id", F.lit(1).alias("__t"))
    p = preds.select(*unit, "row_id", F.lit(1).alias("__p"))
    j = t.join(p, list(unit) + ["row_id"], "full_outer")
    return j.groupBy(*unit).agg(
        F.count_if(F.col("__p").isNull()).alias("missing_pred"),
        F.count_if(F.col("__t").isNull()).alias("extra_pred"),
        F.count(F.lit(1)).alias("n_rows")).withColumn(
        "aligned", (F.col("missing_pred") == 0) & (F.col("extra_pred") == 0))


def aligned_units(truth: DataFrame, preds: DataFrame, unit=UNIT) -> DataFrame:
    """Predictions of aligned units only (the rest are rejected, M01)."""
    ok = align_check(truth, preds, unit).filter("aligned").select(*unit)
    return preds.join(ok, list(unit), "left_semi")


def incremental_units(new: DataFrame, existing: DataFrame, unit=UNIT) -> DataFrame:
    """Units of ``new`` not already scored in ``existing``."""
    return new.join(existing.select(*unit).distinct(), list(unit), "left_anti")


# ------------------------------------------------------------------ confusion
def confusion_counts(truth: DataFrame, preds: DataFrame, unit=UNIT) -> DataFrame:
    """(unit, y, p, n): the base frame of every label metric."""
    split_keys = [u for u in unit if u != "model"]
    j = preds.join(truth, split_keys + ["row_id"])
    return (j.groupBy(*unit, F.col("target").cast("string").alias("y"),
                      F.col("pred").cast("string").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(cc: DataFrame, normalize: str | None = None, unit=UNIT) -> DataFrame:
    """Confusion cells, optionally normalized over true rows, predicted columns or all."""
    if normalize is None:
        return cc.select(*unit, "y", "p", F.col("n").cast("double").alias("value"))
    part = {"true": list(unit) + ["y"], "pred": list(unit) + ["p"], "all": list(unit)}[normalize]
    return cc.select(*unit, "y", "p",
                     _r(F.col("n") / F.sum("n").over(Window.partitionBy(*part)), "value"))


def per_class(cc: DataFrame, unit=UNIT) -> DataFrame:
    """(unit, cls, support, predicted, tp) over the union of true and predicted labels."""
    e = F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("pp"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("pp"),
                 F.lit(0).cast("long").alias("tp"))))
    return (cc.select(*unit, e.alias("s"))
            .groupBy(*unit, F.col("s.cls").alias("cls"))
            .agg(F.sum("s.t").alias("support"), F.sum("s.pp").alias("predicted"),
                 F.sum("s.tp").alias("tp")))


def clf_report(cc: DataFrame, unit=UNIT) -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and weighted rows."""
    pc = per_class(cc, unit)
    prec = F.coalesce(_div(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(_div(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(_div(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    rows = pc.select(*unit, "cls", prec.alias("precision"), rec.alias("recall"),
                     f1.alias("f1"), "support")
    n = F.sum("support")
    avg = rows.groupBy(*unit).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("w_f"), n.alias("n"))
    macro = avg.select(*unit, F.lit("macro avg").alias("cls"), F.col("m_p").alias("precision"),
                       F.col("m_r").alias("recall"), F.col("m_f").alias("f1"),
                       F.col("n").alias("support"))
    weighted = avg.select(*unit, F.lit("weighted avg").alias("cls"), F.col("w_p").alias("precision"),
                          F.col("w_r").alias("recall"), F.col("w_f").alias("f1"),
                          F.col("n").alias("support"))
    out = rows.unionByName(macro).unionByName(weighted)
    return out.select(*unit, "cls", _r(F.col("precision"), "precision"), _r(F.col("recall"), "recall"),
                      _r(F.col("f1"), "f1"), "support")


# ------------------------------------------------------------------ label metrics
def clf_metrics(cc: DataFrame, unit=UNIT) -> DataFrame:
    """M05-M10 in one aggregate over the per-class table.

    accuracy; precision / recall / F1 weighted by true support (0 on zero division);
    macro F1 over the union of true and predicted labels; balanced accuracy over classes
    with true rows; Cohen's kappa (NULL when chance agreement is 1); multiclass MCC (0 on a
    zero denominator).
    """
    pc = per_class(cc, unit)
    t, pp, tp = F.col("support"), F.col("predicted"), F.col("tp")
    prec_c = F.coalesce(_div(tp, pp), F.lit(0.0))
    rec_c = F.coalesce(_div(tp, t), F.lit(0.0))
    f1_c = F.coalesce(_div(2 * tp, t + pp), F.lit(0.0))
    a = pc.groupBy(*unit).agg(
        F.sum(t).cast("double").alias("N"), F.sum(tp).cast("double").alias("C"),
        F.sum(t * prec_c).alias("w_prec"), F.sum(t * rec_c).alias("w_rec"),
        F.sum(t * f1_c).alias("w_f1"), F.avg(f1_c).alias("f1_macro"),
        F.avg(F.when(t > 0, rec_c)).alias("balanced_accuracy"),
        F.sum((t * pp).cast("double")).alias("tp_sum"),
        F.sum((pp * pp).cast("double")).alias("pp2"), F.sum((t * t).cast("double")).alias("tt2"))
    N, C = F.col("N"), F.col("C")
    pe = F.col("tp_sum") / (N * N)
    kappa = _div(C / N - pe, 1 - pe)
    den = F.sqrt((N * N - F.col("pp2")) * (N * N - F.col("tt2")))
    mcc = F.coalesce(_div(C * N - F.col("tp_sum"), den), F.lit(0.0))
    return a.select(*unit, _r(C / N, "accuracy"), _r(F.col("w_prec") / N, "precision"),
                    _r(F.col("w_rec") / N, "recall"), _r(F.col("w_f1") / N, "f1_score"),
                    _r(F.col("f1_macro"), "f1_macro"),
                    _r(F.col("balanced_accuracy"), "balanced_accuracy"),
                    _r(kappa, "cohen_kappa"), _r(mcc, "matthews_corrcoef"),
                    N.cast("long").alias("n_test"))


# ------------------------------------------------------------------ probability metrics
def proba_long(truth: DataFrame, proba: DataFrame, unit=UNIT) -> DataFrame:
    """(unit, row_id, y, cls, score) for every truth class of the unit.

    Scores are read from the proba map by class name, i.e. already in sorted-class order
    whatever order the map was written in. A truth class absent from the map gives a NULL
    score, which makes AUC and log loss NULL for the unit (as the reference's error path).
    """
    split_keys = [u for u in unit if u != "model"]
    classes = truth.groupBy(*split_keys).agg(F.array_sort(F.collect_set(
        F.col("target").cast("string"))).alias("classes"))
    # the maps become one score a class before the rows meet their truth, and the few class lists are broadcast
    scores = F.transform("classes", lambda c: F.struct(c.alias("cls"), F.col("proba")[c].alias("score")))
    scored = proba.join(small_side(classes, "classes"), split_keys).select(*unit, "row_id", scores.alias("__scores"))
    j = scored.join(truth.select(*split_keys, "row_id", F.col("target").cast("string").alias("y")), split_keys + ["row_id"])
    return j.select(*unit, "row_id", "y", F.explode("__scores").alias("s")).select(*unit, "row_id", "y", "s.cls", "s.score")


def proba_degenerate(proba: DataFrame, unit=UNIT) -> DataFrame:
    """A unit whose every probability is exactly 0 or 1 is degenerate (one-hot)."""
    onehot = F.forall(F.map_values("proba"), lambda v: v.isin(0.0, 1.0))
    return proba.groupBy(*unit).agg(F.bool_and(onehot).alias("proba_degenerate"))


def _auc_from_counts(sc: DataFrame, group: list[str]) -> DataFrame:
    """Mid-rank (Mann-Whitney) AUC from per-score (pos, neg) counts.

    AUC = Σ_s pos_s·(neg_below_s + neg_s/2) / (P·N); ties count one half. ``neg_below`` is a
    running count over the distinct scores, computed bucket by bucket of the score
    (:func:`bucket_cumsum`), so a unit with many distinct scores is not sorted in one
    task.
    """
    from ..functions.hashing import bucket_cumsum, order_bucket
    nulls = sc.filter(F.col("score").isNull()).groupBy(*group).agg(F.sum(F.col("pos") + F.col("neg")).alias("__nulls"))
    ok = sc.filter(F.col("score").isNotNull())
    s = bucket_cumsum(ok, group, order_bucket(F.col("score")), [F.col("score")], "neg", "neg_below", inclusive=False)
    agg = s.groupBy(*group).agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))).alias("__u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("Nn"))
    full = sc.select(*group).distinct().join(agg, group, "left").join(nulls, group, "left")
    return full.select(*group, F.when(F.col("__nulls").isNull() & (F.col("P") > 0) & (F.col("Nn") > 0),
                                      F.col("__u") / (F.col("P") * F.col("Nn"))).alias("auc"),
                       F.coalesce(F.col("P"), F.lit(0)).alias("support"))


def roc_auc(pl: DataFrame, unit=UNIT) -> DataFrame:
    """M11 + M12: ROC-AUC per unit.

    Two truth classes: binary AUC of the larger label's score. More: one-vs-rest AUC per
    class averaged with weights = class support. One class, or a class missing from the
    probability map → NULL.
    """
    unit = list(unit)
    sc = (pl.groupBy(*unit, "cls", "score")
          .agg(F.count_if(F.col("y") == F.col("cls")).alias("pos"),
               F.count_if(F.col("y") != F.col("cls")).alias("neg")))
    per = _auc_from_counts(sc, unit + ["cls"])
    w = Window.partitionBy(*unit)
    per = (per.withColumn("k", F.count(F.lit(1)).over(w))
           .withColumn("last", F.max("cls").over(w)))
    agg = per.groupBy(*unit).agg(
        F.max("k").alias("k"),
        F.max(F.when(F.col("cls") == F.col("last"), F.col("auc"))).alias("bin_auc"),
        F.count_if(F.col("auc").isNull()).alias("bad"),
        (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("ovr"))
    val = (F.when(F.col("k") < 2, F.lit(None))
           .when(F.col("bad") > 0, F.lit(None))
           .when(F.col("k") == 2, F.col("bin_auc")).otherwise(F.col("ovr")))
    return agg.select(*unit, _r(val, "roc_auc"))


def log_loss(pl: DataFrame, unit=UNIT) -> DataFrame:
    """Mean −ln p(true class), p clipped to [eps, 1−eps]; NULL if any score is missing."""
    unit = list(unit)
    mine = pl.filter(F.col("y") == F.col("cls"))
    agg = pl.groupBy(*unit).agg(F.count_if(F.col("score").isNull()).alias("bad"),
                                F.countDistinct("cls").alias("k"))
    ll = mine.groupBy(*unit).agg(
        F.avg(-F.ln(F.greatest(F.least(F.col("score"), F.lit(1 - EPS)), F.lit(EPS)))).alias("ll"))
    return agg.join(ll, unit, "left").select(
        *unit, _r(F.when((F.col("bad") == 0) & (F.col("k") >= 2), F.col("ll")), "log_loss"))


def proba_reorder(proba: DataFrame, truth: DataFrame, unit=UNIT) -> DataFrame:
    """The probability vector in sorted truth-class order (array), or the map's own
    order when a truth class is missing from it."""
    split_keys = [u for u in unit if u != "model"]
    classes = truth.groupBy(*split_keys).agg(F.array_sort(F.collect_set(
        F.col("target").cast("string"))).alias("classes"))
    j = proba.join(small_side(classes, "classes"), split_keys)
    ok = F.forall("classes", lambda c: F.array_contains(F.map_keys("proba"), c))
    return j.select(*unit, "row_id", F.when(ok, F.transform("classes", lambda c: F.col("proba")[c]))
                    .otherwise(F.map_values("proba")).alias("scores"))


# ------------------------------------------------------------------ regression
def reg_metrics(rp: DataFrame, unit=UNIT, y: str = "y", p: str = "pred", median: str = "distributed") -> DataFrame:
    """MSE, RMSE, MAE, R², MAPE, explained variance, max error, median AE.

    One aggregate; R² and explained variance follow the finite convention (1 when the
    target is constant and the fit is perfect, else 0). MAPE ×100 over non-zero targets,
    0 if none. Median AE is exact: by default computed from running counts over distinct
    errors (no unit held in one task); ``median="percentile"`` uses Spark's ``percentile``.
    """
    e = F.col(y) - F.col(p)
    unit = list(unit)
    a = rp.groupBy(*unit).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("ss_res"), F.var_pop(y).alias("var_y"), F.var_pop(e).alias("var_e"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))).alias("ape"),
        F.max(F.abs(e)).alias("max_error"),
        *([F.percentile(F.abs(e), 0.5).alias("median_ae")] if median == "percentile" else []))
    if median != "percentile":
        from ..functions.hashing import exact_median
        a = a.join(exact_median(rp.select(*unit, F.abs(e).alias("__ae")), unit, "__ae", "median_ae"), unit, "left")
    ss_tot = F.col("var_y") * F.col("n")
    r2 = (F.when(ss_tot != 0, 1 - F.col("ss_res") / ss_tot)
          .when(F.col("ss_res") == 0, 1.0).otherwise(0.0))
    ev = (F.when(F.col("var_y") != 0, 1 - F.col("var_e") / F.col("var_y"))
          .when(F.col("var_e") == 0, 1.0).otherwise(0.0))
    return a.select(*unit, F.col("mse"), F.sqrt("mse").alias("rmse"), F.col("mae"), r2.alias("r2"),
                    F.coalesce(F.col("ape") * 100, F.lit(0.0)).alias("mape"),
                    ev.alias("explained_variance"), F.col("max_error"), F.col("median_ae"))


# ------------------------------------------------------------------ dispatch, compare, summary
def score_units(clf: DataFrame | None, reg: DataFrame | None) -> DataFrame:
    """Classification and regression metric rows in one wide table (missing → NULL)."""
    frames = [f.withColumn("task", F.lit(t)) for f, t in ((clf, "classification"),
                                                           (reg, "regression")) if f is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def compare_metric(metrics: DataFrame, metric: str, higher_is_better: bool = True,
                   group=("key",)) -> DataFrame:
    """Best / worst model, mean and population std of one metric per group."""
    v = F.col(metric)
    best = F.max_by("model", F.struct(v, F.col("model"))) if higher_is_better else \
        F.min_by("model", F.struct(v, F.col("model")))
    worst = F.min_by("model", F.struct(v, F.col("model"))) if higher_is_better else \
        F.max_by("model", F.struct(v, F.col("model")))
    return metrics.filter(v.isNotNull()).groupBy(*group).agg(
        best.alias("best_model"), worst.alias("worst_model"),
        _r(F.avg(v), "mean"), _r(F.stddev_pop(v), "std"),
        F.count(F.lit(1)).alias("n_models"))


def unparsed_join(metrics: DataFrame, status: DataFrame, unit=UNIT) -> DataFrame:
    """Carry ``llm_unparsed_frac`` from the status records onto metric rows."""
    return metrics.join(status.select(*unit, "llm_unparsed_frac"), list(unit), "left")


def metric_summary(metrics: DataFrame, group=("key", "model"), exclude=("seed",)) -> DataFrame:
    """Mean and sample std of every numeric metric column per (key, model)."""
    num = [f.name for f in metrics.schema.fields
           if f.dataType.typeName() in ("double", "float", "long", "integer")
           and f.name not in group and f.name not in exclude]
    aggs = []
    for c in num:
        aggs += [_r(F.avg(c), f"{c}__mean"), _r(F.stddev_samp(c), f"{c}__std")]
    return metrics.groupBy(*group).agg(*aggs, F.count(F.lit(1)).alias("n_seeds"))


def prob_metrics(truth: DataFrame, proba: DataFrame, unit=UNIT) -> DataFrame:
    """M11-M15 as stored with the metric rows: ROC-AUC and log loss per unit, both NULL
    when the unit's probabilities are one-hot (``proba_degenerate``) — a hard label
    carries no ranking information."""
    unit = list(unit)
    pl = proba_long(truth, proba, unit)
    j = roc_auc(pl, unit).join(log_loss(pl, unit), unit).join(proba_degenerate(proba, unit), unit)
    deg = F.col("proba_degenerate")
    return j.select(*unit, F.when(~deg, F.col("roc_auc")).alias("roc_auc"),
                    F.when(~deg, F.col("log_loss")).alias("log_loss"), "proba_degenerate")
