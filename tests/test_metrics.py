"""Metric values against hand-computed numbers (label and value vectors)."""

import math

import pytest
from pyspark.sql import functions as F

from evalspark.operators import metrics as M


def _units(spark, y, p, model="m"):
    rows = [(0, "k", i, str(a)) for i, a in enumerate(y)]
    truth = spark.createDataFrame(rows, "seed int, key string, row_id long, target string")
    preds = spark.createDataFrame([(0, "k", model, i, str(b)) for i, b in enumerate(p)],
                                  "seed int, key string, model string, row_id long, pred string")
    return truth, preds


def test_label_metrics_hand_values(spark):
    truth, preds = _units(spark, [0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0])
    r = M.clf_metrics(M.confusion_counts(truth, preds)).first().asDict()
    assert r["accuracy"] == pytest.approx(4 / 6)
    assert r["f1_macro"] == pytest.approx((0.5 + 0.8 + 2 / 3) / 3)
    assert r["balanced_accuracy"] == pytest.approx((0.5 + 1 + 0.5) / 3)
    assert r["precision"] == pytest.approx((0.5 + 2 / 3 + 1) / 3)
    assert r["recall"] == pytest.approx(4 / 6)
    assert r["cohen_kappa"] == pytest.approx(0.5)
    assert r["matthews_corrcoef"] == pytest.approx(12 / math.sqrt(22 * 24), abs=1e-9)


def test_predicted_only_class_enters_macro_f1_not_balanced_accuracy(spark):
    truth, preds = _units(spark, ["a", "a", "b", "b"], ["a", "c", "b", "b"])
    r = M.clf_metrics(M.confusion_counts(truth, preds)).first()
    assert r["f1_macro"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert r["balanced_accuracy"] == pytest.approx(0.75)


def test_constant_prediction_mcc_zero_kappa_zero(spark):
    truth, preds = _units(spark, [0, 1, 0, 1], [0, 0, 0, 0])
    r = M.clf_metrics(M.confusion_counts(truth, preds)).first()
    assert r["matthews_corrcoef"] == 0.0
    assert r["cohen_kappa"] == pytest.approx(0.0)


def _proba(spark, y, scores, classes=("0", "1")):
    truth = spark.createDataFrame([(0, "k", i, str(a)) for i, a in enumerate(y)],
                                  "seed int, key string, row_id long, target string")
    rows = [(0, "k", "m", i, {c: float(v) for c, v in zip(classes, s)}) for i, s in enumerate(scores)]
    proba = spark.createDataFrame(rows, "seed int, key string, model string, row_id long, proba map<string,double>")
    return truth, proba


def test_binary_auc_and_ties(spark):
    truth, proba = _proba(spark, [0, 0, 1, 1], [(0.9, 0.1), (0.6, 0.4), (0.65, 0.35), (0.2, 0.8)])
    assert M.roc_auc(M.proba_long(truth, proba)).first()["roc_auc"] == pytest.approx(0.75)
    truth, proba = _proba(spark, [0, 0, 1, 1], [(0.5, 0.5)] * 4)
    assert M.roc_auc(M.proba_long(truth, proba)).first()["roc_auc"] == pytest.approx(0.5)


def test_auc_null_for_single_class_and_missing_class(spark):
    truth, proba = _proba(spark, [1, 1], [(0.2, 0.8), (0.3, 0.7)])
    assert M.roc_auc(M.proba_long(truth, proba)).first()["roc_auc"] is None
    truth, proba = _proba(spark, [0, 1, 2], [(0.2, 0.8)] * 3)
    assert M.roc_auc(M.proba_long(truth, proba)).first()["roc_auc"] is None


def test_log_loss_and_degenerate(spark):
    truth, proba = _proba(spark, [0, 1], [(0.8, 0.2), (0.3, 0.7)])
    ll = M.log_loss(M.proba_long(truth, proba)).first()["log_loss"]
    assert ll == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2)
    assert M.proba_degenerate(proba).first()["proba_degenerate"] is False
    truth, proba = _proba(spark, [0, 1], [(1.0, 0.0), (0.0, 1.0)])
    assert M.proba_degenerate(proba).first()["proba_degenerate"] is True


def test_regression_hand_values(spark):
    y, p = [3, -0.5, 2, 7], [2.5, 0.0, 2, 8]
    df = spark.createDataFrame([(0, "k", "m", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "seed int, key string, model string, row_id long, y double, pred double")
    r = M.reg_metrics(df).first()
    assert r["mse"] == pytest.approx(0.375)
    assert r["mae"] == pytest.approx(0.5)
    assert r["r2"] == pytest.approx(0.948608, abs=1e-6)
    assert r["explained_variance"] == pytest.approx(0.957173, abs=1e-6)
    assert r["max_error"] == pytest.approx(1.0)
    assert r["median_ae"] == pytest.approx(0.5)


def test_mape_with_zero_targets(spark):
    df = spark.createDataFrame([(0, "k", "m", 0, 0.0, 1.0), (0, "k", "m", 1, 0.0, 2.0)],
                               "seed int, key string, model string, row_id long, y double, pred double")
    assert M.reg_metrics(df).first()["mape"] == 0.0


def test_alignment_rejects_mismatched_ids(spark):
    truth, preds = _units(spark, [0, 1, 1], [0, 1, 1])
    preds = preds.filter("row_id <> 2")
    r = M.align_check(truth, preds).first()
    assert r["aligned"] is False and r["missing_pred"] == 1


def test_prob_metrics_null_for_one_hot(spark):
    truth, proba = _proba(spark, [0, 1, 1], [(1.0, 0.0), (0.0, 1.0), (1.0, 0.0)])
    r = M.prob_metrics(truth, proba).first()
    assert r["proba_degenerate"] is True and r["roc_auc"] is None and r["log_loss"] is None
    truth, proba = _proba(spark, [0, 1], [(0.7, 0.3), (0.4, 0.6)])
    r = M.prob_metrics(truth, proba).first()
    assert r["proba_degenerate"] is False and r["roc_auc"] == pytest.approx(1.0)
