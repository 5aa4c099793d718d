"""Coverage, imputation, status taxonomy, streams and merges."""

import pytest
from pyspark.sql import functions as F

from evalspark.operators import coverage as V
from evalspark.operators import frames as P
from evalspark.operators import merge as X
from evalspark.streaming import streams as Z


def test_impute_failures_and_absent_baseline(spark):
    m = spark.createDataFrame([(0, "k", "BASE", 0.4), (0, "k", "A", 0.9), (1, "k", "A", 0.8)],
                              "seed int, key string, model string, f1_macro double")
    st = spark.createDataFrame([(0, "k", "B", "fail"), (1, "k", "B", "fail"), (0, "k", "C", "skip"),
                                (2, "k", "B", "fail")], "seed int, key string, model string, status string")
    out = V.impute_failures(m, st, "BASE", strict=False)
    imp = {(r["seed"], r["model"]): r["f1_macro"] for r in out.filter("imputed").collect()}
    assert imp == {(0, "B"): 0.4}          # seed 1 has no baseline row; seed 2 has no results
    with pytest.raises(Exception, match="no result on a failed unit's task"):       # by the job, whatever it reads
        V.impute_failures(m, st, "BASE").select("model").collect()


def test_missing_units_retry_counts_as_missing(spark):
    m = spark.createDataFrame([(0, "k", "A", 0.9)], "seed int, key string, model string, f1_macro double")
    st = spark.createDataFrame([(0, "k", "B", "retry"), (0, "k", "C", "skip")],
                               "seed int, key string, model string, status string")
    keys = spark.createDataFrame([("k",)], "key string")
    miss = V.missing_units(m, st, [0], keys, ["A", "B", "C"])
    assert [r["model"] for r in miss.collect()] == ["B"]
    with pytest.raises(AssertionError):
        V.assert_complete(miss)


def test_latest_status_rerun_replaces_retry(spark):
    recs = spark.createDataFrame([(0, "k", "A", "retry", 1), (0, "k", "A", "pass", 2)],
                                 "seed int, key string, model string, status string, ts int")
    assert Z.latest_status(recs).first()["status"] == "pass"


def test_error_taxonomy(spark):
    e = spark.createDataFrame([("This model's maximum context length is 8192 tokens",), ("HTTP 503",),
                               ("connection reset by peer",), ("ValueError: bad",), ("Request timed out",)],
                              "error string")
    got = [(r["status"], r["reason"]) for r in P.error_taxonomy(e).collect()]
    assert got == [("skip", "context_window"), ("retry", "infrastructure_error"), ("retry", "infrastructure_error"),
                   ("fail", "fit_error"), ("fail", "fit_error")]


def test_merge_equivalence_rules(spark):
    rows = [("s/predictions/k_ground_truth.csv", "a,b\n1,2\n", "a,b\r\n1,2\r\n"),
            ("s/stats/k_m.json", '{"n":1,"timestamp":"x"}', '{"n":1,"timestamp":"y"}'),
            ("s/stats/k_n.json", '{"n":1,"timestamp":"x"}', '{"n":2,"timestamp":"x"}'),
            ("c/config.json", '{"models":["A"],"output_dir":"o/x","seed":0}',
             '{"models":["A","B"],"output_dir":"o\\\\x","seed":0}'),
            ("c2/config.json", '{"models":["A","C"],"seed":0}', '{"models":["A","B"],"seed":0}')]
    df = spark.createDataFrame(rows, "path string, src string, dst string")
    got = [r[0] for r in df.select(X.files_equivalent(F.col("path"), F.col("src"), F.col("dst"))).collect()]
    assert got == [True, True, False, True, False]


def test_merge_plan_actions(spark):
    src = spark.createDataFrame([("s/predictions/k_ground_truth.csv", "1"), ("s/predictions/k_m.csv", "p"),
                                 ("s/metrics/x.csv", "m"), ("s/predictions/j_m.csv", "q")], "path string, content string")
    dst = spark.createDataFrame([("s/predictions/k_ground_truth.csv", "2"), ("s/predictions/k_m.csv", "p")],
                                "path string, content string")
    plan = {r["path"]: r["action"] for r in X.merge_plan(src, dst, keep_dest_conflicting_units=True).collect()}
    assert plan == {"s/predictions/k_ground_truth.csv": "skipped_conflicting_unit",
                    "s/predictions/k_m.csv": "skipped_conflicting_unit",
                    "s/metrics/x.csv": "ignored_derived", "s/predictions/j_m.csv": "copied"}
    plan = {r["path"]: r["action"] for r in X.merge_plan(src, dst).collect()}
    assert plan["s/predictions/k_ground_truth.csv"] == "conflict"


def test_append_only(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "x", "b"]), (["a", "b"], ["b", "a", "c"]), (["a"], ["a"])],
                               "old array<string>, new array<string>")
    assert [r[0] for r in df.select(X.append_only(F.col("old"), F.col("new"))).collect()] == [True, False, False]


def test_byo_estimator_takes_a_large_unit_in_chunks(spark):
    """Frames of the test rows are bounded; a unit of which a call fails has no rows at all."""
    import pandas as pd

    from evalspark.operators import predictors as P
    rows = [(0, k, i, "test" if i >= 10 else "train", f"c{i % 2}", float(i % 2)) for k in ("big", "bad") for i in range(310)]
    rows += [(0, "untrained", i, "test", "c0", 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "seed int, key string, row_id long, part string, target string, x double")

    def nearest(train, test):
        assert len(test) <= 100 and len(train) == 10
        if (test["key"].iloc[0] == "bad") and (test["row_id"] == 77).any():
            raise ValueError("no")
        return pd.Series([train[train.x == v].target.iloc[0] for v in test.x])
    got = P.byo_estimator(df, nearest, ["x"], "N", chunk_rows=50).collect()
    assert {(r.key, r.row_id): r.pred for r in got} == {("big", i): f"c{i % 2}" for i in range(10, 310)} and len(got) == 300
