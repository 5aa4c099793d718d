"""Leaderboard and rating invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import leaderboard as B
from evalspark.operators import pairwise as E
from evalspark.operators import reports as R


def _scores(spark, rows):
    return spark.createDataFrame(rows, "model string, key string, score double")


def test_minmax_and_single_model_key(spark):
    m = spark.createDataFrame([(0, "k1", "A", 0.9), (0, "k1", "B", 0.8), (0, "k1", "C", 0.2),
                               (0, "k2", "A", 0.85), (0, "k2", "C", 0.2), (0, "k3", "A", 0.5)],
                              "seed int, key string, model string, f1_macro double")
    s = {(r["model"], r["key"]): r["norm_score"] for r in B.minmax_scores(B.seed_mean(m)).collect()}
    assert s[("B", "k1")] == pytest.approx((0.8 - 0.2) / (0.9 - 0.2))
    assert ("A", "k3") not in s                       # keys with one model are dropped
    board = {r["model_id"]: r for r in B.leaderboard(m).collect()}
    assert board["A"]["score"] == 1.0 and board["A"]["n_targets"] == 2
    assert board["C"]["improvability"] == 100.0
    # the heatmap scores a single-model key 1.0 instead (report convention)
    h = {(r["model"], r["key"]): r["norm"] for r in R.score_heatmap(m).collect()}
    assert h[("A", "k3")] == 1.0 and h[("B", "k2")] is None


def test_ties_share_lowest_rank(spark):
    m = spark.createDataFrame([(0, "k", "A", 0.5), (0, "k", "B", 0.5), (0, "k", "C", 0.1)],
                              "seed int, key string, model string, f1_macro double")
    r = {x["model"]: x["rank"] for x in B.minmax_scores(B.seed_mean(m)).collect()}
    assert r == {"A": 1.0, "B": 1.0, "C": 3.0}


def test_win_counts_split_ties_and_skip_unplayed(spark):
    sc = _scores(spark, [("A", "t1", 0.9), ("B", "t1", 0.5), ("A", "t2", 0.7), ("B", "t2", 0.7), ("A", "t3", 0.1)])
    w = {(r["model_a"], r["model_b"]): r["wins"] for r in E.win_counts(E.battles(sc)).collect()}
    assert w[("A", "B")] == 1.5 and w[("B", "A")] == 0.5


def test_bradley_terry_nine_to_one_gap():
    w = np.array([[0.0, 9.0], [1.0, 0.0]])
    logp, sep = E.bt_fit(["A", "B"], w)
    assert not sep
    assert 400 * (logp[0] - logp[1]) == pytest.approx(400 * math.log10(9), abs=1.0)


def test_bt_ratings_anchor_dominance_and_separation(spark):
    rows = []
    for t in range(6):
        for i, m in enumerate(["M0", "M1", "M2", "M3"]):
            rows.append((m, f"t{t}", 1.0 - 0.1 * i + (0.05 if (t + i) % 5 == 0 else 0)))
    sc = _scores(spark, rows)
    w = E.win_counts(E.battles(sc)).withColumn("rep", F.lit(0))
    r = {x["model_id"]: x for x in E.bt_ratings(w, ["rep"], anchor="M1", anchor_value=1000).collect()}
    assert r["M1"]["rating"] == pytest.approx(1000.0)
    assert r["M0"]["rating"] > r["M1"]["rating"] > r["M2"]["rating"] > r["M3"]["rating"]
    assert all(math.isfinite(x["rating"]) for x in r.values())


def test_elo_degenerate_input_is_empty_with_fixed_columns(spark):
    empty = _scores(spark, [])
    out = E.elo_bootstrap(empty, n_boot=5)
    assert out.count() == 0
    assert out.columns == ["model_id", "elo", "elo_lo", "elo_hi", "n_targets"]


def test_newton_fit_balances_wins_and_says_when_it_stopped_early():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = int(rng.integers(2, 12))
        w = rng.integers(0, 30, (m, m)) * (rng.random((m, m)) < 0.7) * 1.0
        np.fill_diagonal(w, 0)
        theta, separated, converged = E.bt_solve(w)
        w = w + 0.5 * (w + w.T > 0) if separated else w
        expected = ((w + w.T) / (1 + np.exp(theta[None, :] - theta[:, None]))).sum(axis=1)
        assert converged and np.allclose(expected, w.sum(axis=1), atol=1e-6)
    lopsided = np.array([[0, 1e6, 1], [1, 0, 1e6], [1, 1, 0.0]])
    assert E.bt_solve(lopsided)[2] and not E.bt_solve(lopsided, steps=1)[2]
    apart = np.array([[0, 3, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 5, 0.0]])     # two pairs that never met
    assert E.bt_solve(apart)[1:] == (True, True)


def test_cells_are_rated_alone_and_together_alike(spark):
    one = [("A", "t%d" % t, 0.9 - 0.1 * (t % 3)) for t in range(6)] + [("B", "t%d" % t, 0.8) for t in range(6)] \
        + [("C", "t%d" % t, 0.5 + 0.1 * (t % 4)) for t in range(6)]
    rows = [("x", *r) for r in one] + [("y", *r) for r in one[:12]] + [("z", "A", "t0", 0.3), ("z", "B", "t1", 0.4),
                                                                     ("y", "D", "t0", None)]
    sc = spark.createDataFrame(rows, "cell string, model string, key string, score double")
    got = E.cell_ratings(sc, ["cell"], n_boot=20, anchor="A")
    assert got.columns == ["cell", "model_id", "elo", "elo_lo", "elo_hi", "rating", "separated", "converged", "n_targets"]
    cells = {(r["cell"], r["model_id"]): r for r in got.collect()}
    assert {c for c, _ in cells} == {"x", "y"} and ("y", "D") not in cells      # no pair met in z; D has no score
    alone = {r["model_id"]: r for r in E.cell_ratings(sc.filter("cell = 'x'"), ["cell"], 20, anchor="A").collect()}
    for m in "ABC":
        a, b = cells["x", m], alone[m]
        assert b["rating"] == pytest.approx(a["rating"]) and (b["elo"], b["elo_lo"], b["elo_hi"]) == (a["elo"], a["elo_lo"], a["elo_hi"])
        assert a["elo_lo"] <= a["elo"] <= a["elo_hi"] and a["converged"] and a["n_targets"] == 6
    assert cells["x", "A"]["rating"] == pytest.approx(1000) and cells["x", "A"]["elo"] == 1000
    w = E.cell_bootstrap_weights(sc.filter("score is not null"), ["cell"], 20).groupBy("cell", "rep").agg(F.sum("weight").alias("w"))
    assert {(r["cell"], r["w"]) for r in w.collect()} == {("x", 6.0), ("y", 6.0), ("z", 2.0)}
    assert E.cell_ratings(sc.limit(0), ["cell"], 5).count() == 0


def test_pareto_front(spark):
    pts = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.7), ("c", 3.0, 0.6), ("d", None, 0.9)],
                                "model_id string, x double, y double")
    got = {r["model_id"]: r["pareto"] for r in R.pareto_front(pts).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_heatmap_of_more_keys_than_a_pivot_takes(spark):
    n = spark.conf.get("spark.sql.pivotMaxValues")
    keys = spark.range(int(n) + 50).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("i"))
    m = keys.select(F.lit(0).alias("seed"), "key", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("model"),
                    F.col("i").cast("double").alias("f1_macro")).filter("model = 'A' or i > 0")
    h = R.score_heatmap(m)
    assert h.count() == 2 * (int(n) + 50)
    assert [r["key"] for r in h.filter("norm is null").collect()] == ["k0"]
