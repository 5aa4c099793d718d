"""Queries: metrics (M*), coverage (V*) and leaderboard (B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import coverage as V
from ..operators import leaderboard as B
from ..operators import metrics as M
from ..operators import predictors as P
from ..session import scratch_dir
from ..sources import tables as TB
from .oracles import board_sql, minmax_sql, with_ctes
from .registry import query


# ============================================================== leaderboard
@query("seed_mean", with_ctes("""
SELECT model, key, round(value, 9) AS value FROM (
  SELECT model, key, avg(f1_macro) AS value FROM metrics_grid GROUP BY 1, 2) WHERE value IS NOT NULL""",
                              "metrics_grid"))
def q_seed_mean(spark, d):
    return B.seed_mean(C.metrics_grid(spark, d)).withColumn("value", F.round("value", 9))


@query("minmax_scores", with_ctes(f"""
SELECT model, key, round(norm_score, 6) AS norm_score FROM ({minmax_sql('metrics_grid', 'f1_macro')})""",
                                  "metrics_grid"))
def q_minmax(spark, d):
    s = B.minmax_scores(B.seed_mean(C.metrics_grid(spark, d)))
    return s.select("model", "key", F.round("norm_score", 6).alias("norm_score"))


@query("per_key_rank", with_ctes(f"""
SELECT model, key, rank FROM ({minmax_sql('metrics_grid', 'rmse', False)})""", "metrics_grid"))
def q_rank(spark, d):
    return B.minmax_scores(B.seed_mean(C.metrics_grid(spark, d), "rmse"), False).select(
        "model", "key", "rank")


@query("leaderboard_agg", with_ctes(board_sql(minmax_sql("metrics_grid", "f1_macro")), "metrics_grid"))
def q_board(spark, d):
    return B.leaderboard(C.metrics_grid(spark, d))


LB_RANK_SQL = with_ctes(f"""
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, model_id) AS INTEGER) AS position
FROM ({board_sql(minmax_sql('metrics_grid', 'f1_macro'))})""", "metrics_grid")


@query("leaderboard_rank", LB_RANK_SQL)
def q_leaderboard_rank(spark, d):
    """The flagship: metric grid → seed mean → min-max → rank → aggregate → ranked board."""
    return B.leaderboard_rank(B.leaderboard(C.metrics_grid(spark, d)))


@query("leaderboard_top10", with_ctes(f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, model_id) AS INTEGER) AS position
FROM ({board_sql(minmax_sql('metrics_grid', 'f1_macro'))})) WHERE position <= 10""", "metrics_grid"))
def q_top10(spark, d):
    return B.leaderboard_rank(B.leaderboard(C.metrics_grid(spark, d)), n_top=10)


@query("leaderboard_overall", with_ctes(board_sql(
    minmax_sql("(SELECT * FROM metrics_grid WHERE task = 'classification')", "f1_macro") +
    " UNION ALL " +
    minmax_sql("(SELECT * FROM metrics_grid WHERE task = 'regression')", "rmse", False)),
    "metrics_grid"))
def q_overall(spark, d):
    m = C.metrics_grid(spark, d)
    return B.leaderboard_overall(m.filter("task = 'classification'"), m.filter("task = 'regression'"))


@query("leaderboard_text", with_ctes(f"""
SELECT model_id, printf('%s: Score=%.4f, Avg Rank=%.1f, Targets=%d', model_id, score, avg_rank,
                        n_targets) AS line
FROM ({board_sql(minmax_sql('metrics_run', 'f1_macro'))})""", "metrics_run"))
def q_lb_text(spark, d):
    return B.leaderboard_text(B.leaderboard(C.metrics_run(spark, d)))


@query("mean_metrics", with_ctes("""
SELECT model, round(avg(f1_macro), 4) AS f1_macro, round(avg(rmse), 4) AS rmse
FROM metrics_grid GROUP BY model""", "metrics_grid"))
def q_mean_metrics(spark, d):
    return B.mean_metrics(C.metrics_grid(spark, d), ["f1_macro", "rmse"])


@query("clf_only_mark", with_ctes(f"""
SELECT b.*, CASE WHEN o.model IS NOT NULL THEN b.model_id || ' *' ELSE b.model_id END AS display_name
FROM ({board_sql(minmax_sql('metrics_grid', 'f1_macro'))}) b
LEFT JOIN (SELECT DISTINCT model FROM metrics_grid WHERE task = 'classification'
           EXCEPT SELECT DISTINCT model FROM metrics_grid WHERE task = 'regression') o
ON b.model_id = o.model""", "metrics_grid"))
def q_clf_only(spark, d):
    m = C.metrics_grid(spark, d)
    return B.clf_only_mark(B.leaderboard(m), m.filter("task = 'classification'"),
                           m.filter("task = 'regression'"))


@query("leaderboard_add", with_ctes(board_sql(minmax_sql(
    "(SELECT seed, key, model, f1_macro FROM metrics_grid WHERE model <> 'CHINA' UNION ALL "
    "SELECT seed, key, model, f1_macro FROM metrics_grid WHERE model = 'CHINA' AND f1_macro IS NOT NULL)",
    "f1_macro")), "metrics_grid"))
def q_lb_add(spark, d):
    m = C.metrics_grid(spark, d)
    return B.leaderboard_add(m.filter("model <> 'CHINA'"), m.filter("model = 'CHINA'"))


@query("meta_upsert", with_ctes("""
SELECT model AS model_id, lower(model) AS display_name, 'old' AS source FROM (SELECT DISTINCT model FROM metrics_grid)
WHERE model NOT IN (SELECT DISTINCT model FROM metrics_grid WHERE model LIKE 'A%')
UNION ALL
SELECT DISTINCT model, upper(model), 'new' FROM metrics_grid WHERE model LIKE 'A%'""", "metrics_grid"))
def q_meta_upsert(spark, d):
    m = C.metrics_grid(spark, d).select("model").distinct()
    old = m.select(F.col("model").alias("model_id"), F.lower("model").alias("display_name"),
                   F.lit("old").alias("source"))
    new = m.filter(F.col("model").startswith("A")).select(
        F.col("model").alias("model_id"), F.upper("model").alias("display_name"), F.lit("new").alias("source"))
    return B.meta_upsert(old, new)


@query("leaderboard_meta", with_ctes(f"""
SELECT b.*, coalesce(m.display_name, b.model_id) AS display_name FROM ({board_sql(minmax_sql('metrics_grid', 'f1_macro'))}) b
LEFT JOIN (SELECT DISTINCT model AS model_id, lower(model) || '!' AS display_name FROM metrics_grid
           WHERE model < 'K') m ON b.model_id = m.model_id""", "metrics_grid"))
def q_lb_meta(spark, d):
    m = C.metrics_grid(spark, d)
    meta = (m.filter(F.col("model") < "K").select(F.col("model").alias("model_id"),
                                                 F.concat(F.lower("model"), F.lit("!")).alias("display_name")).distinct())
    return B.leaderboard_meta(B.leaderboard(m), meta)


# ============================================================== coverage
@query("coverage_counts", with_ctes("""
SELECT model AS model_id, count(*) FILTER (WHERE status = 'pass') AS n_passed,
       count(*) FILTER (WHERE status = 'fail') AS n_failed,
       count(*) FILTER (WHERE status = 'skip') AS n_skipped,
       count(*) FILTER (WHERE status = 'retry') AS n_retry
FROM status GROUP BY model""", "status"))
def q_coverage(spark, d):
    return V.coverage_counts(C.status(spark, d))


IMPUTED_SQL = """
SELECT seed, key, model, f1_macro, accuracy, rmse, false AS imputed FROM metrics_run
UNION ALL
SELECT f.seed, f.key, f.model, b.f1_macro, b.accuracy, b.rmse, true
FROM (SELECT seed, key, model FROM status s WHERE status = 'fail'
        AND EXISTS (SELECT 1 FROM metrics_run m WHERE m.seed = s.seed AND m.key = s.key)
        AND NOT EXISTS (SELECT 1 FROM metrics_run m WHERE m.seed = s.seed AND m.key = s.key
                        AND m.model = s.model)) f
JOIN (SELECT * FROM metrics_run WHERE model = 'm00') b ON f.seed = b.seed AND f.key = b.key"""


@query("impute_failures", with_ctes(IMPUTED_SQL, "metrics_run", "status"))
def q_impute(spark, d):
    return V.impute_failures(C.metrics_run(spark, d), C.status(spark, d), C.BASELINE)


MISSING_SQL = """
SELECT s.seed, k.key, m.model FROM (SELECT * FROM range(0, 5) t(seed)) s
CROSS JOIN (SELECT DISTINCT event_type AS key FROM events) k
CROSS JOIN (SELECT 'm' || lpad(CAST(i AS VARCHAR), 2, '0') AS model FROM range(0, 13) t(i)) m
WHERE NOT EXISTS (SELECT 1 FROM metrics_run x WHERE x.seed = s.seed AND x.key = k.key AND x.model = m.model)
  AND NOT EXISTS (SELECT 1 FROM status x WHERE x.seed = s.seed AND x.key = k.key AND x.model = m.model
                  AND x.status IN ('pass', 'fail', 'skip'))"""


def _axes(spark, d):
    keys = C.table(spark, d, "events").select(F.col("event_type").alias("key")).distinct()
    return list(range(5)), keys, [f"m{i:02d}" for i in range(13)]


@query("missing_units", with_ctes(MISSING_SQL.replace("s.seed, k.key, m.model", "CAST(s.seed AS INTEGER) AS seed, k.key, m.model"),
                                  "metrics_run", "status"))
def q_missing(spark, d):
    """Schedule = 5 seeds × event types × 13 models (m12 never ran, so all its units are missing)."""
    return V.missing_units(C.metrics_run(spark, d), C.status(spark, d), *_axes(spark, d))


@query("missing_from_definition", with_ctes(MISSING_SQL.replace(
    "s.seed, k.key, m.model", "CAST(s.seed AS INTEGER) AS seed, k.key, m.model").replace(
    "(SELECT DISTINCT event_type AS key FROM events) k", "(SELECT DISTINCT event_type AS key FROM events UNION ALL SELECT 'absent') k"),
                                            "metrics_run", "status"))
def q_missing_definition(spark, d):
    """The schedule comes from a stored run definition, so a dataset without any row is noticed."""
    path = scratch_dir(spark, "definition")
    seeds, keys, models = _axes(spark, d)
    every = keys.agg(F.array_union(F.sort_array(F.collect_set("key")), F.array(F.lit("absent"))).alias("keys"))
    every.select(F.array(*(F.lit(s) for s in seeds)).alias("seeds"), "keys",
                 F.array(*(F.lit(m) for m in models)).alias("models")).write.json(path)
    return V.missing_from_schedule(C.metrics_run(spark, d), C.status(spark, d), V.schedule(TB.run_definition(spark, path)))


@query("completeness_report", with_ctes(f"""
SELECT key, count(DISTINCT model) AS n_models, count(*) AS n_units FROM ({MISSING_SQL}) GROUP BY key""",
                                        "metrics_run", "status"))
def q_complete(spark, d):
    return V.completeness_report(V.missing_units(C.metrics_run(spark, d), C.status(spark, d),
                                                 *_axes(spark, d)))


@query("seed_summary", with_ctes("SELECT seed, status, count(*) AS n_units FROM status GROUP BY 1, 2",
                                 "status"))
def q_seed_summary(spark, d):
    return V.seed_summary(C.status(spark, d))


@query("run_cost", with_ctes("""
SELECT model AS model_id, round(avg(train_time_s), 3) AS train_time_s,
       round(avg(inference_time_per_sample_ms), 3) AS inference_ms_per_sample,
       round(avg(train_peak_memory_mb), 1) AS peak_memory_mb, count(*) AS n_units
FROM status WHERE status = 'pass' GROUP BY model""", "status"))
def q_run_cost(spark, d):
    return V.run_cost(C.status(spark, d))


@query("leaderboard_e2e", with_ctes(board_sql(minmax_sql(f"({IMPUTED_SQL})", "f1_macro")),
                                    "metrics_run", "status"))
def q_e2e(spark, d):
    return B.leaderboard_e2e(C.metrics_run(spark, d), C.status(spark, d), C.BASELINE)


@query("incremental_units", with_ctes("""
SELECT seed, key, model, f1_macro FROM metrics_run m
WHERE NOT EXISTS (SELECT 1 FROM metrics_run e WHERE e.seed = m.seed AND e.key = m.key
                  AND e.model = m.model AND e.seed < 3)""", "metrics_run"))
def q_incremental(spark, d):
    m = C.metrics_run(spark, d).select("seed", "key", "model", "f1_macro")
    return M.incremental_units(m, m.filter("seed < 3"))


@query("unparsed_join", with_ctes("""
SELECT m.seed, m.key, m.model, m.f1_macro, s.llm_unparsed_frac FROM metrics_run m
LEFT JOIN status s ON m.seed = s.seed AND m.key = s.key AND m.model = s.model""",
                                  "metrics_run", "status"))
def q_unparsed(spark, d):
    return M.unparsed_join(C.metrics_run(spark, d).select("seed", "key", "model", "f1_macro"),
                           C.status(spark, d))


# ============================================================== classification metrics
def _clf(spark, d):
    _, truth, preds, proba = C.clf_bundle(spark, d)
    return truth, preds, proba


CLF_SQL = """
SELECT seed, key, model, round(C / N, 9) AS accuracy, round(w_prec / N, 9) AS precision,
       round(w_rec / N, 9) AS recall, round(w_f1 / N, 9) AS f1_score, round(f1_macro, 9) AS f1_macro,
       round(bacc, 9) AS balanced_accuracy,
       round(CASE WHEN 1 - tp_sum / (N * N) <> 0 THEN (C / N - tp_sum / (N * N)) / (1 - tp_sum / (N * N)) END, 9) AS cohen_kappa,
       round(coalesce(CASE WHEN (N * N - pp2) * (N * N - tt2) <> 0
                           THEN (C * N - tp_sum) / sqrt((N * N - pp2) * (N * N - tt2)) END, 0.0), 9) AS matthews_corrcoef,
       CAST(N AS BIGINT) AS n_test
FROM (SELECT seed, key, model, CAST(sum(support) AS DOUBLE) AS N, CAST(sum(tp) AS DOUBLE) AS C,
             sum(support * coalesce(CASE WHEN predicted <> 0 THEN tp / predicted END, 0.0)) AS w_prec,
             sum(support * coalesce(CASE WHEN support <> 0 THEN tp / support END, 0.0)) AS w_rec,
             sum(support * coalesce(2 * tp / (support + predicted), 0.0)) AS w_f1,
             avg(coalesce(2 * tp / (support + predicted), 0.0)) AS f1_macro,
             avg(CASE WHEN support > 0 THEN tp / support END) AS bacc,
             CAST(sum(support * predicted) AS DOUBLE) AS tp_sum,
             CAST(sum(predicted * predicted) AS DOUBLE) AS pp2,
             CAST(sum(support * support) AS DOUBLE) AS tt2
      FROM per_class GROUP BY 1, 2, 3)"""


@query("clf_metrics", with_ctes(CLF_SQL, "per_class"))
def q_clf_metrics(spark, d):
    t, p, _ = _clf(spark, d)
    return M.clf_metrics(M.confusion_counts(t, p))


@query("confusion_matrix", with_ctes("""
SELECT seed, key, model, y, p, round(n / sum(n) OVER (PARTITION BY seed, key, model, y), 9) AS value
FROM cc""", "cc"))
def q_confusion(spark, d):
    t, p, _ = _clf(spark, d)
    return M.confusion_matrix(M.confusion_counts(t, p), "true")


@query("clf_report", with_ctes("""
SELECT seed, key, model, cls, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1, support FROM (
  SELECT * FROM report_rows
  UNION ALL SELECT seed, key, model, 'macro avg', avg(precision), avg(recall), avg(f1),
                   CAST(sum(support) AS BIGINT) FROM report_rows GROUP BY 1, 2, 3
  UNION ALL SELECT seed, key, model, 'weighted avg', sum(precision * support) / sum(support),
                   sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
                   CAST(sum(support) AS BIGINT) FROM report_rows GROUP BY 1, 2, 3)""", "report_rows"))
def q_report(spark, d):
    t, p, _ = _clf(spark, d)
    return M.clf_report(M.confusion_counts(t, p))


AUC_SQL = """
WITH pl AS (SELECT p.seed, p.key, p.model, p.row_id, t.target AS y, p.cls, p.score
            FROM proba_long p JOIN truth t ON p.seed = t.seed AND p.key = t.key AND p.row_id = t.row_id),
sc AS (SELECT seed, key, model, cls, score, count(*) FILTER (WHERE y = cls) AS pos,
              count(*) FILTER (WHERE y <> cls) AS neg FROM pl GROUP BY 1, 2, 3, 4, 5),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY seed, key, model, cls ORDER BY score
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM sc),
per AS (SELECT seed, key, model, cls, sum(pos) AS P, sum(neg) AS Nn,
               CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                    THEN sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc
        FROM cum GROUP BY 1, 2, 3, 4),
agg AS (SELECT seed, key, model, count(*) AS k, max(cls) AS last_cls,
               count(*) FILTER (WHERE auc IS NULL) AS bad,
               sum(auc * P) / sum(P) AS ovr FROM per GROUP BY 1, 2, 3)
SELECT a.seed, a.key, a.model,
       round(CASE WHEN a.k < 2 OR a.bad > 0 THEN NULL WHEN a.k = 2 THEN p.auc ELSE a.ovr END, 9) AS roc_auc
FROM agg a JOIN per p ON a.seed = p.seed AND a.key = p.key AND a.model = p.model AND p.cls = a.last_cls"""


def _auc(spark, d):
    t, _, proba = _clf(spark, d)
    return M.roc_auc(M.proba_long(t, proba))


@query("roc_auc_binary", with_ctes(f"SELECT * FROM ({AUC_SQL}) WHERE key LIKE 'documents%'",
                                   "proba_long", "truth"))
def q_auc_bin(spark, d):
    return _auc(spark, d).filter(F.col("key").startswith("documents"))


@query("roc_auc_ovr", with_ctes(f"SELECT * FROM ({AUC_SQL}) WHERE key NOT LIKE 'documents%'",
                                "proba_long", "truth"))
def q_auc_ovr(spark, d):
    return _auc(spark, d).filter(~F.col("key").startswith("documents"))


@query("log_loss", with_ctes("""
SELECT p.seed, p.key, p.model,
       round(avg(-ln(greatest(least(p.score, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 9) AS log_loss
FROM proba_long p JOIN truth t ON p.seed = t.seed AND p.key = t.key AND p.row_id = t.row_id
WHERE p.cls = t.target GROUP BY 1, 2, 3""", "proba_long", "truth"))
def q_log_loss(spark, d):
    t, _, proba = _clf(spark, d)
    return M.log_loss(M.proba_long(t, proba))


@query("proba_degenerate", with_ctes("""
SELECT seed, key, model, bool_and(score IN (0.0, 1.0)) AS proba_degenerate
FROM proba_long GROUP BY 1, 2, 3""", "proba_long"))
def q_degenerate(spark, d):
    _, _, proba = _clf(spark, d)
    return M.proba_degenerate(proba)


@query("align_check", with_ctes("""
SELECT p.seed, p.key, p.model, CAST(0 AS BIGINT) AS missing_pred, CAST(0 AS BIGINT) AS extra_pred,
       count(*) AS n_rows, true AS aligned
FROM predictions p GROUP BY 1, 2, 3""", "predictions"))
def q_align(spark, d):
    t, p, _ = _clf(spark, d)
    return M.align_check(t, p)


@query("score_units", with_ctes(f"""
SELECT seed, key, model, accuracy, f1_macro, NULL::DOUBLE AS rmse, 'classification' AS task FROM ({CLF_SQL})
UNION ALL
SELECT seed, key, model, NULL, NULL, round(sqrt(avg((y - pred) * (y - pred))), 6), 'regression'
FROM reg_preds GROUP BY 1, 2, 3""", "per_class", "reg_preds"))
def q_score_units(spark, d):
    t, p, _ = _clf(spark, d)
    clf = M.clf_metrics(M.confusion_counts(t, p)).select("seed", "key", "model", "accuracy", "f1_macro")
    reg = M.reg_metrics(_reg(spark, d)).select("seed", "key", "model", F.round("rmse", 6).alias("rmse"))
    return M.score_units(clf, reg)


@query("compare_metric", with_ctes(f"""
SELECT key, arg_max(model, (f1_macro, model)) AS best_model, arg_min(model, (f1_macro, model)) AS worst_model,
       round(avg(f1_macro), 9) AS mean, round(stddev_pop(f1_macro), 9) AS std, count(*) AS n_models
FROM ({CLF_SQL}) WHERE f1_macro IS NOT NULL GROUP BY key""", "per_class"))
def q_compare(spark, d):
    t, p, _ = _clf(spark, d)
    return M.compare_metric(M.clf_metrics(M.confusion_counts(t, p)), "f1_macro")


@query("metric_summary", with_ctes(f"""
SELECT key, model, round(avg(accuracy), 9) AS accuracy__mean, round(stddev_samp(accuracy), 9) AS accuracy__std,
       round(avg(f1_macro), 9) AS f1_macro__mean, round(stddev_samp(f1_macro), 9) AS f1_macro__std,
       count(*) AS n_seeds
FROM ({CLF_SQL}) GROUP BY key, model""", "per_class"))
def q_summary(spark, d):
    t, p, _ = _clf(spark, d)
    m = M.clf_metrics(M.confusion_counts(t, p)).select("seed", "key", "model", "accuracy", "f1_macro")
    return M.metric_summary(m)


# ============================================================== regression metrics
def _reg(spark, d):
    return P.regression_models(C.reg_parts_cached(spark, d))


@query("reg_metrics", with_ctes("""
SELECT seed, key, model, round(mse, 1) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
       round(CASE WHEN var_y * n <> 0 THEN 1 - ss_res / (var_y * n) WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END, 9) AS r2,
       round(coalesce(ape * 100, 0.0), 6) AS mape,
       round(CASE WHEN var_y <> 0 THEN 1 - var_e / var_y WHEN var_e = 0 THEN 1.0 ELSE 0.0 END, 9) AS explained_variance,
       round(max_error, 6) AS max_error, round(median_ae, 6) AS median_ae
FROM (SELECT seed, key, model, avg((y - pred) * (y - pred)) AS mse, avg(abs(y - pred)) AS mae,
             sum((y - pred) * (y - pred)) AS ss_res, var_pop(y) AS var_y, var_pop(y - pred) AS var_e,
             count(*) AS n, avg(CASE WHEN y <> 0 THEN abs((y - pred) / y) END) AS ape,
             max(abs(y - pred)) AS max_error, quantile_cont(abs(y - pred), 0.5) AS median_ae
      FROM reg_preds GROUP BY 1, 2, 3)""", "reg_preds"))
def q_reg_metrics(spark, d):
    m = M.reg_metrics(_reg(spark, d))
    # magnitudes differ (squared prices ~1e9 vs fractions): compare at fixed decimals
    digits = {"mse": 1, "r2": 9, "explained_variance": 9}
    return m.select("seed", "key", "model", *[F.round(c, digits.get(c, 6)).alias(c) for c in
                                              ("mse", "rmse", "mae", "r2", "mape", "explained_variance",
                                               "max_error", "median_ae")])


@query("prob_metrics", with_ctes(f"""
WITH a AS ({AUC_SQL}),
l AS (SELECT p.seed, p.key, p.model,
             round(avg(-ln(greatest(least(p.score, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 9) AS log_loss
      FROM proba_long p JOIN truth t ON p.seed = t.seed AND p.key = t.key AND p.row_id = t.row_id
      WHERE p.cls = t.target GROUP BY 1, 2, 3),
dg AS (SELECT seed, key, model, bool_and(score IN (0.0, 1.0)) AS proba_degenerate FROM proba_long GROUP BY 1, 2, 3)
SELECT a.seed, a.key, a.model, CASE WHEN NOT dg.proba_degenerate THEN a.roc_auc END AS roc_auc,
       CASE WHEN NOT dg.proba_degenerate THEN l.log_loss END AS log_loss, dg.proba_degenerate
FROM a JOIN l ON a.seed = l.seed AND a.key = l.key AND a.model = l.model
JOIN dg ON a.seed = dg.seed AND a.key = dg.key AND a.model = dg.model""", "proba_long", "truth"))
def q_prob_metrics(spark, d):
    """M15 applied: AUC and log loss nulled for one-hot (degenerate) units."""
    t, _, proba = _clf(spark, d)
    return M.prob_metrics(t, proba)
