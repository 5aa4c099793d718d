"""Queries: grid slicing (G*) and report frames (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import values

from .. import catalog as C
from ..operators import coverage as V
from ..operators import grid as G
from ..operators import leaderboard as B
from ..operators import pairwise as E
from ..operators import reports as R
from .oracles import board_sql, cte, minmax_sql, with_ctes
from .q_core import IMPUTED_SQL
from .registry import query

cte("grid_results", ("metrics_grid",), """
SELECT seed, key AS dataset, model, f1_macro, rmse, CAST(n_rows AS DOUBLE) AS n_rows,
       CASE WHEN seed % 3 = 0 THEN 'on' ELSE 'off' END AS reasoning,
       CASE WHEN seed % 2 = 1 THEN 'hidden' ELSE 'visible' END AS labels,
       CASE WHEN seed = 7 THEN '32' ELSE 'full' END AS feature_cap,
       CASE WHEN seed <= 4 THEN '100' ELSE '10' END AS n_train
FROM metrics_grid""")
cte("grid_datasets", (), """
SELECT p_brand AS dataset, CASE WHEN p_brand LIKE '%1' THEN 'synthetic' ELSE 'real' END AS suite,
       count(DISTINCT p_type) AS n_features FROM part GROUP BY 1, 2""")


def _grid_results(spark, d):
    m = C.metrics_grid(spark, d)
    s = F.col("seed")
    return m.select("seed", F.col("key").alias("dataset"), "model", "f1_macro", "rmse",
                    F.col("n_rows").cast("double").alias("n_rows"),
                    F.when(s % 3 == 0, "on").otherwise("off").alias("reasoning"),
                    F.when(s % 2 == 1, "hidden").otherwise("visible").alias("labels"),
                    F.when(s == 7, "32").otherwise("full").alias("feature_cap"),
                    F.when(s <= 4, "100").otherwise("10").alias("n_train"))


def _grid_datasets(spark, d):
    p = C.table(spark, d, "part")
    return p.groupBy(F.col("p_brand").alias("dataset"),
                     F.when(F.col("p_brand").endswith("1"), "synthetic").otherwise("real").alias("suite")) \
        .agg(F.countDistinct("p_type").alias("n_features"))


PLAN_ARGS = (["off", "on"], ["hidden", "visible"], ["32", "64", "full"], ["10", "100", "full"], ["10", "100"])
PLAN_SQL = """
SELECT DISTINCT r.reasoning, l.labels, c.feature_cap, n.n_train, d.dataset, d.suite
FROM grid_datasets d
JOIN (VALUES ('real', '10'), ('real', '100'), ('real', 'full'), ('synthetic', '10'), ('synthetic', '100')) n(suite, n_train)
  ON d.suite = n.suite
CROSS JOIN (VALUES ('off'), ('on')) r(reasoning) CROSS JOIN (VALUES ('hidden'), ('visible')) l(labels)
CROSS JOIN (VALUES ('32'), ('64'), ('full')) c(feature_cap)
WHERE (l.labels <> 'visible' OR d.suite = 'real')
  AND (c.feature_cap = 'full' OR d.n_features > CAST(c.feature_cap AS INTEGER))"""


def _plan(spark, d):
    return G.grid_plan(_grid_datasets(spark, d), *PLAN_ARGS)


@query("grid_plan", with_ctes(PLAN_SQL, "grid_datasets"))
def q_grid_plan(spark, d):
    return _plan(spark, d)


@query("axis_tokens", with_ctes(f"""
SELECT DISTINCT feature_cap, n_train,
       CASE WHEN lower(feature_cap) IN ('all', 'full') THEN NULL ELSE TRY_CAST(feature_cap AS INTEGER) END AS cap_value,
       CASE WHEN lower(n_train) IN ('all', 'full') THEN NULL ELSE TRY_CAST(n_train AS INTEGER) END AS n_value
FROM ({PLAN_SQL})""", "grid_datasets"))
def q_axis_tokens(spark, d):
    p = _plan(spark, d).select("feature_cap", "n_train").distinct()
    return p.select("feature_cap", "n_train", G.axis_token(F.col("feature_cap")).alias("cap_value"),
                    G.axis_token(F.col("n_train")).alias("n_value"))


@query("grid_collect", with_ctes(f"""
SELECT g.* FROM grid_results g WHERE EXISTS (SELECT 1 FROM ({PLAN_SQL}) p WHERE p.reasoning = g.reasoning
  AND p.labels = g.labels AND p.feature_cap = g.feature_cap AND p.n_train = g.n_train AND p.dataset = g.dataset)""",
                                  "grid_results", "grid_datasets"))
def q_grid_collect(spark, d):
    return G.grid_collect(_grid_results(spark, d), _plan(spark, d))


@query("grid_summary", with_ctes("""
SELECT dataset, model, reasoning, labels, feature_cap, n_train,
       round(avg(f1_macro), 9) AS f1_macro__mean, round(stddev_samp(f1_macro), 9) AS f1_macro__std, count(f1_macro) AS f1_macro__count,
       round(avg(rmse), 9) AS rmse__mean, round(stddev_samp(rmse), 9) AS rmse__std, count(rmse) AS rmse__count,
       round(avg(n_rows), 9) AS n_rows__mean, round(stddev_samp(n_rows), 9) AS n_rows__std, count(n_rows) AS n_rows__count
FROM grid_results GROUP BY 1, 2, 3, 4, 5, 6""", "grid_results"))
def q_grid_summary(spark, d):
    return G.grid_summary(_grid_results(spark, d), ["f1_macro", "rmse", "n_rows"])


@query("grid_elo_cells")
def q_grid_elo(spark, d):
    """Bradley-Terry per (reasoning, labels, n_train) cell on full-feature rows (rows-only)."""
    g = _grid_results(spark, d).filter("feature_cap = 'full'")
    cell = ["reasoning", "labels", "n_train"]
    sc = g.groupBy(*cell, "model", F.col("dataset").alias("key")).agg(F.avg("f1_macro").alias("score"))
    w = E.win_counts(E.battles(sc, cell), cell)
    return E.bt_ratings(w, cell, "ARGENTINA").withColumn("rating", F.round("rating"))


RATING_CELL = ["metric", "reasoning", "labels", "n_train", "suite"]
cte("cell_scores", ("grid_results",), """
SELECT m.metric, reasoning, labels, n_train, CASE WHEN dataset LIKE '%1' THEN 'synthetic' ELSE 'real' END AS suite,
       dataset AS key, model, avg(CASE WHEN m.metric = 'f1_macro' THEN f1_macro ELSE -rmse END) AS score
FROM grid_results, (VALUES ('f1_macro'), ('rmse')) m(metric)
WHERE feature_cap = 'full' GROUP BY ALL HAVING score IS NOT NULL""")
cte("cell_wins", ("cell_scores",), """
SELECT metric, reasoning, labels, n_train, suite, model_a, model_b, sum(w) AS wins FROM (
  SELECT a.metric, a.reasoning, a.labels, a.n_train, a.suite, a.model AS model_a, b.model AS model_b,
         CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END AS w
  FROM cell_scores a JOIN cell_scores b USING (metric, reasoning, labels, n_train, suite, key) WHERE a.model <> b.model)
GROUP BY ALL""")


def _cell_scores(spark, d):
    """(metric, reasoning, labels, n_train, suite, key, model, score): means over seeds, higher is better."""
    full = _grid_results(spark, d).filter("feature_cap = 'full'")
    suite = F.when(F.col("dataset").endswith("1"), "synthetic").otherwise("real").alias("suite")
    metric = F.explode(F.create_map(F.lit("f1_macro"), F.col("f1_macro"), F.lit("rmse"), -F.col("rmse"))).alias("metric", "v")
    long = full.select("reasoning", "labels", "n_train", suite, F.col("dataset").alias("key"), "model", metric)
    return long.groupBy(*RATING_CELL, "key", "model").agg(F.avg("v").alias("score")).filter("score is not null")


@query("grid_ratings")
def q_grid_ratings(spark, d):
    """Ratings with bootstrap intervals of every (metric, reasoning, labels, n, suite) cell (rows-only: a fit;
    ``grid_rating_balance`` checks its point fits)."""
    return E.cell_ratings(_cell_scores(spark, d), RATING_CELL, 100, 0, "ARGENTINA").drop("rating")


@query("grid_rating_balance", with_ctes("""SELECT * FROM (
WITH RECURSIVE cells AS (SELECT metric, reasoning, labels, n_train, suite, model_a AS a, model_b AS b, wins FROM cell_wins),
hops AS (
  SELECT metric, reasoning, labels, n_train, suite, a, b FROM cells WHERE wins > 0
  UNION
  SELECT h.metric, h.reasoning, h.labels, h.n_train, h.suite, h.a, c.b FROM hops h
  JOIN cells c ON c.metric = h.metric AND c.reasoning = h.reasoning AND c.labels = h.labels AND c.n_train = h.n_train
   AND c.suite = h.suite AND c.a = h.b AND c.wins > 0),
reached AS (SELECT metric, reasoning, labels, n_train, suite, count(*) AS n FROM hops WHERE a <> b GROUP BY ALL),
size AS (SELECT metric, reasoning, labels, n_train, suite, count(DISTINCT a) AS m FROM cells GROUP BY ALL)
SELECT metric, reasoning, labels, n_train, suite, a AS model_id, coalesce(n, 0) < m * (m - 1) AS separated, true AS converged,
       round(sum(CAST(wins AS DOUBLE)) + CASE WHEN coalesce(n, 0) < m * (m - 1) THEN 0.5 * count(*) ELSE 0 END, 6) AS expected_wins
FROM cells JOIN size USING (metric, reasoning, labels, n_train, suite)
LEFT JOIN reached USING (metric, reasoning, labels, n_train, suite) GROUP BY metric, reasoning, labels, n_train, suite, a, n, m)
""", "cell_wins"))
def q_grid_rating_balance(spark, d):
    """Expected wins under the point fit of each cell. The oracle has the observed wins: equal at the maximum only."""
    wins = E.win_counts(E.battles(_cell_scores(spark, d), RATING_CELL), RATING_CELL)
    fit = E.bt_ratings(wins, RATING_CELL, "ARGENTINA")
    even = E.rating_balance(wins, fit, RATING_CELL)
    return even.join(fit, [*RATING_CELL, "model_id"]).select(
        *RATING_CELL, "model_id", "separated", "converged", F.round("expected", 6).alias("expected_wins"))


AXVALS_SQL = """SELECT 'n_train' AS axis, n_train AS value FROM grid_results
UNION SELECT 'feature_cap', feature_cap FROM grid_results UNION SELECT 'n_train', 'full' FROM grid_results"""


@query("axis_order", with_ctes(f"""
SELECT axis, value, row_number() OVER (PARTITION BY axis ORDER BY TRY_CAST(value AS DOUBLE) IS NULL,
                                       TRY_CAST(value AS DOUBLE), value) AS position
FROM (SELECT DISTINCT axis, value FROM ({AXVALS_SQL}))""", "grid_results"))
def q_axis_order(spark, d):
    g = _grid_results(spark, d)
    v = (g.select(F.lit("n_train").alias("axis"), F.col("n_train").alias("value"))
         .union(g.select(F.lit("feature_cap"), "feature_cap"))
         .union(g.select(F.lit("n_train"), F.lit("full"))))
    return G.axis_order(v).withColumn("position", F.col("position").cast("long"))


@query("perf_surface", with_ctes("""
WITH f AS (SELECT * FROM grid_results WHERE feature_cap = 'full'),
v AS (SELECT dataset, reasoning, model, n_train, labels, avg(f1_macro) AS value FROM f GROUP BY 1, 2, 3, 4, 5)
SELECT m.dataset, m.reasoning, m.model, x.n_train, y.labels, round(v.value, 9) AS value
FROM (SELECT DISTINCT dataset, reasoning, model FROM v) m
CROSS JOIN (SELECT DISTINCT n_train FROM f) x CROSS JOIN (SELECT DISTINCT labels FROM f) y
LEFT JOIN v ON m.dataset = v.dataset AND m.reasoning = v.reasoning AND m.model = v.model
          AND x.n_train = v.n_train AND y.labels = v.labels""", "grid_results"))
def q_surface(spark, d):
    return G.perf_surface(_grid_results(spark, d), "f1_macro")


CELLS_SQL = """SELECT DISTINCT CASE WHEN dataset LIKE '%1' THEN 'synthetic' ELSE 'real' END AS suite,
  reasoning, labels, feature_cap, n_train FROM grid_results"""


@query("default_cell", with_ctes(f"""
SELECT suite, reasoning, labels, feature_cap, n_train FROM (
  SELECT *, row_number() OVER (PARTITION BY suite ORDER BY reasoning <> 'off', labels <> 'hidden', feature_cap <> 'full',
         n_train <> '10', TRY_CAST(n_train AS INTEGER) IS NULL, TRY_CAST(n_train AS INTEGER)) AS r
  FROM ({CELLS_SQL})) WHERE r = 1""", "grid_results"))
def q_default_cell(spark, d):
    g = _grid_results(spark, d).withColumn(
        "suite", F.when(F.col("dataset").endswith("1"), "synthetic").otherwise("real"))
    return G.default_cell(g)


@query("reference_cell", with_ctes("""
SELECT reasoning, labels, feature_cap, n_train FROM (
  SELECT *, row_number() OVER (ORDER BY labels <> 'hidden' OR n_train <> '100', labels <> 'hidden',
         TRY_CAST(n_train AS INTEGER) IS NOT NULL, TRY_CAST(n_train AS INTEGER) DESC,
         reasoning, labels, feature_cap, n_train) AS r
  FROM (SELECT DISTINCT reasoning, labels, feature_cap, n_train FROM grid_results)) WHERE r = 1""",
                                    "grid_results"))
def q_reference_cell(spark, d):
    return G.reference_cell(_grid_results(spark, d))


@query("run_state", with_ctes("""
SELECT s.status, s.n_units, m.models, m.n_models FROM (SELECT status, count(*) AS n_units FROM status GROUP BY 1) s
CROSS JOIN (SELECT array_to_string(list_sort(list(DISTINCT model)), ',') AS models, count(DISTINCT model) AS n_models
            FROM status) m""", "status"))
def q_run_state(spark, d):
    return G.run_state(C.status(spark, d))


# ------------------------------------------------------------------ reports
LB_ORDER_SQL = f"""SELECT model_id, row_number() OVER (ORDER BY score DESC, model_id) AS position
FROM ({board_sql(minmax_sql('metrics_grid', 'f1_macro'))})"""

HEATMAP_SQL = f"""
WITH v AS (SELECT model, key, avg(f1_macro) AS value FROM metrics_grid GROUP BY 1, 2 HAVING avg(f1_macro) IS NOT NULL),
s AS (SELECT model, key, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1.0 END AS norm FROM (
        SELECT *, min(value) OVER (PARTITION BY key) AS lo, max(value) OVER (PARTITION BY key) AS hi FROM v))
SELECT m.model, k.key, round(s.norm, 9) AS norm, o.position
FROM (SELECT DISTINCT model FROM metrics_grid) m CROSS JOIN (SELECT DISTINCT key FROM metrics_grid) k
LEFT JOIN s ON m.model = s.model AND k.key = s.key
LEFT JOIN ({LB_ORDER_SQL}) o ON m.model = o.model_id"""


def _order(spark, d):
    return B.leaderboard_rank(B.leaderboard(C.metrics_grid(spark, d))).select(
        "model_id", F.col("position").cast("long").alias("position"))


@query("score_heatmap", with_ctes(HEATMAP_SQL, "metrics_grid"))
def q_heatmap(spark, d):
    return R.score_heatmap(C.metrics_grid(spark, d), order=_order(spark, d))


PROFILE_SQL = """SELECT key, CASE WHEN sum(n_rows) <= 200 THEN 'small' WHEN sum(n_rows) <= 1000 THEN 'medium' ELSE 'large' END AS size_bucket,
  any_value(task) AS task_bucket FROM metrics_grid GROUP BY key"""


def _profile(spark, d):
    m = C.metrics_grid(spark, d)
    return m.groupBy("key").agg(F.when(F.sum("n_rows") <= 200, "small").when(F.sum("n_rows") <= 1000, "medium")
                                .otherwise("large").alias("size_bucket"), F.first("task").alias("task_bucket"))


@query("breakdown", with_ctes(f"""
WITH h AS ({HEATMAP_SQL.replace('LEFT JOIN s ON', 'JOIN s ON')}),
p AS ({PROFILE_SQL}),
l AS (SELECT h.model, h.key, h.norm, 'size_bucket' AS axis, p.size_bucket AS bucket FROM h JOIN p ON h.key = p.key
      UNION ALL SELECT h.model, h.key, h.norm, 'task_bucket', p.task_bucket FROM h JOIN p ON h.key = p.key)
SELECT axis, bucket, model, round(avg(norm), 9) AS mean_score, count(DISTINCT key) AS n_keys FROM l GROUP BY 1, 2, 3""",
                              "metrics_grid"))
def q_breakdown(spark, d):
    h = R.score_heatmap(C.metrics_grid(spark, d)).filter(F.col("norm").isNotNull())
    return R.breakdown(h, _profile(spark, d), ["size_bucket", "task_bucket"])


@query("dataset_overview", with_ctes("""
WITH r AS (SELECT key, count(*) AS n_samples, count(DISTINCT target) AS n_classes FROM clf_parts
           WHERE key <> 'customer_0' AND seed = 0 GROUP BY 1),
n AS (SELECT key, 'classification' AS task, count(*) AS n_samples, count(DISTINCT target) AS n_classes FROM clf_tasks GROUP BY 1
      UNION ALL SELECT 'lineitem_0', 'regression', count(*), NULL FROM lineitem)
SELECT coalesce(r.key, n.key) AS key, coalesce(r.n_samples, n.n_samples) AS n_samples,
       CASE WHEN coalesce(n.task, 'classification') = 'classification' THEN coalesce(r.n_classes, n.n_classes) END AS n_classes,
       CASE WHEN r.n_samples IS NOT NULL THEN 'results' ELSE 'native' END AS source
FROM r FULL OUTER JOIN n ON r.key = n.key""", "clf_parts", "clf_tasks"))
def q_overview(spark, d):
    parts = C.clf_parts_cached(spark, d)
    r = parts.filter("key <> 'customer_0' AND seed = 0").groupBy("key").agg(     # train and test rows of one seed: every row once
        F.count(F.lit(1)).alias("n_samples"), F.countDistinct("target").alias("n_classes"))
    t = C.clf_tasks(spark, d)
    n = t.groupBy("key").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("target").alias("n_classes")) \
        .withColumn("task", F.lit("classification"))
    li = C.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n_samples")).select(
        F.lit("lineitem_0").alias("key"), "n_samples", F.lit(None).cast("long").alias("n_classes"),
        F.lit("regression").alias("task"))
    return R.dataset_overview(r, n.unionByName(li))


@query("key_sizes", with_ctes("""
SELECT coalesce(s.key, k.key) AS key, s.n_samples, k.n_classes FROM
  (SELECT key, arg_min(n_train + n_test, (model, seed)) AS n_samples FROM status GROUP BY 1) s
FULL OUTER JOIN (SELECT key, count(DISTINCT CAST(k % 4 AS VARCHAR)) AS n_classes FROM event_units GROUP BY 1) k
ON s.key = k.key""", "status", "event_units"))
def q_key_sizes(spark, d):
    truth = C._event_units(spark, d).select("key", (F.col("k") % 4).cast("string").alias("target"))
    return R.key_sizes(C.status(spark, d), truth)


POINTS_SQL = f"""SELECT b.model_id, b.score AS y,
  CASE WHEN n.n_nationkey % 5 = 0 THEN NULL ELSE (n.n_nationkey % 7 + 1) * CAST(1.5 AS DOUBLE) END AS x
FROM ({board_sql(minmax_sql('metrics_grid', 'f1_macro'))}) b JOIN nation n ON b.model_id = n.n_name"""


@query("pareto_front", with_ctes(f"""
WITH p AS ({POINTS_SQL}),
b AS (SELECT x, max(y) AS best FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x),
bb AS (SELECT x, best, max(best) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b)
SELECT p.x, p.model_id, p.y, p.y = bb.best AND (bb.prev IS NULL OR p.y > bb.prev) AS pareto
FROM p JOIN bb ON p.x = bb.x""", "metrics_grid"))
def q_pareto(spark, d):
    board = B.leaderboard(C.metrics_grid(spark, d))
    n = C.table(spark, d, "nation")
    pts = board.join(n, board.model_id == n.n_name).select(
        "model_id", F.col("score").alias("y"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).otherwise((F.col("n_nationkey") % 7 + 1) * 1.5).alias("x"))
    return R.pareto_front(pts)


@query("score_vs_cost", with_ctes(f"""
SELECT b.model_id, b.score, c.train_time_s FROM ({board_sql(minmax_sql(f'({IMPUTED_SQL})', 'f1_macro'))}) b
JOIN (SELECT model AS model_id, round(avg(train_time_s), 3) AS train_time_s FROM status WHERE status = 'pass' GROUP BY 1) c
  ON b.model_id = c.model_id WHERE c.train_time_s > 0""", "metrics_run", "status"))
def q_score_cost(spark, d):
    board = B.leaderboard_e2e(C.metrics_run(spark, d), C.status(spark, d), C.BASELINE)
    return R.score_vs_cost(board, V.run_cost(C.status(spark, d)))


@query("characteristics", with_ctes("""
SELECT dataset, n_samples, row_number() OVER (ORDER BY TRY_CAST(n_samples AS BIGINT) DESC NULLS LAST, dataset) AS position
FROM (SELECT key AS dataset, CASE WHEN key = 'events_0' THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS n_samples
      FROM clf_tasks GROUP BY key)""", "clf_tasks"))
def q_characteristics(spark, d):
    t = C.clf_tasks(spark, d).groupBy(F.col("key").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    t = t.select("dataset", F.when(F.col("dataset") == "events_0", "n/a").otherwise(F.col("n").cast("string"))
                 .alias("n_samples"))
    return R.characteristics(t).withColumn("position", F.col("position").cast("long"))


# ---------------------------------------------------------------- fixed values
# Reference collections drawn next to our datasets on the samples × features panel.
REFERENCE_POINTS = [("reference-small", "reference", 100, 10), ("reference-wide", "reference", 200, 20000),
                    ("reference-tall", "reference", 100000, 50)]


@query("shape_points", with_ctes("""
SELECT key AS dataset, any_value(task) AS modality, count(*) AS n_samples, CAST(3 AS BIGINT) AS n_features, false AS reference
FROM clf_tasks GROUP BY key
UNION ALL SELECT * FROM (VALUES ('reference-small', 'reference', CAST(100 AS BIGINT), CAST(10 AS BIGINT), true),
  ('reference-wide', 'reference', 200, 20000, true), ('reference-tall', 'reference', 100000, 50, true))""", "clf_tasks"))
def q_shape(spark, d):
    t = C.clf_tasks(spark, d).groupBy(F.col("key").alias("dataset")).agg(
        F.first("task").alias("modality"), F.count(F.lit(1)).alias("n_samples")).withColumn("n_features", F.lit(3).cast("long"))
    ref = values(spark, REFERENCE_POINTS, "dataset string, modality string, n_samples long, n_features long")
    return R.shape_points(t, ref)


@query("axis_options", with_ctes("""
WITH p AS (SELECT list_sort(list(DISTINCT labels)) AS present FROM grid_results),
o AS (SELECT list_concat(list_filter(['hidden', 'none', 'visible'], lambda x: list_contains(present, x)),
                         list_filter(present, lambda x: NOT list_contains(['hidden', 'none', 'visible'], x))) AS opts FROM p)
SELECT 'labels' AS axis, CAST(i - 1 AS INTEGER) AS position, opts[i] AS option FROM o, range(1, len(opts) + 1) t(i)""",
                                  "grid_results"))
def q_axis_options(spark, d):
    return R.axis_options(_grid_results(spark, d), "labels", ["hidden", "none", "visible"])
