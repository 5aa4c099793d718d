"""Queries: pairwise ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import leaderboard as B
from ..operators import pairwise as E
from .oracles import board_sql, cte, minmax_sql, with_ctes
from .registry import query

ANCHOR = "ARGENTINA"
N_BOOT = 100

cte("scores", ("metrics_grid",), """
SELECT model, key, avg(f1_macro) AS score FROM metrics_grid WHERE task = 'classification' GROUP BY 1, 2
UNION ALL
SELECT model, key, -avg(rmse) FROM metrics_grid WHERE task = 'regression' GROUP BY 1, 2""")
cte("battles", ("scores",), """
SELECT a.key, a.model AS a, b.model AS b,
       CAST(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END AS DOUBLE) AS s
FROM scores a JOIN scores b ON a.key = b.key AND a.model < b.model""")
cte("wins", ("battles",), """
SELECT model_a, model_b, sum(w) AS wins, CAST(count(*) AS DOUBLE) AS games FROM (
  SELECT a AS model_a, b AS model_b, s AS w FROM battles UNION ALL SELECT b, a, 1 - s FROM battles)
GROUP BY 1, 2""")


def _scores(spark, d):
    m = C.metrics_grid(spark, d)
    return E.score_table(m.filter("task = 'classification'"), m.filter("task = 'regression'"))


@query("score_table", with_ctes("SELECT model, key, round(score, 9) AS score FROM scores", "scores"))
def q_score_table(spark, d):
    return _scores(spark, d).withColumn("score", F.round("score", 9))


@query("battles", with_ctes("SELECT * FROM battles", "battles"))
def q_battles(spark, d):
    return E.battles(_scores(spark, d))


@query("win_counts", with_ctes("SELECT * FROM wins", "wins"))
def q_wins(spark, d):
    return E.win_counts(E.battles(_scores(spark, d)))


@query("winrate_matrix", with_ctes(f"""
WITH o AS (SELECT model_id, row_number() OVER (ORDER BY score DESC, model_id) AS pos
           FROM ({board_sql(minmax_sql('metrics_grid', 'f1_macro'))}))
SELECT ra.pos AS row_pos, cb.pos AS col_pos, w.model_a, w.model_b, w.wins
FROM wins w JOIN o ra ON w.model_a = ra.model_id JOIN o cb ON w.model_b = cb.model_id""", "wins", "metrics_grid"))
def q_winrate(spark, d):
    board = B.leaderboard(C.metrics_grid(spark, d))
    w = E.win_counts(E.battles(_scores(spark, d)))
    return E.winrate_matrix(w, board, order_col="score")


@query("bootstrap_weights", with_ctes(f"""
WITH k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS key_no, count(*) OVER () AS n_keys
           FROM (SELECT DISTINCT key FROM scores)),
d AS (SELECT r.rep, CAST('0x' || substr(md5('0:' || CAST(r.rep AS VARCHAR) || ':' || CAST(j.j AS VARCHAR)), 1, 8) AS BIGINT)
               % (SELECT max(n_keys) FROM k) AS key_no
      FROM range(0, {N_BOOT}) r(rep) CROSS JOIN range(0, (SELECT max(n_keys) FROM k)) j(j))
SELECT -1 AS rep, key, 1.0 AS weight FROM k
UNION ALL
SELECT CAST(d.rep AS INTEGER), k.key, CAST(count(*) AS DOUBLE) FROM d JOIN k ON d.key_no = k.key_no GROUP BY 1, 2""",
                                      "scores"))
def q_boot_w(spark, d):
    return E.bootstrap_weights(_scores(spark, d), N_BOOT, 0)


@query("bt_ratings")
def q_bt(spark, d):
    """Point BT fit on all keys (rows-only: an iterative fit, checked by pytest invariants)."""
    w = E.win_counts(E.battles(_scores(spark, d))).withColumn("rep", F.lit(-1))
    return E.bt_ratings(w, ["rep"], ANCHOR).select("model_id", F.round("rating").cast("long").alias("elo"),
                                                  "separated")


@query("elo_bootstrap")
def q_elo_boot(spark, d):
    return E.elo_bootstrap(_scores(spark, d), N_BOOT, 0, ANCHOR)


@query("elo_online")
def q_elo_online(spark, d):
    return E.elo_online(_scores(spark, d), n_orderings=10, anchor=ANCHOR)


BT_STEPS_SQL = """WITH p0 AS (SELECT model_a AS model_id, 1.0::DOUBLE AS p FROM wins GROUP BY 1),
w AS (SELECT model_a AS model_id, sum(wins) AS W FROM wins GROUP BY 1),
q1 AS (SELECT w.model_id, w.W / d.den AS p FROM w JOIN (
      SELECT x.model_a AS model_id, sum(x.games / (a.p + b.p)) AS den FROM wins x
      JOIN p0 a ON x.model_a = a.model_id JOIN p0 b ON x.model_b = b.model_id GROUP BY 1) d
      ON w.model_id = d.model_id),
p1 AS (SELECT model_id, p / (SELECT exp(avg(ln(p))) FROM q1) AS p FROM q1),
q2 AS (SELECT w.model_id, w.W / d.den AS p FROM w JOIN (
      SELECT x.model_a AS model_id, sum(x.games / (a.p + b.p)) AS den FROM wins x
      JOIN p1 a ON x.model_a = a.model_id JOIN p1 b ON x.model_b = b.model_id GROUP BY 1) d
      ON w.model_id = d.model_id),
p2 AS (SELECT model_id, p / (SELECT exp(avg(ln(p))) FROM q2) AS p FROM q2),
q3 AS (SELECT w.model_id, w.W / d.den AS p FROM w JOIN (
      SELECT x.model_a AS model_id, sum(x.games / (a.p + b.p)) AS den FROM wins x
      JOIN p2 a ON x.model_a = a.model_id JOIN p2 b ON x.model_b = b.model_id GROUP BY 1) d
      ON w.model_id = d.model_id),
p3 AS (SELECT model_id, p / (SELECT exp(avg(ln(p))) FROM q3) AS p FROM q3),
q4 AS (SELECT w.model_id, w.W / d.den AS p FROM w JOIN (
      SELECT x.model_a AS model_id, sum(x.games / (a.p + b.p)) AS den FROM wins x
      JOIN p3 a ON x.model_a = a.model_id JOIN p3 b ON x.model_b = b.model_id GROUP BY 1) d
      ON w.model_id = d.model_id),
p4 AS (SELECT model_id, p / (SELECT exp(avg(ln(p))) FROM q4) AS p FROM q4),
q5 AS (SELECT w.model_id, w.W / d.den AS p FROM w JOIN (
      SELECT x.model_a AS model_id, sum(x.games / (a.p + b.p)) AS den FROM wins x
      JOIN p4 a ON x.model_a = a.model_id JOIN p4 b ON x.model_b = b.model_id GROUP BY 1) d
      ON w.model_id = d.model_id),
p5 AS (SELECT model_id, p / (SELECT exp(avg(ln(p))) FROM q5) AS p FROM q5)
SELECT model_id, round(400 * log10(p), 6) AS rating FROM p5"""


@query("bt_mm_step", with_ctes(BT_STEPS_SQL, "wins"))
def q_bt_steps(spark, d):
    """Five MM steps of the Bradley-Terry fit, computed with joins (exact oracle)."""
    w = E.win_counts(E.battles(_scores(spark, d)))
    return E.bt_mm_steps(w, 5).withColumn("rating", F.round("rating", 6))
