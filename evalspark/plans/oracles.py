"""DuckDB oracle SQL for every exact (``=``) query in :mod:`evalspark.plans.queries`.

The oracles rebuild the same fact tables from the driver's tables in plain SQL (common
table expressions below) and answer each query independently of the Spark code path.
"""

from __future__ import annotations

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body


def H(seed: str, ident: str) -> str:
    """md5(seed:id) in SQL."""
    return f"md5(CAST({seed} AS VARCHAR) || ':' || CAST({ident} AS VARCHAR))"


def HN(text: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


# ----------------------------------------------------------------------------- fact tables
cte("metrics_grid", (), """
SELECT seed, key, model, f1_macro, rmse, n_rows,
       CASE WHEN key LIKE '%5' THEN 'regression' ELSE 'classification' END AS task
FROM (SELECT l.l_linenumber AS seed, p.p_brand AS key, n.n_name AS model,
             round(avg(l.l_discount), 9) AS f1_macro,
             round(stddev_pop(l.l_extendedprice), 6) AS rmse, count(*) AS n_rows
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
      JOIN nation n ON s.s_nationkey = n.n_nationkey
      JOIN part p ON l.l_partkey = p.p_partkey
      GROUP BY 1, 2, 3)""")

cte("event_units", (), """
SELECT CAST(event_id % 5 AS INTEGER) AS seed, event_type AS key,
       'm' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS model,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts, event_id, value
FROM events""")

cte("status", ("event_units",), """
SELECT seed, key, model, status,
       CASE WHEN status = 'skip' THEN (CASE WHEN k % 2 = 0 THEN 'context_window' ELSE 'design_limit' END)
            ELSE '' END AS reason,
       CASE WHEN status = 'fail' THEN (CASE k % 5
            WHEN 0 THEN 'This model''s maximum context length is 8192 tokens'
            WHEN 1 THEN 'HTTP 503 Service Unavailable'
            WHEN 2 THEN 'Request timed out after 900 seconds'
            WHEN 3 THEN 'could not parse any answer line'
            ELSE 'ValueError: Input contains NaN' END) END AS error,
       n_test * 4 AS n_train, n_test, train_time_s, inference_time_per_sample_ms,
       train_peak_memory_mb, llm_unparsed, round(llm_unparsed / n_test, 6) AS llm_unparsed_frac,
       ts, k
FROM (
  SELECT a.*, l.k, l.ts,
         CASE WHEN a.model = 'm00' THEN 'pass' WHEN l.k < 70 THEN 'pass' WHEN l.k < 85 THEN 'fail'
              WHEN l.k < 95 THEN 'skip' ELSE 'retry' END AS status
  FROM (SELECT seed, key, model, CAST(count(*) AS INTEGER) AS n_test,
               CAST(count(*) FILTER (WHERE value < 5) AS INTEGER) AS llm_unparsed,
               round(sum(value) / 100, 4) AS train_time_s,
               round(avg(value), 4) AS inference_time_per_sample_ms,
               round(max(value) * 10, 2) AS train_peak_memory_mb
        FROM event_units GROUP BY 1, 2, 3) a
  JOIN (SELECT seed, key, model, k, ts FROM (
          SELECT *, row_number() OVER (PARTITION BY seed, key, model
                                       ORDER BY ts DESC, event_id DESC) AS rn
          FROM event_units) WHERE rn = 1) l
  USING (seed, key, model))""")

cte("metrics_run", ("event_units", "status"), """
SELECT m.* FROM (
  SELECT seed, key, model, round(avg(value) / 500, 9) AS f1_macro,
         round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
         round(stddev_pop(value), 6) AS rmse
  FROM event_units GROUP BY 1, 2, 3) m
WHERE EXISTS (SELECT 1 FROM status s WHERE s.status = 'pass' AND s.seed = m.seed
              AND s.key = m.key AND s.model = m.model)""")

cte("clf_tasks", (), """
SELECT dataset, target_idx, dataset || '_' || CAST(target_idx AS VARCHAR) AS key,
       'classification' AS task, row_id, target, x1, x2, grp
FROM (
  SELECT 'orders' AS dataset, 0 AS target_idx, o_orderkey AS row_id, o_orderpriority AS target,
         o_totalprice AS x1, CAST(month(o_orderdate) AS DOUBLE) AS x2, o_orderstatus AS grp
  FROM orders
  UNION ALL
  SELECT 'customer', 0, c_custkey, c_mktsegment, c_acctbal, CAST(c_nationkey AS DOUBLE),
         CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL
  SELECT 'events', 0, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE), CAST(user_id % 10 AS VARCHAR)
  FROM events
  UNION ALL
  SELECT 'documents', 0, d.doc_id, CAST(l.quality AS VARCHAR), CAST(d.n_chars AS DOUBLE),
         CAST(length(d.source) AS DOUBLE), d.lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 'documents', 1, d.doc_id, CAST(l.toxic AS VARCHAR), CAST(d.n_chars AS DOUBLE),
         CAST(length(d.source) AS DOUBLE), d.lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""")

cte("seeds", (), "SELECT * FROM (VALUES (0), (1), (2)) t(seed)")

# stratified 20 % holdout: ceil(n*0.2) test rows per key; class quotas by largest remainder
cte("clf_quota", ("clf_tasks",), """
SELECT key, target, cnt, q0 + CASE WHEN r <= extra THEN 1 ELSE 0 END AS quota FROM (
  SELECT *, take - sum(q0) OVER (PARTITION BY key) AS extra,
         row_number() OVER (PARTITION BY key ORDER BY take * cnt - q0 * n DESC, target) AS r
  FROM (SELECT *, CAST(floor(take * cnt / n) AS BIGINT) AS q0 FROM (
          SELECT key, target, cnt, sum(cnt) OVER (PARTITION BY key) AS n,
                 CAST(ceil(sum(cnt) OVER (PARTITION BY key) * 0.2) AS BIGINT) AS take
          FROM (SELECT key, target, count(*) AS cnt FROM clf_tasks GROUP BY 1, 2))))""")

cte("clf_splits", ("clf_tasks", "clf_quota", "seeds"), f"""
SELECT r.key, r.seed, r.row_id, CASE WHEN r.rn <= q.quota THEN 'test' ELSE 'train' END AS part
FROM (SELECT t.key, s.seed, t.row_id, t.target,
             row_number() OVER (PARTITION BY t.key, s.seed, t.target
                                ORDER BY {H('s.seed', 't.row_id')}, t.row_id) AS rn
      FROM clf_tasks t CROSS JOIN seeds s) r
JOIN clf_quota q ON r.key = q.key AND r.target = q.target""")

cte("clf_parts", ("clf_tasks", "clf_splits"), """
SELECT s.seed, s.key, s.row_id, s.part, t.target, t.x1, t.x2, t.grp
FROM clf_splits s JOIN clf_tasks t ON s.key = t.key AND s.row_id = t.row_id""")

cte("truth", ("clf_parts",), "SELECT seed, key, row_id, target FROM clf_parts WHERE part = 'test'")

cte("k_counts", ("clf_parts",), """
SELECT seed, key, target, count(*) AS cnt FROM clf_parts WHERE part = 'train' GROUP BY 1, 2, 3""")
cte("g_counts", ("clf_parts",), """
SELECT seed, key, grp, target, count(*) AS cnt FROM clf_parts WHERE part = 'train' GROUP BY 1, 2, 3, 4""")
cte("k_major", ("k_counts",), """
SELECT seed, key, target AS majority FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, key ORDER BY cnt DESC, target) AS r FROM k_counts)
WHERE r = 1""")
cte("g_major", ("g_counts",), """
SELECT seed, key, grp, target AS g_major FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, key, grp ORDER BY cnt DESC, target) AS r FROM g_counts)
WHERE r = 1""")
cte("k_classes", ("k_counts",), """
SELECT seed, key, list_sort(list(target)) AS classes, count(*) AS k FROM k_counts GROUP BY 1, 2""")

cte("predictions", ("truth", "k_major", "g_major", "k_classes", "clf_parts"), f"""
SELECT t.seed, t.key, 'DUMMY' AS model, t.row_id, m.majority AS pred
FROM truth t JOIN k_major m USING (seed, key)
UNION ALL
SELECT p.seed, p.key, 'GROUP', p.row_id, coalesce(g.g_major, m.majority)
FROM clf_parts p JOIN k_major m USING (seed, key)
LEFT JOIN g_major g ON p.seed = g.seed AND p.key = g.key AND p.grp = g.grp
WHERE p.part = 'test'
UNION ALL
SELECT t.seed, t.key, 'HASH', t.row_id,
       c.classes[CAST({HN("'HASH:' || CAST(t.seed AS VARCHAR) || ':' || CAST(t.row_id AS VARCHAR)")} % c.k AS INTEGER) + 1]
FROM truth t JOIN k_classes c USING (seed, key)""")

# long probability table: (seed, key, model, row_id, cls, score) over all train classes
cte("proba_long", ("clf_parts", "k_counts", "g_counts", "predictions"), """
SELECT p.seed, p.key, 'DUMMY' AS model, p.row_id, k.target AS cls,
       k.cnt / sum(k.cnt) OVER (PARTITION BY p.seed, p.key, p.row_id) AS score
FROM clf_parts p JOIN k_counts k ON p.seed = k.seed AND p.key = k.key
WHERE p.part = 'test'
UNION ALL
SELECT p.seed, p.key, 'GROUP', p.row_id, k.target,
       CASE WHEN gt.tot IS NULL THEN k.cnt / sum(k.cnt) OVER (PARTITION BY p.seed, p.key, p.row_id)
            ELSE coalesce(g.cnt, 0) / gt.tot END
FROM clf_parts p JOIN k_counts k ON p.seed = k.seed AND p.key = k.key
LEFT JOIN (SELECT seed, key, grp, sum(cnt) AS tot FROM g_counts GROUP BY 1, 2, 3) gt
  ON p.seed = gt.seed AND p.key = gt.key AND p.grp = gt.grp
LEFT JOIN g_counts g ON p.seed = g.seed AND p.key = g.key AND p.grp = g.grp AND k.target = g.target
WHERE p.part = 'test'
UNION ALL
SELECT pr.seed, pr.key, 'HASH', pr.row_id, k.target, CASE WHEN k.target = pr.pred THEN 1.0 ELSE 0.0 END
FROM predictions pr JOIN k_counts k ON pr.seed = k.seed AND pr.key = k.key
WHERE pr.model = 'HASH'""")

cte("cc", ("truth", "predictions"), """
SELECT p.seed, p.key, p.model, t.target AS y, p.pred AS p, count(*) AS n
FROM predictions p JOIN truth t ON p.seed = t.seed AND p.key = t.key AND p.row_id = t.row_id
GROUP BY 1, 2, 3, 4, 5""")

cte("per_class", ("cc",), """
SELECT seed, key, model, cls, CAST(sum(t) AS BIGINT) AS support, CAST(sum(pp) AS BIGINT) AS predicted,
       CAST(sum(tp) AS BIGINT) AS tp
FROM (SELECT seed, key, model, y AS cls, n AS t, 0 AS pp, CASE WHEN y = p THEN n ELSE 0 END AS tp FROM cc
      UNION ALL
      SELECT seed, key, model, p, 0, n, 0 FROM cc)
GROUP BY 1, 2, 3, 4""")

cte("report_rows", ("per_class",), """
SELECT seed, key, model, cls, coalesce(CASE WHEN predicted <> 0 THEN tp / predicted END, 0.0) AS precision,
       coalesce(CASE WHEN support <> 0 THEN tp / support END, 0.0) AS recall,
       coalesce(2 * tp / (support + predicted), 0.0) AS f1, support FROM per_class""")

cte("reg_tasks", (), f"""
SELECT 'lineitem_0' AS key,
       {HN("CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)", 15)} AS row_id,
       l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_returnflag AS grp
FROM lineitem""")

cte("reg_splits", ("reg_tasks", "seeds"), f"""
SELECT key, seed, row_id, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part,
       y, x1, x2, grp
FROM (SELECT t.*, s.seed,
             row_number() OVER (PARTITION BY t.key, s.seed ORDER BY {H('s.seed', 't.row_id')}, t.row_id) AS rn,
             CAST(ceil(count(*) OVER (PARTITION BY t.key, s.seed) * 0.2) AS BIGINT) AS quota
      FROM reg_tasks t CROSS JOIN seeds s)""")

cte("reg_preds", ("reg_splits",), """
SELECT t.seed, t.key, m.model, t.row_id, t.y,
       CASE m.model WHEN 'MEAN' THEN k.mu WHEN 'RATE' THEN t.x1 * k.rate
            ELSE coalesce(g.g_mu, k.mu) END AS pred
FROM (SELECT * FROM reg_splits WHERE part = 'test') t
JOIN (SELECT seed, key, avg(y) AS mu, sum(y) / sum(x1) AS rate FROM reg_splits
      WHERE part = 'train' GROUP BY 1, 2) k ON t.seed = k.seed AND t.key = k.key
LEFT JOIN (SELECT seed, key, grp, avg(y) AS g_mu FROM reg_splits WHERE part = 'train'
           GROUP BY 1, 2, 3) g ON t.seed = g.seed AND t.key = g.key AND t.grp = g.grp
CROSS JOIN (VALUES ('MEAN'), ('RATE'), ('GROUPMEAN')) m(model)""")


# ----------------------------------------------------------------------------- oracles
ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, *deps: str) -> None:
    ORACLES[name] = with_ctes(body, *deps)


def minmax_sql(src: str, metric: str, higher: bool = True) -> str:
    e = "value" if higher else "-value"
    return f"""
SELECT model, key, value, CASE WHEN hi > lo THEN (e - lo) / (hi - lo) ELSE 1.0 END AS norm_score,
       CAST(rank() OVER (PARTITION BY key ORDER BY e DESC) AS DOUBLE) AS rank
FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n, min(e) OVER (PARTITION BY key) AS lo,
             max(e) OVER (PARTITION BY key) AS hi
      FROM (SELECT model, key, value, {e} AS e FROM (
              SELECT model, key, avg({metric}) AS value FROM {src} GROUP BY 1, 2)
            WHERE value IS NOT NULL))
WHERE n >= 2"""


def board_sql(scores: str) -> str:
    return f"""
SELECT model AS model_id, round(avg(norm_score), 4) AS score, round(avg(rank), 1) AS avg_rank,
       round((1 - avg(norm_score)) * 100, 1) AS improvability, count(DISTINCT key) AS n_targets
FROM ({scores}) GROUP BY model"""
