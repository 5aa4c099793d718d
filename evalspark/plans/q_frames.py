"""Queries: framing and predicates (P*), feature preparation and labels (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import values

from .. import catalog as C
from ..operators import features as T
from ..operators import frames as P
from .oracles import cte, with_ctes
from ..session import scratch_dir
from .registry import query

ORDERS_NULLED = """SELECT o_orderkey AS row_id,
  CASE WHEN substr(md5('lbl:target:' || CAST(o_orderkey AS VARCHAR)), 1, 1) < '1' THEN NULL ELSE o_orderpriority END AS target
FROM orders"""

cte("registry", ("clf_tasks",), """
SELECT dataset AS dataset_id, 'target' AS target,
       CASE WHEN n_classes = 2 THEN 'binary' ELSE 'multiclass' END AS problem_type,
       CASE WHEN dataset = 'events' THEN 'accuracy' END AS eval_metric,
       dataset <> 'customer' AS enabled,
       CASE WHEN dataset = 'orders' THEN 16 END AS max_features
FROM (SELECT dataset, count(DISTINCT target) AS n_classes FROM clf_tasks GROUP BY 1)
UNION ALL
SELECT 'lineitem', 'target', 'regression', NULL, true, NULL FROM (SELECT count(*) FROM lineitem)""")


def _registry(spark, d):
    t = C.clf_tasks(spark, d)
    r = t.groupBy("dataset").agg(F.countDistinct("target").alias("n_classes")).select(
        F.col("dataset").alias("dataset_id"), F.lit("target").alias("target"),
        F.when(F.col("n_classes") == 2, "binary").otherwise("multiclass").alias("problem_type"),
        F.when(F.col("dataset") == "events", F.lit("accuracy")).alias("eval_metric"),
        (F.col("dataset") != "customer").alias("enabled"),
        F.when(F.col("dataset") == "orders", F.lit(16)).alias("max_features"))
    li = C.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("lineitem").alias("dataset_id"), F.lit("target").alias("target"),
        F.lit("regression").alias("problem_type"), F.lit(None).cast("string").alias("eval_metric"),
        F.lit(True).alias("enabled"), F.lit(None).cast("int").alias("max_features"))
    return r.unionByName(li)


def _orders_nulled(spark, d):
    o = C.table(spark, d, "orders")
    h = F.substring(F.md5(F.concat(F.lit("lbl:target:"), F.col("o_orderkey").cast("string"))), 1, 1)
    return o.select(F.col("o_orderkey").alias("row_id"),
                    F.when(h < "1", F.lit(None)).otherwise(F.col("o_orderpriority")).alias("target"))


@query("drop_unlabeled", f"SELECT row_id, target FROM ({ORDERS_NULLED}) WHERE target IS NOT NULL")
def q_drop_unlabeled(spark, d):
    return P.drop_unlabeled(_orders_nulled(spark, d))


@query("frame_target", """SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment AS target FROM customer""")
def q_frame_target(spark, d):
    return P.frame_target(C.table(spark, d, "customer"), "c_mktsegment",
                          ["c_custkey", "c_acctbal", "c_nationkey"])


@query("multi_target_unpivot", """
SELECT doc_id, 'documents' AS dataset, 0 AS target_idx, 'documents_0' AS key, CAST(quality AS VARCHAR) AS target FROM labels
UNION ALL
SELECT doc_id, 'documents', 1, 'documents_1', CAST(toxic AS VARCHAR) FROM labels""")
def q_unpivot(spark, d):
    return P.multi_target_unpivot(C.table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"], "documents")


@query("key_codec", """
SELECT DISTINCT source || '/' || lang AS name, regexp_replace(source || '/' || lang, '[/\\\\]', '_', 'g') || '_' || CAST(length(lang) AS VARCHAR) AS key,
       regexp_replace(source || '/' || lang, '[/\\\\]', '_', 'g') AS dataset, CAST(length(lang) AS INTEGER) AS target_idx
FROM documents""")
def q_key_codec(spark, d):
    doc = C.table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("name"),
                                                F.length("lang").alias("n"))
    k = doc.select("name", P.key_of(F.col("name"), F.col("n")).alias("key")).distinct()
    ds, idx = P.split_key(F.col("key"))
    return k.select("name", "key", ds.alias("dataset"), idx.alias("target_idx"))


LONG_SQL = """
SELECT 'lineitem_0' AS key, l_orderkey * 10 + l_linenumber AS row_id, l_orderkey % 5 AS fold, feature,
       CASE WHEN substr(md5('na:' || feature || ':' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 1) < rate THEN NULL
            ELSE value END AS value
FROM (SELECT l_orderkey, l_linenumber, 'q' AS feature, l_quantity AS value, '1' AS rate FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'dsc', l_discount, '8' FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'tx', l_tax, '9' FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'ghost', l_tax, 'g' FROM lineitem)"""


def _long(spark, d):
    li = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    rid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    parts = []
    for f, c, rate in (("q", "l_quantity", "1"), ("dsc", "l_discount", "8"), ("tx", "l_tax", "9"),
                       ("ghost", "l_tax", "g")):
        h = F.substring(F.md5(F.concat(F.lit(f"na:{f}:"), rid.cast("string"))), 1, 1)
        parts.append(li.select(F.lit("lineitem_0").alias("key"), rid.alias("row_id"),
                               (F.col("l_orderkey") % 5).alias("fold"), F.lit(f).alias("feature"),
                               F.when(h < rate, F.lit(None).cast("double")).otherwise(F.col(c)).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("drop_sparse_features", f"""
SELECT key, feature, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS missing_frac
FROM ({LONG_SQL}) WHERE fold <> 0 GROUP BY 1, 2
HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5""")
def q_sparse(spark, d):
    train = _long(spark, d).filter("fold <> 0")
    f = P.sparse_feature_fractions(train)
    return f.filter("missing_frac <= 0.5").withColumn("missing_frac", F.round("missing_frac", 9))


@query("sparse_features_test", f"""
WITH l AS ({LONG_SQL}),
k AS (SELECT key, feature FROM l WHERE fold <> 0 GROUP BY 1, 2 HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5)
SELECT l.key, l.row_id, l.feature, round(l.value, 9) AS value FROM l JOIN k ON l.key = k.key AND l.feature = k.feature WHERE fold = 0""")
def q_sparse_test(spark, d):
    """Features kept on the training folds, stored, and applied to the rows of the other."""
    path = scratch_dir(spark, "kept-features")
    P.drop_sparse_features(_long(spark, d).filter("fold <> 0")).write.parquet(path)
    out = P.apply_kept_features(_long(spark, d).filter("fold = 0"), spark.read.parquet(path))
    return out.select("key", "row_id", "feature", F.round("value", 9).alias("value"))


@query("all_null_features", f"SELECT key, feature FROM ({LONG_SQL}) GROUP BY 1, 2 HAVING count(value) = 0")
def q_all_null(spark, d):
    return P.all_null_features(_long(spark, d))


@query("missing_fraction", f"""
SELECT key, round(count(*) FILTER (WHERE value IS NULL) / count(*), 9) AS missing_frac FROM ({LONG_SQL}) GROUP BY 1""")
def q_missing_frac(spark, d):
    return T.missing_fraction(_long(spark, d)).withColumn("missing_frac", F.round("missing_frac", 9))


@query("log1p_matrix", f"SELECT key, row_id, feature, round(ln(1 + value), 9) AS value FROM ({LONG_SQL}) WHERE value IS NOT NULL")
def q_log1p(spark, d):
    lg = _long(spark, d).filter("value IS NOT NULL").drop("fold")
    return T.log1p_matrix(lg).withColumn("value", F.round("value", 9))


@query("feature_counts", f"SELECT key, count(DISTINCT feature) AS n_features FROM ({LONG_SQL}) WHERE value IS NOT NULL GROUP BY 1")
def q_feature_counts(spark, d):
    return P.feature_counts(_long(spark, d).filter("value IS NOT NULL"))


FEATS_SQL = """SELECT p_brand AS key, p_type AS feature,
  dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS feature_idx FROM (SELECT DISTINCT p_brand, p_type FROM part)"""


@query("feature_cap", f"""
SELECT key, feature, feature_idx, row_number() OVER (PARTITION BY key ORDER BY feature_idx) AS kept_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('0:' || CAST(feature_idx AS VARCHAR)), feature_idx) AS r
  FROM ({FEATS_SQL})) WHERE r <= 8""")
def q_feature_cap(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("feature")).distinct()
    from pyspark.sql import Window
    p = p.withColumn("feature_idx", F.dense_rank().over(Window.partitionBy("key").orderBy("feature")).cast("long"))
    out = P.feature_cap(p, 8, seed=0)
    return out.withColumn("kept_pos", F.col("kept_pos").cast("long"))


@query("effective_cap", with_ctes("SELECT dataset_id, coalesce(max_features, 32) AS effective_cap FROM registry", "registry"))
def q_eff_cap(spark, d):
    return P.effective_cap(_registry(spark, d), 32).select("dataset_id", "effective_cap")


@query("active_registry", with_ctes("SELECT dataset_id, problem_type FROM registry WHERE enabled AND problem_type <> 'regression'",
                                    "registry"))
def q_active(spark, d):
    r = P.active_registry(_registry(spark, d))
    return r.filter("problem_type <> 'regression'").select("dataset_id", "problem_type")


@query("resolved_metric", with_ctes("""
SELECT dataset_id, coalesce(eval_metric, CASE problem_type WHEN 'regression' THEN 'rmse' ELSE 'f1_macro' END) AS metric
FROM registry""", "registry"))
def q_resolved(spark, d):
    return P.resolved_metric(_registry(spark, d)).select("dataset_id", "metric")


@query("binarize_label", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1' ELSE '0' END AS target
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW')""")
def q_binarize(spark, d):
    o = C.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return P.binarize_label(o, "o_orderpriority", ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"]) \
        .select("o_orderkey", "target")


@query("infer_problem_type", with_ctes("""
SELECT key, count(DISTINCT target) AS n_classes,
       CASE WHEN count(DISTINCT target) <= 2 THEN 'binary' ELSE 'multiclass' END AS problem_type
FROM clf_tasks GROUP BY 1""", "clf_tasks"))
def q_infer(spark, d):
    return P.infer_problem_type(C.clf_tasks(spark, d))


META_SQL = """
SELECT c_custkey AS row_id, field, value FROM (
  SELECT c_custkey, 'segment' AS field, c_mktsegment AS value FROM customer
  UNION ALL SELECT c_custkey, 'band', CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END FROM customer
  UNION ALL SELECT c_custkey, 'customer_name', c_name FROM customer
  UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)"""


@query("auto_pick_label", f"""
WITH v AS (SELECT row_id, field, lower(trim(value)) AS value FROM ({META_SQL}) WHERE value <> ''),
big AS (SELECT field, value FROM v WHERE NOT regexp_matches(lower(field), '(date|latitude|longitude)')
        GROUP BY 1, 2 HAVING count(*) >= 30),
ok AS (SELECT field FROM big GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10)
SELECT v.row_id, v.field, v.value AS target FROM v JOIN big ON v.field = big.field AND v.value = big.value
WHERE v.field = (SELECT min(field) FROM ok)""")
def q_auto_pick(spark, d):
    c = C.table(spark, d, "customer")
    parts = [c.select(F.col("c_custkey").alias("row_id"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")),
             c.select("c_custkey", F.lit("band"), F.when(F.col("c_acctbal") < 0, "neg").when(F.col("c_acctbal") < 5000, "mid")
                      .otherwise("high")),
             c.select("c_custkey", F.lit("customer_name"), "c_name"),
             c.select("c_custkey", F.lit("nation"), F.col("c_nationkey").cast("string"))]
    m = parts[0]
    for p in parts[1:]:
        m = m.union(p)
    return P.auto_pick_label(m)


UNITS_SQL = """SELECT CAST(s.seed AS INTEGER) AS seed, k.key, m.model FROM (SELECT DISTINCT key FROM clf_tasks) k
CROSS JOIN (VALUES (0), (1), (2)) s(seed) CROSS JOIN (VALUES ('DUMMY'), ('GROUP'), ('HASH')) m(model)"""


def _units(spark, d):
    keys = C.clf_tasks(spark, d).select("key").distinct()
    return (keys.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (0, 1, 2)])))
            .withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("DUMMY", "GROUP", "HASH")]))))


@query("exclude_units", with_ctes(f"""
SELECT u.seed, u.key, u.model,
       u.key IN ('customer_0') OR regexp_extract(u.key, '^(.*)_(\\d+)$', 1) IN ('documents')
       OR u.key IN (SELECT DISTINCT key FROM clf_tasks WHERE target = 'click') AS excluded
FROM ({UNITS_SQL}) u""", "clf_tasks"))
def q_exclude(spark, d):
    targets = C.clf_tasks(spark, d).filter("target = 'click'").select("key")
    return P.exclude_units(_units(spark, d), ["customer_0"], ["documents"], targets)


@query("exclude_route", with_ctes(f"""
SELECT CASE WHEN u.key IN ('customer_0') OR regexp_extract(u.key, '^(.*)_(\\d+)$', 1) IN ('documents') THEN 'excluded'
            ELSE 'metrics' END AS route, count(*) AS n_units
FROM ({UNITS_SQL}) u GROUP BY 1""", "clf_tasks"))
def q_exclude_route(spark, d):
    ex = P.exclude_units(_units(spark, d), ["customer_0"], ["documents"], values(spark, [], "key string"))
    return ex.groupBy(F.when(F.col("excluded"), "excluded").otherwise("metrics").alias("route")).agg(
        F.count(F.lit(1)).alias("n_units"))


@query("drop_design_skips", with_ctes("""
SELECT DISTINCT seed, key, model FROM event_units u
WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'other_reason' ELSE reason END AS why FROM status) s
                  WHERE s.status = 'skip' AND s.why IN ('model_limit', 'context_window', 'empty_split',
                        'empty_split_after_filtering', 'constant_target', 'classification_only')
                  AND s.seed = u.seed AND s.key = u.key AND s.model = u.model)""",
                                      "event_units", "status"))
def q_design_skips(spark, d):
    units = C._event_units(spark, d).select("seed", "key", "model").distinct()
    st = C.status(spark, d).withColumn("reason", F.when(F.col("k") % 4 == 0, "other_reason").otherwise(F.col("reason")))
    return P.drop_design_skips(units, st)


@query("reject_continuous", with_ctes("""
SELECT seed, key, model, bool_or(v <> floor(v)) AS continuous
FROM (SELECT seed, key, model, TRY_CAST(CAST(CASE WHEN k > 50 THEN value ELSE k END AS VARCHAR) AS DOUBLE) AS v FROM event_units)
GROUP BY 1, 2, 3""", "event_units"))
def q_reject(spark, d):
    u = C._event_units(spark, d)
    p = u.select("seed", "key", "model", F.when(F.col("k") > 50, F.col("value")).otherwise(F.col("k").cast("double"))
                 .cast("string").alias("pred"))
    return P.reject_continuous(p)


LIMITS_SQL = "SELECT n_name AS model, 20 + n_nationkey AS max_features, 100 * (n_regionkey + 1) AS max_samples FROM nation"


@query("limit_skip", with_ctes(f"""
WITH u AS (SELECT g.seed, g.model, g.key, g.n_rows AS n_train, f.n_features FROM metrics_grid g
           JOIN (SELECT p_brand AS key, count(DISTINCT p_type) AS n_features FROM part GROUP BY 1) f ON g.key = f.key)
SELECT u.seed, u.model, u.key, u.n_train, u.n_features,
       coalesce(u.n_features > l.max_features AND u.n_train > l.max_samples, false) AS skip
FROM u LEFT JOIN ({LIMITS_SQL}) l ON u.model = l.model""", "metrics_grid"))
def q_limit_skip(spark, d):
    g = C.metrics_grid(spark, d)
    f = C.table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.countDistinct("p_type").alias("n_features"))
    u = g.join(f, "key").select("seed", "model", "key", F.col("n_rows").alias("n_train"), "n_features")
    n = C.table(spark, d, "nation")
    limits = n.select(F.col("n_name").alias("model"), (F.lit(20) + F.col("n_nationkey")).alias("max_features"),
                      (F.lit(100) * (F.col("n_regionkey") + 1)).alias("max_samples"))
    return P.limit_skip(u, limits).select("seed", "model", "key", "n_train", "n_features", "skip")


@query("degenerate_split_skip", with_ctes("""
SELECT seed, key, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'test') AS n_test,
       count(DISTINCT CASE WHEN part = 'train' THEN target END) AS train_classes,
       CASE WHEN count(*) FILTER (WHERE part = 'train') = 0 OR count(*) FILTER (WHERE part = 'test') = 0 THEN 'empty_split'
            WHEN count(DISTINCT CASE WHEN part = 'train' THEN target END) < 2 THEN 'constant_target' END AS skip_reason
FROM (SELECT seed, key, part, CASE WHEN key LIKE 'documents%' AND seed = 2 THEN 'x' ELSE target END AS target FROM clf_parts)
GROUP BY 1, 2""", "clf_parts"))
def q_degenerate(spark, d):
    p = C.clf_parts_cached(spark, d).withColumn(
        "target", F.when(F.col("key").startswith("documents") & (F.col("seed") == 2), F.lit("x")).otherwise(F.col("target")))
    return P.degenerate_split_skip(p)


ERRORS = ["This model's maximum context length is 8192 tokens", "ContextWindowExceededError: too large", "504 Gateway Timeout",
          "Error code: 429 - slow down", "HTTP 408", "insufficient quota", "Too Many Requests", "Bad Gateway",
          "service temporarily unavailable", "Connection reset by peer", "Connection refused", "connection error", "rate limit",
          "unparseable_responses: 9 of 10", "cell_timeout: 3600 s", "train set will be empty", "ValueError: 500 bad rows",
          "Request timed out", "HTTP 409 conflict", "Service Unavailable", "status: 502"]
ERRORS_SQL = "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in ERRORS) + "]"


@query("error_taxonomy", with_ctes(rf"""
WITH e AS (SELECT seed, key, model, k, coalesce(error, ({ERRORS_SQL})[k % {len(ERRORS)} + 1]) AS error FROM status),
r AS (SELECT *, lower(error) AS t FROM e)
SELECT seed, key, model, error,
  CASE WHEN t LIKE '%train set will be empty%' OR (t LIKE '%context%' AND (t LIKE '%length%' OR t LIKE '%window%')) THEN 'skip'
       WHEN t LIKE 'unparseable%' OR t LIKE 'cell_timeout%' THEN 'fail'
       WHEN regexp_matches(t, 'rate limit|too many requests|quota|service unavailable|bad gateway|gateway timeout|connection error|connection reset|connection refused|temporarily unavailable') OR regexp_matches(t, '(^|http |code:? ?|status:? ?)(408|409|429|500|502|503|504)\b') THEN 'retry' ELSE 'fail' END AS status,
  CASE WHEN t LIKE '%train set will be empty%' THEN 'empty_split_after_filtering'
       WHEN t LIKE '%context%' AND (t LIKE '%length%' OR t LIKE '%window%') THEN 'context_window'
       WHEN t LIKE 'unparseable%' THEN 'unparseable_responses' WHEN t LIKE 'cell_timeout%' THEN 'cell_timeout'
       WHEN regexp_matches(t, 'rate limit|too many requests|quota|service unavailable|bad gateway|gateway timeout|connection error|connection reset|connection refused|temporarily unavailable') OR regexp_matches(t, '(^|http |code:? ?|status:? ?)(408|409|429|500|502|503|504)\b') THEN 'infrastructure_error'
       ELSE 'fit_error' END AS reason
FROM r""", "status"))
def q_error_tax(spark, d):
    texts = F.array(*[F.lit(e) for e in ERRORS])
    s = C.status(spark, d).select("seed", "key", "model", F.coalesce(
        "error", texts[(F.col("k") % len(ERRORS)).cast("int")]).alias("error"))
    return P.error_taxonomy(s)


@query("reason_check", with_ctes("""
SELECT seed, key, model, reason FROM (
  SELECT seed, key, model, status, CASE WHEN k % 3 = 0 THEN 'bogus' ELSE reason END AS reason FROM status)
WHERE status = 'skip' AND reason NOT IN ('model_limit', 'context_window', 'empty_split',
  'empty_split_after_filtering', 'constant_target', 'classification_only')""", "status"))
def q_reason_check(spark, d):
    s = C.status(spark, d).withColumn("reason", F.when(F.col("k") % 3 == 0, "bogus").otherwise(F.col("reason")))
    return P.reason_check(s).select("seed", "key", "model", "reason")


FAMILY_RULES = [("united", "Anglo"), ("ind", "South Asia"), ("ira", "Middle East"), ("j", "J-countries")]


@query("model_family", with_ctes("""
WITH m AS (SELECT DISTINCT model FROM metrics_grid),
p AS (SELECT model, string_split_regex(lower(model), '[-_/:. ]') AS parts FROM m)
SELECT model, coalesce(CASE WHEN model = 'CHINA' THEN 'Asia (exact)' END,
       CASE WHEN len(list_filter(parts, lambda x: starts_with(x, 'united'))) > 0 THEN 'Anglo'
            WHEN len(list_filter(parts, lambda x: starts_with(x, 'ind'))) > 0 THEN 'South Asia'
            WHEN len(list_filter(parts, lambda x: starts_with(x, 'ira'))) > 0 THEN 'Middle East'
            WHEN len(list_filter(parts, lambda x: starts_with(x, 'j'))) > 0 THEN 'J-countries'
            ELSE 'Other' END) AS family
FROM p""", "metrics_grid"))
def q_family(spark, d):
    m = C.metrics_grid(spark, d).select("model").distinct()
    exact = values(spark, [("CHINA", "Asia (exact)")], "model string, family string")
    return P.model_family(m, exact, FAMILY_RULES)


@query("display_name", with_ctes("""
SELECT m.model, coalesce(d.display, m.model) AS display_name FROM (SELECT DISTINCT model FROM metrics_grid) m
LEFT JOIN (SELECT n.n_name AS model, n.n_name || ' (' || r.r_name || ')' AS display FROM nation n
           JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey < 3) d ON m.model = d.model""", "metrics_grid"))
def q_display(spark, d):
    m = C.metrics_grid(spark, d).select("model").distinct()
    n, r = C.table(spark, d, "nation"), C.table(spark, d, "region")
    disp = n.join(r, n.n_regionkey == r.r_regionkey).filter(F.col("r_regionkey") < 3).select(
        F.col("n_name").alias("model"), F.concat("n_name", F.lit(" ("), "r_name", F.lit(")")).alias("display"))
    return m.join(disp, "model", "left").select("model", F.coalesce("display", "model").alias("display_name"))


PROFILE_SQL = """
SELECT key, task, count(*) AS n_samples, count(DISTINCT target) AS n_classes,
       round(count(*) FILTER (WHERE substr(md5('na:' || key || ':' || CAST(row_id AS VARCHAR)), 1, 2) < '08') / count(*), 9) AS missing_frac
FROM clf_tasks GROUP BY 1, 2"""


def _profile(spark, d):
    t = C.clf_tasks(spark, d)
    h = F.substring(F.md5(F.concat(F.lit("na:"), F.col("key"), F.lit(":"), F.col("row_id").cast("string"))), 1, 2)
    return t.groupBy("key", "task").agg(F.count(F.lit(1)).alias("n_samples"),
                                        F.countDistinct("target").alias("n_classes"),
                                        F.round(F.count_if(h < "08") / F.count(F.lit(1)), 9).alias("missing_frac"))


@query("profile_buckets", with_ctes(f"""
SELECT key, n_samples, n_classes, missing_frac,
  CASE WHEN n_samples <= 200 THEN '≤ 200' WHEN n_samples <= 1000 THEN '201-1000' ELSE '> 1000' END AS size_bucket,
  CASE WHEN task = 'regression' THEN 'Regression' WHEN n_classes <= 2 THEN 'Binary' WHEN n_classes <= 10 THEN 'Multiclass (≤ 10)' ELSE 'Many (> 10)' END AS class_bucket,
  CASE WHEN missing_frac <= 0 THEN 'None' WHEN missing_frac <= 0.05 THEN 'Sparse (≤ 5%)' WHEN missing_frac > 0.05 THEN 'Heavy (> 5%)' END AS nan_bucket
FROM ({PROFILE_SQL})""", "clf_tasks"))
def q_profile(spark, d):
    return P.profile_buckets(_profile(spark, d)).drop("task")


@query("suite_tag", """
SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'synthetic_' ELSE '' END || source AS dataset,
       CASE WHEN doc_id % 3 = 0 THEN 'synthetic' ELSE 'real' END AS suite FROM documents""")
def q_suite(spark, d):
    doc = C.table(spark, d, "documents").select(
        F.concat(F.when(F.col("doc_id") % 3 == 0, "synthetic_").otherwise(""), F.col("source")).alias("dataset"))
    return P.suite_tag(doc.distinct())


# ------------------------------------------------------------------ features
@query("nan_policy_resolve", with_ctes("""
SELECT m.model, coalesce(p.nan_policy, 'median') AS nan_policy FROM (SELECT DISTINCT model FROM metrics_grid) m
LEFT JOIN (SELECT n_name AS model, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'mean' ELSE 'native' END AS nan_policy
           FROM nation WHERE n_nationkey % 2 = 0) p ON m.model = p.model""", "metrics_grid"))
def q_nan_policy(spark, d):
    m = C.metrics_grid(spark, d).select("model").distinct()
    n = C.table(spark, d, "nation").filter("n_nationkey % 2 = 0")
    pol = n.select(F.col("n_name").alias("model"), F.when(F.col("n_regionkey") == 0, "zero")
                   .when(F.col("n_regionkey") == 1, "mean").otherwise("native").alias("nan_policy"))
    pol = pol.unionByName(values(spark, [("default", "median")], "model string, nan_policy string"))
    return T.nan_policy_resolve(m, pol)


IMPUTE_BASE = with_ctes("""
SELECT seed, key, row_id, part, target,
       CASE WHEN substr(md5('na:x1:' || CAST(row_id AS VARCHAR)), 1, 1) < '3' THEN NULL ELSE x1 END AS x1,
       CASE WHEN substr(md5('na:x2:' || CAST(row_id AS VARCHAR)), 1, 1) < '2' THEN NULL ELSE x2 END AS x2
FROM clf_parts""", "clf_parts")


def _nulled_parts(spark, d):
    p = C.clf_parts_cached(spark, d).select("seed", "key", "row_id", "part", "target", "x1", "x2")
    p = T.inject_nulls(p, ["x1"], "na", rate_hex="3")
    return T.inject_nulls(p, ["x2"], "na", rate_hex="2")


def _impute_sql(fn: str) -> str:
    return f"""
SELECT b.seed, b.key, b.row_id, b.part, round(coalesce(b.x1, s.f1), 6) AS x1, round(coalesce(b.x2, s.f2), 6) AS x2
FROM ({IMPUTE_BASE}) b LEFT JOIN (SELECT seed, key, {fn.format('x1')} AS f1, {fn.format('x2')} AS f2
                                  FROM ({IMPUTE_BASE}) WHERE part = 'train' GROUP BY 1, 2) s
  ON b.seed = s.seed AND b.key = s.key"""


def _impute_q(policy):
    def fn(spark, d):
        out = T.impute(_nulled_parts(spark, d), ["x1", "x2"], policy)
        return out.select("seed", "key", "row_id", "part", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))
    return fn


query("impute_median", _impute_sql("quantile_cont({}, 0.5)"))(_impute_q("median"))
query("impute_mean", _impute_sql("avg({})"))(_impute_q("mean"))
query("impute_zero", f"SELECT seed, key, row_id, part, round(coalesce(x1, 0.0), 6) AS x1, round(coalesce(x2, 0.0), 6) AS x2 FROM ({IMPUTE_BASE})")(
    _impute_q("zero"))


@query("standardize_target", with_ctes("""
SELECT r.seed, r.key, r.row_id, r.part, round(s.mu, 6) AS mu, round(s.sd, 6) AS sd, round((r.y - s.mu) / s.sd, 9) AS y_std
FROM reg_splits r JOIN (SELECT seed, key, avg(y) AS mu,
                               CASE WHEN coalesce(stddev_samp(y), 0) = 0 THEN 1.0 ELSE stddev_samp(y) END AS sd
                        FROM reg_splits WHERE part = 'train' GROUP BY 1, 2) s ON r.seed = s.seed AND r.key = s.key""",
                                       "reg_splits"))
def q_standardize(spark, d):
    from ..operators import splits as S
    t = C.reg_tasks(spark, d)
    parts = S.holdout_plain(t, list(C.SEEDS), C.TEST_SIZE).join(t.select("key", "row_id", "y"), ["key", "row_id"])
    out = T.standardize_target(parts)
    return out.select("seed", "key", "row_id", "part", F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"),
                      F.round("y_std", 9).alias("y_std"))


@query("label_median_split", """
SELECT l_returnflag AS key, l_orderkey, l_linenumber, l_partkey,
       CAST(l_extendedprice > quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY l_returnflag) AS INTEGER) AS label
FROM lineitem""")
def q_median_split(spark, d):
    li = C.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), "l_orderkey", "l_linenumber",
                                              "l_partkey", "l_extendedprice")
    return T.label_median_split(li, "l_extendedprice").drop("l_extendedprice")


@query("label_quantile", """
SELECT o_orderstatus AS key, o_orderkey,
       CAST(o_totalprice > quantile_cont(o_totalprice, 0.9) OVER (PARTITION BY o_orderstatus) AS INTEGER) AS label
FROM orders""")
def q_quantile(spark, d):
    o = C.table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), "o_orderkey", "o_totalprice")
    return T.label_quantile(o, "o_totalprice", 0.9).drop("o_totalprice")


@query("label_flip", f"""
SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('5:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < {int(0.1 * 16 ** 8)}
                    THEN 1 - quality ELSE quality END AS quality
FROM labels""")
def q_flip(spark, d):
    lab = C.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return T.label_flip(lab, "quality", 0.1, seed=5).withColumnRenamed("row_id", "doc_id")


@query("label_rules", """
SELECT c_custkey, (CAST(c_acctbal - 4500 > 0 AS INTEGER) + CAST(c_nationkey - 12 > 0 AS INTEGER)) % 2 AS xor_label,
       (CAST(c_acctbal - 4500 > 0 AS INTEGER) + CAST(c_nationkey - 12 > 0 AS INTEGER) + CAST(c_custkey % 7 - 3 > 0 AS INTEGER)) % 2 AS parity_label,
       CAST(((floor(c_acctbal / 2000) + floor(c_nationkey / 5)) % 2 + 2) % 2 AS INTEGER) AS checker_label,
       CAST(sqrt((c_acctbal / 1000) * (c_acctbal / 1000) + c_nationkey * c_nationkey) < 10 AS INTEGER) AS ring_label
FROM customer""")
def q_rules(spark, d):
    c = C.table(spark, d, "customer")
    a, b = F.col("c_acctbal") - 4500, F.col("c_nationkey") - 12
    par = T.rule_parity([a, b, F.col("c_custkey") % 7 - 3])
    return c.select("c_custkey", T.rule_xor(a, b).alias("xor_label"), par.alias("parity_label"),
                    T.rule_checker(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), 1.0).alias("checker_tmp"),
                    T.rule_checker(F.col("c_acctbal") / 2000, F.col("c_nationkey") / 5, 1.0).alias("checker_label"),
                    T.rule_ring(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), 10.0).alias("ring_label")
                    ).drop("checker_tmp")


@query("score_linear", """
SELECT vec_id, round(list_reduce(list_transform(range(1, 5), lambda i: CAST(embedding[i] AS DOUBLE) * [0.5, -1.0, 2.0, 0.25][i]), lambda a, b: a + b), 6) AS score
FROM embeddings""")
def q_linear(spark, d):
    e = C.table(spark, d, "embeddings")
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return e.select("vec_id", F.round(T.score_linear(v, [0.5, -1.0, 2.0, 0.25]), 6).alias("score"))


@query("score_additive", """
SELECT c_custkey, round(sin(c_acctbal / 1000) + abs(c_nationkey - 12) + pow(tanh(c_custkey / 500), 2), 9) AS score FROM customer""")
def q_additive(spark, d):
    c = C.table(spark, d, "customer")
    return c.select("c_custkey", F.round(T.score_additive(F.col("c_acctbal") / 1000, F.col("c_nationkey") - 12,
                                                          F.col("c_custkey") / 500), 9).alias("score"))
