"""Queries: class space, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import splits as S
from .oracles import H, with_ctes
from .registry import query

# events' target classes are balanced; a rarer class space comes from the customer nation
# (25 classes of unequal size) — the rare-class and top-k operators act on that.
NATION_TASK = """SELECT 'customer_nation' AS key, c_custkey AS row_id,
       CAST(c_nationkey % 7 AS VARCHAR) || CASE WHEN c_acctbal > 9000 THEN 'x' ELSE '' END AS target
FROM customer"""


def _nation_task(spark, d):
    c = C.table(spark, d, "customer")
    return c.select(F.lit("customer_nation").alias("key"), F.col("c_custkey").alias("row_id"),
                    F.concat((F.col("c_nationkey") % 7).cast("string"),
                             F.when(F.col("c_acctbal") > 9000, "x").otherwise("")).alias("target"))


@query("rare_class_filter", with_ctes(f"""
WITH t AS ({NATION_TASK}),
c AS (SELECT key, target, count(*) AS cnt FROM t GROUP BY 1, 2 HAVING count(*) >= 40),
k AS (SELECT key FROM c GROUP BY key HAVING count(*) >= 2)
SELECT key, target, count(*) AS n FROM t WHERE (key, target) IN (SELECT key, target FROM c WHERE key IN (SELECT key FROM k))
GROUP BY 1, 2"""))
def q_rare(spark, d):
    return (S.rare_class_filter(_nation_task(spark, d), min_samples=40)
            .groupBy("key", "target").agg(F.count(F.lit(1)).alias("n")))


@query("limit_classes", f"""
WITH t AS ({NATION_TASK}),
c AS (SELECT key, target, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, target) AS r
      FROM t GROUP BY 1, 2)
SELECT key, target, count(*) AS n FROM t WHERE (key, target) IN (SELECT key, target FROM c WHERE r <= 4)
GROUP BY 1, 2""")
def q_limit(spark, d):
    return (S.limit_classes(_nation_task(spark, d), 4)
            .groupBy("key", "target").agg(F.count(F.lit(1)).alias("n")))


@query("refilter_cached", with_ctes("""
SELECT seed, key, target, count(*) AS n FROM clf_parts p
WHERE (seed, key, target) IN (SELECT seed, key, target FROM clf_parts GROUP BY 1, 2, 3 HAVING count(*) >= 2000)
  AND (seed, key) IN (SELECT seed, key FROM (SELECT seed, key, target FROM clf_parts GROUP BY 1, 2, 3
                                             HAVING count(*) >= 2000) GROUP BY 1, 2 HAVING count(*) >= 2)
GROUP BY 1, 2, 3""", "clf_parts"))
def q_refilter(spark, d):
    parts = C.clf_parts_cached(spark, d)
    return (S.refilter_cached(parts, min_samples=2000)
            .groupBy("seed", "key", "target").agg(F.count(F.lit(1)).alias("n")))


@query("split_indices", """
SELECT CAST(i AS INTEGER) AS seed, CAST(i // 5 AS INTEGER) AS repeat, CAST(i % 5 AS INTEGER) AS fold,
       n AS n_keys
FROM range(0, 10) t(i) CROSS JOIN (SELECT count(DISTINCT o_orderpriority) AS n FROM orders)""")
def q_split_indices(spark, d):
    n = C.table(spark, d, "orders").agg(F.countDistinct("o_orderpriority").alias("n_keys"))
    return S.split_indices(spark, 2, 5).withColumn("n_keys", n.scalar())


@query("holdout_stratified", with_ctes("""
SELECT key, seed, part, target, count(*) AS n FROM clf_parts GROUP BY 1, 2, 3, 4""", "clf_parts"))
def q_holdout_strat(spark, d):
    return C.clf_parts(spark, d).groupBy("key", "seed", "part", "target").agg(
        F.count(F.lit(1)).alias("n"))


@query("holdout_members", with_ctes("""
SELECT key, seed, row_id FROM clf_splits WHERE part = 'test'""", "clf_splits"))
def q_holdout_members(spark, d):
    return C.clf_splits(spark, d).filter("part = 'test'").select("key", "seed", "row_id")


@query("holdout_plain", with_ctes("SELECT key, seed, row_id FROM reg_splits WHERE part = 'test'",
                                  "reg_splits"))
def q_holdout_plain(spark, d):
    return S.holdout_plain(C.reg_tasks(spark, d), list(C.SEEDS), C.TEST_SIZE) \
        .filter("part = 'test'").select("key", "seed", "row_id")


KFOLD_SQL = f"""
SELECT key, CAST(r.repeat * 5 + f.fold AS INTEGER) AS seed, row_id,
       CASE WHEN f.fold = row_fold THEN 'test' ELSE 'train' END AS part FROM (
  SELECT t.key, t.row_id, rp.repeat, CAST((row_number() OVER (PARTITION BY t.key, rp.repeat, t.target
             ORDER BY {H('rp.repeat', 't.row_id')}, t.row_id) - 1 + o.offset) % 5 AS INTEGER) AS row_fold
  FROM clf_tasks t CROSS JOIN (VALUES (0), (1)) rp(repeat)
  JOIN (SELECT key, target, coalesce(sum(cnt) OVER (PARTITION BY key ORDER BY target
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset
        FROM (SELECT key, target, count(*) AS cnt FROM clf_tasks GROUP BY 1, 2)) o
    ON t.key = o.key AND t.target = o.target) r
CROSS JOIN (SELECT * FROM range(0, 5) x(fold)) f"""


@query("kfold_stratified", with_ctes(f"""
SELECT k.key, k.seed, k.part, t.target, count(*) AS n FROM ({KFOLD_SQL}) k
JOIN clf_tasks t ON k.key = t.key AND k.row_id = t.row_id GROUP BY 1, 2, 3, 4""", "clf_tasks"))
def q_kfold_strat(spark, d):
    t = C.clf_tasks(spark, d)
    f = S.kfold_stratified(t, 5, repeats=2)
    return (f.join(t.select("key", "row_id", "target"), ["key", "row_id"])
            .groupBy("key", "seed", "part", "target").agg(F.count(F.lit(1)).alias("n")))


@query("kfold_plain", with_ctes(f"""
SELECT key, CAST(seed AS INTEGER) AS seed, row_id FROM (
  SELECT r.key, r.repeat * 5 + f.fold AS seed, r.row_id, f.fold, r.row_fold FROM (
    SELECT t.key, t.row_id, rp.repeat,
           (row_number() OVER (PARTITION BY t.key, rp.repeat ORDER BY {H('rp.repeat', 't.row_id')}, t.row_id) - 1) % 5 AS row_fold
    FROM reg_tasks t CROSS JOIN (VALUES (0)) rp(repeat)) r
  CROSS JOIN (SELECT * FROM range(0, 5) x(fold)) f)
WHERE fold = row_fold""", "reg_tasks"))
def q_kfold_plain(spark, d):
    f = S.kfold_plain(C.reg_tasks(spark, d), 5, repeats=1)
    return f.filter("part = 'test'").select("key", "seed", "row_id")


# group ids: rows of lineitem identical in their non-zero (quantity, discount, tax) values
GROUP_LONG = """
SELECT 'lineitem_0' AS key, row_id, feature, value FROM (
  SELECT row_id, l_quantity AS q, l_discount AS dsc, l_tax AS tx FROM
    (SELECT *, {rid} AS row_id FROM lineitem))
UNPIVOT (value FOR feature IN (q, dsc, tx))"""


def _group_long(spark, d):
    t = C.table(spark, d, "lineitem")
    r = C.reg_tasks(spark, d).select("row_id")
    ident = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                        F.col("l_quantity").cast("bigint"),
                        F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    from ..functions.hashing import hash_number
    del r
    w = t.select(F.lit("lineitem_0").alias("key"), hash_number(ident, 15).alias("row_id"),
                 F.col("l_quantity").alias("q"), F.col("l_discount").alias("dsc"),
                 F.col("l_tax").alias("tx"))
    return w.unpivot(["key", "row_id"], ["q", "dsc", "tx"], "feature", "value")


def _rid_sql():
    from .oracles import HN
    return HN("CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || "
              "CAST(l_suppkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || "
              "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '|' || "
              "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)", 15)


GROUPS_SQL = f"""
WITH lg AS ({GROUP_LONG.format(rid=_rid_sql())}),
sig AS (SELECT key, row_id, string_agg(feature || '=' || CAST(value AS VARCHAR), ',' ORDER BY feature) AS s
        FROM lg WHERE value <> 0 GROUP BY 1, 2),
rows AS (SELECT DISTINCT r.key, r.row_id, coalesce(s.s, '__unique_' || CAST(r.row_id AS VARCHAR)) AS s
         FROM lg r LEFT JOIN sig s ON r.key = s.key AND r.row_id = s.row_id)
SELECT key, row_id, min(row_id) OVER (PARTITION BY key, s) AS group_id,
       count(*) OVER (PARTITION BY key, s) AS group_size FROM rows"""


@query("group_ids", f"SELECT group_size, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM ({GROUPS_SQL}) GROUP BY 1")
def q_group_ids(spark, d):
    g = S.group_ids(_group_long(spark, d))
    return g.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct("group_id").alias("n_groups"))


@query("kfold_grouped", f"""
WITH g AS ({GROUPS_SQL}),
gs AS (SELECT key, group_id, group_size, (row_number() OVER (PARTITION BY key ORDER BY group_size DESC, group_id) - 1) % 10 AS pos
       FROM (SELECT DISTINCT key, group_id, group_size FROM g))
SELECT CAST(CASE WHEN pos < 5 THEN pos ELSE 9 - pos END AS INTEGER) AS seed, count(*) AS n_test,
       count(DISTINCT g.group_id) AS n_groups
FROM g JOIN gs ON g.key = gs.key AND g.group_id = gs.group_id GROUP BY 1""")
def q_kfold_grouped(spark, d):
    g = S.group_ids(_group_long(spark, d))
    f = S.kfold_grouped(g, 5)
    return (f.filter("part = 'test'").join(g, ["key", "row_id"])
            .groupBy("seed").agg(F.count(F.lit(1)).alias("n_test"),
                                 F.countDistinct("group_id").alias("n_groups")))


@query("holdout_grouped", f"""
WITH g AS ({GROUPS_SQL}),
gg AS (SELECT DISTINCT key, group_id FROM g),
q AS (SELECT key, CAST(ceil(count(*) * 0.2) AS BIGINT) AS quota FROM gg GROUP BY key),
r AS (SELECT gg.key, s.seed, gg.group_id, row_number() OVER (PARTITION BY gg.key, s.seed
          ORDER BY {H('s.seed', 'gg.group_id')}, gg.group_id) AS rn FROM gg CROSS JOIN (VALUES (0), (1)) s(seed))
SELECT r.seed, count(*) AS n_test, count(DISTINCT g.group_id) AS n_groups
FROM r JOIN q ON r.key = q.key JOIN g ON g.key = r.key AND g.group_id = r.group_id
WHERE r.rn <= q.quota GROUP BY 1""")
def q_holdout_grouped(spark, d):
    g = S.group_ids(_group_long(spark, d))
    h = S.holdout_grouped(g, [0, 1], 0.2)
    return (h.filter("part = 'test'").join(g, ["key", "row_id"])
            .groupBy("seed").agg(F.count(F.lit(1)).alias("n_test"),
                                 F.countDistinct("group_id").alias("n_groups")))


def _quota_sql(src: str, n: int) -> str:
    return f"""
WITH c AS (SELECT key, target, count(*) AS cnt FROM {src} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, target) - 1 AS rk,
             count(*) OVER (PARTITION BY key) AS k, sum(cnt) OVER (PARTITION BY key) AS total FROM c),
b AS (SELECT *, CAST(CASE WHEN total <= {n} THEN cnt WHEN {n} <= k THEN (CASE WHEN rk < {n} THEN 1 ELSE 0 END)
                     ELSE least(1 + floor(cnt / total * ({n} - k)), cnt) END AS BIGINT) AS base FROM r),
d AS (SELECT *, CASE WHEN total > {n} AND {n} > k THEN {n} - sum(base) OVER (PARTITION BY key) ELSE 0 END AS deficit FROM b),
slots AS (SELECT d.key, d.target, row_number() OVER (PARTITION BY d.key ORDER BY rd.i, d.rk) AS slot, d.deficit
          FROM d JOIN range(0, 10) rd(i) ON rd.i < least(d.cnt - d.base, 10) WHERE d.deficit > 0),
add AS (SELECT key, target, count(*) AS a FROM slots WHERE slot <= deficit GROUP BY 1, 2)
SELECT d.key, d.target, d.cnt, CAST(d.base + coalesce(add.a, 0) AS BIGINT) AS quota
FROM d LEFT JOIN add ON d.key = add.key AND d.target = add.target"""


@query("fewshot_quota", with_ctes(f"""
SELECT * FROM ({_quota_sql("(SELECT key, target FROM clf_tasks)", 10)})
UNION ALL SELECT * FROM ({_quota_sql("(SELECT key || '#3' AS key, target FROM clf_tasks)", 3)})
UNION ALL SELECT * FROM ({_quota_sql("(SELECT key || '#100' AS key, target FROM clf_tasks)", 100)})""",
                                  "clf_tasks"))
def q_fewshot_quota(spark, d):
    t = C.clf_tasks(spark, d)
    out = None
    for n in (10, 3, 100):
        tt = t if n == 10 else t.withColumn("key", F.concat("key", F.lit(f"#{n}")))
        q = S.fewshot_quota(S.class_counts(tt), n)
        out = q if out is None else out.unionByName(q)
    return out


def _side_sql(part: str, n: int) -> str:
    rows = f"(SELECT key || ':' || CAST(seed AS VARCHAR) AS key, target FROM clf_parts WHERE part = '{part}')"
    return f"""
SELECT r.key, r.seed, r.part, r.target, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY key, seed, target ORDER BY {H('seed', 'row_id')}, row_id) AS rn
      FROM clf_parts WHERE part = '{part}') r
JOIN ({_quota_sql(rows, n)}) q ON q.key = r.key || ':' || CAST(r.seed AS VARCHAR) AND q.target = r.target
WHERE r.rn <= q.quota GROUP BY 1, 2, 3, 4"""


@query("subsample_parts", with_ctes(f"SELECT * FROM ({_side_sql('train', 100)}) UNION ALL SELECT * FROM ({_side_sql('test', 30)})",
                                    "clf_parts"))
def q_subsample(spark, d):
    s = S.subsample_parts(C.clf_parts_cached(spark, d), n_train=100, n_test=30)
    return s.groupBy("key", "seed", "part", "target").agg(F.count(F.lit(1)).alias("n"))


@query("sample_exact", with_ctes(f"""
SELECT key, row_id FROM (SELECT key, row_id, row_number() OVER (PARTITION BY key ORDER BY {H('7', 'row_id')}, row_id) AS rn
                         FROM clf_tasks) WHERE rn <= 50""", "clf_tasks"))
def q_sample_exact(spark, d):
    return S.sample_exact(C.clf_tasks(spark, d), 50, seed=7).select("key", "row_id")


@query("seeded_shuffle", with_ctes(f"""
SELECT key, row_id, row_number() OVER (PARTITION BY key ORDER BY {H('3', 'row_id')}, row_id) AS pos
FROM clf_tasks""", "clf_tasks"))
def q_shuffle(spark, d):
    return S.seeded_shuffle(C.clf_tasks(spark, d), 3).select("key", "row_id", "pos")


@query("split_audit", with_ctes("""
SELECT key, seed, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_duplicated
FROM clf_splits GROUP BY 1, 2""", "clf_splits"))
def q_audit(spark, d):
    return S.split_audit(C.clf_splits(spark, d), C.clf_tasks(spark, d))
