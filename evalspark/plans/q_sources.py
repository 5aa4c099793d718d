"""Queries: scans and sinks (S*). File-layout queries write a deterministic tree derived
from the driver's tables to a fresh folder under the shared checkpoint directory, then
scan it; the oracle computes the same rows from the tables directly."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import leaderboard as B
from ..operators import splits as S
from ..session import scratch_dir
from ..sources import artifacts as A
from ..sources import matrices as MX
from ..sources import results as RS
from ..sources import tables as TB
from ..sources.split_cache import cached_table
from .oracles import board_sql, minmax_sql, with_ctes
from .q_reports import _grid_results
from .registry import query


@query("src_table_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_table_scan(spark, d):
    path = scratch_dir(spark, "csv") + "/customer.csv"
    c = C.table(spark, d, "customer")
    c.toDF(*[f"  {x} " for x in c.columns]).write.option("header", True).csv(path)
    raw = TB.read_table(spark, path)
    return raw.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"),
                      F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("embedding_explode", "SELECT vec_id, label, " + ", ".join(
    f"embedding[{i + 1}] AS embedding_{i}" for i in range(64)) + " FROM embeddings")
def q_embedding(spark, d):
    e = C.table(spark, d, "embeddings")
    s = e.select("vec_id", "label", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
                 .alias("embedding"))
    return TB.embedding_explode(s, "embedding")


@query("status_scan", with_ctes("SELECT seed, key, model, status, reason FROM status", "status"))
def q_status_scan(spark, d):
    root = scratch_dir(spark, "status")
    RS.write_status_tree(C.status(spark, d), root)
    return RS.status_scan(spark, root)


@query("path_keys", with_ctes("SELECT DISTINCT key FROM metrics_run", "metrics_run"))
def q_path_keys(spark, d):
    root = scratch_dir(spark, "truth")
    C.metrics_run(spark, d).write.partitionBy("key").parquet(root)
    return RS.path_keys(spark, root)


@query("cell_axes_from_path", with_ctes("""
SELECT DISTINCT reasoning, labels, feature_cap, n_train, CAST(n_train AS INTEGER) AS n FROM (
  SELECT reasoning, labels, feature_cap, CASE WHEN seed = 6 THEN 'full' ELSE n_train END AS n_train FROM grid_results)
WHERE TRY_CAST(n_train AS INTEGER) IS NOT NULL""", "grid_results"))
def q_cell_axes(spark, d):
    root = scratch_dir(spark, "grid")
    g = _grid_results(spark, d).withColumn("n_train", F.when(F.col("seed") == 6, "full").otherwise(F.col("n_train")))
    g.write.partitionBy("reasoning", "labels", "feature_cap", "n_train").parquet(root)
    return RS.cell_axes_from_path(spark, root)


@query("prediction_sink", with_ctes("SELECT seed, key, model, row_id, round(pred, 6) AS pred FROM reg_preds", "reg_preds"))
def q_pred_sink(spark, d):
    from .q_core import _reg
    root = scratch_dir(spark, "predictions")
    RS.write_predictions(_reg(spark, d).select("seed", "key", "model", "row_id", "pred"), root)
    back = spark.read.parquet(root)
    return back.select(F.col("seed").cast("int"), "key", "model", "row_id", F.round("pred", 6).alias("pred"))


@query("metric_sink", with_ctes("""
SELECT seed, key, model, CASE WHEN seed = 1 THEN 0.0 ELSE f1_macro END AS f1_macro FROM metrics_run""", "metrics_run"))
def q_metric_sink(spark, d):
    root = scratch_dir(spark, "metrics")
    m = C.metrics_run(spark, d).select("seed", "key", "model", "f1_macro")
    RS.write_metrics(m, root)
    RS.write_metrics(m.filter("seed = 1").withColumn("f1_macro", F.lit(0.0)), root, overwrite_touched=True)
    return spark.read.parquet(root).select(F.col("seed").cast("int"), "key", "model", "f1_macro")


@query("proba_sink", with_ctes("""
SELECT seed, key, model, row_id, cls, round(score, 9) AS score,
       row_number() OVER (PARTITION BY seed, key, model, row_id ORDER BY cls) - 1 AS class_no FROM proba_long""", "proba_long"))
def q_proba_sink(spark, d):
    root = scratch_dir(spark, "proba")
    RS.write_probabilities(C.clf_bundle(spark, d)[3], root)
    rows = spark.read.parquet(root).select("seed", "key", "model", "row_id", "classes", F.posexplode("proba").alias("class_no", "score"))
    return rows.select("seed", "key", "model", "row_id", F.get("classes", F.col("class_no")).alias("cls"),
                       F.round("score", 9).alias("score"), F.col("class_no").cast("long").alias("class_no"))


@query("truth_sink", with_ctes("""
SELECT seed, key, row_id, CASE WHEN key = 'orders_0' THEN target ELSE 'm2:' || target END AS target FROM truth""", "truth"))
def q_truth_sink(spark, d):
    """Three models write the truth of their test rows, the first that of one key alone; each (seed, key) keeps its first."""
    root = scratch_dir(spark, "truth")
    t = C.clf_bundle(spark, d)[1]
    RS.write_truth_once(spark, t.filter("key = 'orders_0'"), root)
    for model in ("m2:", "m3:"):
        RS.write_truth_once(spark, t.withColumn("target", F.concat(F.lit(model), "target")), root)
    return spark.read.parquet(root).select("seed", "key", "row_id", "target")


@query("metric_summary_sink", with_ctes("""
SELECT CAST(v AS INTEGER) AS version, key, model, count(*) AS n_rows, round(avg(f1_macro), 9) AS mean_f1,
       count(*) AS n_summary
FROM metrics_run JOIN (SELECT * FROM range(1, 4) r(v)) ON v = 3 OR (v = 2 AND seed <= 2) OR (v = 1 AND seed = 0)
GROUP BY 1, 2, 3""", "metrics_run"))
def q_metric_summary_sink(spark, d):
    """Three saves; each version's rows, counted, beside the summary that was published with them."""
    root = scratch_dir(spark, "saves")
    m = C.metrics_run(spark, d).select("seed", "key", "model", "f1_macro")
    summary = lambda rows: rows.groupBy("key", "model").agg(
        F.round(F.avg("f1_macro"), 9).alias("mean_f1"), F.count(F.lit(1)).alias("n_summary"))
    out = []
    for seeds in ("seed = 0", "seed between 1 and 2", "seed > 2"):
        version = RS.save_metrics(spark, m.filter(seeds), root, summary)
        rows, total = RS.read_metrics(spark, root, version)
        out.append(rows.groupBy("key", "model").agg(F.count(F.lit(1)).alias("n_rows")).join(total, ["key", "model"])
                   .select(F.lit(version).alias("version"), "key", "model", "n_rows", "mean_f1", "n_summary"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("split_cache", with_ctes("""
WITH t AS (SELECT 'customer_0' AS key, c_custkey AS row_id, c_mktsegment AS target FROM customer),
more AS (SELECT 'supplier_0' AS key, s_suppkey AS row_id, CAST(s_nationkey % 2 AS VARCHAR) AS target FROM supplier),
a AS (SELECT key, count(*) AS n FROM t GROUP BY 1), b AS (SELECT * FROM a UNION ALL SELECT key, count(*) FROM more GROUP BY 1),
s AS (SELECT 'first' AS step, false AS reused, * FROM a UNION ALL SELECT 'other session', true, * FROM a
      UNION ALL SELECT 'file added', false, * FROM b)
SELECT step, reused, key, CAST(ceil(n * 0.2) AS BIGINT) AS n_test, n - CAST(ceil(n * 0.2) AS BIGINT) AS n_train FROM s"""))
def q_split_cache(spark, d):
    """A split of a table in the cache: written, read by another session, written anew after a file came to the table."""
    src, root = scratch_dir(spark, "tasks"), scratch_dir(spark, "cache")
    C.table(spark, d, "customer").select(F.lit("customer_0").alias("key"), F.col("c_custkey").alias("row_id"),
                                         F.col("c_mktsegment").alias("target")).write.parquet(src)

    def split(session, step):
        parts, reused = cached_table(session, "tasks", {"test_size": 0.2}, [src],
                                     lambda: S.holdout_stratified(session.read.parquet(src), [0], 0.2), root)
        counts = spark.read.parquet(parts.inputFiles()[0].rsplit("/", 1)[0]).groupBy("key").agg(
            F.count_if(F.col("part") == "test").alias("n_test"), F.count_if(F.col("part") == "train").alias("n_train"))
        return counts.select(F.lit(step).alias("step"), F.lit(reused).alias("reused"), "key", "n_test", "n_train")

    out = split(spark, "first").unionByName(split(spark.newSession(), "other session"))
    C.table(spark, d, "supplier").select(F.lit("supplier_0").alias("key"), F.col("s_suppkey").alias("row_id"),
                                         (F.col("s_nationkey") % 2).cast("string").alias("target")).write.mode("append").parquet(src)
    return out.unionByName(split(spark, "file added"))


@query("split_fingerprint", with_ctes("""
SELECT key, seed, md5(to_json({'key': key, 'seed': seed, 'test_size': CAST(0.2 AS DOUBLE), 'min_samples_per_class': 10,
                               'train_subsample': 100})) AS split_hash
FROM (SELECT DISTINCT key FROM clf_tasks) CROSS JOIN (VALUES (0), (1), (2)) s(seed)""", "clf_tasks"))
def q_fingerprint(spark, d):
    keys = C.clf_tasks(spark, d).select("key").distinct()
    p = keys.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (0, 1, 2)]))) \
        .withColumn("test_size", F.lit(0.2)).withColumn("min_samples_per_class", F.lit(10)) \
        .withColumn("train_subsample", F.lit(100))
    out = RS.split_fingerprint(p, ["key", "seed", "test_size", "min_samples_per_class", "train_subsample"])
    return out.select("key", "seed", "split_hash")


@query("matrix_file_parse", """
SELECT 'S' || CAST(p_size % 10 AS VARCHAR) AS sample, replace(p_type, ' ', '_') AS gene,
       CAST(round(avg(p_retailprice), 2) AS FLOAT) AS value
FROM part GROUP BY 1, 2""")
def q_matrix_parse(spark, d):
    root = scratch_dir(spark, "counts")
    p = C.table(spark, d, "part")
    g = p.groupBy(F.concat(F.lit("S"), (F.col("p_size") % 10).cast("string")).alias("sample"),
                  F.regexp_replace("p_type", " ", "_").alias("gene")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 2).alias("tpm"))
    genes = g.select("sample", F.concat_ws("\t", "gene", F.lower("gene"), F.lit("protein_coding"), F.col("n").cast("string"),
                                           F.lit("0"), F.lit("0"), F.col("tpm").cast("string"), F.lit("0"), F.lit("0"))
                     .alias("value"))
    samples = g.select("sample").distinct()
    extra = samples.select("sample", F.explode(F.array(
        F.lit("# gene-model: synthetic"),
        *[F.lit(f"{n}\t\t\t0\t0\t0\t\t\t") for n in ("N_unmapped", "N_multimapping", "N_noFeature", "N_ambiguous")]))
        .alias("value"))
    genes.unionByName(extra).write.partitionBy("sample").text(root)
    return MX.parse_counts(spark, root)


@query("matrix_assemble", """
SELECT n.n_name AS sample, c.c_mktsegment AS feature, count(*) AS value
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""")
def q_matrix_assemble(spark, d):
    c, n = C.table(spark, d, "customer"), C.table(spark, d, "nation")
    long = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(
        F.col("n_name").alias("sample"), F.col("c_mktsegment").alias("feature")).agg(F.count(F.lit(1)).alias("value"))
    return MX.matrix_assemble(long)


@query("matrix_dedupe_pivot", """
SELECT probe, sample, TRY_CAST(value AS DOUBLE) AS value FROM (
         SELECT *, row_number() OVER (PARTITION BY sample, probe ORDER BY pos) AS r FROM (
           SELECT event_type AS sample, 'P' || CAST(user_id % 4 AS VARCHAR) AS probe,
                  CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value, event_id AS pos
           FROM events)) WHERE r = 1""")
def q_dedupe_pivot(spark, d):
    e = C.table(spark, d, "events")
    pr = e.select(F.col("event_type").alias("sample"), F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string")).alias("probe"),
                  F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
                  F.col("event_id").alias("pos"))
    return MX.matrix_dedupe_pivot(pr)


@query("kv_target_extract", """
SELECT doc_id AS sample, CASE WHEN doc_id % 7 = 0 THEN 'zz' ELSE lang END AS target FROM documents""")
def q_kv(spark, d):
    doc = C.table(spark, d, "documents")
    ch = F.array_compact(F.array(
        F.concat(F.lit("source: "), F.col("source")),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Lang: "), F.col("lang"))),
        F.concat(F.lit("LANG : "), F.lit("zz")),
        F.concat(F.lit("length: "), F.col("n_chars").cast("string"))))
    s = doc.select(F.col("doc_id").alias("sample"), ch.alias("characteristics"))
    return MX.kv_target_extract(s, "lang")


@query("prevalence_filter", """
WITH f0 AS (SELECT p_brand AS sample, p_type AS marker, max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) AS value
            FROM part GROUP BY 1, 2),
f AS (SELECT b.sample, m.marker, CAST(coalesce(f0.value, 0) AS INTEGER) AS value
      FROM (SELECT DISTINCT sample FROM f0) b CROSS JOIN (SELECT DISTINCT marker FROM f0) m
      LEFT JOIN f0 ON f0.sample = b.sample AND f0.marker = m.marker),
k AS (SELECT marker FROM f GROUP BY 1 HAVING avg(value) >= 0.1)
SELECT f.sample, f.marker, f.value FROM f JOIN k ON f.marker = k.marker""")
def q_prevalence(spark, d):
    path = scratch_dir(spark, "markers")
    p = C.table(spark, d, "part")
    f0 = p.groupBy(F.col("p_brand").alias("sample"), F.col("p_type").alias("marker")).agg(
        F.max(F.when(F.col("p_size") > 45, 1).otherwise(0)).alias("value"))
    brands = f0.select("sample").distinct()
    # one text line per marker over every sample: pivot (dense, NULL = absent → 0)
    wide = f0.groupBy("marker").pivot("sample").agg(F.first("value")).fillna(0)
    samples = sorted(c for c in wide.columns if c != "marker")
    rows = wide.select("marker", F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in samples]).alias("vals"))
    header = brands.agg(F.concat_ws("\t", F.lit("marker"), F.array_join(F.array_sort(F.collect_list("sample")), "\t"))
                        .alias("value"))
    junk = brands.agg(F.concat_ws("\t", F.lit("junk"), F.array_join(F.transform(F.collect_list("sample"),
                                                                               lambda s: F.lit("2")), "\t")).alias("value"))
    lines = header.unionByName(rows.select(F.concat_ws("\t", "marker", "vals").alias("value"))).unionByName(junk)
    lines.write.text(path)
    return MX.prevalence_filter(spark, path, 0.1)


@query("two_hop_label_join", """
WITH w AS (SELECT l_orderkey AS run, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A,
                  sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N,
                  sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1),
l AS (SELECT run, 'A' AS feature, A AS value FROM w UNION ALL SELECT run, 'N', N FROM w UNION ALL SELECT run, 'R', R FROM w)
SELECT l.run, o.o_custkey AS sample, l.feature, l.value, lower(trim(c.c_mktsegment)) AS label
FROM l JOIN orders o ON l.run = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment IS NOT NULL AND trim(c.c_mktsegment) <> ''""")
def q_two_hop(spark, d):
    li = C.table(spark, d, "lineitem")
    wide = li.groupBy(F.col("l_orderkey").alias("run")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    rs = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("sample"))
    meta = C.table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), "c_mktsegment")
    return MX.two_hop_label_join(wide, "run", ["A", "N", "R"], rs, meta, "c_mktsegment")


@query("artifact_manifest", """
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, sha256(text || chr(10)) AS sha256 FROM documents""")
def q_manifest(spark, d):
    root = scratch_dir(spark, "tree")
    A.text_tree(C.table(spark, d, "documents"), "doc_id", "text", root)
    spark.range(1).select(F.lit("run finished").alias("value")).write.text(root + "/logs")
    m = A.artifact_manifest(spark, root)
    return m.select(F.regexp_extract("rel_path", r"doc_id=(\d+)", 1).cast("bigint").alias("doc_id"), "size", "sha256")


@query("json_hits_flatten", "SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS file_id, o_orderstatus AS sample_type FROM orders WHERE o_orderstatus <> 'P'")
def q_json_hits(spark, d):
    o = C.table(spark, d, "orders")
    st = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    js = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"),
                                             F.array(F.struct(F.array(F.struct(st.alias("sample_type"))).alias("samples")))
                                             .alias("cases"))).alias("hits")))
    return TB.json_hits_flatten(o.select(js.alias("json")))


@query("report_sink", with_ctes(board_sql(minmax_sql("metrics_grid", "f1_macro")), "metrics_grid"))
def q_report_sink(spark, d):
    root = scratch_dir(spark, "report")
    board = B.leaderboard(C.metrics_grid(spark, d))
    RS.report_sink(board, root)
    return spark.read.text(root).select(F.from_json("value", board.schema).alias("r")).select("r.*")
