"""Queries: merging result trees (X01-X05). Two trees are derived from ``documents``: the
destination overlaps the source and carries edits that exercise every equivalence rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import merge as X
from .registry import query


def _files(doc, dest: bool):
    d = F.col("doc_id")
    s = (d % 3).cast("string")
    key = F.concat(F.lit("k"), d.cast("string"))
    seed_dir = F.concat(F.lit("seed_"), s)
    text = F.col("text")
    if dest:
        truth = (F.when(d % 97 == 0, F.concat(text, F.lit("X")))
                 .when(d % 13 == 0, F.regexp_replace(text, "\n", "\r\n")).otherwise(text))
        pred = F.when(d % 23 == 0, F.lit("changed")).otherwise(F.upper(text))
        stats = F.to_json(F.struct(key.alias("key"), F.when(d % 17 == 0, F.col("n_chars") + 1)
                                   .otherwise(F.col("n_chars")).alias("n_chars"),
                                   F.lit("2024-02-02T10:00:00").alias("timestamp")))
        models = F.when(d % 2 == 0, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("A"), F.lit("B")))
        config = F.to_json(F.struct(models.alias("models"), F.concat(F.lit("out\\"), key).alias("output_dir"),
                                    F.when(d % 19 == 0, d % 3 + 1).otherwise(d % 3).alias("seed")))
    else:
        truth = text
        pred = F.upper(text)
        stats = F.to_json(F.struct(key.alias("key"), F.col("n_chars").alias("n_chars"),
                                   F.lit("2024-01-01T00:00:00").alias("timestamp")))
        config = F.to_json(F.struct(F.array(F.lit("A"), F.lit("B")).alias("models"),
                                    F.concat(F.lit("out/"), key).alias("output_dir"), (d % 3).alias("seed")))
    files = F.array(
        F.struct(F.concat(seed_dir, F.lit("/predictions/"), key, F.lit("_ground_truth.csv")).alias("path"), truth.alias("content")),
        F.struct(F.concat(seed_dir, F.lit("/predictions/"), key, F.lit("_mA.csv")).alias("path"), pred.alias("content")),
        F.struct(F.concat(seed_dir, F.lit("/stats/"), key, F.lit("_mA.json")).alias("path"), stats.alias("content")),
        F.struct(F.concat(seed_dir, F.lit("/metrics/"), key, F.lit(".csv")).alias("path"),
                 F.concat(F.lit("m,"), F.col("n_chars").cast("string")).alias("content")),
        F.struct(F.concat(F.lit("cells/"), key, F.lit("/config.json")).alias("path"), config.alias("content")))
    return doc.select("doc_id", F.inline(files))


def _trees(spark, d):
    doc = C.table(spark, d, "documents").select("doc_id", "text", "n_chars")
    src = _files(doc.filter(F.col("doc_id") % 4 != 3), dest=False)
    dst = _files(doc.filter(F.col("doc_id") % 4 != 0), dest=True)
    return src, dst


FILES_SQL = """
SELECT doc_id, 'seed_' || CAST(doc_id % 3 AS VARCHAR) || '/predictions/k' || CAST(doc_id AS VARCHAR) || '_ground_truth.csv' AS path, 'truth' AS kind FROM documents
UNION ALL SELECT doc_id, 'seed_' || CAST(doc_id % 3 AS VARCHAR) || '/predictions/k' || CAST(doc_id AS VARCHAR) || '_mA.csv', 'pred' FROM documents
UNION ALL SELECT doc_id, 'seed_' || CAST(doc_id % 3 AS VARCHAR) || '/stats/k' || CAST(doc_id AS VARCHAR) || '_mA.json', 'stats' FROM documents
UNION ALL SELECT doc_id, 'seed_' || CAST(doc_id % 3 AS VARCHAR) || '/metrics/k' || CAST(doc_id AS VARCHAR) || '.csv', 'metric' FROM documents
UNION ALL SELECT doc_id, 'cells/k' || CAST(doc_id AS VARCHAR) || '/config.json', 'config' FROM documents"""

# equivalence of an overlapping file, from the edit rules of the destination tree
EQUIV_SQL = """CASE kind WHEN 'truth' THEN doc_id % 97 <> 0 WHEN 'pred' THEN doc_id % 23 <> 0
  WHEN 'stats' THEN doc_id % 17 <> 0 WHEN 'config' THEN doc_id % 19 <> 0 ELSE true END"""


@query("merge_plan", f"""
SELECT path, CASE WHEN kind IN ('truth', 'pred', 'stats') AND doc_id % 97 = 0 AND doc_id % 4 IN (1, 2) THEN 'skipped_conflicting_unit'
                  WHEN kind = 'metric' THEN 'ignored_derived'
                  WHEN doc_id % 4 = 0 THEN 'copied'
                  WHEN {EQUIV_SQL} THEN 'identical' ELSE 'conflict' END AS action
FROM ({FILES_SQL}) WHERE doc_id % 4 <> 3""")
def q_merge_plan(spark, d):
    src, dst = _trees(spark, d)
    return X.merge_plan(src, dst, keep_dest_conflicting_units=True)


@query("artifact_equivalence", f"""
SELECT path, {EQUIV_SQL} AS equivalent FROM ({FILES_SQL}) WHERE doc_id % 4 IN (1, 2) AND kind <> 'metric'""")
def q_equivalence(spark, d):
    src, dst = _trees(spark, d)
    j = src.select("path", F.col("content").alias("src")).join(dst.select("path", F.col("content").alias("dst")), "path")
    j = j.filter(~X.is_derived_or_log(F.col("path")))
    return j.select("path", X.files_equivalent(F.col("path"), F.col("src"), F.col("dst")).alias("equivalent"))


@query("skip_conflicting_units", """
SELECT DISTINCT 'seed_' || CAST(doc_id % 3 AS VARCHAR) AS seed_dir, 'k' || CAST(doc_id AS VARCHAR) AS key
FROM documents WHERE doc_id % 97 = 0 AND doc_id % 4 IN (1, 2)""")
def q_conflict_units(spark, d):
    src, dst = _trees(spark, d)
    return X.conflicting_truth_units(src, dst)


@query("manifest_verify", f"""
SELECT path, CASE WHEN doc_id % 37 = 0 THEN 'missing' WHEN doc_id % 31 = 0 THEN 'size_mismatch'
                  WHEN doc_id % 29 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS "check"
FROM ({FILES_SQL}) WHERE doc_id % 4 <> 3""")
def q_manifest_verify(spark, d):
    src, _ = _trees(spark, d)
    man = src.select("doc_id", "path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
    dd = F.col("doc_id")
    listed = man.select("path", F.when(dd % 31 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
                        F.when(dd % 29 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    scanned = man.filter(dd % 37 != 0).select("path", "size", "sha256")
    return X.manifest_verify(listed, scanned)


@query("append_only_check", """
WITH s AS (SELECT n.n_name, list_sort(list(DISTINCT c.c_mktsegment)) AS segs,
                  list_sort(list(DISTINCT c.c_mktsegment) FILTER (WHERE c.c_acctbal > 5000)) AS rich
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1)
SELECT n_name, CASE WHEN n_name < 'I' THEN len(rich) < len(segs) ELSE false END AS append_only FROM s""")
def q_append_only(spark, d):
    c, n = C.table(spark, d, "customer"), C.table(spark, d, "nation")
    s = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("segs"),
        F.array_sort(F.collect_set(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")))).alias("rich"))
    new = F.when(F.col("n_name") < "I", F.col("segs")).otherwise(F.reverse("segs"))
    old = F.when(F.col("n_name") < "I", F.col("rich")).otherwise(F.col("segs"))
    return s.select("n_name", X.append_only(old, new).alias("append_only"))
