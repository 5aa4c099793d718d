"""Queries: predictors and the UDF surface (U01-U05), probability reordering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.hashing import seeded_hash
from ..operators import metrics as M
from ..operators import predictors as P
from ..operators import prompts as PR
from ..operators import responses as RS
from ..operators import splits as S
from .oracles import with_ctes
from .registry import query


@query("predict_dummy", with_ctes("""
SELECT t.seed, t.key, t.row_id, m.majority AS pred, k.target AS cls, k.cnt / sum(k.cnt) OVER (PARTITION BY t.seed, t.key, t.row_id) AS p
FROM truth t JOIN k_major m ON t.seed = m.seed AND t.key = m.key JOIN k_counts k ON t.seed = k.seed AND t.key = k.key""",
                                  "truth", "k_major", "k_counts"))
def q_dummy(spark, d):
    parts, _, _, _ = C.clf_bundle(spark, d)
    out = P.predict_dummy(parts.filter("part = 'train'"), parts.filter("part = 'test'"))
    return out


KNN_SQL = """
WITH e AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS target, embedding,
                  substr(md5('knn:' || CAST(vec_id AS VARCHAR)), 1, 1) < '4' AS is_test FROM embeddings),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('0:' || CAST(row_id AS VARCHAR)), row_id) AS rn
                      FROM e WHERE NOT is_test) WHERE rn <= 100),
te AS (SELECT * FROM e WHERE is_test),
pairs AS (SELECT te.row_id, tr.row_id AS train_id, tr.target AS tlabel,
                 round(list_reduce(list_transform(range(1, len(te.embedding) + 1),
                       lambda i: (CAST(te.embedding[i] AS DOUBLE) - CAST(tr.embedding[i] AS DOUBLE))
                               * (CAST(te.embedding[i] AS DOUBLE) - CAST(tr.embedding[i] AS DOUBLE))), lambda a, b: a + b), 6) AS d2
          FROM te CROSS JOIN tr),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, train_id) AS r FROM pairs) WHERE r <= 5),
v AS (SELECT row_id, tlabel, count(*) AS votes, sum(d2) AS dsum FROM nn GROUP BY 1, 2)
SELECT 0 AS seed, 'embeddings_0' AS key, row_id, tlabel AS pred FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, dsum, tlabel) AS r FROM v) WHERE r = 1"""


@query("predict_knn", KNN_SQL)
def q_knn(spark, d):
    e = C.table(spark, d, "embeddings").select(
        F.lit(0).alias("seed"), F.lit("embeddings_0").alias("key"), F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("target"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        (F.substring(F.md5(F.concat(F.lit("knn:"), F.col("vec_id").cast("string"))), 1, 1) < "4").alias("is_test"))
    train = S.sample_exact(e.filter(~F.col("is_test")), 100, seed=0, key_cols=("seed", "key"))
    test = e.filter("is_test")
    return P.predict_knn(train, test, k=5)


@query("proba_reorder", with_ctes("""
SELECT p.seed, p.key, p.model, p.row_id, c.pos, round(p.score, 9) AS score FROM proba_long p
JOIN (SELECT seed, key, target AS cls, CAST(row_number() OVER (PARTITION BY seed, key ORDER BY target) AS INTEGER) AS pos
      FROM (SELECT DISTINCT seed, key, target FROM truth)) c ON p.seed = c.seed AND p.key = c.key AND p.cls = c.cls""",
                                  "proba_long", "truth"))
def q_reorder(spark, d):
    _, truth, _, proba = C.clf_bundle(spark, d)
    r = M.proba_reorder(proba, truth)
    return r.select("seed", "key", "model", "row_id", F.posexplode("scores").alias("pos", "score")) \
        .select("seed", "key", "model", "row_id", (F.col("pos") + 1).alias("pos"), F.round("score", 9).alias("score"))


def _nearest_centroid(train: pd.DataFrame, test: pd.DataFrame) -> pd.Series:
    """A tiny estimator for the bring-your-own path: nearest class centroid on x1, x2."""
    feats = ["x1", "x2"]
    cent = train.groupby("target")[feats].mean()
    x = test[feats].fillna(0.0).to_numpy()
    dist = ((x[:, None, :] - cent.to_numpy()[None, :, :]) ** 2).sum(axis=2)
    return pd.Series(cent.index.to_numpy()[np.argmin(dist, axis=1)])


@query("byo_estimator")
def q_byo(spark, d):
    """U01 (rows-only): one pandas fit/predict per (seed, key) on few-shot train rows."""
    parts = C.clf_parts_cached(spark, d)
    fs = S.subsample_parts(parts, n_train=100, n_test=None)
    return P.byo_estimator(fs, _nearest_centroid, ["x1", "x2"], "NCENT")


def _echo_answers(prompts: pd.Series) -> pd.Series:
    """A deterministic stand-in answerer: names the first class for every test row."""
    out = []
    for text in prompts.tolist():
        n = int(text.split("Test table (", 1)[1].split(" ", 1)[0])
        first = text.split("Possible classes: ", 1)[1].split(",", 1)[0].split(".", 1)[0]
        out.append("\n".join(f"Row {i}: {first}" for i in range(1, n + 1)))
    return pd.Series(out)


@query("batch_predict")
def q_batch_predict(spark, d):
    """U02 (rows-only): requests → mapInPandas answerer → parsed answers."""
    parts = C.clf_parts_cached(spark, d)
    fs = S.subsample_parts(parts, n_train=10, n_test=None)
    train, test = fs.filter("part = 'train'"), parts.filter("part = 'test'")
    req = PR.build_requests(train, test, [("x1", True), ("x2", True), ("grp", False)], 20)
    answered = P.batch_predict(req.select("seed", "key", "model", "chunk", "n_rows", "prompt"), _echo_answers)
    codec = PR.label_codec(train)
    return RS.parse_answers(answered, codec.select("seed", "key", "token")).select("seed", "key", "model", "chunk", "idx", "token")


def _ml(spark, d, kind):
    """One Spark ML fit per (seed, key) unit — the unit list is small (keys × seeds), each
    fit is itself distributed over the unit's train rows."""
    from functools import reduce
    parts = C.clf_parts_cached(spark, d)
    units = [(r["seed"], r["key"]) for r in parts.select("seed", "key").distinct().orderBy("seed", "key").collect()]
    outs = []
    for seed, key in units:
        u = parts.filter((F.col("seed") == seed) & (F.col("key") == key))
        outs.append(P.spark_ml_model(u.filter("part = 'train'"), u.filter("part = 'test'"), ["x1", "x2"], kind)
                    .select("seed", "key", "row_id", "pred"))
    return reduce(lambda a, b: a.unionByName(b), outs)


@query("predict_rf")
def q_rf(spark, d):
    """U05 (rows-only): Spark ML random forest per unit."""
    return _ml(spark, d, "RF")


@query("predict_lr")
def q_lr(spark, d):
    """U05 (rows-only): Spark ML logistic regression per unit."""
    return _ml(spark, d, "LR")
