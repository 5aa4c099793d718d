"""Predictors (U01-U05): rule baselines as joins, k-NN as a per-key join, and the
bring-your-own-estimator path through ``applyInPandas`` / ``mapInPandas``.

Built-in predictors never leave the JVM: a "fit" is an aggregate over the train part
and "predict" is a join of that small model table to the test rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_number
from ..session import materialize, small_side

UNIT_SPLIT = ["seed", "key"]

#: Test rows of a unit that one call of a user's estimator takes: a frame of some ten MB.
BYO_ROWS = 100_000


def _majority(counts: DataFrame, keys: list[str], cls: str = "target") -> DataFrame:
    """Most frequent class per group; tie: label ascending."""
    w = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), F.col(cls))
    return (counts.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
            .select(*keys, F.col(cls).alias("majority")))


def majority_class(train: DataFrame, keys=UNIT_SPLIT, cls: str = "target") -> DataFrame:
    """Majority class per (seed, key) of a train part."""
    counts = train.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("cnt"))
    return _majority(counts, list(keys), cls)


def _share_map(counts: DataFrame, keys: list[str], classes: DataFrame) -> DataFrame:
    """MAP<class, share> over every class of the key (0 for classes the group lacks)."""
    tot = counts.groupBy(*keys).agg(F.sum("cnt").alias("__tot"))
    grid = tot.join(classes, [k for k in keys if k in classes.columns])
    full = (grid.join(counts, keys + ["target"], "left")
            .withColumn("share", F.coalesce(F.col("cnt"), F.lit(0)) / F.col("__tot")))
    return full.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "share")))).alias("proba"))


def rule_models(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fit DUMMY / GROUP / HASH on the train part and predict every test row.

    ``parts``: (seed, key, row_id, part, target, grp). Returns (predictions, proba) with
    predictions (seed, key, model, row_id, pred) and proba (seed, key, model, row_id,
    proba MAP<STRING, DOUBLE>). The fit is two small aggregates — one row per (seed, key)
    and one per (seed, key, group) holding majority, class list and class shares — and the
    test rows meet them in two joins; no per-row Python.
    """
    train = parts.filter(F.col("part") == "train")
    test = parts.filter(F.col("part") == "test").select("seed", "key", "row_id", "grp")
    g_counts = train.groupBy("seed", "key", "grp", "target").agg(F.count(F.lit(1)).alias("cnt"))
    k_counts = g_counts.groupBy("seed", "key", "target").agg(F.sum("cnt").alias("cnt"))
    top = lambda: F.min_by("target", F.struct((-F.col("cnt")).alias("n"), F.col("target").alias("t")))
    K = k_counts.groupBy("seed", "key").agg(
        top().alias("majority"), F.array_sort(F.collect_list(F.struct("target", "cnt"))).alias("tc"))
    K = K.select("seed", "key", "majority", F.transform("tc", lambda x: x["target"]).alias("classes"),
                 F.aggregate("tc", F.lit(0).cast("long"), lambda acc, x: acc + x["cnt"]).alias("tot"), "tc")
    K = K.withColumn("proba", F.map_from_entries(F.transform(
        "tc", lambda x: F.struct(x["target"], x["cnt"] / F.col("tot"))))).drop("tc", "tot")
    K = small_side(K, "key-models")
    G = g_counts.groupBy("seed", "key", "grp").agg(
        top().alias("g_major"), F.map_from_entries(F.collect_list(F.struct("target", "cnt"))).alias("gm"),
        F.sum("cnt").alias("gtot"))
    G = G.join(K.select("seed", "key", "classes"), UNIT_SPLIT).select(
        "seed", "key", "grp", "g_major", F.map_from_arrays("classes", F.transform(
            "classes", lambda c: F.coalesce(F.col("gm")[c], F.lit(0)) / F.col("gtot"))).alias("g_proba"))
    G = small_side(G, "group-models")
    t = test.join(K, UNIT_SPLIT).join(G, ["seed", "key", "grp"], "left")
    h = hash_number(F.concat_ws(":", F.lit("HASH"), F.col("seed").cast("string"),
                                F.col("row_id").cast("string")))
    hash_pred = F.element_at("classes", (h % F.size("classes") + 1).cast("int"))
    one_hot = F.map_from_arrays("classes", F.transform("classes", lambda c: F.when(c == hash_pred, 1.0)
                                                       .otherwise(0.0)))
    preds = t.select("seed", "key", "row_id", F.explode(F.array(
        F.struct(F.lit("DUMMY").alias("model"), F.col("majority").alias("pred")),
        F.struct(F.lit("GROUP").alias("model"), F.coalesce("g_major", "majority").alias("pred")),
        F.struct(F.lit("HASH").alias("model"), hash_pred.alias("pred")),
    )).alias("m")).select("seed", "key", "m.model", "row_id", "m.pred")
    proba = t.select("seed", "key", "row_id", F.explode(F.array(
        F.struct(F.lit("DUMMY").alias("model"), F.col("proba").alias("proba")),
        F.struct(F.lit("GROUP").alias("model"), F.coalesce("g_proba", "proba").alias("proba")),
        F.struct(F.lit("HASH").alias("model"), one_hot.alias("proba")),
    )).alias("m")).select("seed", "key", "m.model", "row_id", "m.proba")
    return preds, proba


def regression_models(parts: DataFrame) -> DataFrame:
    """MEAN / RATE / GROUPMEAN regression baselines: (seed, key, model, row_id, y, pred)."""
    train = parts.filter(F.col("part") == "train")
    test = parts.filter(F.col("part") == "test")
    k = train.groupBy("seed", "key").agg(F.avg("y").alias("mu"),
                                         (F.sum("y") / F.sum("x1")).alias("rate"))
    g = train.groupBy("seed", "key", "grp").agg(F.avg("y").alias("g_mu"))
    t = test.join(small_side(k, "key-means"), UNIT_SPLIT).join(small_side(g, "group-means"), ["seed", "key", "grp"], "left")
    return t.select("seed", "key", "row_id", "y", F.explode(F.array(
        F.struct(F.lit("MEAN").alias("model"), F.col("mu").alias("pred")),
        F.struct(F.lit("RATE").alias("model"), (F.col("x1") * F.col("rate")).alias("pred")),
        F.struct(F.lit("GROUPMEAN").alias("model"), F.coalesce("g_mu", "mu").alias("pred")),
    )).alias("m")).select("seed", "key", "m.model", "row_id", "y", "m.pred")


def predict_dummy(train: DataFrame, test: DataFrame, keys=UNIT_SPLIT) -> DataFrame:
    """Chance baseline — constant majority class plus the train class prior."""
    keys = list(keys)
    counts = train.groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("cnt"))
    tot = counts.groupBy(*keys).agg(F.sum("cnt").alias("tot"))
    prior = counts.join(tot, keys).select(*keys, "target", (F.col("cnt") / F.col("tot")).alias("p"))
    return test.select(*keys, "row_id").join(_majority(counts, keys), keys) \
        .join(prior, keys).select(*keys, "row_id", F.col("majority").alias("pred"),
                                  F.col("target").alias("cls"), "p")


def predict_knn(train: DataFrame, test: DataFrame, k: int = 5, keys=UNIT_SPLIT,
                vec: str = "vec") -> DataFrame:
    """K-nearest-neighbour vote per (seed, key).

    A unit's train rows are one array (the few-shot train side is bounded by the shot
    quota), joined to its test rows; all else happens inside the test row, so no pair is
    ever shuffled. Distance = rounded squared L2; neighbours = the k least by (distance,
    train id); vote = most neighbours, tie by the smaller summed distance, then label.
    """
    keys = list(keys)
    shots = train.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("row_id").alias("train_id"), F.col(vec).alias("tv"), F.col("target").alias("tlabel"))).alias("__shots"))

    def near(t):
        d2 = F.aggregate(F.zip_with(F.col(vec), t["tv"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
        return F.struct(F.round(d2, 6).alias("d2"), t["train_id"].alias("train_id"), t["tlabel"].alias("tlabel"))

    def vote(label):
        mine = F.filter("__nn", lambda n: n["tlabel"] == label)
        return F.struct((-F.size(mine)).alias("votes"), F.aggregate(mine, F.lit(0.0), lambda acc, n: acc + n["d2"]).alias("dsum"),
                        label.alias("tlabel"))

    nn = test.select(*keys, "row_id", vec).join(shots, keys).select(
        *keys, "row_id", F.slice(F.array_sort(F.transform("__shots", near)), 1, k).alias("__nn"))
    labels = F.array_distinct(F.transform("__nn", lambda n: n["tlabel"]))
    return nn.select(*keys, "row_id", F.array_min(F.transform(labels, vote))["tlabel"].alias("pred"))


def byo_estimator(parts: DataFrame, fit_predict: Callable[[pd.DataFrame, pd.DataFrame], pd.Series],
                  features: list[str], model_name: str, keys=UNIT_SPLIT, chunk_rows: int = BYO_ROWS) -> DataFrame:
    """Bring-your-own estimator: one pandas call per (seed, key) unit, or, of a unit with
    more than ``chunk_rows`` test rows, one per part of them of about that size.

    ``fit_predict(train_pdf, test_pdf) -> predictions`` runs inside a cogroup: every call has the
    unit's whole train part (bounded by the few-shot quota) in one order, so that each fits the
    same model; a row's prediction may depend on the train part and that row alone. A unit of
    which a call fails yields no rows (its failure belongs in the status table), others go on.
    """
    keys = list(keys)
    cols = keys + ["row_id", "part", "target"] + list(features)
    parts = parts.select(*cols)
    test = parts.filter(F.col("part") == "test")
    sizes = small_side(test.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("__n")), "byo-sizes")

    def sized(rows: DataFrame) -> DataFrame:
        n = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], "__n")
        return rows.join(n, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(*cols, "__n")

    test = sized(test).withColumn("__chunk", F.pmod(F.xxhash64("row_id"), F.col("__n")).cast("int")).drop("__n")
    train = sized(parts.filter(F.col("part") == "train")).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    train = train.toDF(*train.columns)      # columns of its own: both sides come from one table

    def run(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        train = train.sort_values(["row_id", "target", *features], ignore_index=True).drop(columns="__chunk")
        out = pd.DataFrame({k: test[k].values for k in keys})
        out["model"] = model_name
        out["row_id"] = test["row_id"].values
        try:
            return out.assign(pred=pd.Series(fit_predict(train, test.drop(columns="__chunk"))).astype(str).values, __ok=True)
        except Exception:  # noqa: BLE001 - a failed unit is reported, not raised
            return out.iloc[0:1].assign(pred=None, __ok=False)

    schema = ", ".join(f"{k} {'int' if k == 'seed' else 'string'}" for k in keys) + \
        ", model string, row_id long, pred string"
    done = materialize(train.groupBy(*keys, "__chunk").cogroup(test.groupBy(*keys, "__chunk"))
                       .applyInPandas(run, schema + ", __ok boolean"), "byo")
    failed = small_side(done.filter(~F.col("__ok")).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), "byo-failed")
    return done.filter("__ok").join(failed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti").drop("__ok")


def batch_predict(requests: DataFrame, answer: Callable[[pd.Series], pd.Series],
                  text_col: str = "prompt") -> DataFrame:
    """Run any batch answerer over request rows with ``mapInPandas``.

    ``answer`` receives a pandas Series of prompts per Arrow batch (load the model once
    per partition in the closure) and returns the answer texts; order is kept.
    """
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(requests.schema.fields) + [StructField("text", StringType())])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=pd.Series(answer(pdf[text_col])).astype(str).values)

    return requests.mapInPandas(run, schema)


def spark_ml_model(train: DataFrame, test: DataFrame, features: list[str], kind: str = "RF",
                   seed: int = 0) -> DataFrame:
    """Spark ML baselines by name (RF, LR, GBM, NN) on numeric features.

    One model per call (per key); Spark ML fits are distributed over the train rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                           MultilayerPerceptronClassifier,
                                           RandomForestClassifier)
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    idx = StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc")
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    if kind == "RF":
        est = RandomForestClassifier(numTrees=20, seed=seed)
    elif kind == "LR":
        est = LogisticRegression(maxIter=50)
    elif kind == "GBM":                       # binary targets only (Spark ML limitation)
        est = GBTClassifier(maxIter=20, seed=seed)
    elif kind == "NN":
        n_cls = train.select("target").distinct().count()
        est = MultilayerPerceptronClassifier(layers=[len(features), 16, n_cls], seed=seed)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    fitted_idx = idx.fit(train)
    back = IndexToString(inputCol="prediction", outputCol="pred", labels=fitted_idx.labels)
    model = Pipeline(stages=[fitted_idx, asm, est, back]).fit(train)
    return model.transform(test).select(*[c for c in test.columns if c not in ("target",)], "pred")
