"""Framing, projections and predicates.

A table becomes a supervised task by selecting feature columns and one ``target``; every
other operator here is a column expression or a small join against a lookup table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import EFFORT_ORDER

# ---------------------------------------------------------------- fixed values
# Default evaluation metric per problem type.
DEFAULT_METRIC = {"binary": "f1_macro", "multiclass": "f1_macro", "regression": "rmse"}
# Declared design-skip reasons a skip record may carry.
DESIGN_SKIPS = ("model_limit", "context_window", "empty_split", "empty_split_after_filtering",
                "constant_target", "classification_only")
# Messages and HTTP codes of failures that say nothing about the model.
RETRY_MESSAGES = ("rate limit", "too many requests", "quota", "service unavailable", "bad gateway", "gateway timeout",
                  "connection error", "connection reset", "connection refused", "temporarily unavailable")
RETRY_CODES = (408, 409, 429, 500, 502, 503, 504)
# Parts of field names that are never labels.
NOT_LABELS = ("date", "latitude", "longitude")
# Size, class-count and missingness buckets.
SIZE_BUCKETS = ("≤ 200", "201-1000", "> 1000")
CLASS_BUCKETS = ("Binary", "Multiclass (≤ 10)", "Many (> 10)", "Regression")
NAN_BUCKETS = ("None", "Sparse (≤ 5%)", "Heavy (> 5%)")
# ---------------------------------------------------------------- end of fixed values


def frame_target(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Select the features and rename the curated target column to ``target``."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in table")
    feats = features if features is not None else [c for c in df.columns if c != target]
    return df.select(*feats, F.col(target).alias("target"))


def drop_unlabeled(df: DataFrame, target: str = "target") -> DataFrame:
    """Drop rows whose target is NULL or NaN."""
    c = F.col(target)
    cond = c.isNotNull()
    if dict(df.dtypes).get(target) in ("double", "float"):
        cond = cond & ~F.isnan(c)
    return df.filter(cond)


def multi_target_unpivot(df: DataFrame, ids: list[str], targets: list[str], dataset: str) -> DataFrame:
    """One task per target column: (ids, dataset, target_idx, key, target)."""
    stacked = df.select(*ids, *[F.col(t).cast("string").alias(f"t{i}") for i, t in enumerate(targets)])
    u = stacked.unpivot(ids, [f"t{i}" for i in range(len(targets))], "tname", "target")
    idx = F.substring("tname", 2, 9).cast("int")
    return u.select(*ids, F.lit(dataset).alias("dataset"), idx.alias("target_idx"),
                    key_of(F.lit(dataset), idx).alias("key"), "target")


def key_of(dataset: Column, target_idx: Column) -> Column:
    """``{dataset}_{target_idx}`` with path separators replaced by ``_``."""
    return F.concat(F.regexp_replace(dataset, r"[/\\]", "_"), F.lit("_"), target_idx.cast("string"))


def split_key(key: Column) -> tuple[Column, Column]:
    """P03 inverse: (dataset, target_idx) from ``^(.*)_(\\d+)$``."""
    return (F.regexp_extract(key, r"^(.*)_(\d+)$", 1),
            F.regexp_extract(key, r"^(.*)_(\d+)$", 2).try_cast("int"))


def sparse_feature_fractions(train_long: DataFrame, keys=("key",)) -> DataFrame:
    """P04 helper: missing fraction per (key, feature) over **train** rows (long form)."""
    return train_long.groupBy(*keys, "feature").agg(
        F.avg(F.col("value").isNull().cast("double")).alias("missing_frac"))


def drop_sparse_features(train_long: DataFrame, max_missing: float = 0.5, keys=("key",)) -> DataFrame:
    """Features kept per key — missing in at most ``max_missing`` of train rows."""
    return sparse_feature_fractions(train_long, keys).filter(F.col("missing_frac") <= max_missing) \
        .select(*keys, "feature")


def apply_kept_features(long_df: DataFrame, kept: DataFrame, keys=("key",)) -> DataFrame:
    """Cells of unseen rows in the features that were kept on train, whatever is missing in them here."""
    return long_df.join(kept.select(*keys, "feature"), [*keys, "feature"], "left_semi")


def all_null_features(long_df: DataFrame, keys=("key",)) -> DataFrame:
    """Features whose every value is NULL (dropped)."""
    return long_df.groupBy(*keys, "feature").agg(F.count("value").alias("n")).filter("n = 0") \
        .select(*keys, "feature")


def feature_cap(features: DataFrame, cap: Column | int, seed: int = 0, keys=("key",)) -> DataFrame:
    """Uniform seeded cap — rank features by md5(seed:feature_idx), keep ≤ cap, keep the
    original column order. ``features``: (keys, feature, feature_idx)."""
    keys = list(keys)
    cap_c = cap if isinstance(cap, Column) else F.lit(cap)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("feature_idx").cast("string")))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(h, "feature_idx"))
    return (features.withColumn("__r", r).filter(F.col("__r") <= cap_c).drop("__r")
            .withColumn("kept_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("feature_idx"))))


def effective_cap(registry: DataFrame, default: int) -> DataFrame:
    """Per-dataset ``max_features`` override, else the default."""
    return registry.withColumn("effective_cap", F.coalesce(F.col("max_features"), F.lit(default)))


def binarize_label(df: DataFrame, col: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Collapse values to 1 / 0; values in neither list are dropped."""
    c = F.col(col)
    return (df.withColumn("target", F.when(c.isin(*positive), "1").when(c.isin(*negative), "0"))
            .filter(F.col("target").isNotNull()))


def infer_problem_type(df: DataFrame, target: str = "target", keys=("key",)) -> DataFrame:
    """Per key — a numeric target is regression at any number of values; else up to two
    classes are binary, more are multiclass."""
    numeric = isinstance(df.schema[target].dataType, NumericType)
    n = df.groupBy(*keys).agg(F.countDistinct(target).alias("n_classes"))
    kind = F.when(F.lit(numeric), "regression").when(F.col("n_classes") <= 2, "binary").otherwise("multiclass")
    return n.withColumn("problem_type", kind)


def auto_pick_label(long_meta: DataFrame, min_count: int = 30, max_classes: int = 10,
                    junk: tuple[str, ...] = NOT_LABELS) -> DataFrame:
    """P10: first field (sorted) with 2..max_classes values of ≥ min_count rows, junk names
    skipped; values are trimmed and lower-cased before they are counted. ``long_meta``:
    (row_id, field, value). Returns the chosen field's rows of the classes kept: (row_id,
    field, target). Fails when no field qualifies."""
    v = long_meta.filter(F.col("value").isNotNull() & (F.col("value") != "")).withColumn(
        "value", F.lower(F.trim("value")))
    v = v.filter(~F.lower("field").rlike("(" + "|".join(junk) + ")"))
    big = v.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    ok = big.groupBy("field").agg(F.count(F.lit(1)).alias("k")).filter(
        (F.col("k") >= 2) & (F.col("k") <= max_classes))
    chosen = ok.agg(F.coalesce(F.min("field"), F.raise_error(F.lit("no field yields 2 or more big classes")).cast("string"))
                    .alias("field"))
    keep = big.join(chosen, "field")
    return v.join(keep.select("field", "value"), ["field", "value"]).select(
        "row_id", "field", F.col("value").alias("target"))


def active_registry(registry: DataFrame, problem_type: str | None = None) -> DataFrame:
    """Enabled and curated (target + problem type set), optionally one problem type."""
    r = registry.filter(F.col("enabled") & F.col("target").isNotNull() & F.col("problem_type").isNotNull())
    return r.filter(F.col("problem_type") == problem_type) if problem_type else r


def exclude_units(units: DataFrame, keys: list[str], datasets: list[str], targets: DataFrame) -> DataFrame:
    """Units excluded by exact key, by dataset, or by target name (``targets``: key)."""
    ds = split_key(F.col("key"))[0]
    flag = F.col("key").isin(*keys) | ds.isin(*datasets) if (keys or datasets) else F.lit(False)
    ex_t = targets.select("key").distinct().withColumn("__t", F.lit(True))
    return units.join(ex_t, "key", "left").withColumn(
        "excluded", flag | F.coalesce(F.col("__t"), F.lit(False))).drop("__t")


def reject_continuous(preds: DataFrame, unit=("seed", "key", "model"), pred: str = "pred") -> DataFrame:
    """Classification units whose predictions are non-integral numbers."""
    v = F.col(pred).try_cast("double")
    return preds.groupBy(*unit).agg(F.bool_or(v.isNotNull() & (v != F.floor(v))).alias("continuous"))


def drop_design_skips(units: DataFrame, status: DataFrame, unit=("seed", "key", "model")) -> DataFrame:
    """Units without those whose status record is a declared design skip."""
    skips = status.filter((F.col("status") == "skip") & F.col("reason").isin(*DESIGN_SKIPS)).select(*unit)
    return units.join(skips, list(unit), "left_anti")


def error_taxonomy(errors: DataFrame, error: str = "error") -> DataFrame:
    """Map an error text to (status, reason); the first rule that matches wins.

    A retry is not terminal: the failure says nothing about the model. A time limit that all
    models share (``cell_timeout``) and unusable answers are failures."""
    e = F.lower(F.col(error))
    codes = r"(^|http |code:? ?|status:? ?)(" + "|".join(map(str, RETRY_CODES)) + r")\b"
    rules = [(e.contains("train set will be empty"), "skip", "empty_split_after_filtering"),
             (e.contains("context") & e.rlike("length|window"), "skip", "context_window"),
             (e.startswith("unparseable"), "fail", "unparseable_responses"),
             (e.startswith("cell_timeout"), "fail", "cell_timeout"),
             (e.rlike("|".join(RETRY_MESSAGES)) | e.rlike(codes), "retry", "infrastructure_error")]
    found = F.struct(F.lit("fail").alias("status"), F.lit("fit_error").alias("reason"))
    for matches, status, reason in reversed(rules):
        found = F.when(matches, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(found)
    return errors.withColumn("__found", found).select(*errors.columns, "__found.status", "__found.reason")


def model_family(models: DataFrame, exact: DataFrame, rules: list[tuple[str, str]],
                 default: str = "Other", col: str = "model") -> DataFrame:
    """P20: exact map (joined), then the first rule whose token prefixes a part of the id
    (split on ``-_/: .``), then the default."""
    parts = F.split(F.lower(F.col(col)), r"[-_/:. ]")
    expr = None
    def starts(t):
        return lambda p: p.startswith(t)

    for token, fam in rules:
        cond = F.exists(parts, starts(token))
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    rule = expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)
    j = models.join(exact.withColumnRenamed("family", "__exact"), col, "left")
    return j.withColumn("family", F.coalesce("__exact", rule)).drop("__exact")


def profile_buckets(df: DataFrame, n_col: str = "n_samples", k_col: str = "n_classes",
                    nan_col: str = "missing_frac", task_col: str = "task") -> DataFrame:
    """Size, class-count and missingness buckets."""
    n, k, m = F.col(n_col), F.col(k_col), F.col(nan_col)
    size = F.when(n <= 200, SIZE_BUCKETS[0]).when(n <= 1000, SIZE_BUCKETS[1]).when(n > 1000, SIZE_BUCKETS[2])
    cls = (F.when(F.col(task_col) == "regression", CLASS_BUCKETS[3]).when(k <= 2, CLASS_BUCKETS[0])
           .when(k <= 10, CLASS_BUCKETS[1]).when(k > 10, CLASS_BUCKETS[2]))
    nan = F.when(m <= 0, NAN_BUCKETS[0]).when(m <= 0.05, NAN_BUCKETS[1]).when(m > 0.05, NAN_BUCKETS[2])
    return df.withColumn("size_bucket", size).withColumn("class_bucket", cls).withColumn("nan_bucket", nan)


def suite_tag(df: DataFrame, col: str = "dataset") -> DataFrame:
    """``synthetic`` for ``synthetic_`` names, else ``real``."""
    return df.withColumn("suite", F.when(F.col(col).startswith("synthetic_"), "synthetic").otherwise("real"))


def snap_level(df: DataFrame, requested: str, supported: str) -> DataFrame:
    """P25: nearest supported level on the ordinal effort scale (tie: the lower level)."""
    order = F.array(*[F.lit(x) for x in EFFORT_ORDER])
    rp = F.array_position(order, F.col(requested))
    scored = F.transform(F.col(supported), lambda s: F.struct(
        F.abs(F.array_position(order, s) - rp).alias("d"), F.array_position(order, s).alias("p"),
        s.alias("s")))
    return df.withColumn("snapped", F.array_min(scored)["s"])


def resolved_metric(registry: DataFrame) -> DataFrame:
    """Explicit eval metric, else the default for the problem type."""
    m = F.create_map(*[x for kv in DEFAULT_METRIC.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return registry.withColumn("metric", F.coalesce(F.col("eval_metric"), m[F.col("problem_type")]))


def feature_counts(long_df: DataFrame, keys=("key",)) -> DataFrame:
    """Native feature count per key (long form)."""
    return long_df.groupBy(*keys).agg(F.countDistinct("feature").alias("n_features"))


def limit_skip(units: DataFrame, limits: DataFrame) -> DataFrame:
    """Skip a unit when raw features > max_features **and** n_train > max_samples.

    ``limits``: (model, max_features, max_samples) — one row per model."""
    j = units.join(limits, "model", "left")
    over = (F.col("n_features") > F.col("max_features")) & (F.col("n_train") > F.col("max_samples"))
    return j.withColumn("skip", F.coalesce(over, F.lit(False)))


def degenerate_split_skip(parts: DataFrame, task: str = "task", keys=("seed", "key")) -> DataFrame:
    """Empty train/test part or constant train target → skip reason."""
    s = parts.groupBy(*keys).agg(
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if(F.col("part") == "test").alias("n_test"),
        F.countDistinct(F.when(F.col("part") == "train", F.col("target"))).alias("train_classes"))
    reason = (F.when((F.col("n_train") == 0) | (F.col("n_test") == 0), "empty_split")
              .when(F.col("train_classes") < 2, "constant_target"))
    return s.withColumn("skip_reason", reason)


def reason_check(status: DataFrame) -> DataFrame:
    """Skip records whose reason is not a declared design skip."""
    return status.filter((F.col("status") == "skip") & ~F.col("reason").isin(*DESIGN_SKIPS))
