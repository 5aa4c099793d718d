"""Feature preparation (T01-T05) and label derivation.

Fill values and scalers are fitted on the **train** part only (a grouped aggregate per
(seed, key)) and joined back to both parts; the label is never touched. Label rules are
plain column expressions applied to the user's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import exact_percentile

NAN_POLICIES = ("native", "none", "median", "mean", "zero")
DEFAULT_NAN_POLICY = "native"
UNIT = ["seed", "key"]


def nan_policy_resolve(models: DataFrame, policies: DataFrame) -> DataFrame:
    """Explicit per-model policy, else the ``default`` row, else ``native``.

    ``policies``: (model, nan_policy) with an optional ``model = 'default'`` row (one row,
    so the left join with it is a broadcast of a single value).
    """
    default = policies.filter(F.col("model") == "default").select(F.col("nan_policy").alias("__d"))
    explicit = policies.filter(F.col("model") != "default")
    d = default.agg(F.first("__d").alias("__d"))
    j = models.join(explicit, "model", "left")
    return j.withColumn("nan_policy", F.coalesce(F.col("nan_policy"), F.lit(d.scalar()),
                                                 F.lit(DEFAULT_NAN_POLICY)))


def impute_fills(train: DataFrame, features: list[str], policy: str, keys=UNIT) -> DataFrame:
    """``(keys, fills)``, a map from each feature to the median or mean of its values; null and NaN are missing.

    One plan for any number of features: the rows are unpivoted to (keys, feature, value), whose
    histograms are combined map-side, and all medians are looked up together."""
    keys = list(keys)
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
    long = train.select(*keys, *doubles).unpivot(keys, [f"`{c}`" for c in features], "__feature", "__value") \
        .filter(F.col("__value").isNotNull() & ~F.isnan("__value"))
    g = [*keys, "__feature"]
    fills = exact_percentile(long, g, "__value", 0.5, "__fill") if policy == "median" else \
        long.groupBy(*g).agg(F.avg("__value").alias("__fill"))
    return fills.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__feature", "__fill"))).alias("fills"))


def impute(parts: DataFrame, features: list[str], policy: str, keys=UNIT) -> DataFrame:
    """Fill missing features (null or NaN) from train statistics (median / mean / zero); the same fill
    on test rows. ``native`` / ``none`` leave the data as is; a feature without any train value stays missing."""
    if policy in ("native", "none"):
        return parts
    if policy not in NAN_POLICIES:
        raise ValueError(f"unknown nan policy {policy!r}")
    if policy == "zero":
        return parts.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
                                  for c in features})
    keys = list(keys)
    fills = impute_fills(parts.filter(F.col("part") == "train"), features, policy, keys)
    present = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in features}
    return parts.join(fills, keys, "left").withColumns(
        {c: F.coalesce(present[c], F.try_element_at("fills", F.lit(c))) for c in features}).drop("fills")


def standardize_target(parts: DataFrame, y: str = "y", keys=UNIT) -> DataFrame:
    """y_std = (y − train mean) / train sample std (std 0 or NULL → 1); keeps mu, sd
    so predictions can be mapped back with ``pred·sd + mu``."""
    keys = list(keys)
    st = parts.filter(F.col("part") == "train").groupBy(*keys).agg(
        F.avg(y).alias("mu"), F.stddev_samp(y).alias("__sd"))
    st = st.withColumn("sd", F.when(F.coalesce(F.col("__sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("__sd"))) \
        .drop("__sd")
    return parts.join(st, keys).withColumn("y_std", (F.col(y) - F.col("mu")) / F.col("sd"))


def unstandardize(pred: Column, mu: Column, sd: Column) -> Column:
    return pred * sd + mu


def log1p_matrix(long_df: DataFrame, value: str = "value") -> DataFrame:
    """log1p of every matrix value (long form)."""
    return long_df.withColumn(value, F.log1p(F.col(value)))


def missing_fraction(long_df: DataFrame, keys=("key",), value: str = "value") -> DataFrame:
    """Missing cells / (rows × features) per key, in long form."""
    return long_df.groupBy(*keys).agg(
        (F.count_if(F.col(value).isNull()) / F.count(F.lit(1))).alias("missing_frac"))


def inject_nulls(df: DataFrame, cols: list[str], salt: str, id_col: str = "row_id",
                 rate_hex: str = "1") -> DataFrame:
    """Deterministic missing values: a cell is NULL when md5(salt:col:id) < rate_hex
    (first hex digit), i.e. ~1/16 per hex step."""
    for c in cols:
        h = F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.lit(c), F.col(id_col).cast("string"))), 1, 1)
        df = df.withColumn(c, F.when(h < F.lit(rate_hex), F.lit(None).cast("double")).otherwise(F.col(c)))
    return df


# ---------------------------------------------------------------- labels
def label_median_split(df: DataFrame, score: str, keys=("key",)) -> DataFrame:
    """label = score > median(score) per group (balanced binary); exact median."""
    med = exact_percentile(df.select(*keys, score), list(keys), score, 0.5, "__med")
    return df.join(med, list(keys)).withColumn("label", (F.col(score) > F.col("__med")).cast("int")) \
        .drop("__med")


def label_quantile(df: DataFrame, score: str, q: float = 0.9, keys=("key",)) -> DataFrame:
    """Imbalanced label = score > q-quantile per group (exact, interpolated)."""
    thr = exact_percentile(df.select(*keys, score), list(keys), score, q, "__thr")
    return df.join(thr, list(keys)).withColumn("label", (F.col(score) > F.col("__thr")).cast("int")) \
        .drop("__thr")


def label_flip(df: DataFrame, label: str, rate: float, seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """Flip a 0/1 label when the md5(seed:id) number falls below rate·16^8."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 8),
               16, 10).cast("bigint")
    thr = int(rate * 16 ** 8)
    return df.withColumn(label, F.when(h < F.lit(thr), 1 - F.col(label)).otherwise(F.col(label)))


def rule_xor(a: Column, b: Column) -> Column:
    """Parity of two signs."""
    return ((a > 0).cast("int") + (b > 0).cast("int")) % 2


def rule_parity(cols: list[Column]) -> Column:
    """Parity of several signs."""
    s = F.lit(0)
    for c in cols:
        s = s + (c > 0).cast("int")
    return s % 2


def rule_checker(a: Column, b: Column, cell: float) -> Column:
    """Checkerboard cell parity: (floor(a/cell) + floor(b/cell)) mod 2."""
    return F.pmod(F.floor(a / cell) + F.floor(b / cell), F.lit(2)).cast("int")


def rule_ring(a: Column, b: Column, r: float) -> Column:
    """Inside a ring of radius r."""
    return (F.sqrt(a * a + b * b) < r).cast("int")


def score_linear(vec: Column, weights: list[float]) -> Column:
    """Weighted linear score of an array column: Σ w_i x_i via zip_with / aggregate."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vec, w, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def score_additive(a: Column, b: Column, c: Column) -> Column:
    """An additive nonlinear score: sin(a) + |b| + tanh(c)^2."""
    return F.sin(a) + F.abs(b) + F.pow(F.tanh(c), 2)
