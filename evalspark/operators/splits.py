"""Class space, splits and sampling.

Splits are a long table ``(key, seed, row_id, part)``; features are never copied per
split. All draws are ``md5(seed:row_id)`` orders (deterministic, retry-safe, and
reproducible in SQL). Ranks inside (possibly huge) groups use
:func:`evalspark.functions.hashing.hash_rank`, which never sorts a whole group in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side
from ..functions.hashing import bucket_cumsum, hash_rank, hash_threshold, order_bucket, seeded_hash, within_threshold


def _keys(key_cols) -> list[str]:
    return [key_cols] if isinstance(key_cols, str) else list(key_cols)


# ------------------------------------------------------------------ class space
def class_counts(df: DataFrame, key_cols=("key",), cls: str = "target") -> DataFrame:
    """(keys, class, cnt): one partial hash aggregate over the rows."""
    return df.groupBy(*_keys(key_cols), cls).agg(F.count(F.lit(1)).alias("cnt"))


def rare_class_filter(df: DataFrame, min_samples: int = 10, key_cols=("key",),
                      cls: str = "target") -> DataFrame:
    """Drop classes with fewer than ``min_samples`` rows; drop keys left with < 2 classes."""
    keys = _keys(key_cols)
    kept = class_counts(df, keys, cls).filter(F.col("cnt") >= min_samples)
    good_keys = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").drop("k")
    kept = small_side(kept.join(good_keys, keys, "left_semi").select(*keys, cls), "kept-classes")
    return df.join(kept, keys + [cls], "left_semi")


def limit_classes(df: DataFrame, max_classes: int, key_cols=("key",),
                  cls: str = "target") -> DataFrame:
    """Keep the ``max_classes`` most frequent classes per key (tie: label asc)."""
    keys = _keys(key_cols)
    w = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), F.col(cls))
    top = (class_counts(df, keys, cls).withColumn("r", F.row_number().over(w))
           .filter(F.col("r") <= max_classes).select(*keys, cls))
    return df.join(top, keys + [cls], "left_semi")


def refilter_cached(parts: DataFrame, min_samples: int = 10, subsampled: bool = False,
                    key_cols=("key", "seed"), cls: str = "target") -> DataFrame:
    """Re-apply the rare-class filter on train ∪ test of a cached split.

    Counts are taken over both parts together; a subsampled split is returned unchanged.
    """
    if subsampled:
        return parts
    return rare_class_filter(parts, min_samples, key_cols, cls)


# ------------------------------------------------------------------ split indices
def split_indices(spark, n_repetitions: int | None, cv_folds: int | None,
                  random_state: int = 0) -> DataFrame:
    """The seed list: k×repeats fold indices, holdout repeats, or the single seed."""
    if cv_folds is not None:
        n = cv_folds * (n_repetitions if n_repetitions is not None else 1)
        df = spark.range(n).select(F.col("id").cast("int").alias("seed"))
        return df.select("seed", (F.col("seed") / cv_folds).cast("int").alias("repeat"),
                         (F.col("seed") % cv_folds).alias("fold"))
    if n_repetitions is not None:
        df = spark.range(n_repetitions).select(F.col("id").cast("int").alias("seed"))
    else:
        df = spark.range(1).select(F.lit(random_state).cast("int").alias("seed"))
    return df.select("seed", F.lit(None).cast("int").alias("repeat"),
                     F.lit(None).cast("int").alias("fold"))


def with_seeds(df: DataFrame, seeds) -> DataFrame:
    """Replicate rows once per seed (seeds: list of ints)."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


# ------------------------------------------------------------------ quotas
def largest_remainder_quota(counts: DataFrame, keys: list[str], cls: str,
                            take: Column) -> DataFrame:
    """Split ``take`` rows over classes proportionally: floors, then +1 by largest remainder.

    ``counts`` is the small (keys, class, cnt) table; integer arithmetic only, so every
    engine gets the same quotas. Tie on remainder: label ascending.
    """
    wk = Window.partitionBy(*keys)
    c = (counts.withColumn("__n", F.sum("cnt").over(wk))
         .withColumn("__take", take.cast("long"))
         .withColumn("__num", F.col("__take") * F.col("cnt"))
         .withColumn("__q0", F.floor(F.col("__num") / F.col("__n")).cast("long"))
         .withColumn("__rem", F.col("__num") - F.col("__q0") * F.col("__n"))
         .withColumn("__extra", F.col("__take") - F.sum("__q0").over(wk)))
    r = F.row_number().over(wk.orderBy(F.col("__rem").desc(), F.col(cls)))
    return (c.withColumn("__r", r)
            .withColumn("quota", (F.col("__q0") + F.when(F.col("__r") <= F.col("__extra"), 1)
                                  .otherwise(0)).cast("long"))
            .drop("__n", "__take", "__num", "__q0", "__rem", "__extra", "__r"))


def first_by_hash(rows: DataFrame, groups: list[str], quotas: DataFrame, id_col: str, order_hex: str = "__h") -> DataFrame:
    """Adds ``chosen``: whether a row is among the first ``quota`` of its group by ``order_hex``.

    The group's threshold is selected from histograms (:func:`hash_threshold`) and written; every row
    is then decided by comparison, where it lies: the rows are neither sorted nor shuffled."""
    cuts = small_side(hash_threshold(rows, groups, order_hex, id_col, quotas), "thresholds")
    return rows.join(cuts, groups).withColumn("chosen", within_threshold(order_hex, id_col)).drop("__th", "__tid", "quota")


# ------------------------------------------------------------------ holdout
def holdout_stratified(df: DataFrame, seeds, test_size: float = 0.2, key_cols=("key",),
                       cls: str = "target", id_col: str = "row_id", keep=()) -> DataFrame:
    """Stratified holdout; ``ceil(n·test_size)`` test rows per key, class quotas by
    largest remainder, rows drawn by ``md5(seed:row_id)`` within (key, seed, class).

    ``keep`` carries extra columns (e.g. features) through, so callers need no join back.
    """
    keys = _keys(key_cols)
    counts = class_counts(df, keys, cls)
    n = F.sum("cnt").over(Window.partitionBy(*keys))
    quotas = largest_remainder_quota(counts, keys, cls, F.ceil(n * F.lit(test_size)))
    rows = with_seeds(df.select(*keys, cls, id_col, *keep), seeds) \
        .withColumn("__h", seeded_hash("seed", id_col))
    drawn = first_by_hash(rows, keys + ["seed", cls], with_seeds(quotas.select(*keys, cls, "quota"), seeds), id_col)
    return drawn.select(*keys, "seed", id_col, F.when(F.col("chosen"), "test").otherwise("train").alias("part"),
                        *([cls] if keep else []), *keep)


def holdout_plain(df: DataFrame, seeds, test_size: float = 0.2, key_cols=("key",),
                  id_col: str = "row_id", keep=()) -> DataFrame:
    """C05 (regression): ``ceil(n·test_size)`` rows per key by md5 order; ``keep`` carries
    extra columns through."""
    keys = _keys(key_cols)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_size)).alias("quota"))
    rows = with_seeds(df.select(*keys, id_col, *keep), seeds).withColumn("__h", seeded_hash("seed", id_col))
    drawn = first_by_hash(rows, keys + ["seed"], with_seeds(sizes, seeds), id_col)
    return drawn.select(*keys, "seed", id_col, F.when(F.col("chosen"), "test").otherwise("train").alias("part"), *keep)


# ------------------------------------------------------------------ k-fold
def kfold_stratified(df: DataFrame, k: int, repeats: int = 1, key_cols=("key",),
                     cls: str = "target", id_col: str = "row_id", check_min_class: bool = True) -> DataFrame:
    """Stratified k-fold. Seed g → (repeat, fold) = divmod(g, k).

    Within (key, repeat, class) rows are ranked by md5(repeat:id); a row's fold is
    ``(rank - 1 + offset) % k`` with offset = rows of earlier classes, so fold sizes and
    per-class fold counts differ by at most one and every row is tested once per repeat.
    """
    keys = _keys(key_cols)
    counts = class_counts(df, keys, cls)
    if check_min_class:
        # a class smaller than k cannot appear in every fold (the reference refuses it)
        bad = counts.filter(F.col("cnt") < k).select(*keys, cls).limit(1).collect()
        if bad:
            raise ValueError(f"smallest class has fewer than k={k} rows: {bad[0].asDict()}")
    wprev = Window.partitionBy(*keys).orderBy(cls).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("cnt").over(wprev), F.lit(0))) \
        .select(*keys, cls, "offset")
    rows = df.select(*keys, cls, id_col).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("__h", seeded_hash("repeat", id_col))
    ranked = hash_rank(rows, keys + ["repeat", cls], "__h", id_col).join(offsets, keys + [cls])
    folded = ranked.withColumn("row_fold", ((F.col("rn") - 1 + F.col("offset")) % k).cast("int"))
    return _expand_folds(folded, k, keys, id_col)


def kfold_plain(df: DataFrame, k: int, repeats: int = 1, key_cols=("key",),
                id_col: str = "row_id") -> DataFrame:
    """K-fold without strata: fold = (rank - 1) % k by md5(repeat:id)."""
    keys = _keys(key_cols)
    rows = df.select(*keys, id_col).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("__h", seeded_hash("repeat", id_col))
    ranked = hash_rank(rows, keys + ["repeat"], "__h", id_col)
    folded = ranked.withColumn("row_fold", ((F.col("rn") - 1) % k).cast("int"))
    return _expand_folds(folded, k, keys, id_col)


def _expand_folds(folded: DataFrame, k: int, keys: list[str], id_col: str) -> DataFrame:
    out = folded.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.select(*keys, (F.col("repeat") * k + F.col("fold")).cast("int").alias("seed"),
                      id_col, F.when(F.col("fold") == F.col("row_fold"), "test")
                      .otherwise("train").alias("part"))


def group_ids(long_df: DataFrame, key_cols=("key",), id_col: str = "row_id",
              feature: str = "feature", value: str = "value") -> DataFrame:
    """Rows with identical non-zero values share a group; all-zero rows are singletons.

    Input is long form (keys, row_id, feature, value). The signature is the number of
    non-zero (feature, value) pairs and the sums of the four words of their md5, which do not
    depend on their order: one hash aggregate of five numbers a row, no list that is held or
    sorted. The group is named by its smallest row id. Rows without a key or id are left out.
    Output: (keys, row_id, group_id, group_size).
    """
    keys = _keys(key_cols)
    pair = F.md5(F.to_json(F.struct(F.col(feature).cast("string").alias("f"), F.col(value).alias("v"))))
    known = long_df.dropna(subset=[*keys, id_col]).withColumn("__p", F.when(F.col(value) != 0, pair))
    part = lambda i: F.conv(F.substring("__p", 8 * i + 1, 8), 16, 10).cast("long")
    rows = known.groupBy(*keys, id_col).agg(F.count("__p").alias("__n"), *(F.sum(part(i)).alias(f"__s{i}") for i in range(4)))
    rows = rows.select(*keys, id_col, F.when(F.col("__n") > 0, F.concat_ws(",", "__n", *(f"__s{i}" for i in range(4)))).otherwise(
        F.concat(F.lit("__unique_"), F.col(id_col).cast("string"))).alias("sig"))
    rows = materialize(rows, "signatures")
    # group name and size by a partial aggregate joined back (a hot signature is a skewed
    # join key, which AQE splits) rather than a window that holds the group in one task
    g = small_side(rows.groupBy(*keys, "sig").agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return rows.join(g, keys + ["sig"]).select(*keys, id_col, "group_id", "group_size")


def kfold_grouped(groups: DataFrame, k: int, key_cols=("key",), id_col: str = "row_id",
                  seeds=None) -> DataFrame:
    """Group k-fold. Groups are ranked by size desc (tie: group id) and dealt to the
    k folds in serpentine order; disjoint, complete, and the fold sizes differ by at most
    the largest group. Only the (group, size) table is ranked, in buckets of size and group
    id, so that a key of many groups is never sorted in one task. A key with
    fewer than k groups falls back to the plain k-fold (C07) over its rows."""
    keys = _keys(key_cols)
    g = groups.select(*keys, "group_id", "group_size").distinct()
    ng = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ng"))
    few = small_side(ng.filter(F.col("__ng") < k).select(*keys), "few-groups")
    gid = F.col("group_id")
    by_id = F.substring(gid, 1, 3) if dict(g.dtypes)["group_id"] == "string" else order_bucket(gid, 1024)
    pos = (F.col("__rn") - 1) % (2 * k)
    g = bucket_cumsum(g.join(few, keys, "left_anti"), keys, F.struct((-F.col("group_size")).alias("s"), by_id.alias("i")),
                      [F.col("group_size").desc(), gid], out="__rn").withColumn(
        "row_fold", F.when(pos < k, pos).otherwise(2 * k - 1 - pos).cast("int"))
    rows = groups.select(*keys, id_col, "group_id").join(small_side(g.select(*keys, "group_id", "row_fold"), "group-folds"),
                                                         keys + ["group_id"])
    dealt = _expand_folds(rows.withColumn("repeat", F.lit(0)), k, keys, id_col)
    plain = kfold_plain(groups.select(*keys, id_col).join(few, keys, "left_semi"), k, 1, keys, id_col)
    return dealt.unionByName(plain)


def holdout_grouped(groups: DataFrame, seeds, test_size: float = 0.2, key_cols=("key",),
                    id_col: str = "row_id") -> DataFrame:
    """Grouped holdout — ``ceil(test_size · n_groups)`` groups by md5(seed:group) go
    to test, so co-measured rows never straddle the split."""
    keys = _keys(key_cols)
    g = groups.select(*keys, "group_id").distinct()
    ng = g.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_size)).alias("quota"))
    gs = with_seeds(g, seeds).withColumn("__h", seeded_hash("seed", "group_id"))
    chosen = small_side(first_by_hash(gs, keys + ["seed"], with_seeds(ng, seeds), "group_id").select(
        *keys, "seed", "group_id", F.when(F.col("chosen"), "test").otherwise("train").alias("part")), "group-parts")
    return (groups.select(*keys, id_col, "group_id").join(chosen, keys + ["group_id"])
            .select(*keys, "seed", id_col, "part"))


# ------------------------------------------------------------------ few-shot (C11-C14)
def fewshot_quota(counts: DataFrame, n: int, key_cols=("key",), cls: str = "target") -> DataFrame:
    """C11: stratified few-shot quota per class.

    Classes are ordered by count desc (tie: label asc). n ≥ total → all rows. n ≤ k → one
    row for each of the n largest classes. Otherwise 1 + floor(cnt/total·(n−k)) capped at
    cnt, and the deficit is dealt round-robin (at most ten rounds) to classes that still
    have spare rows, largest first — computed in closed form as slots (round, rank).
    """
    keys = _keys(key_cols)
    wk = Window.partitionBy(*keys)
    c = (counts.withColumn("__rank", F.row_number().over(wk.orderBy(F.col("cnt").desc(), F.col(cls))) - 1)
         .withColumn("__k", F.count(F.lit(1)).over(wk))
         .withColumn("__total", F.sum("cnt").over(wk)))
    base = F.least(F.lit(1) + F.floor(F.col("cnt") / F.col("__total") * (F.lit(n) - F.col("__k"))),
                   F.col("cnt")).cast("long")
    c = c.withColumn("__base", F.when(F.col("__total") <= n, F.col("cnt"))
                     .when(F.lit(n) <= F.col("__k"),
                           F.when(F.col("__rank") < n, 1).otherwise(0))
                     .otherwise(base).cast("long"))
    c = c.withColumn("__deficit", F.when((F.col("__total") > n) & (F.lit(n) > F.col("__k")),
                                         F.lit(n) - F.sum("__base").over(wk)).otherwise(0))
    spare = F.least(F.col("cnt") - F.col("__base"), F.lit(10))
    slots = (c.filter(spare > 0).select(*keys, cls, "__rank", "__k", "__deficit",
                                        F.explode(F.sequence(F.lit(0), spare - 1)).alias("__round"))
             .filter(F.col("__deficit") > 0))
    # the round-robin walks i = round·k + rank and stops after 10·k steps
    ws = Window.partitionBy(*keys).orderBy("__round", "__rank")
    got = (slots.withColumn("__slot", F.row_number().over(ws))
           .filter(F.col("__slot") <= F.col("__deficit"))
           .groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("__add")))
    return (c.join(got, keys + [cls], "left")
            .select(*keys, cls, "cnt", (F.col("__base") + F.coalesce("__add", F.lit(0))).alias("quota")))


def subsample_parts(parts: DataFrame, n_train: int | None, n_test: int | None,
                    key_cols=("key", "seed"), cls: str = "target",
                    id_col: str = "row_id") -> DataFrame:
    """Apply the few-shot quota separately to the train and the test part.

    Same rows for every model (the draw depends on seed and row id only).
    """
    keys = _keys(key_cols)
    out = []
    for part, n in (("train", n_train), ("test", n_test)):
        p = parts.filter(F.col("part") == part)
        if n is None:
            out.append(p)
            continue
        q = fewshot_quota(class_counts(p, keys, cls), n, keys, cls)
        h = p.withColumn("__h", seeded_hash("seed", id_col)) if "seed" in p.columns \
            else p.withColumn("__h", F.md5(F.col(id_col).cast("string")))
        out.append(first_by_hash(h, keys + [cls], q, id_col).filter("chosen").select(*parts.columns))
    return out[0].unionByName(out[1])


def sample_exact(df: DataFrame, n: int, seed: int = 0, key_cols=("key",),
                 id_col: str = "row_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows per key by md5(seed:id) — unlike ``sample()``,
    whose size is random."""
    keys = _keys(key_cols)
    h = df.withColumn("__h", seeded_hash(F.lit(seed), id_col))
    quotas = df.select(*keys).distinct().withColumn("quota", F.lit(n))
    return first_by_hash(h, keys, quotas, id_col).filter("chosen").select(*df.columns)


def seeded_shuffle(df: DataFrame, seed: int = 0, key_cols=("key",),
                   id_col: str = "row_id") -> DataFrame:
    """C14: a seeded permutation: adds ``pos`` = 1-based position by md5(seed:id) per key."""
    keys = _keys(key_cols)
    h = df.withColumn("__h", seeded_hash(F.lit(seed), id_col))
    return hash_rank(h, keys, "__h", id_col, out="pos").drop("__h")


# ------------------------------------------------------------------ audit
def split_audit(splits: DataFrame, rows: DataFrame, key_cols=("key",),
                id_col: str = "row_id") -> DataFrame:
    """Per (key, seed): rows, test rows, rows missing from / duplicated in the split,
    and (for k-fold) times each row was tested across a repeat is checked separately."""
    keys = _keys(key_cols)
    seeds = splits.select(*keys, "seed").distinct()
    expected = rows.select(*keys, id_col).join(seeds, keys)
    per_row = splits.groupBy(*keys, "seed", id_col).agg(F.count(F.lit(1)).alias("n"))
    j = expected.join(per_row, keys + ["seed", id_col], "full_outer")
    return j.groupBy(*keys, "seed").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("n").isNull()).alias("n_missing"),
        F.count_if(F.col("n") > 1).alias("n_duplicated"))
