"""Split guarantees: sizes, disjointness, completeness, quotas, determinism."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions.hashing import hash_rank, seeded_hash
from evalspark.operators import splits as S


@pytest.fixture(scope="module")
def rows(spark):
    data = [("k1", i, ["a", "b", "c"][i % 3] if i < 90 else "d") for i in range(100)] + \
           [("k2", i, "x" if i % 4 else "y") for i in range(40)]
    return spark.createDataFrame(data, "key string, row_id long, target string")


def test_hash_rank_equals_plain_window(spark, rows):
    df = S.with_seeds(rows, [0, 1]).withColumn("h", seeded_hash("seed", "row_id"))
    a = hash_rank(df, ["key", "seed", "target"], "h", "row_id", digits=1)
    w = Window.partitionBy("key", "seed", "target").orderBy("h", "row_id")
    b = df.withColumn("rn", F.row_number().over(w).cast("long"))
    cols = ["key", "seed", "row_id", "rn"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_stratified_holdout_sizes_and_determinism(spark, rows):
    sp = S.holdout_stratified(rows, [0, 1], 0.2)
    sizes = {(r["key"], r["seed"]): r["n"] for r in
             sp.filter("part = 'test'").groupBy("key", "seed").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[("k1", 0)] == math.ceil(100 * 0.2) and sizes[("k2", 1)] == math.ceil(40 * 0.2)
    assert sp.count() == 2 * 140 and sp.select("key", "seed", "row_id").distinct().count() == 280
    again = S.holdout_stratified(rows, [0, 1], 0.2)
    assert sorted(sp.collect()) == sorted(again.collect())
    a = set(r["row_id"] for r in sp.filter("key='k1' AND seed=0 AND part='test'").collect())
    b = set(r["row_id"] for r in sp.filter("key='k1' AND seed=1 AND part='test'").collect())
    assert a != b


def test_kfold_each_row_tested_once_per_repeat(spark, rows):
    f = S.kfold_stratified(rows.filter("target <> 'd'"), 5, repeats=2)
    per = f.filter("part = 'test'").withColumn("repeat", (F.col("seed") / 5).cast("int")) \
        .groupBy("key", "repeat", "row_id").count()
    assert per.filter("count <> 1").count() == 0
    sizes = [r["n"] for r in f.filter("part='test' AND key='k1'").groupBy("seed").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [2, 3, 4, 10, 200])
def test_fewshot_quota_sums_to_n(spark, rows, n):
    q = S.fewshot_quota(S.class_counts(rows.filter("key = 'k1'")), n)
    got = {r["target"]: r["quota"] for r in q.collect()}
    assert sum(got.values()) == min(n, 100)
    if n <= 4:
        assert sorted(got.values(), reverse=True)[:n] == [1] * n
    else:
        assert all(v >= 1 for v in got.values())


def test_rare_class_filter_drops_small_and_single_class_keys(spark, rows):
    out = S.rare_class_filter(rows, min_samples=11)
    assert {r["target"] for r in out.filter("key='k1'").collect()} == {"a", "b", "c"}
    assert out.filter("key='k2'").count() == 0     # 'y' has 10 rows -> one class left -> key dropped
    assert S.rare_class_filter(rows, min_samples=10).filter("key='k2'").count() == 40


def test_group_kfold_disjoint_groups(spark):
    long = spark.createDataFrame(
        [("k", i, "f", float(i // 3)) for i in range(30)] + [("k", 100 + i, "f", 0.0) for i in range(4)],
        "key string, row_id long, feature string, value double")
    g = S.group_ids(long)
    assert g.filter("row_id >= 100").select("group_id").distinct().count() == 4
    folds = S.kfold_grouped(g, 3).filter("part = 'test'").join(g, ["key", "row_id"])
    per_group = folds.groupBy("group_id").agg(F.countDistinct("seed").alias("n"))
    assert per_group.filter("n <> 1").count() == 0
    assert folds.count() == 34


def test_sample_exact_size(spark, rows):
    assert S.sample_exact(rows, 7).filter("key='k1'").count() == 7


def test_exact_median_matches_numpy(spark):
    import numpy as np
    from evalspark.functions.hashing import exact_median
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 101), ("b", 100), ("c", 1), ("d", 2)):
        vals = np.round(rng.exponential(5.0, n), 2)
        vals[: n // 5] = 0.0 if g == "a" else vals[: n // 5]
        rows += [(g, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    for g in "abcd":
        want = float(np.median([v for gg, v in rows if gg == g]))
        assert got[g] == pytest.approx(want)


def test_exact_percentile_with_negatives(spark):
    import numpy as np
    from evalspark.functions.hashing import exact_percentile
    rng = np.random.default_rng(5)
    vals = np.round(rng.normal(0, 100, 257), 3).tolist() + [0.0, 0.0, -1e-9, 1e-9]
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    for q in (0.1, 0.5, 0.9):
        got = exact_percentile(df, ["g"], "v", q).first()["percentile"]
        assert got == pytest.approx(float(np.percentile(vals, q * 100)))


def test_kfold_refuses_class_smaller_than_k(spark):
    df = spark.createDataFrame([("k", i, "a" if i < 10 else "b") for i in range(12)],
                               "key string, row_id long, target string")
    with pytest.raises(ValueError):
        S.kfold_stratified(df, 5)
    assert S.kfold_stratified(df, 2).filter("part = 'test'").count() == 12


def test_prefix_cumsum_decimal_keys_match_window(spark):
    import numpy as np
    from evalspark.functions.hashing import bucket_cumsum, order_bucket
    rng = np.random.default_rng(11)
    rows = [("u", float(s), int(n)) for s, n in zip(np.round(rng.random(300), 4), rng.integers(0, 5, 300))]
    rows += [("u", 1.0, 2), ("u", 0.0, 1)]
    df = spark.createDataFrame(rows, "g string, score double, neg long").dropDuplicates(["g", "score"])
    got = bucket_cumsum(df, ["g"], order_bucket(F.col("score"), 4), [F.col("score")], "neg", "below", inclusive=False)
    w = Window.partitionBy("g").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    key = ["g", "score", "below"]
    assert sorted(got.select(key).collect()) == sorted(want.select(key).collect())


def test_group_kfold_falls_back_when_groups_fewer_than_k(spark):
    long = spark.createDataFrame([("k", i, "f", float(i % 2 + 1)) for i in range(10)],
                                 "key string, row_id long, feature string, value double")
    g = S.group_ids(long)                       # two groups only
    f = S.kfold_grouped(g, 5).filter("part = 'test'")
    assert f.count() == 10 and f.select("seed").distinct().count() == 5


def test_order_bucket_splits_hot_groups(spark):
    """One group of 200,000 rows: no bucket is large for normal, price-like or packed values."""
    from evalspark.functions.hashing import exact_percentile, order_bucket
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.randn(1).alias("normal"),
                                     (F.floor(F.rand(2) * 1e7) / 100 + 1).alias("price"), (F.rand(3) / 100 + 0.5).alias("packed"))
    for c in ("normal", "price", "packed"):
        b = df.groupBy(order_bucket(F.col(c)).alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        rows = b.orderBy("b").collect()
        assert max(r["n"] for r in rows) < 1000
        assert all(x["hi"] < y["lo"] for x, y in zip(rows, rows[1:]))
        want = df.agg(F.percentile(c, 0.3)).first()[0]
        assert exact_percentile(df, ["g"], c, 0.3).first()[1] == want


def test_kfold_grouped_deals_in_order_of_size_and_id(spark):
    rows = [("k", 10_000 + i, 10_000 + i - i % 3 if i < 300 else 10_000 + i, 3 if i < 300 else 1) for i in range(1_000)]
    for cast in ("long", "string"):
        g = spark.createDataFrame(rows, "key string, row_id long, group_id long, group_size long") \
            .withColumn("group_id", F.col("group_id").cast(cast))
        group = {i: gid if cast == "long" else str(gid) for _, i, gid, _ in rows}
        got = {group[r["row_id"]]: r["seed"] for r in S.kfold_grouped(g, 5).filter("part = 'test'").collect()}
        order = sorted({(-s, gid if cast == "long" else str(gid)) for _, _, gid, s in rows})
        pos = [i % 10 for i in range(len(order))]
        assert got == {gid: p if p < 5 else 9 - p for (_, gid), p in zip(order, pos, strict=True)}


def test_threshold_and_percentile_do_not_shuffle_the_rows(spark):
    """The rows meet small tables of cuts: shuffled by a key of few values they would all lie in a few tasks."""
    import evalspark.functions.hashing as H
    seen, kept = [], H.materialize
    H.materialize = lambda df, name="table": (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), kept(df, name))[1]
    try:
        df = spark.range(4000).selectExpr("id % 2 as g", "id as i", "md5(cast(id as string)) as h", "cast(id as double) as v")
        q = spark.createDataFrame([(0, 100), (1, 3000)], "g long, quota long")
        cut = H.hash_threshold(df, ["g"], "h", "i", q)
        assert df.join(cut, "g").filter(H.within_threshold("h", "i")).count() == 2100
        assert sorted(r[1] for r in H.exact_percentile(df, ["g"], "v", 0.5).collect()) == [1999.0, 2000.0]
    finally:
        H.materialize = kept
    plans = dict(seen)
    assert "BroadcastHashJoin" in plans["cut-rows"] and "hashpartitioning" not in plans["cut-rows"]
    assert "BroadcastHashJoin" in plans["rank-rows"] and "SortMergeJoin" not in plans["rank-rows"]


def test_group_ids_hold_no_lists(spark):
    rows = [("k", i, f, float(v)) for i, vs in enumerate([(1, 2), (2, 1), (1, 2), (0, 0), (0, 0), (1, 0), (0, 1)])
            for f, v in zip("ab", vs)] + [("k", None, "a", 1.0), (None, 9, "a", 1.0), ("k", 7, "a", None), ("k", 8, "a", 1.0), ("k", 8, "b", None)]
    df = spark.createDataFrame(rows, "key string, row_id long, feature string, value double")
    out = S.group_ids(df)
    got = {(r.key, r.row_id): (r.group_id, r.group_size) for r in out.collect()}
    assert got == {("k", 0): (0, 2), ("k", 2): (0, 2), ("k", 1): (1, 1), ("k", 3): (3, 1), ("k", 4): (4, 1),
                   ("k", 5): (5, 2), ("k", 8): (5, 2), ("k", 6): (6, 1), ("k", 7): (7, 1)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan
