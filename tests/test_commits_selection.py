"""The shared cache, racing sinks, selection by threshold, percentiles and imputation on odd values."""

import math
import random
import statistics
import threading
import time

import pytest
from pyspark.sql import functions as F

from evalspark.functions import hashing as H
from evalspark.operators import features as T
from evalspark.operators import prompts as PR
from evalspark.operators import responses as RE
from evalspark.operators import splits as S
from evalspark.session import scratch_dir
from evalspark.sources import commits, split_cache
from evalspark.sources import results as RS


# ---------------------------------------------------------------- cache
def test_cache_is_read_by_other_sessions_until_a_file_changes(spark):
    src, root = scratch_dir(spark, "src"), scratch_dir(spark, "cache")
    spark.range(10).write.parquet(src)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(src).selectExpr("id * 2 as x")

    get = lambda session, **p: split_cache.cached_table(session, "t", {"a": 1} | p, [src], build, root)
    assert get(spark)[1] is False and get(spark)[1] is True and get(spark.newSession())[1] is True
    assert len(built) == 1 and get(spark)[0].count() == 10
    assert get(spark, a=2)[1] is False          # another parameter
    spark.range(5).write.mode("append").parquet(src)
    again, hit = get(spark)
    assert not hit and again.count() == 15 and len(built) == 3


def test_cache_race_builds_once_and_takes_over_an_abandoned_lease(spark):
    src, root = scratch_dir(spark, "src"), scratch_dir(spark, "cache")
    spark.range(3).write.parquet(src)
    built, got = [], []

    def build():
        built.append(1)
        time.sleep(1)
        return spark.range(7)

    def job():
        got.append(split_cache.cached_table(spark, "t", {}, [src], build, root)[0].count())
    threads = [threading.Thread(target=job) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [7, 7, 7] and len(built) == 1
    entry = split_cache.entry_path(spark, "t", {"b": 1}, [src], root)
    assert commits.create_exclusive(spark, f"{entry}/LEASE", "someone who died")
    time.sleep(1.2)
    df, hit = split_cache.cached_table(spark, "t", {"b": 1}, [src], build, root, lease_s=1)
    assert not hit and df.count() == 7


def test_cache_failed_build_leaves_nothing(spark):
    src, root = scratch_dir(spark, "src"), scratch_dir(spark, "cache")
    spark.range(3).write.parquet(src)

    def broken():
        raise ValueError("no split")
    with pytest.raises(ValueError, match="no split"):
        split_cache.cached_table(spark, "t", {}, [src], broken, root)
    assert split_cache.cached_table(spark, "t", {}, [src], lambda: spark.range(2), root)[1] is False


# ---------------------------------------------------------------- sinks
def test_truth_has_one_writer_a_key(spark):
    root, won = scratch_dir(spark, "truth"), {}

    def model(name):
        rows = [(s, k, i, f"{name}") for s in (0, 1) for k in ("a b", "c") for i in range(20)]
        won[name] = RS.write_truth_once(spark, spark.createDataFrame(rows, "seed int, key string, row_id long, target string"), root)
    threads = [threading.Thread(target=model, args=(n,)) for n in ("x", "y", "z")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    back = spark.read.parquet(root)
    assert back.count() == 80 and back.select("seed", "key", "row_id").distinct().count() == 80
    assert back.groupBy("seed", "key").agg(F.countDistinct("target").alias("n")).filter("n > 1").count() == 0
    assert sum(len(w) for w in won.values()) == 4
    assert not [n for n in commits.names(spark, root) if n.startswith("_stage")]


def test_probabilities_follow_label_order(spark):
    root = scratch_dir(spark, "proba")
    rows = [(0, "k", "m", 2, {"b": 0.25, "a": 0.75}), (0, "k", "m", 1, {"c": 1.0}), (0, "k", "n", 1, {"z": 1.0})]
    RS.write_probabilities(spark.createDataFrame(rows, "seed int, key string, model string, row_id long, proba map<string,double>"), root)
    got = {(r.model, r.row_id): (r.classes, r.proba) for r in spark.read.parquet(root).collect()}
    assert got == {("m", 2): (["a", "b", "c"], [0.75, 0.25, 0.0]), ("m", 1): (["a", "b", "c"], [0.0, 0.0, 1.0]), ("n", 1): (["z"], [1.0])}


def test_rows_and_summary_are_published_together(spark):
    root = scratch_dir(spark, "saves")
    summary = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"))
    assert RS.read_metrics(spark, root) is None
    done = threading.Event()
    seen = []

    def reader():
        while not done.is_set():
            state = RS.read_metrics(spark, root)
            if state:
                total = state[1].first()
                seen.append((state[0].count(), total["n"]))
    r = threading.Thread(target=reader)
    r.start()
    save = lambda s: RS.save_metrics(spark, spark.range(s * 10 + 10).selectExpr("id as x", f"{s} as seed"), root, summary)
    writers = [threading.Thread(target=save, args=(s,)) for s in range(3)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    done.set()
    r.join()
    rows, total = RS.read_metrics(spark, root)
    assert rows.count() == 60 == total.first()["n"] and all(a == b for a, b in seen)
    assert sorted(RS.read_metrics(spark, root, v)[1].first()["n"] for v in (1, 2, 3))[-1] == 60


def test_a_file_has_one_creator(spark):
    """Before: two of them on a mounted folder, now and then, so that a save of metric rows was lost."""
    root, start = scratch_dir(spark, "race"), threading.Barrier(8)
    won = [[] for _ in range(60)]

    def writer(name):
        for i, winners in enumerate(won):
            start.wait()
            if commits.create_exclusive(spark, f"{root}/v/{i}", name):
                winners.append(name)
    threads = [threading.Thread(target=writer, args=(f"writer {k}",)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [len(w) for w in won] == [1] * len(won)
    assert [commits.read_text(spark, f"{root}/v/{i}") for i in range(len(won))] == [w[0] for w in won]


# ---------------------------------------------------------------- selection
@pytest.mark.parametrize("digits,levels", [(1, 1), (1, 3), (3, 2)])
def test_threshold_selects_the_first_by_hash(spark, digits, levels):
    r = random.Random(2)
    rows = [(g, i, f"{r.getrandbits(64):016x}" if i % 5 else "00ff00ff00ff00ff") for g, n in (("a", 500), ("b", 3), ("c", 40)) for i in range(n)]
    quotas = {"a": 137, "b": 9, "c": 0}
    df = spark.createDataFrame(rows, "g string, i long, h string")
    q = spark.createDataFrame(list(quotas.items()), "g string, quota long")
    cut = H.hash_threshold(df, ["g"], "h", "i", q, digits, levels)
    got = {(x.g, x.i) for x in df.join(cut, "g").filter(H.within_threshold("h", "i")).collect()}
    want = {(g, i) for g, n in quotas.items() for h, i in sorted((h, i) for k, i, h in rows if k == g)[:n]}
    assert got == want


def test_holdout_neither_sorts_nor_shuffles_rows(spark):
    df = spark.range(5000).selectExpr("'k' as key", "id as row_id", "cast(id % 3 as string) as target")
    out = S.holdout_stratified(df, [0, 1], 0.2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in physical and "hashpartitioning" not in physical
    assert out.groupBy("seed", "part").count().filter("part = 'test'").select("count").distinct().collect()[0][0] == 1000


# ---------------------------------------------------------------- order of doubles
INF, NAN = math.inf, math.nan


def test_order_bucket_grows_with_the_value(spark):
    xs = [-INF, -1e308, -1.5, -1e-300, 0.0, 5e-324, 1e-300, 1.0, 1.5, 2.0, 1e308, INF, NAN]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
           .select(H.order_bucket(F.col("x"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(xs)


@pytest.mark.parametrize("values", [[1.0, 2.0, NAN], [1.0, INF, 3.0, -INF], [5.0], [1.7e9 + i / 1000 for i in range(400)],
                                    [0.1, 0.1, 0.1, 0.2], [INF, INF, 1.0], [None, 4.0, 2.0]])
@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_exact_percentile_is_sparks(spark, values, q):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = H.exact_percentile(df, ["g"], "v", q).first()["percentile"]
    want = df.groupBy("g").agg(F.percentile("v", q).alias("p")).first()["p"]
    assert got == want or (math.isnan(got) and math.isnan(want)) or abs(got - want) <= 1e-12 * abs(want)


def test_impute_many_features_in_one_plan(spark):
    n = 120
    feats = [f"f.{i}" for i in range(n)]
    r = random.Random(4)
    rows = [(0, "k", "train" if i % 4 else "test", *(None if r.random() < .2 else NAN if r.random() < .1 else INF if r.random() < .02
                                                    else r.random() for _ in feats)) for i in range(60)]
    df = spark.createDataFrame(rows, "seed int, key string, part string, " + ", ".join(f"`{c}` double" for c in feats))
    out = T.impute(df, feats, "median").collect()
    lacking = lambda x: x is None or math.isnan(x)
    for j, c in enumerate(feats):
        fill = statistics.median(x[3 + j] for x in rows if x[2] == "train" and not lacking(x[3 + j]))
        assert sorted(x[c] for x in out) == sorted(fill if lacking(x[3 + j]) else x[3 + j] for x in rows)


# ---------------------------------------------------------------- answers and budgets
def test_label_with_the_end_mark_of_a_quotation(spark):
    lines = spark.createDataFrame([(0, "k", "m", 0, 0, 1, r"it is a\Eb, surely")],
                                  "seed int, key string, model string, chunk int, line_no int, idx int, body string")
    classes = spark.createDataFrame([(0, "k", r"a\Eb"), (0, "k", "c")], "seed int, key string, token string")
    assert [r.token for r in RE.match_class(lines, classes).collect()] == [r"a\Eb"]


@pytest.mark.parametrize("budget", [0, -5])
def test_no_budget_is_a_skip(spark, budget):
    rows = spark.range(4).selectExpr("0 as seed", "'k' as key", "'m' as model", "id as row_id", "3 as row_tokens")
    got = PR.pack_by_budget(rows, F.lit(10), overhead=F.lit(10 - budget)).collect()
    assert len(got) == 4 and all(r.too_large and r.chunk >= 0 for r in got)
