"""Report tables against plain counts."""

SF = "/root/testdata/sf0.01"


def test_dataset_overview_counts_all_rows(spark):
    """Sizes from results are train plus test rows, not five times the test rows (400 here for 399)."""
    from evalspark import catalog as C
    from evalspark.plans import registry
    registry.load_all()
    got = {r["key"]: r["n_samples"] for r in registry.QUERIES["dataset_overview"](spark, SF).collect() if r["source"] == "results"}
    want = {r["key"]: r["count"] for r in C.clf_tasks(spark, SF).groupBy("key").count().collect() if r["key"] != "customer_0"}
    assert got == want and want["documents_0"] == 399


def test_pareto_front_against_brute_force(spark):
    import math
    import random

    from evalspark.operators.reports import pareto_front
    r = random.Random(8)
    xs = [-math.inf, -2.0, -1e-9, 0.0, 1e-300, 1.0, 1.0000001, 3.5, 1e12, math.inf]
    pts = [(i, r.choice(xs) if i % 2 else r.uniform(-5, 5), round(r.uniform(0, 3), 1)) for i in range(300)] + [(900, None, 1.0), (901, 1.0, None)]
    got = {p.i: p.pareto for p in pareto_front(spark.createDataFrame(pts, "i int, x double, y double")).collect()}
    known = [p for p in pts if p[1] is not None and p[2] is not None]
    want = {i: not any((a <= x and b >= y) and (a < x or b > y) for _, a, b in known) for i, x, y in known}
    assert got == want
    plan = pareto_front(spark.createDataFrame(pts, "i int, x double, y double"))._jdf.queryExecution().optimizedPlan().toString()
    import re
    assert all(m.strip() for m in re.findall(r"Window \[[^\]]*\], \[([^\]]*)\]", plan))


def test_absent_dataset_is_missing(spark):
    from evalspark.operators import coverage as V
    d = spark.createDataFrame([([0, 1], ["a", "gone"], ["m"]), ([1], ["a"], ["m", "n"])], "seeds array<int>, keys array<string>, models array<string>")
    done = spark.createDataFrame([(0, "a", "m"), (1, "a", "m")], "seed int, key string, model string")
    none = spark.createDataFrame([(1, "a", "n", "retry")], "seed int, key string, model string, status string")
    got = sorted(tuple(r) for r in V.missing_from_schedule(done, none, V.schedule(d)).select("seed", "key", "model").collect())
    assert got == [(0, "gone", "m"), (1, "a", "n"), (1, "gone", "m")]
