"""Pairwise ratings (E01-E08): score table, battles, win counts, Bradley-Terry, online Elo.

Pair tables grow with models² per key, so battles are a self join on ``key`` (hash
partitioned by key — never broadcast, keys are many) and are aggregated to per-pair
counts before anything else. The rating fits themselves are M×M problems: Spark computes
the counts per replicate (bootstrap draw, grid cell), and only the tiny count matrix of
one replicate is handed to one ``applyInPandas`` call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_number, hash_rank

DEFAULT_ANCHOR = "RF"
DEFAULT_BASE = 1000.0
DEFAULT_SCALE = 400.0
DEFAULT_K = 32.0


def score_table(clf: DataFrame | None, reg: DataFrame | None, clf_metric: str = "f1_macro",
                reg_metric: str = "rmse") -> DataFrame:
    """(model, key, score) — seed-mean metric; regression negated (higher = better)."""
    parts = []
    if clf is not None:
        parts.append(clf.groupBy("model", "key").agg(F.avg(clf_metric).alias("score")))
    if reg is not None:
        parts.append(reg.groupBy("model", "key").agg((-F.avg(reg_metric)).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("score").isNotNull())


def battles(scores: DataFrame, extra_keys=()) -> DataFrame:
    """Per key, every pair of models with a score: s = 1 / 0.5 / 0 for a higher / equal /
    lower score of ``a``; pairs not both present are not played."""
    ek = list(extra_keys)
    a = scores.select(*ek, "key", F.col("model").alias("a"), F.col("score").alias("sa"))
    b = scores.select(*ek, "key", F.col("model").alias("b"), F.col("score").alias("sb"))
    j = a.join(b, ek + ["key"]).filter(F.col("a") < F.col("b"))
    s = F.when(F.col("sa") > F.col("sb"), 1.0).when(F.col("sa") == F.col("sb"), 0.5).otherwise(0.0)
    return j.select(*ek, "key", "a", "b", s.alias("s"))


def win_counts(bt: DataFrame, extra_keys=(), weight: str | None = None) -> DataFrame:
    """Head-to-head wins both directions, ties split: (model_a, model_b, wins, games)."""
    ek = list(extra_keys)
    w = F.col(weight) if weight else F.lit(1.0)
    both = bt.select(*ek, F.explode(F.array(
        F.struct(F.col("a").alias("model_a"), F.col("b").alias("model_b"), (F.col("s") * w).alias("wins"),
                 w.alias("games")),
        F.struct(F.col("b").alias("model_a"), F.col("a").alias("model_b"), ((1 - F.col("s")) * w).alias("wins"),
                 w.alias("games")))).alias("x"))
    return both.groupBy(*ek, "x.model_a", "x.model_b").agg(F.sum("x.wins").alias("wins"),
                                                          F.sum("x.games").alias("games"))


def bootstrap_weights(scores: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """Resample the **keys** n_boot times: draw j of replicate b picks key number
    ``md5(seed:b:j) % n_keys``; weight = how often a key was drawn. Replicate -1 is the
    point fit (every key once). Output (rep, key, weight)."""
    keys = scores.select("key").distinct()
    w_key = Window.orderBy("key")
    numbered = keys.withColumn("key_no", F.row_number().over(w_key) - 1)   # keys: small table
    n = numbered.agg(F.count(F.lit(1)).alias("n_keys"))
    draws = (n.select(F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"), "n_keys")
             .select("rep", "n_keys", F.explode(F.sequence(F.lit(0), F.col("n_keys") - 1)).alias("j")))
    h = hash_number(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("j").cast("string")))
    picks = draws.select("rep", (h % F.col("n_keys")).alias("key_no"))
    w = picks.groupBy("rep", "key_no").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    boot = w.join(numbered, "key_no").select("rep", "key", "weight")
    point = keys.select(F.lit(-1).alias("rep"), "key", F.lit(1.0).alias("weight"))
    return point.unionByName(boot)


def cell_bootstrap_weights(scores: DataFrame, cell_cols, n_boot: int, seed: int = 0) -> DataFrame:
    """E06 for many cells at once: (cell, rep, key, weight), each cell's own keys resampled.

    A cell's keys are numbered in the order of their md5, by :func:`hash_rank`, so no cell is
    sorted in one task; draw j of replicate b picks number ``md5(seed:b:j) % n_keys``.
    Replicate -1 has every key once.
    """
    g = list(cell_cols)
    keys = scores.select(*g, "key").distinct()
    numbered = hash_rank(keys.withColumn("__h", F.md5("key")), g, "__h", "key", "__no").drop("__h")
    last = F.col("n_keys") - 1
    draws = (keys.groupBy(*g).agg(F.count(F.lit(1)).alias("n_keys"))
             .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
             .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last))))
    h = hash_number(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("j").cast("string")))
    drawn = draws.groupBy(*g, "rep", (h % F.col("n_keys") + 1).alias("__no")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    boot = drawn.join(numbered, [*g, "__no"]).select(*g, "rep", "key", "weight")
    return keys.select(*g, F.lit(-1).alias("rep"), "key", F.lit(1.0).alias("weight")).unionByName(boot)


# ---------------------------------------------------------------- Bradley-Terry (per replicate)
def _strongly_connected(wins: np.ndarray) -> bool:
    beat = wins > 0
    n = len(beat)
    reach = beat | np.eye(n, dtype=bool)
    for _ in range(int(np.ceil(np.log2(max(n, 2)))) + 1):
        reach = reach | ((reach.astype(np.int64) @ reach.astype(np.int64)) > 0)
    return bool(reach.all())


def bt_solve(wins: np.ndarray, steps: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, bool, bool]:
    """Bradley-Terry MLE by damped Newton steps on the log strengths.

    At the maximum each model's expected wins equal its observed ones; ``converged`` says that they
    agree within ``tol`` of the largest total. When the win graph is not strongly connected the MLE is
    infinite; then half a win is added each way on every played pair and ``separated`` is reported.
    Returns (natural log strengths centred at 0, separated, converged). Models in groups that never met are
    centred within their group.
    """
    separated = not _strongly_connected(wins)
    if separated:
        wins = wins + 0.5 * (wins + wins.T > 0)
    games, total = wins + wins.T, wins.sum(axis=1)
    bound = tol * max(1.0, float(total.max(initial=0.0)))

    def gap(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = 1.0 / (1.0 + np.exp(np.clip(t[None, :] - t[:, None], -700, 700)))
        return total - (games * share).sum(axis=1), games * share * share.T

    def likelihood(t: np.ndarray) -> float:
        return -float((wins * np.logaddexp(0.0, t[None, :] - t[:, None])).sum())

    theta = np.zeros(len(wins))
    g, w = gap(theta)
    for _ in range(steps):
        if np.abs(g).max(initial=0.0) <= bound:
            break
        step = np.linalg.lstsq(np.diag(w.sum(axis=1)) - w, g, rcond=None)[0]
        size, here, slope = 1.0, likelihood(theta), float(g @ step)
        while True:
            g_new, w_new = gap(theta + size * step)
            if likelihood(theta + size * step) >= here + 1e-4 * size * slope or \
                    np.abs(g_new).max() < np.abs(g).max() or size < 1e-9:
                break
            size /= 2
        theta, g, w = theta + size * step, g_new, w_new
    return theta - theta.mean() if len(theta) else theta, separated, bool(np.abs(g).max(initial=0.0) <= bound)


def bt_fit(models: list[str], wins: np.ndarray) -> tuple[np.ndarray, bool]:
    """(log10 strengths centred at 0, separated) of :func:`bt_solve`."""
    theta, separated, _ = bt_solve(wins)
    return theta / np.log(10), separated


def bt_ratings(pair_counts: DataFrame, group_cols: list[str], anchor: str = DEFAULT_ANCHOR,
               anchor_value: float = DEFAULT_BASE, scale: float = DEFAULT_SCALE) -> DataFrame:
    """BT ratings per group (e.g. bootstrap replicate, grid cell) via ``applyInPandas``.

    ``pair_counts``: (group, model_a, model_b, wins) — the M² counts are already aggregated
    in Spark. Rating = scale·log10 p, shifted so the anchor sits at ``anchor_value`` (the
    mean when the anchor is absent). Output (group, model_id, rating, separated, converged).
    """
    schema = ", ".join(f"{c} {t}" for c, t in pair_counts.select(*group_cols).dtypes) + \
        ", model_id string, rating double, separated boolean, converged boolean"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        models = sorted(set(pdf["model_a"]) | set(pdf["model_b"]))
        ix = {m: i for i, m in enumerate(models)}
        w = np.zeros((len(models), len(models)))
        for a, b, x in zip(pdf["model_a"], pdf["model_b"], pdf["wins"]):
            w[ix[a], ix[b]] += x
        theta, sep, done = bt_solve(w)
        r = scale * theta / np.log(10)
        r = r + (anchor_value - r[ix[anchor]] if anchor in ix else anchor_value - r.mean())
        out = pd.DataFrame({"model_id": models, "rating": r, "separated": sep, "converged": done})
        for i, g in enumerate(group_cols):
            out.insert(i, g, pdf[g].iloc[0])
        return out

    return pair_counts.groupBy(*group_cols).applyInPandas(fit, schema)


def elo_bootstrap(scores: DataFrame, n_boot: int = 100, seed: int = 0, anchor: str = DEFAULT_ANCHOR,
                  anchor_value: float = DEFAULT_BASE, scale: float = DEFAULT_SCALE) -> DataFrame:
    """E05 + E06: ratings = bootstrap median, 2.5 / 97.5 % quantiles, integer rounded.

    Draw weights are joined to the **aggregated** per-key pair table (not to raw rows); each
    replicate's M×M counts are one pandas group.
    """
    bt = battles(scores)
    wts = bootstrap_weights(scores, n_boot, seed)
    weighted = bt.join(wts, "key")
    counts = win_counts(weighted, ["rep"], weight="weight").filter(F.col("games") > 0)
    r = bt_ratings(counts, ["rep"], anchor, anchor_value, scale).filter(F.col("rep") >= 0)
    n_t = scores.groupBy(F.col("model").alias("model_id")).agg(F.countDistinct("key").alias("n_targets"))
    q = r.groupBy("model_id").agg(
        F.round(F.percentile("rating", 0.5)).cast("long").alias("elo"),
        F.round(F.percentile("rating", 0.025)).cast("long").alias("elo_lo"),
        F.round(F.percentile("rating", 0.975)).cast("long").alias("elo_hi"))
    return q.join(n_t, "model_id", "left")


def cell_ratings(scores: DataFrame, cell_cols, n_boot: int = 100, seed: int = 0, anchor: str = DEFAULT_ANCHOR,
                 anchor_value: float = DEFAULT_BASE, scale: float = DEFAULT_SCALE) -> DataFrame:
    """E05 + E06 for every cell of a grid in one plan.

    ``scores``: (cell, model, key, score); rows without a score are left out, cell columns are not
    null. All cells and replicates are fitted side by side: a task holds the models x models counts of one
    replicate of one cell. Output (cell, model_id, elo, elo_lo, elo_hi, rating, separated, converged,
    n_targets): bootstrap median and 2.5 / 97.5 % quantiles, rounded; the point fit and whether it
    is separated; whether the point fit and all the replicates in which the model played converged. Cells with
    no pair of models on one key have no rows.
    """
    g = list(cell_cols)
    rows = scores.filter(F.col("score").isNotNull()).select(*g, "model", "key", "score")
    weighted = battles(rows, g).join(cell_bootstrap_weights(rows, g, n_boot, seed), [*g, "key"])
    w = F.col("weight")
    # one row a pair is summed up before it is turned both ways
    pairs = weighted.groupBy(*g, "rep", "a", "b").agg(F.sum(F.col("s") * w).alias("won"), F.sum((1 - F.col("s")) * w).alias("lost"))
    both = F.inline(F.array(F.struct(F.col("a").alias("model_a"), F.col("b").alias("model_b"), F.col("won").alias("wins")),
                            F.struct(F.col("b").alias("model_a"), F.col("a").alias("model_b"), F.col("lost").alias("wins"))))
    fits = bt_ratings(pairs.select(*g, "rep", both), [*g, "rep"], anchor, anchor_value, scale)
    point = F.col("rep") < 0
    drawn = F.when(~point, F.col("rating"))
    out = fits.groupBy(*g, "model_id").agg(
        *(F.round(F.percentile(drawn, q)).cast("long").alias(n)
          for n, q in (("elo", 0.5), ("elo_lo", 0.025), ("elo_hi", 0.975))),
        F.max(F.when(point, F.col("rating"))).alias("rating"),
        F.max(F.when(point, F.col("separated"))).alias("separated"), F.min("converged").alias("converged"))
    n_t = rows.groupBy(*g, F.col("model").alias("model_id")).agg(F.countDistinct("key").alias("n_targets"))
    return out.join(n_t, [*g, "model_id"])


def rating_balance(wins: DataFrame, ratings: DataFrame, group_cols=(), scale: float = DEFAULT_SCALE) -> DataFrame:
    """Observed and expected wins of each model under its ratings: equal at the maximum of the likelihood.

    ``wins`` as from :func:`win_counts`, ``ratings``: (group, model_id, rating, separated). Where the fit
    is separated each played pair counts half a win more each way. Output (group, model_id, observed, expected).
    """
    g = list(group_cols)
    a = ratings.select(*g, F.col("model_id").alias("model_a"), F.col("rating").alias("__ra"), "separated")
    b = ratings.select(*g, F.col("model_id").alias("model_b"), F.col("rating").alias("__rb"))
    more = F.when(F.col("separated"), 0.5).otherwise(0.0)
    share = 1 / (1 + F.pow(F.lit(10.0), (F.col("__rb") - F.col("__ra")) / scale))
    pairs = wins.join(a, [*g, "model_a"]).join(b, [*g, "model_b"])
    return pairs.groupBy(*g, F.col("model_a").alias("model_id")).agg(
        F.sum(F.col("wins") + more).alias("observed"), F.sum((F.col("games") + 2 * more) * share).alias("expected"))


def winrate_matrix(wins: DataFrame, ratings: DataFrame, order_col: str = "elo") -> DataFrame:
    """Win matrix cells with row / column positions ordered by rating desc (tie: id)."""
    order = ratings.select("model_id", F.row_number().over(
        Window.orderBy(F.col(order_col).desc(), F.col("model_id"))).cast("long").alias("pos"))   # models: small
    ra = order.select(F.col("model_id").alias("model_a"), F.col("pos").alias("row_pos"))
    cb = order.select(F.col("model_id").alias("model_b"), F.col("pos").alias("col_pos"))
    return wins.join(ra, "model_a").join(cb, "model_b").select("row_pos", "col_pos", "model_a", "model_b", "wins")


def elo_online(scores: DataFrame, n_orderings: int = 20, k: float = DEFAULT_K, base: float = DEFAULT_BASE,
               anchor: str = DEFAULT_ANCHOR, anchor_value: float = DEFAULT_BASE, seed: int = 0) -> DataFrame:
    """Sequential Elo averaged over md5-seeded game orders.

    A sequence is inherently ordered, so the parallelism is across orderings: each
    ordering is one ``applyInPandas`` group holding the (small) game list; the average
    and anchor shift are Spark aggregates.
    """
    bt = battles(scores)
    orders = bt.select(F.explode(F.sequence(F.lit(0), F.lit(n_orderings - 1))).alias("ordering"), "key", "a", "b", "s")
    orders = orders.withColumn("pos", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ordering").cast("string"),
                                                        F.col("key"), F.col("a"), F.col("b"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        models = sorted(set(pdf["a"]) | set(pdf["b"]))
        r = {m: base for m in models}
        for a, b, s in zip(pdf["a"], pdf["b"], pdf["s"]):
            ea = 1.0 / (1.0 + 10.0 ** ((r[b] - r[a]) / 400.0))
            d = k * (s - ea)
            r[a] += d
            r[b] -= d
        return pd.DataFrame({"ordering": pdf["ordering"].iloc[0], "model_id": models,
                             "rating": [r[m] for m in models]})

    per = orders.groupBy("ordering").applyInPandas(run, "ordering int, model_id string, rating double")
    avg = per.groupBy("model_id").agg(F.avg("rating").alias("rating"))
    # the model table is roster-sized: a whole-table window computes the anchor shift
    allw = Window.partitionBy()
    shift = F.coalesce(F.max(F.when(F.col("model_id") == anchor, F.lit(anchor_value) - F.col("rating"))).over(allw),
                       F.lit(anchor_value) - F.avg("rating").over(allw))
    return avg.select("model_id", F.round(F.col("rating") + shift).cast("long").alias("elo"))


def bt_mm_steps(wins: DataFrame, steps: int = 5, scale: float = DEFAULT_SCALE) -> DataFrame:
    """A fixed number of Bradley-Terry minorize-maximize steps as Spark joins.

    ``wins``: (model_a, model_b, wins, games) in both directions. Each step is
    p_i ← W_i / Σ_j n_ij / (p_i + p_j), then normalised to geometric mean 1; it is a
    join of the pair table with the current strengths plus one aggregate, so it also
    works when the model set is too large for one pandas group. Output (model_id, rating)
    with rating = scale·log10 p (centred, uncalibrated). The strengths of each step are
    written to the shared checkpoint folder, which cuts the lineage between steps.
    """
    from ..catalog import materialize
    W = materialize(wins.groupBy(F.col("model_a").alias("model_id")).agg(F.sum("wins").alias("W")), "bt-w")
    p = W.select("model_id", F.lit(1.0).alias("p"))
    pairs = materialize(wins.select(F.col("model_a").alias("i"), F.col("model_b").alias("j"),
                                    F.col("games").alias("n")), "bt-pairs")
    for _ in range(steps):
        pi = p.select(F.col("model_id").alias("i"), F.col("p").alias("pi"))
        pj = p.select(F.col("model_id").alias("j"), F.col("p").alias("pj"))
        den = pairs.join(pi, "i").join(pj, "j").groupBy(F.col("i").alias("model_id")).agg(
            F.sum(F.col("n") / (F.col("pi") + F.col("pj"))).alias("den"))
        new = W.join(den, "model_id").select("model_id", (F.col("W") / F.col("den")).alias("p"))
        g = F.exp(F.avg(F.ln("p")).over(Window.partitionBy()))      # roster-sized table
        # each step reads the previous one from storage: the plan does not grow with steps
        p = materialize(new.select("model_id", (F.col("p") / g).alias("p")), "bt-p")
    return p.select("model_id", (F.lit(scale) * F.log10("p")).alias("rating"))
