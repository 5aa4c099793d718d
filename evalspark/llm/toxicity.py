"""Toxicity scores from a bidirectional GRU with attention pooling, trained in numpy.

Each word enters as its embedding joined to the mean embedding of its byte trigrams (white
space marks both ends), so that unseen forms of a known stem are recognised. All overlapping
windows of ``WINDOW`` words, one from every word on, are read forwards and backwards by gated
recurrent units; attention weighs the states of a window, a logistic unit scores it. A text of
fewer words is one window. A text's score is that of its highest window, so that a short passage
counts in a long text, wherever it stands.

Training reads a bounded sample (``positives`` and ``negatives`` labelled texts of at most
``sample_bytes`` each, in the order of a hash of their ids) on the driver; a text's loss goes
to its highest window. The model (about 1 MB) is broadcast; scoring is a pandas UDF without a
shuffle over whole texts.

Null, empty and blank texts: no word, score 0. Labels that are null or belong to no text are
left out; of several labels of an id the largest counts. Without both classes in the sample
every score is 0. Equal texts score equally, but for the last digits of 32-bit floats. Extra columns
are kept and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from evalspark.llm.common import free_name, id_fold, small_batches, table, text_bytes
from evalspark.llm.textarrays import U, Words

WINDOW = 12
WORD_ROWS, TRI_ROWS, EMBED, HIDDEN = 1 << 14, 1 << 14, 8, 8
POSITIVES, NEGATIVES, SAMPLE_BYTES, EPOCHS, STEPS = 1500, 2500, 1 << 15, 6, 360
THRESHOLD = 0.7
HOLD_MOD, HOLD_OUT = 3, 1

Model = dict[str, np.ndarray]


class Inputs:
    """Distinct words of a batch of texts, with their byte trigrams, and the windows over all words."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, lower=True)
        _, first, self.which = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = (w.hash[first] & U(WORD_ROWS - 1)).astype(np.int32)
        # trigrams of each distinct word, white space at both ends: as many as it has bytes
        self.size = (w.end - w.start)[first]
        self.cut = np.concatenate([[0], np.cumsum(self.size)])
        at = np.arange(self.cut[-1]) + np.repeat(w.start[first] - self.cut[:-1], self.size)
        b = np.concatenate([[32], np.where(w.buf < 33, 32, w.buf)]).astype(np.uint32)
        code = b[at] | (b[at + 1] << np.uint32(8)) | (b[at + 2] << np.uint32(16))
        self.tri = ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)
        n = np.diff(w.first)
        count = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
        self.doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.at = w.first[self.doc] + nth
        self.len = np.minimum(WINDOW, w.first[self.doc + 1] - self.at)

    def vectors(self, p: Model) -> np.ndarray:
        """Input vectors of the distinct words."""
        if not len(self.word):
            return np.zeros((0, 2 * EMBED), np.float32)
        sums = np.add.reduceat(p["tri"][self.tri], self.cut[:-1], axis=0)
        return np.concatenate([p["word"][self.word], sums / self.size[:, None].astype(np.float32)], 1)


def new_model(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    d, h = 2 * EMBED, HIDDEN
    g = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
    p = {"word": g(WORD_ROWS, EMBED, k=0.1), "tri": g(TRI_ROWS, EMBED, k=0.1)}
    for side in "fb":
        p |= {f"wx_{side}": g(d, 3 * h), f"wh_{side}": g(h, 3 * h), f"b_{side}": np.zeros(3 * h, np.float32)}
    return p | {"wa": g(2 * h, h), "va": g(h), "wo": g(2 * h), "bo": np.full(1, -1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _gru(proj: np.ndarray, wh: np.ndarray, place: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
    """States (T, B, H) for input projections ``proj[place[t]]``; a state is held where not live."""
    h, k = np.zeros((place.shape[1], HIDDEN), np.float32), HIDDEN
    out = np.empty((*place.shape, k), np.float32)
    for t in range(len(place)):
        x, g = proj[place[t]], h @ wh
        zr = _sigmoid(x[:, :2 * k] + g[:, :2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(x[:, 2 * k:] + r * g[:, 2 * k:])
        new = n + z * (h - n)
        if not live[t].all():
            new = np.where(live[t][:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, n, g[:, 2 * k:]))
        h = out[t] = new
    return out


def project(p: Model, x: np.ndarray) -> dict[str, np.ndarray]:
    return {side: x @ p[f"wx_{side}"] + p[f"b_{side}"] for side in "fb"}


def forward(p: Model, proj: dict[str, np.ndarray], which: np.ndarray, at: np.ndarray, size: np.ndarray,
            keep: dict | None = None) -> np.ndarray:
    """Logits of windows that begin at word ``at``; ``which`` gives each word's row of ``proj``."""
    t = np.arange(int(size.max(initial=0)))[:, None]
    live = t < size
    places = {"f": which[at + np.minimum(t, size - 1)], "b": which[at + np.maximum(size - 1 - t, 0)]}
    states, caches = {}, {"f": None if keep is None else [], "b": None if keep is None else []}
    for side, place in places.items():
        states[side] = _gru(proj[side], p[f"wh_{side}"], place, live, caches[side])
    back = np.maximum(size - 1 - t, 0)      # the backward state of word t
    both = np.concatenate([states["f"], np.take_along_axis(states["b"], back[:, :, None], 0)], 2)
    u = np.tanh(both @ p["wa"])
    e = np.where(live, u @ p["va"], -1e9)
    a = np.exp(e - e.max(0, initial=-1e9))
    a /= a.sum(0)
    pooled = (a[:, :, None] * both).sum(0)
    if keep is not None:
        keep |= dict(live=live, places=places, caches=caches, back=back, both=both, u=u, a=a, pooled=pooled)
    return pooled @ p["wo"] + p["bo"][0]


def _scaled(rows: np.ndarray) -> np.ndarray:
    """A copy with the rows of both gates times -1 and the others times -2, for ``_side``."""
    return rows * np.where(np.arange(3 * HIDDEN) < 2 * HIDDEN, -1, -2).astype(np.float32)[:, None]


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place: the gates, and with them tanh(y) = 2 / (1 + exp(-2 y)) - 1, for less than ``np.tanh``."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _starts(proj: np.ndarray) -> np.ndarray:
    """State (H, words) after a window's first word: the state before it is zero, and so are its products."""
    k = HIDDEN
    n = 2 * _logistic(proj[2 * k:].copy()) - 1
    return n - _logistic(proj[:k].copy()) * n


def _side(proj: np.ndarray, wh: np.ndarray, start: np.ndarray, places: list, out: list[np.ndarray]) -> None:
    """States (H, B) after each of ``places``, which pick columns of ``proj`` and ``start``, put into ``out``; nothing is masked.

    The rows of ``proj`` and ``wh`` come scaled (:func:`_scaled`).
    """
    k = HIDDEN
    h = out[0]
    h[:] = start[:, places[0]]
    for place, state in zip(places[1:], out[1:], strict=True):
        x = proj[:, place]
        g = wh @ h
        gates, n = g[:2 * k], g[2 * k:]
        gates += x[:2 * k]
        _logistic(gates)
        n *= gates[k:]
        n += x[2 * k:]
        _logistic(n)
        n *= 2
        n -= 1
        np.subtract(h, n, out=state)
        state *= gates[:k]
        state += n
        h = state


def _sliding(p: Model, cols: dict[str, np.ndarray], which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """As ``forward`` for whole windows that begin at the ascending words ``at``.

    ``cols`` has a column a distinct word, the scaled projections above the state that it begins
    with. Neighbouring windows read neighbouring words, so the columns are laid out once and each
    step takes a slice. That also covers windows that begin between those of ``at`` (they cross
    from text to text); where those were more than half, the columns are picked step by step.
    """
    span, k = int(at[-1] - at[0]) + 1, HIDDEN
    if span <= 2 * len(at):
        words = which[at[0]:at[0] + span + WINDOW - 1]
        cols = {side: x.take(words, axis=1) for side, x in cols.items()}
        places, mine = [slice(t, t + span) for t in range(WINDOW)], at - at[0]
    else:
        places, mine, span = [which[at + t] for t in range(WINDOW)], slice(None), len(at)
    states = np.empty((WINDOW, 2 * k, span), np.float32)      # forward above backward
    with np.errstate(over="ignore"):
        _side(cols["f"][:3 * k], _scaled(p["wh_f"].T), cols["f"][3 * k:], places, list(states[:, :k]))
        _side(cols["b"][:3 * k], _scaled(p["wh_b"].T), cols["b"][3 * k:], places[::-1], list(states[::-1, k:]))
        # rows of one product: what attention looks at, and the state's part of the logit
        m = np.concatenate([-2 * p["wa"], p["wo"][:, None]], 1).T @ states
        # va @ tanh(y) but for a number that all words of a window share
        e = (2 * p["va"]) @ np.stack([_logistic(x[:k]) for x in m])
    a = np.exp(e - e.max(0))
    return ((a * m[:, k]).sum(0) / a.sum(0) + p["bo"][0])[mine]


def all_logits(p: Model, proj: dict[str, np.ndarray], i: Inputs, step: int = 1 << 11) -> np.ndarray:
    """Logits of all windows of a batch, ``step`` at a time: the arrays then stay in the processor's caches."""
    out = np.empty(len(i.at), np.float32)
    short = np.flatnonzero(i.len < WINDOW)
    for lo in range(0, len(short), step):
        pick = short[lo:lo + step]
        out[pick] = forward(p, proj, i.which, i.at[pick], i.len[pick])
    whole = np.flatnonzero(i.len == WINDOW)
    with np.errstate(over="ignore"):
        cols = {side: np.concatenate([x, _starts(x)]) for side, x in ((side, _scaled(y.T)) for side, y in proj.items())}
    for lo in range(0, len(whole), step):
        pick = whole[lo:lo + step]
        out[pick] = _sliding(p, cols, i.which, i.at[pick])
    return out


def backward(p: Model, x: np.ndarray, c: dict, dlogit: np.ndarray) -> tuple[Model, np.ndarray]:
    """Gradients of the weights, and of the word vectors."""
    k, live = HIDDEN, c["live"]
    g = {"wo": c["pooled"].T @ dlogit, "bo": dlogit.sum(keepdims=True)}
    dpool = dlogit[:, None] * p["wo"]
    dboth = c["a"][:, :, None] * dpool
    da = (c["both"] * dpool).sum(2)
    de = c["a"] * (da - (c["a"] * da).sum(0))
    g["va"] = np.einsum("tbh,tb->h", c["u"], de)
    du = de[:, :, None] * p["va"] * (1 - c["u"] ** 2)
    g["wa"] = np.einsum("tbi,tbj->ij", c["both"], du)
    dboth += du @ p["wa"].T
    dboth *= live[:, :, None]
    dback = np.zeros_like(dboth[:, :, k:])
    for t in range(len(live)):
        np.add.at(dback, (c["back"][t], np.arange(live.shape[1])), dboth[t, :, k:])
    dx = np.zeros_like(x)
    for side, dh_t in (("f", dboth[:, :, :k]), ("b", dback)):
        wh, dwh, dproj = p[f"wh_{side}"], np.zeros_like(p[f"wh_{side}"]), np.zeros((len(x), 3 * k), np.float32)
        dh = np.zeros_like(dh_t[0])
        for t in range(len(live) - 1, -1, -1):
            h, z, r, n, gn = c["caches"][side][t]
            dh = dh + dh_t[t]
            on = dh * live[t][:, None]
            dn = on * (1 - z) * (1 - n ** 2)
            dz = on * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dgate = np.concatenate([dz, dr, dn * r], 1)
            dwh += h.T @ dgate
            np.add.at(dproj, c["places"][side][t], np.concatenate([dz, dr, dn], 1))
            dh = np.where(live[t][:, None], on * z + dgate @ wh.T, dh)
        g[f"wh_{side}"], g[f"wx_{side}"], g[f"b_{side}"] = dwh, x.T @ dproj, dproj.sum(0)
        dx += dproj @ p[f"wx_{side}"].T
    return g, dx


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> Model | None:
    """Adam on the logistic loss of each text's highest window; None without both classes.

    At least ``epochs`` rounds, and as many as make STEPS steps.
    """
    if len(set(labels.tolist())) < 2:
        return None
    p, rng = new_model(), np.random.default_rng(11)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in "mv")
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    step = 0
    for _ in range(max(epochs, -(-STEPS * batch // len(texts)))):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            i = Inputs([texts[j] for j in pick])
            if not len(i.doc):
                continue
            x = i.vectors(p)
            proj = project(p, x)
            logit = all_logits(p, proj, i)
            rank = np.lexsort((-logit, i.doc))
            top = rank[np.flatnonzero(np.diff(i.doc[rank], prepend=-1))]
            keep: dict = {}
            d = _sigmoid(forward(p, proj, i.which, i.at[top], i.len[top], keep)) - labels[pick][i.doc[top]]
            grads, dx = backward(p, x, keep, (d * weight[pick][i.doc[top]] / len(top)).astype(np.float32))
            used = np.flatnonzero(np.abs(dx).sum(1))
            grads["word"], grads["tri"] = np.zeros_like(p["word"]), np.zeros_like(p["tri"])
            np.add.at(grads["word"], i.word[used], dx[used, :EMBED])
            per = dx[used, EMBED:] / i.size[used][:, None]
            rows = np.concatenate([np.arange(a, z) for a, z in zip(i.cut[used], i.cut[used + 1], strict=True)] or [used])
            np.add.at(grads["tri"], i.tri[rows], np.repeat(per, i.size[used], axis=0))
            step += 1
            for k in p:
                m[k] += 0.1 * (grads[k] - m[k])
                v[k] += 0.001 * (grads[k] ** 2 - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32)
    return p


def scores(p: Model, texts: list[bytes], part: int = 1 << 19) -> np.ndarray:
    """Score of each text: its highest window. Texts are taken some ``part`` bytes at a time."""
    out, lo = np.zeros(len(texts)), 0
    ends = np.cumsum([len(t) for t in texts])
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + part)))
        i = Inputs(texts[lo:hi])
        logit = all_logits(p, project(p, i.vectors(p)), i)
        np.maximum.at(out, lo + i.doc, _sigmoid(logit.astype(np.float64)))
        lo = hi
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
          positives: int = POSITIVES, negatives: int = NEGATIVES, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on a bounded sample of the labelled texts outside the held-out fold."""
    y = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
         .filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (id_fold("_id", HOLD_MOD) != HOLD_OUT))
         .groupBy("_id").agg(F.max("_y").alias("_y")))
    order = F.xxhash64("_id"), F.col("_id")
    sample = (y.filter("_y = 1").orderBy(*order).limit(positives)
              .unionByName(y.filter("_y = 0").orderBy(*order).limit(negatives)))
    rows = (docs.select(F.col(id_col).alias("_id"), text_bytes(text).alias("_t"))
            .filter(F.octet_length("_t") <= sample_bytes)
            .join(F.broadcast(sample), "_id")       # at most positives + negatives rows
            .groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y"))
            .orderBy("_id").collect())
    return fit([bytes(r["_t"]) for r in rows], np.array([r["_y"] for r in rows], np.float64))


def score_column(spark: SparkSession, model: Model | None, text: str = "text") -> Column:
    """Score of a text column, from 0 to 1."""
    if model is None:
        return F.lit(0.0)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(scores(shared.value, list(b)))

    return score(text_bytes(text))


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model | None, text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without texts that score ``threshold`` or more."""
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, score_column(spark, model, text)).filter(F.col(name) < threshold).drop(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out, its score and the prediction at the threshold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", F.coalesce(id_fold("doc_id", HOLD_MOD) == HOLD_OUT, F.lit(False)).alias("held_out"),
                      score_column(spark, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
