"""The recurrent network against plain loops, its gradients against differences, and every window of a text."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import toxicity as T


def sig(x):
    return 1 / (1 + np.exp(-x))


def plain_logit(p, vectors):
    """One window, word by word: both directions, attention, logistic unit."""
    k, sides = T.HIDDEN, {}
    for side, seq in (("f", vectors), ("b", vectors[::-1])):
        h, states = np.zeros(k), []
        for x in seq:
            a, g = x @ p[f"wx_{side}"] + p[f"b_{side}"], h @ p[f"wh_{side}"]
            z, r = sig(a[:k] + g[:k]), sig(a[k:2 * k] + g[k:2 * k])
            h = (1 - z) * np.tanh(a[2 * k:] + r * g[2 * k:]) + z * h
            states.append(h)
        sides[side] = states if side == "f" else states[::-1]
    both = [np.concatenate(s) for s in zip(sides["f"], sides["b"], strict=True)]
    e = np.array([np.tanh(s @ p["wa"]) @ p["va"] for s in both])
    a = np.exp(e - e.max())
    return sum(w * s for w, s in zip(a / a.sum(), both, strict=True)) @ p["wo"] + p["bo"][0]


def some_texts(n_words):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdeé"), r.integers(1, 7)))
    return [" ".join(word() for _ in range(n)).encode() for n in n_words]


def test_every_window_against_plain_loops():
    p = T.new_model()
    w = T.WINDOW
    texts = some_texts([1, w - 1, 0, w, w + 1, 5 * w, 3, 40 * w])
    i = T.Inputs(texts)
    x = i.vectors(p)
    got = T.all_logits(p, T.project(p, x), i, step=64)
    want, doc = [], []
    for d, t in enumerate(texts):
        n = len(t.split())
        first = int(sum(len(s.split()) for s in texts[:d]))
        for s in range(max(1, n - w + 1) if n else 0):
            want.append(plain_logit(p, [x[i.which[first + j]] for j in range(s, min(s + w, n))]))
            doc.append(d)
    assert i.doc.tolist() == doc
    assert np.allclose(got, want, atol=1e-5)
    top = [max([sig(v) for v, d in zip(want, doc, strict=True) if d == k], default=0) for k in range(len(texts))]
    assert np.allclose(T.scores(p, texts), top, atol=1e-5)
    # in batches of any size
    assert np.allclose(T.scores(p, texts, part=10), top, atol=1e-5)


def test_short_texts_between_long_ones_are_picked_one_by_one():
    p = T.new_model()
    texts = some_texts([T.WINDOW] * 30)     # one whole window a text: most slices would cross texts
    i = T.Inputs(texts)
    proj = T.project(p, i.vectors(p))
    assert np.allclose(T.all_logits(p, proj, i), T.forward(p, proj, i.which, i.at, i.len), atol=1e-5)


def test_gradients_against_differences():
    p = {k: v.astype(np.float64) for k, v in T.new_model().items()}
    i = T.Inputs(some_texts([5, T.WINDOW, 9]))
    x = i.vectors(p).astype(np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def loss(q, v):
        s = sig(T.forward(q, T.project(q, v), i.which, i.at, i.len).astype(np.float64))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    keep = {}
    d = sig(T.forward(p, T.project(p, x), i.which, i.at, i.len, keep)) - y
    grads, dx = T.backward(p, x, keep, d)
    r, step = np.random.default_rng(1), 1e-2     # states are kept as 32-bit floats
    for name, g in [*grads.items(), ("x", dx)]:
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in g.shape)
            side = []
            for e in (step, -step):
                q, v = {k: a.copy() for k, a in p.items()}, x.copy()
                (v if name == "x" else q[name])[at] += e
                side.append(loss(q, v))
            assert (side[0] - side[1]) / (2 * step) == pytest.approx(g[at], abs=3e-3, rel=2e-2), name


def test_short_passage_counts_wherever_it_stands():
    r = np.random.default_rng(5)
    clean = [b" ".join(t.split()[:60]) for t in some_texts([60] * 300)]
    bad = lambda t, at: b" ".join([*t.split()[:at], b"zzbadzz", b"zzwordzz", *t.split()[at:]])
    y = np.array([k % 2 for k in range(300)], float)
    p = T.fit([bad(t, r.integers(0, 60)) if v else t for t, v in zip(clean, y, strict=True)], y)
    base = clean[0]
    assert T.scores(p, [base])[0] < T.THRESHOLD
    assert (T.scores(p, [bad(base, at) for at in range(61)]) >= T.THRESHOLD).all()


def test_query_columns_clashes_and_repeated_labels(spark, tmp_path):
    rows = [(i, ("zzbadzz " if i % 2 else "") + " ".join("abc de fgh".split() * 4) + f" w{i}", "en", "s", 1.5) for i in range(120)]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0.0), (None, "abc", "en", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _toxicity double")
    # two labels of an id: the largest counts; null labels and labels without a text are left out
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(i, 0) for i in range(120)]
                                   + [(2, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = T.op1_toxicity(spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i in range(120):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == i % 2 == int(got[i]["score"] >= 0.7)
    assert got[500]["score"] == got[501]["score"] == 0.0
    kept = T.drop_toxic(spark, docs, T.train(docs, labels))
    assert kept.columns == docs.columns
    assert kept.filter("_toxicity = 1.5").count() == 60 and kept.filter("doc_id >= 500 or doc_id is null").count() == 3
    assert T.drop_toxic(spark, docs.limit(0), None).count() == 0
    assert T.train(docs, labels.filter(F.lit(False))) is None


def test_saturated_states_and_first_words_of_windows():
    """Weights so large that exp overflows: the states are -1 or 1, without a warning, as in the plain pass."""
    p = {k: v * np.float32(400) for k, v in T.new_model().items()}
    i = T.Inputs(some_texts([3 * T.WINDOW, 20, 2 * T.WINDOW]))
    proj = T.project(p, i.vectors(p))
    with np.errstate(all="raise", under="ignore"):
        got = T.all_logits(p, proj, i, step=16)
    assert np.isfinite(got).all() and np.allclose(got, T.forward(p, proj, i.which, i.at, i.len), rtol=1e-4, atol=1e-2)
    # the state after a window's first word is computed once a distinct word
    p = T.new_model()
    proj = T.project(p, i.vectors(p))
    at = np.arange(len(i.which))
    for side in "fb":
        h = T._gru(proj[side], p[f"wh_{side}"], i.which[None, at], np.ones((1, len(at)), bool), None)[0]
        assert np.allclose(T._starts(T._scaled(proj[side].T))[:, i.which].T, h, atol=1e-6)
