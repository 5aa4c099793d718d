"""Language of texts by a linear-chain conditional random field over their words.

Every word has features: its lower-cased form (the lexicon), its prefixes and suffixes of two
to four bytes, and its byte trigrams, hashed into one weight table with a weight per language.
Learned transitions tie neighbouring words together, so a word that two languages share is
read as its surroundings are; forward-backward gives each word's probabilities in code-switched
text. A text's language is the one with the largest mean probability over its words that hold
a letter (``score`` is that mean; ties go to the language that sorts first); ``und`` with
score 0 if the text is null or holds no letter.

Training reads a bounded sample on the driver: ``per_lang`` texts of each language outside the
held-out fold, in the order of a hash of their ids, of at most ``sample_bytes`` each. Spans of
random length from random texts are strung together, so that transitions are learned on
code-switched chains. Whole texts are labelled by a pandas UDF without a shuffle; a batch is
one chain whose texts do not influence each other, and long texts are never cut.

Languages are the non-null values of ``lang`` found in the sample. Without any, all texts are
``und``. Equal texts get equal results. Extra columns are kept and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import pandas_udf

from evalspark.llm.common import id_fold, small_batches, table, text_bytes
from evalspark.llm.textarrays import U, Words, mix, spans_hash

ROWS = 1 << 17
AFFIXES = (2, 3, 4)
PER_LANG, SAMPLE_BYTES, SPAN = 400, 1 << 14, (4, 40)
CHAINS, LENGTH, STEPS = 32, 128, 400
HOLD_MOD, HOLD_OUT = 4, 2
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Features:
    """Rows of the weight table for each distinct word of a batch: some fixed, and its trigrams."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, lower=True)
        self.doc, self.first = w.doc, w.first
        _, at, self.which = np.unique(w.hash, return_index=True, return_inverse=True)
        start, end = w.start[at], w.end[at]
        size = end - start
        rows = [w.hash[at]]
        for n in AFFIXES:
            k = np.minimum(size, n)
            rows += [mix(spans_hash(w.pre, start, start + k, "byte") + U(2 * n)),
                     mix(spans_hash(w.pre, end - k, end, "byte") + U(2 * n + 1))]
        self.fixed = np.stack([(r % U(ROWS)).astype(np.int32) for r in rows])
        self.cut = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(self.cut[-1]) + np.repeat(start - self.cut[:-1], size)
        b = np.concatenate([[32], np.where(w.buf < 33, 32, w.buf)]).astype(np.uint32)
        code = b[place] | (b[place + 1] << np.uint32(8)) | (b[place + 2] << np.uint32(16))
        self.tri = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - ROWS.bit_length() + 1)).astype(np.int32)
        letters = np.concatenate([[0], np.cumsum(_LETTER[w.buf])])
        self.lettered = letters[end] > letters[start]       # of distinct words
        self.size = size

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Score of each language for each distinct word."""
        if not len(self.size):
            return np.zeros((0, weights.shape[1]), np.float32)
        out = np.add.reduceat(weights[self.tri], self.cut[:-1], axis=0) / self.size[:, None].astype(np.float32)
        for rows in self.fixed:
            out += weights[rows]
        return out


def marginals(e: np.ndarray, trans: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Forward-backward: probabilities of the labels of each word of one long chain.

    ``reset`` marks words that begin a text: nothing passes from the word before. The chain is
    folded into blocks that are worked side by side: products of the transfer matrices give
    what enters each block from either side, then all blocks are filled in at once.
    """
    n, k = e.shape
    if not n:
        return np.zeros((0, k))
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    psi = np.exp(e - e.max(1, keepdims=True)).astype(np.float64)
    psi = np.concatenate([psi, np.ones((pad, k))]).reshape(blocks, width, k) + 1e-30
    cut = np.concatenate([reset, np.ones(pad, bool)]).reshape(blocks, width)
    m = np.exp(trans - trans.max()).astype(np.float64)

    def through(state: np.ndarray, t: int) -> np.ndarray:
        """Rows of weights (blocks, r, k) carried over word t."""
        flow = np.where(cut[:, t, None, None], state.sum(2, keepdims=True), state @ m)
        return flow * psi[:, t, None, :]

    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(width):
        whole = through(whole, t)
        whole /= whole.sum((1, 2), keepdims=True)
    enter, leave = np.ones((blocks, k)), np.ones((blocks, k))
    for b in range(1, blocks):
        x = enter[b - 1] @ whole[b - 1]
        enter[b] = x / x.sum()
        y = whole[-b] @ leave[-b]
        leave[-b - 1] = y / y.sum()
    alpha = np.empty((blocks, width, k))
    state = enter[:, None, :]
    for t in range(width):
        state = through(state, t)
        state = state / state.sum(2, keepdims=True)
        alpha[:, t] = state[:, 0]
    beta, back = np.empty((blocks, width, k)), leave
    for t in range(width - 1, -1, -1):
        beta[:, t] = back
        x = back * psi[:, t]
        back = np.where(cut[:, t, None], x.sum(1, keepdims=True), x @ m.T)
        back = back / back.sum(1, keepdims=True)
    p = (alpha * beta).reshape(-1, k)[:n]
    return p / p.sum(1, keepdims=True)


def fit(texts: list[bytes], labels: np.ndarray, k: int, steps: int = STEPS, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(weight table, transitions) by AdaGrad on the chains' log likelihood."""
    rng = np.random.default_rng(5)
    f = Features(texts)
    weights, trans = np.zeros((ROWS, k), np.float32), np.zeros((k, k))
    gw, gt = np.full((ROWS, k), 1e-4, np.float32), np.full((k, k), 1e-4)
    filled = np.flatnonzero(np.diff(f.first) > 0)
    if not len(filled):
        return weights, trans
    by_lang = [filled[labels[filled] == x] for x in range(k)]
    by_lang = [x for x in by_lang if len(x)]
    size = CHAINS * LENGTH
    for _ in range(steps):
        words, length = [], 0
        while length < size:        # languages alike often, whatever their shares
            d = int(rng.choice(by_lang[rng.integers(len(by_lang))]))
            a = int(rng.integers(f.first[d], f.first[d + 1]))
            z = min(int(f.first[d + 1]), a + int(rng.integers(*SPAN)))
            words.append(np.arange(a, z))
            length += z - a
        at = np.concatenate(words)[:size]
        y, which = labels[f.doc[at]], f.which[at]
        reset = np.arange(size) % LENGTH == 0
        distinct, inv = np.unique(which, return_inverse=True)
        rows = np.concatenate([np.arange(f.cut[w], f.cut[w + 1]) for w in distinct])
        part = np.repeat(np.arange(len(distinct)), f.size[distinct])
        inside = 1 / f.size[distinct][part, None].astype(np.float32)
        tri = f.tri[rows]
        e = np.zeros((len(distinct), k), np.float32)
        np.add.at(e, part, weights[tri] * inside)
        for r in f.fixed:
            e += weights[r[distinct]]
        p = marginals(e[inv], trans, reset)
        gold = np.eye(k)[y]
        g = np.zeros((len(distinct), k), np.float32)
        np.add.at(g, inv, ((p - gold) / 64).astype(np.float32))
        for r, d in [(r[distinct], g) for r in f.fixed] + [(tri, g[part] * inside)]:
            uniq, back = np.unique(r, return_inverse=True)
            s = np.zeros((len(uniq), k), np.float32)
            np.add.at(s, back, d)
            gw[uniq] += s ** 2
            weights[uniq] -= rate * s / np.sqrt(gw[uniq])
        # pairs: expected minus seen, from the marginals of both neighbours under the chain
        pair = np.flatnonzero(~reset)
        joint = _pairs(e[inv], trans, p, pair)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[pair - 1], y[pair]), 1)
        d = (joint - seen) / len(pair)
        gt += d ** 2
        trans -= rate * d / np.sqrt(gt)
    return weights, trans


def _pairs(e: np.ndarray, trans: np.ndarray, p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected label pairs of words ``at`` and those before them.

    P(a, b) is in proportion to alpha(a) M(a, b) psi(b) beta(b). alpha is in proportion to
    p / beta before the word, and psi beta to p / (alpha M) at it; both come from p by solving
    the rows: the pair table with marginals p before and p at the word and odds ratios of M.
    """
    m = np.exp(trans - trans.max())
    left, right = p[at - 1], p[at]
    v = np.ones_like(right)
    for _ in range(30):     # iterative proportional fitting converges to that table
        u = left / np.maximum(v @ m.T, 1e-300)
        v = right / np.maximum(u @ m, 1e-300)
    return np.einsum("na,ab,nb->ab", u, m, v)


class Tagger:
    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.weights, self.trans = langs, weights, trans

    def words(self, texts: list[bytes]) -> tuple[Features, np.ndarray]:
        """Features of a batch, and each word's probabilities."""
        f = Features(texts)
        reset = np.zeros(len(f.which), bool)
        reset[f.first[:-1][np.diff(f.first) > 0]] = True
        return f, marginals(self.emissions(f), self.trans, reset)

    def emissions(self, f: Features) -> np.ndarray:
        return f.emissions(self.weights)[f.which]

    def languages(self, texts: list[bytes], part: int = 1 << 19) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        out, score, lo = [], np.zeros(len(texts)), 0
        ends = np.cumsum([len(t) for t in texts])
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + part)))
            f, p = self.words(texts[lo:hi])
            m, k = hi - lo, len(self.langs)
            on = f.lettered[f.which].astype(np.float64)
            count = np.bincount(f.doc, on, m)
            mean = np.stack([np.bincount(f.doc, on * p[:, j], m) for j in range(k)], 1) / np.maximum(count, 1)[:, None]
            best = mean.argmax(1)
            for d in range(m):
                known = count[d] > 0 and has_letter(texts[lo + d])
                out.append(self.langs[best[d]] if known else UNKNOWN)
                score[lo + d] = mean[d, best[d]] if known else 0.0
            lo = hi
        return out, np.clip(score, 0, 1)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
          per_lang: int = PER_LANG, sample_bytes: int = SAMPLE_BYTES) -> Tagger | None:
    """Fit on a bounded sample outside the held-out fold; None if no text has a language."""
    fold = F.coalesce(id_fold(id_col, HOLD_MOD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang).cast("string").alias("_lang"), text_bytes(text).alias("_t"),
                       fold.alias("_f")).filter(
        (F.col("_f") != HOLD_OUT) & F.col("_lang").isNotNull() & F.octet_length("_t").between(1, sample_bytes))
    # equal texts of one id are one candidate; the first by hash of id and text, whatever the ids look like. The
    # limit of a rank is applied in each task before the shuffle, so no language's rows are ranked whole
    keyed = rows.select("_lang", "_t", F.xxhash64("_id", "_t").alias("_k"))
    by_hash = Window.partitionBy("_lang").orderBy("_k")
    first = keyed.groupBy("_lang", "_k").agg(F.count(F.lit(1)).alias("_n")).withColumn("_r", F.row_number().over(by_hash)) \
        .filter(F.col("_r") <= per_lang).select("_lang", "_k")
    # per_lang rows a language
    got = keyed.join(F.broadcast(first), ["_lang", "_k"]).groupBy("_lang", "_k").agg(F.first("_t").alias("_t")) \
        .select("_lang", "_t").orderBy("_lang", "_t").collect()
    langs = sorted({r["_lang"] for r in got})
    if not langs:
        return None
    labels = np.array([langs.index(r["_lang"]) for r in got])
    return Tagger(langs, *fit([bytes(r["_t"]) for r in got], labels, len(langs)))


def language_column(spark: SparkSession, tagger: Tagger | None, text: str = "text") -> Column:
    """struct<lang, score> of a text column."""
    if tagger is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tagger)

    @pandas_udf("struct<lang:string,score:double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, score = shared.value.languages(list(b))
            yield pd.DataFrame({"lang": langs, "score": score})

    return label(text_bytes(text))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out, its predicted language and the score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_column(spark, train(docs))
    return docs.select("doc_id", F.coalesce(id_fold("doc_id", HOLD_MOD) == HOLD_OUT, F.lit(False)).alias("held_out"),
                       found.alias("found")).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"),
                                                    F.col("found.score").alias("score"))
