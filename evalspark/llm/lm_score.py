"""Language-model scores with stupid backoff, from n-gram counts of the whole corpus.

S(w | u v) = c(u v w) / c(u v) if the trigram was seen at least ``min_count`` times, else
``alpha`` times the bigram score c(v w) / c(v) under the same rule, else ``alpha`` times
c(w) / N. A document's score is the sum of the logs over its words (lower-cased A to Z).
The scored documents are part of the corpus, so ``min_count`` is 2 by default: an n-gram
that occurs nowhere else is no evidence.

The count tables are partitioned by n-gram hash and joined to the documents' exploded
n-grams; both sides move in packed blocks (``exchange``), since one row per n-gram and order
would shuffle some ten times the corpus. A block holds the differences of its sorted keys.
An n-gram is known by at least 48 bits besides its bucket number (64 in all from 65,536
buckets on); as buckets grow in number with the corpus, about one n-gram in 10**8 shares its
counts with another at any size up to there.

Null, empty or blank texts: no words, score 0, mean null. Every row is scored, equal rows
alike and each counted. Extra columns are not read. Null ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import exchange as X
from evalspark.llm.common import table, text_bytes
from evalspark.llm.textarrays import U, Words, mix

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
_ALL = U(0x5851F42D4C957F2D)    # key of the empty n-gram: its count is the corpus size


def _keys(w: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first word, key) for each order from 1."""
    out = []
    for n in range(1, order + 1):
        at, h = w.grams(n)
        out.append((at, mix(h + U(n))))
    return out


def _all_keys(texts: list[bytes], order: int) -> np.ndarray:
    w = Words(texts, lower=True)
    return np.concatenate([np.full(len(w.hash), _ALL), *(k for _, k in _keys(w, order))])


def backoff_logs(counts: list[np.ndarray], n_words: np.ndarray, total: int, alpha: float,
                 min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """(log score, order used) of every word.

    ``counts[n - 1][i]``: corpus count of the n-gram that ends at word i, 0 where the text
    has no n words there. ``n_words`` is the place of each word in its text.
    """
    size = len(counts[0])
    score = np.log(counts[0] / max(total, 1))
    used = np.ones(size, np.int64)
    for n in range(2, len(counts) + 1):
        ctx = np.concatenate([[1], counts[n - 2][:-1]])     # the n-1 words before word i
        seen = counts[n - 1] >= min_count
        full = np.log(np.maximum(counts[n - 1], 1) / np.maximum(ctx, 1))
        # a word with fewer than n-1 words before it has no n-gram to back off from
        score = np.where(seen, full, np.where(n_words >= n - 1, score + np.log(alpha), score))
        used = np.where(seen, n, used)
    return score, used


def lm_scores(spark: SparkSession, docs: DataFrame, text: str = "text", id_col: str = "doc_id",
              order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, n_words, log_score, n_backoff): words, sum of logs, words scored below full order."""
    rows = docs.select(F.col(id_col), text_bytes(text).alias("_raw"))
    c = X.chunked(spark, rows, "_raw", [id_col], chunk_bytes=4 << 20)
    answers = X.global_counts(c, "_raw", lambda t: _all_keys(t, order), width=None, count_type="<u8")

    def score(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        texts = chunk["_raw"].to_pylist()
        w = Words(texts, lower=True)
        grams = _keys(w, order)
        n, m = len(w.hash), len(texts)
        logs, below = np.zeros(m), np.zeros(m, np.int64)
        if n:
            keys = np.concatenate([np.full(1, _ALL), *(k for _, k in grams)])
            _, inverse = np.unique(keys, return_inverse=True)
            got = X.totals_of(answer, "<u8", X.unsqueeze)[inverse].astype(np.int64)
            counts, at = [], 1
            for k, (first, _) in enumerate(grams):
                here = np.zeros(n, np.int64)
                here[first + k] = got[at:at + len(first)]
                counts.append(here)
                at += len(first)
            place = np.arange(n) - w.first[w.doc]
            s, used = backoff_logs(counts, place, int(got[0]), alpha, min_count)
            logs = np.bincount(w.doc, s, m)
            below = np.bincount(w.doc, used < np.minimum(place + 1, order), m).astype(np.int64)
        return pa.table({id_col: chunk[id_col], "n_words": np.diff(w.first), "log_score": logs, "n_backoff": below})

    kind = rows.schema[id_col].dataType.simpleString()
    return X.with_counts(c, answers, score,
                         f"`{id_col}` {kind}, n_words long, log_score double, n_backoff long")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, log score and its mean, words scored by backoff."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scores(spark, docs)
    return out.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"),
                      F.round(F.col("log_score") / F.nullif("n_words", F.lit(0)), 6).alias("mean_log"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
g AS (SELECT doc_id, i, w[i] AS g1,
             CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS g2,
             CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS g3,
             CASE WHEN i > 1 THEN w[i-1] END AS h1,
             CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] END AS h2 FROM pos),
c1 AS (SELECT g1 AS k, count(*) AS n FROM g GROUP BY 1),
c2 AS (SELECT g2 AS k, count(*) AS n FROM g WHERE g2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT g3 AS k, count(*) AS n FROM g WHERE g3 IS NOT NULL GROUP BY 1),
s AS (
  SELECT g.doc_id, g.i, a.n AS n1, b.n AS n2, c.n AS n3, x.n AS x1, y.n AS x2, (SELECT count(*) FROM g) AS total
  FROM g JOIN c1 a ON a.k = g1 LEFT JOIN c2 b ON b.k = g2 LEFT JOIN c3 c ON c.k = g3
  LEFT JOIN c1 x ON x.k = h1 LEFT JOIN c2 y ON y.k = h2),
t AS (
  SELECT doc_id, CASE WHEN n3 >= 2 THEN ln(n3 / x2)
              WHEN n2 >= 2 THEN ln(n2 / x1) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
              ELSE ln(n1 / total) + CASE WHEN i > 2 THEN 2 * ln(0.4) WHEN i > 1 THEN ln(0.4) ELSE 0 END END AS v,
         CASE WHEN (i > 2 AND coalesce(n3, 0) < 2) OR (i = 2 AND n2 < 2) THEN 1 ELSE 0 END AS b FROM s)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(sum(b), 0) AS BIGINT) AS n_backoff,
       round(coalesce(sum(v), 0.0), 4) AS log_score, round(sum(v) / nullif(len(w.w), 0), 6) AS mean_log
FROM words w LEFT JOIN t USING (doc_id) GROUP BY w.doc_id, len(w.w)
"""
