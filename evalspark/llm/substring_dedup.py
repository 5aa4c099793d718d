"""Substring dedup by repeated-phrase automata.

A window of ``width`` consecutive words that starts at two or more places of the corpus (in
the same document or not) is recurring; every word that a recurring window covers is removed,
first copies included. Windows are judged on the input.

1. Window hashes of all documents are counted by ``exchange.global_counts``: a count of two
   or more confirms a window (64 bits besides the bucket number).
2. Documents are dealt to shards by all their columns, so copies of one text spread over all
   shards; the confirmed passages of a shard (longest runs of words
   that confirmed windows cover) are compiled into one Aho-Corasick automaton.
3. All documents of the shard stream through it; each place where a passage matches whole
   words is removed. Passages of one text are parted by at least one word, so the longest
   match from the left is the whole passage.

Null text: no words. A text of fewer than ``width`` words is left alone. Repeated rows are
further occurrences, so equal rows of at least ``width`` words lose all words. Null and
repeated ids are allowed; extra columns are kept and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from evalspark.llm import exchange as X
from evalspark.llm.common import free_name, table, text_bytes
from evalspark.llm.textarrays import Words

WIDTH = 35


def _covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    d = np.zeros(n_words + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + width, -1)
    return np.cumsum(d[:-1]) > 0


def _runs(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marked words that end with their document: first word, end."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = (np.diff(at, prepend=at[0] - 2) != 1) | (np.diff(doc[at], prepend=doc[at[0]]) != 0)
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def _spaced(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogateescape")


#: Bytes of a shard's texts whose passages share an automaton: it takes many times their size.
PART_BYTES = 1 << 18


def remove_passages(texts: list[bytes], w: Words, starts: np.ndarray, width: int) -> list[tuple[int, int, bytes]]:
    """(words, words removed, kept words joined by a space) of each text of a shard.

    ``starts``: first words of the confirmed windows. A passage of one text that another holds is a part of one
    of that text's own, so texts are cut in parts of some :data:`PART_BYTES`, each with an automaton of its own.
    """
    first, end = _runs(_covered(len(w.hash), starts, width), w.doc)
    runs = np.searchsorted(w.doc[first], np.arange(len(texts) + 1)) if len(first) else np.zeros(len(texts) + 1, np.int64)
    out: list[tuple[int, int, bytes]] = []
    part = np.cumsum([0, *(len(t) for t in texts)])[:-1] // PART_BYTES
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        at = slice(runs[a], runs[z])
        out += _remove_part(texts, w, zip(first[at].tolist(), end[at].tolist(), strict=True), range(a, z), width)
    return out


def _remove_part(texts: list[bytes], w: Words, runs: Iterable[tuple[int, int]], docs: range, width: int
                 ) -> list[tuple[int, int, bytes]]:
    """:func:`remove_passages` of the texts ``docs``, whose confirmed passages are ``runs``."""
    tokens: dict[int, list[bytes]] = {}
    patterns: set[str] = set()
    for a, b in runs:
        d = int(w.doc[a])
        words = tokens.get(d) or tokens.setdefault(d, texts[d].split())
        patterns.add(_spaced(words[a - w.first[d]:b - w.first[d]]))
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in patterns:
        auto.add_word(p)
    if patterns:
        auto.make_automaton()
    out = []
    for d in docs:
        text = texts[d]
        words = tokens.get(d) or text.split()
        n = len(words)
        if not patterns or n < width:
            out.append((n, 0, b" ".join(words)))
            continue
        line = _spaced(words)
        kept, at, removed = [], 0, 0
        for last, size in auto.iter_long(line):
            kept.append(line[at:last - size + 2])
            removed += line.count(" ", last - size + 1, last)
            at = last
        if not removed:
            out.append((n, 0, b" ".join(words)))
            continue
        kept.append(line[at:])
        rest = " ".join("".join(kept).split(" ")).encode("utf-8", "surrogateescape")
        out.append((n, removed, b" ".join(rest.split())))
    return out


def substring_dedup(spark: SparkSession, docs: DataFrame, text: str = "text", width: int = WIDTH,
                    joined: bool = False) -> DataFrame:
    """``docs`` with ``text`` cut to its kept words, and columns n_words and n_removed.

    A document that loses nothing keeps its text byte for byte (null stays null) unless
    ``joined``; otherwise the kept words are joined by one space. ``n_words`` and
    ``n_removed`` replace input columns of these names.
    """
    raw = free_name(docs, "raw")
    rest = [x for x in docs.columns if x not in (text, "n_words", "n_removed")]
    hidden = docs.select(*rest, text_bytes(text).alias(raw), F.col(text).isNull().alias(raw + "_null"))
    c = X.chunked(spark, hidden, raw, X.hashable(hidden, rest))     # by the text alone, copies would meet in one chunk
    answers = X.global_counts(c, raw, lambda texts: Words(texts).grams(width)[1], width=8, count_type="u1")

    def cut(rows: pa.Table, answer: pa.Table) -> pa.Table:
        texts = rows[raw].to_pylist()
        w = Words(texts)
        at, h = w.grams(width)
        _, inverse = np.unique(h, return_inverse=True)
        starts = at[X.totals_of(answer, "u1")[inverse] >= 2] if len(h) else at
        done = remove_passages(texts, w, starts, width)
        new = [None if null and not joined else k if r or joined else t
               for t, (_, r, k), null in zip(texts, done, rows[raw + "_null"].to_pylist(), strict=True)]
        out = rows.select(rest).append_column(raw, pa.array(new, pa.binary()))
        out = out.append_column("n_words", pa.array([x[0] for x in done], pa.int64()))
        return out.append_column("n_removed", pa.array([x[1] for x in done], pa.int64()))

    schema = StructType([*hidden.select(*rest).schema.fields, StructField(raw, BinaryType()),
                         StructField("n_words", LongType()), StructField("n_removed", LongType())])
    out = X.with_counts(c, answers, cut, schema)
    return out.select(*[F.col(raw).cast("string").alias(text) if x == text else F.col(x)
                        for x in docs.columns if x not in ("n_words", "n_removed")], "n_words", "n_removed")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words removed, digest of the kept words joined by one space."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup(spark, docs, joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1),
               lambda i: CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i+34], ' ')) END)) AS h FROM words),
seen AS (SELECT h, count(*) AS n FROM win WHERE h IS NOT NULL GROUP BY h),
cov AS (
  SELECT doc_id, i, word, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM win LEFT JOIN seen USING (h)),
agg AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""
