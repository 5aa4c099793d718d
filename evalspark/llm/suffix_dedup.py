"""Exact substring dedup over bytes, by suffix arrays built with external induced sorting.

Every byte of a document that is covered by a string of ``length`` bytes which also starts in
a document with a smaller id is removed. Strings are judged on the input; matches never cross
documents.

A suffix array over a whole corpus would have to be one task's work. It is cut into shards in
which all equal strings meet, so each shard is sorted alone and nothing is lost:

1. Of any ``length`` bytes in a row, the ``GRAM``-byte gram with the least hash is its anchor;
   equal strings have equal anchors at equal places. Anchors are counted over the corpus
   (``exchange.global_counts``); a string whose anchor occurs once is unique.
2. Around each anchor that occurs again lies its segment: the bytes that strings with this
   anchor can reach. Distinct segments of a chunk of documents, each with its smallest id, go
   to the shard of the anchor's hash. A passage that a third of all documents hold is one
   segment a chunk.
3. Every string around an anchor holds the anchor with the bytes before it or with those
   after it, up to half of the rest. A distinct segment of a shard that shares neither with
   another one shares no string with it, and is answered by its own smallest id. Of the
   others a shard sorts all suffixes by external induced sorting with common-prefix values
   (``induced_sort``): the priority queues and, if large, the sequences are on disk, but a
   shard's segments and their arrays are in memory, so shards must be small. Neighbours with a common prefix of ``length`` are
   equal strings; the smallest id among them decides.
4. Each segment's answer, one bit for each string in it, returns to its chunk.

Ids are integers; a null id counts as larger than all others, and equal ids are not smaller
than one another, so repeated rows of one id keep each other. Null texts: empty. Texts
shorter than ``length`` lose nothing and take nothing. Extra columns are kept and never looked at.
"""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from evalspark.llm import exchange as X
from evalspark.llm.common import free_name, partitions, table, text_bytes
from evalspark.llm.induced_sort import sorted_suffixes
from evalspark.llm.textarrays import U, join_texts, prefix, rolling, spans_hash

LENGTH, GRAM = 50, 25
MEMORY = 32 << 20       # bytes that a shard's queues hold in memory, and above which its arrays are files
SHARD_BYTES = 3 << 20   # bytes of text a shard: its segments come to about as much
_ORDER = U(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of x[i:i + width] for every i; x is padded at the end by its own rule."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


class Anchors:
    """Anchor places of a batch of texts, their keys and segments."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.buf, self.offs = join_texts(texts)
        size = np.diff(self.offs) - 1
        n = len(self.buf)
        self.pre = prefix(self.buf.astype(U) + U(1), "byte")
        edge = np.zeros(n + 1, np.int64)
        long_ = size >= length
        np.add.at(edge, self.offs[:-1][long_], 1)
        np.add.at(edge, (self.offs[:-1] + size - gram + 1)[long_], -1)
        valid = np.cumsum(edge[:-1]) > 0
        key = np.zeros(n, U)
        key[:max(0, n - gram + 1)] = rolling(self.pre, n, gram, "byte")
        top = np.uint32(0xFFFFFFFF)
        # not the key's own top bits, by which keys are dealt to buckets and shards: anchors would meet in the first of them
        h = np.where(valid, ((key * _ORDER) >> U(32)).astype(np.uint32), top)
        span = length - gram + 1
        pad = np.full(span - 1, top)
        low = _slide(np.concatenate([pad, h, pad]), span, np.minimum)     # windows that start at -(span-1) and later
        self.at = np.flatnonzero(valid & (_slide(low, span, np.maximum) == h))
        self.key = key[self.at]
        self.length, self.gram = length, gram

    def segments(self, ids: np.ndarray, repeated: np.ndarray) -> None:
        """Segments of the anchors marked in ``repeated``; ``ids``: id of each text."""
        at, self.seg_key = self.at[repeated], self.key[repeated]
        self.seg_doc = np.searchsorted(self.offs, at, side="right") - 1
        reach = self.length - self.gram
        self.a = np.maximum(at - reach, self.offs[self.seg_doc])
        self.left = (at - self.a).astype("u1")
        self.z = np.minimum(at + self.length, self.offs[self.seg_doc + 1] - 1)
        h = spans_hash(self.pre, self.a, self.z, "byte")
        # one anchor's segments together; what is equal is sent once, with its smallest id
        order = np.lexsort((h, self.seg_key))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (self.seg_key[order][1:] != self.seg_key[order][:-1])
        self.one = order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = np.full(len(self.one), _LAST)
        np.minimum.at(self.least, self.of, ids[self.seg_doc])

    def covered(self, ids: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Bytes to remove: ``masks`` has, for each distinct segment, a bit for each string in it."""
        offset = np.arange(self.length - self.gram + 1)
        inside = offset <= (self.z - self.a - self.length)[:, None]
        gone = (masks[self.of][:, None] >> offset.astype(np.uint32)) & np.uint32(1) > 0
        # with a smaller id in this chunk the whole segment is a copy
        gone |= (self.least[self.of] < ids[self.seg_doc])[:, None]
        hit = np.zeros(len(self.buf) + 1, np.int64)
        hit[(self.a[:, None] + offset)[gone & inside]] = 1
        run = np.cumsum(hit[:-1])
        run[self.length:] -= run[:-self.length].copy()
        return run > 0


def _file_array(folder: str, name: str, n: int, dtype, memory: int) -> np.ndarray:
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype)
    return np.memmap(os.path.join(folder, name), dtype, "w+", shape=(n,))


def _shared(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[of] > 1


def may_share(pre: np.ndarray, start: np.ndarray, end: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which of the distinct segments may share a string of ``length`` bytes, anchor at the same place, with another."""
    before = (length - gram) // 2
    lo, hi = anchor - before, anchor + length - before      # a string holds [lo, anchor + gram) or [anchor, hi)
    out = np.zeros(len(start), bool)
    for fits, a, z in ((lo >= start, lo, anchor + gram), (hi <= end, anchor, hi)):
        out[fits] |= _shared(spans_hash(pre, a[fits], z[fits], "byte"))
    return out


def smaller_id_masks(segments: bytes, sizes: np.ndarray, left: np.ndarray, least: np.ndarray, length: int, gram: int,
                     memory: int = MEMORY) -> np.ndarray:
    """For each segment, a bit for each of its first strings, one at each place of the anchor: it occurs with a smaller id.

    ``left`` is the anchor's place in the segment, ``least`` the smallest id that the segment
    occurs with in its chunk.
    """
    raw, strings = np.frombuffer(segments, np.uint8), length - gram + 1
    end = np.cumsum(sizes.astype(np.int64))
    start = end - sizes
    pre = prefix(raw.astype(U) + U(1), "byte")
    h = spans_hash(pre, start, end, "byte") + left * U(0x9E3779B97F4A7C15)
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    low = np.full(len(one), _LAST)
    np.minimum.at(low, of, least)
    # strings of a segment that shares none: as its own copies have them
    every = (1 << np.clip(sizes.astype(np.int64) - length + 1, 0, strings)) - 1
    out = np.where(low[of] < least, every, 0).astype(np.uint32)
    share = may_share(pre, start[one], end[one], start[one] + left[one], length, gram)
    del pre, h
    if not share.any():
        return out
    kept = np.flatnonzero(share[of])
    of, one, low = (np.cumsum(share) - 1)[of[kept]], one[share], low[share]
    out[kept] = _sorted_masks(raw, start, sizes, one, of, low, least[kept], length, strings, memory)
    return out


def _sorted_masks(raw: np.ndarray, start: np.ndarray, sizes: np.ndarray, one: np.ndarray, of: np.ndarray, low: np.ndarray,
                  least: np.ndarray, length: int, strings: int, memory: int) -> np.ndarray:
    """Masks of segments ``of`` whose distinct ones are ``one``, with smallest ids ``low``, by sorting all suffixes."""
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        size = sizes[one].astype(np.int64)
        first = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum()) + 1
        text = _file_array(folder, "text", n, np.uint16, memory)
        rest = _file_array(folder, "rest", n, np.uint8, memory)
        seg = _file_array(folder, "seg", n, np.int32, memory)
        least_at = _file_array(folder, "least", n, np.int64, memory)
        least_at[:] = _LAST
        step = max(1, len(one) // (n // (1 << 22) + 1))
        for lo in range(0, len(one), step):     # a bounded part of the shard at a time
            sl = slice(lo, lo + step)
            nth = np.arange(int(size[sl].sum())) - np.repeat(np.cumsum(size[sl]) - size[sl], size[sl])
            to = np.repeat(first[sl], size[sl]) + nth
            text[to] = raw[np.repeat(start[one[sl]], size[sl]) + nth].astype(np.uint16) + 2
            rest[to] = np.repeat(size[sl], size[sl]) - nth
            seg[to] = np.repeat(np.arange(lo, lo + len(size[sl])), size[sl])
            text[first[sl] + size[sl]] = 1      # parts segments; the last symbol, 0, occurs once
        group: list[np.ndarray] = []
        best = _LAST

        def close() -> None:
            for x in group:
                least_at[x] = best
            group.clear()

        for x, common in sorted_suffixes(text, folder, length, memory, rest=rest):
            cut = np.flatnonzero(common < length)
            if not len(cut) or cut[0] > 0:      # goes on with the group before
                part = x[:cut[0]] if len(cut) else x
                group.append(part)
                best = min(best, int(low[seg[part]].min()))
                if not len(cut):
                    continue
            close()
            x = x[cut[0]:]
            cut = cut - cut[0]
            mins = np.minimum.reduceat(low[seg[x]], cut)
            least_at[x[:cut[-1]]] = np.repeat(mins[:-1], np.diff(cut))
            group.append(x[cut[-1]:])
            best = int(mins[-1])
        close()
        out = np.zeros(len(of), np.uint32)
        for k in range(strings):
            has = size[of] >= length + k
            at = first[of[has]] + k
            out[has] |= (least_at[at] < least[has]).astype(np.uint32) << np.uint32(k)
    return out


def suffix_dedup(spark: SparkSession, docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                 length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept bytes (binary), and n_bytes, n_removed, n_spans.

    Columns n_bytes, n_removed and n_spans of ``docs`` are replaced. ``length - gram`` is at most 31.
    """
    added = ("n_bytes", "n_removed", "n_spans")
    raw, num = free_name(docs, "raw"), free_name(docs, "num")
    rest = [x for x in docs.columns if x not in (text, *added)]
    rows = docs.select(*rest, text_bytes(text).alias(raw),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias(num))
    c = X.chunked(spark, rows, raw, [num])
    shards = math.ceil(c.bytes / SHARD_BYTES) + partitions(spark)

    def prepare(chunk: pa.Table, answer: pa.Table) -> tuple[Anchors, np.ndarray]:
        ids = chunk[num].to_numpy()
        anchors = Anchors(chunk[raw].to_pylist(), length, gram)
        _, inverse = np.unique(anchors.key, return_inverse=True)
        count = X.totals_of(answer, "u1")[inverse] if len(inverse) else np.zeros(0, "u1")
        anchors.segments(ids, count > 1)
        return anchors, ids

    answers = X.global_counts(c, raw, lambda t: Anchors(t, length, gram).key, width=4, count_type="u1")

    def send(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        x, _ = prepare(chunk, answer)
        shard, first = X._bounds(x.seg_key[x.one], shards)
        ends = np.append(first, len(x.one))[1:]
        a, z = x.a[x.one], x.z[x.one]
        buf, size, left = x.buf.tobytes(), (z - a).astype("u1"), x.left[x.one]
        return pa.table({
            "shard": shard.astype(np.int64), X.CHUNK: pa.array([chunk[X.CHUNK][0].as_py()] * len(shard), pa.int64()),
            "segments": pa.array([b"".join([buf[i:j] for i, j in zip(a[lo:hi].tolist(), z[lo:hi].tolist(), strict=True)])
                                  for lo, hi in zip(first, ends, strict=True)], pa.binary()),
            "sizes": pa.array([size[lo:hi].tobytes() for lo, hi in zip(first, ends, strict=True)], pa.binary()),
            "lefts": pa.array([left[lo:hi].tobytes() for lo, hi in zip(first, ends, strict=True)], pa.binary()),
            "least": pa.array([x.least[lo:hi].tobytes() for lo, hi in zip(first, ends, strict=True)], pa.binary())})

    def sort(d: pd.DataFrame) -> pd.DataFrame:
        sizes, lefts = (np.frombuffer(b"".join(d[x]), "u1") for x in ("sizes", "lefts"))
        masks = smaller_id_masks(b"".join(d["segments"]), sizes, lefts, np.frombuffer(b"".join(d["least"]), "<i8"),
                                 length, gram, memory)
        cut = np.cumsum([len(x) for x in d["sizes"]])[:-1]
        return pd.DataFrame({X.CHUNK: d[X.CHUNK].to_numpy(), X.BUCKET: d["shard"].to_numpy(),
                             "totals": [X.planes(m.astype("<u4")) for m in np.split(masks, cut)]})

    sent = X.with_counts(c, answers, send, f"shard long, {X.CHUNK} long, segments binary, sizes binary, lefts binary, least binary")
    masks = sent.groupBy("shard").applyInPandas(sort, f"{X.CHUNK} long, {X.BUCKET} long, totals binary")
    both = answers.withColumn("is_mask", F.lit(False)).unionByName(masks.withColumn("is_mask", F.lit(True)))

    def cut_out(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        is_mask = answer["is_mask"].to_numpy(zero_copy_only=False).astype(bool)
        x, ids = prepare(chunk, answer.filter(pa.array(~is_mask)))
        gone = x.covered(ids, X.totals_of(answer.filter(pa.array(is_mask)), "<u4"))
        step = np.diff(gone.astype(np.int8), prepend=np.int8(0))
        lo, hi = x.offs[:-1], x.offs[1:] - 1        # the newline after a text is never removed
        removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(step == 1)])
        n_removed = removed[hi] - removed[lo]
        kept = [t if not r else x.buf[a:z][~gone[a:z]].tobytes()
                for t, r, a, z in zip(chunk[raw].to_pylist(), n_removed, lo, hi, strict=True)]
        out = chunk.select(rest).append_column(raw, pa.array(kept, pa.binary()))
        for name, v in zip(added, (hi - lo, n_removed, spans[hi] - spans[lo]), strict=True):
            out = out.append_column(name, pa.array(v, pa.int64()))
        return out

    schema = StructType([*rows.select(*rest).schema.fields, StructField(raw, BinaryType()),
                         *[StructField(x, LongType()) for x in added]])
    out = X.with_counts(c, both, cut_out, schema)
    return out.select(*[F.col(raw).alias(text) if x == text else F.col(x) for x in docs.columns if x not in added], *added)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and runs removed, digest of the bytes kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                            F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (  -- 200 bytes and the 49 that follow: substr is slow far inside a long text
  SELECT doc_id, length(h) // 2 AS n, unnest(range(0, length(h) // 2, 200)) AS o,
         unnest(list_transform(range(0, length(h) // 2, 200), lambda o: substr(h, 2 * o + 1, 500))) AS part FROM hexed),
pos AS (SELECT doc_id, n, o, part, unnest(range(0, least(200, n - o))) AS q FROM parts),
win AS (SELECT doc_id, o + q AS p, substr(part, 2 * q + 1, 2) AS byte,
               CASE WHEN o + q + 50 <= n THEN md5(substr(part, 2 * q + 1, 100)) END AS s FROM pos),
least AS (SELECT s, min(doc_id) AS m FROM win WHERE s IS NOT NULL GROUP BY s),
cov AS (
  SELECT doc_id, p, byte, max(CASE WHEN m < doc_id THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM win LEFT JOIN least USING (s)),
runs AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 THEN 1 ELSE 0 END AS head FROM cov),
agg AS (
  SELECT doc_id, sum(gone) AS n_removed, sum(head) AS n_spans,
         string_agg(byte, '' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM hexed d LEFT JOIN agg USING (doc_id)
"""
