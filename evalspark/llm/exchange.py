"""Global counts of 64-bit keys for chunks of documents, exchanged in packed blocks.

Several operators must know, for each n-gram of each document, how often it occurs in the
whole corpus. One row per n-gram would shuffle many times the corpus. Here documents are
dealt to chunks of 2 MB on average, by a hash of the text and of columns that the caller names:
copies of a text spread if those differ, and only rows equal in all of them must meet. Each chunk sends its sorted distinct keys, cut by hash range into buckets, as one packed
block per bucket; a bucket adds up the blocks and answers each with the totals in the same
order; the answers meet their chunk again in a cogroup. A key that a third of all documents
hold costs one entry per chunk, whatever its count. Both uses of the chunked documents read
the same shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.llm.common import partitions, total_bytes

U = np.uint64
CHUNK, BUCKET = "_x_chunk", "_x_bucket"


@dataclass
class Chunks:
    """Documents dealt to chunks, and how many buckets the keys are cut into."""

    df: DataFrame
    buckets: int
    bytes: int


def hashable(df: DataFrame, cols: list[str]) -> list[str]:
    """Those of ``cols`` whose type Spark can hash: no maps and variants at any depth."""
    return [x for x in cols if not any(t in df.schema[x].dataType.simpleString() for t in ("map<", "variant"))]


def chunked(spark: SparkSession, docs: DataFrame, text: str, keys: list[str],
            chunk_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20) -> Chunks:
    """Add the chunk number and shuffle by it. ``text`` is a binary column of ``docs``."""
    total, n = total_bytes(docs, text), partitions(spark)
    n = max(n, math.ceil(total / (64 << 20)))
    chunks = max(2 * n, math.ceil(total / chunk_bytes))
    df = docs.withColumn(CHUNK, F.pmod(F.xxhash64(*keys, text), F.lit(chunks)))
    return Chunks(df.repartition(n, CHUNK), max(n, math.ceil(total / bucket_bytes)), total)


def _bounds(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first entry of each) of sorted keys; buckets are ranges of the top 32 bits."""
    b = ((keys >> U(32)) * U(buckets)) >> U(32)
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    return b[first], first


def pack(keys: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bytes of each key, as rows of bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpack(blob: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<u8").ravel()


def planes(x: np.ndarray) -> bytes:
    """Integers with their first bytes together, then their second bytes, and so on: small
    numbers leave runs of zeros, which Spark's shuffle compression takes away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def squeeze(x: np.ndarray) -> bytes:
    """:func:`planes`, entropy coded: Spark's own compression leaves bytes of few values as they are."""
    return zstandard.ZstdCompressor(level=1).compress(planes(x))


def unsqueeze(blob: bytes, dtype: str) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(blob), dtype)


def pack_steps(keys: np.ndarray, bucket: int, buckets: int) -> bytes:
    """Sorted keys of one bucket as squeezed differences. At least 48 bits of a key's place in its bucket
    are kept, all of them from 65,536 buckets on; n keys of a block save some log2(n) bits each."""
    start = U(-(-(int(bucket) << 32) // buckets) << 32)
    place = (keys - start) >> U(max(0, 17 - buckets.bit_length()))
    return squeeze(np.diff(place, prepend=U(0)).astype("<u8"))


def unpack_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, "<u8"), dtype=np.uint64)


def global_counts(c: Chunks, text: str, keys_of: Callable[[list[bytes]], np.ndarray], width: int | None = 8,
                  count_type: str = "<u4") -> DataFrame:
    """Rows (chunk, bucket, totals): for a chunk's sorted distinct keys, their corpus counts.

    ``keys_of(texts)`` gives one key per occurrence. ``width`` bytes of a key are sent
    besides its bucket; None sends differences (:func:`pack_steps`) and squeezes the counts too.
    Totals saturate at the largest value of ``count_type``.
    """
    buckets = c.buckets
    put, get = (squeeze, unsqueeze) if width is None else (planes, unplanes)
    top = min(np.iinfo(np.dtype(count_type)).max, 2 ** 63 - 1)

    def send(key, rows):
        k, n = np.unique(keys_of(rows[text].to_pylist()), return_counts=True)
        bucket, first = _bounds(k, buckets)
        ends = np.append(first, len(k))[1:]
        cnt = np.minimum(n, top).astype(count_type)
        cuts = list(zip(first, ends, strict=True))
        if width is None:
            blocks = [pack_steps(k[a:z], b, buckets) for b, (a, z) in zip(bucket, cuts, strict=True)]
        else:
            raw = pack(k, width)
            blocks = [raw[a:z].tobytes() for a, z in cuts]
        return pa.table({
            CHUNK: np.full(len(bucket), key[0].as_py(), np.int64), BUCKET: bucket.astype(np.int64),
            "keys": pa.array(blocks, pa.binary()),
            "counts": pa.array([put(cnt[a:z]) for a, z in cuts], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = [unpack_steps(x) if width is None else unpack(x, width) for x in rows["keys"]]
        cut = np.cumsum([len(x) for x in blocks])
        k = np.concatenate(blocks)
        del blocks                      # a bucket holds some 8 MB of text in keys: each array goes as soon as it is used
        order = np.argsort(k, kind="stable")
        k = k[order]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        del k
        n = np.concatenate([get(x, count_type) for x in rows["counts"]])[order]
        sums = np.minimum(np.add.reduceat(n, head, dtype=np.int64), top).astype(count_type)
        total = np.empty(len(n), count_type)
        total[order] = np.repeat(sums, np.diff(np.append(head, len(n))))
        cut = cut[:-1]
        return pd.DataFrame({CHUNK: rows[CHUNK].to_numpy(), BUCKET: rows[BUCKET].to_numpy(),
                             "totals": [put(x) for x in np.split(total, cut)]})

    sent = c.df.groupBy(CHUNK).applyInArrow(
        send, f"{CHUNK} long, {BUCKET} long, keys binary, counts binary")
    return sent.groupBy(BUCKET).applyInPandas(add, f"{CHUNK} long, {BUCKET} long, totals binary")


def totals_of(answer: pa.Table, count_type: str = "<u4",
              get: Callable[[bytes, str], np.ndarray] = unplanes) -> np.ndarray:
    """Totals of a chunk's sorted distinct keys, from its answers (``unsqueeze`` where no width was given)."""
    parts = [get(x, count_type) for x in answer.sort_by(BUCKET)["totals"].to_pylist()]
    return np.concatenate([np.zeros(0, count_type), *parts])


def with_counts(c: Chunks, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table],
                schema: str | StructType) -> DataFrame:
    """``fn(chunk rows, answers)`` for every chunk."""
    def run(rows, answer):
        return fn(rows, answer)

    return c.df.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(run, schema)
