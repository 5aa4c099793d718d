"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``piece`` characters are first cut at safe boundaries. The split pattern
matches either a run that has no white space after its first character or a run of white
space, so a match always ends where a visible character is followed by a plain space; a
match that starts there looks at nothing before it. Encoding the cuts one by one therefore
gives the ids of the whole text. White-space runs of ``run`` or more characters, on which
the pattern's look-ahead would backtrack for long, are matched by hand: such a run is one
match, less its last character if a visible one follows.

Null text: empty, no ids. Ids are decoded to raw bytes, so any list of valid ids decodes,
also one that ends inside a character. Equal rows are encoded alike; other columns are kept
and never looked at.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from evalspark.llm.common import small_batches, table, vocab_path

RANKS = "byte_bpe_50k.tiktoken"
# visible ASCII, then a plain space, then visible ASCII: safe under any reading of white space
_SAFE = re.compile(r"(?<=[!-~])(?= [!-~])")


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, piece: int) -> Iterator[str]:
    """The text in pieces of ``piece`` characters and more, cut at safe boundaries."""
    at = 0
    while len(text) - at > piece:
        m = _SAFE.search(text, at + piece)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def _runs(text: str, run: int) -> Iterator[tuple[bool, str]]:
    """(is a whole white-space match, text) parts; white space as the pattern reads it."""
    at = 0
    for m in re.finditer(r"[^\S\x1c-\x1f]{%d,}" % run, text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield False, text[at:m.start()]
        yield True, text[m.start():end]
        at = end
    if at < len(text) or not text:
        yield False, text[at:]


def encode_text(enc, text: str, piece: int = 1 << 16, run: int = 1 << 12) -> list[int]:
    """Ids of the text, as ``enc.encode_ordinary`` gives them."""
    if len(text) <= piece:
        if len(text) < run:
            return enc.encode_ordinary(text)
        parts = [text]
    else:
        parts = cuts(text, piece)
    ids: list[int] = []
    for part in parts:
        for whole, s in _runs(part, run):
            # an ordinary part ends where white space begins, so no match is cut short
            ids += enc._core_bpe.encode_single_piece(s.encode()) if whole else enc.encode_ordinary(s)
    return ids


def bpe_encode(spark: SparkSession, docs: DataFrame, text: str = "text", out: str = "ids",
               ranks: str | None = None, piece: int = 1 << 16) -> DataFrame:
    """``docs`` with the ids of every whole text in ``out`` (array of int; replaces a column of that name)."""
    path = ranks or vocab_path(RANKS)
    small_batches(spark)

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([np.array(encode_text(enc, t or "", piece), np.int32) for t in batch], dtype=object)

    return docs.withColumn(out, encode(F.col(text)))


def bpe_decode(spark: SparkSession, docs: DataFrame, ids: str = "ids", out: str = "decoded",
               ranks: str | None = None) -> DataFrame:
    """``docs`` with the raw bytes of ``ids`` in ``out`` (null ids: no bytes)."""
    path = ranks or vocab_path(RANKS)
    small_batches(spark)

    @pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([b"" if x is None else enc.decode_bytes(x.tolist()) for x in batch], dtype=object)

    return docs.withColumn(out, decode(F.col(ids)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and digest of the bytes decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_decode(spark, bpe_encode(spark, docs))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
