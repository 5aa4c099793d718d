"""Token counts through a digest cache.

A count depends on the content and on the tokenizer alone, so it is kept under two digests:
SHA-256 of the normalised content (null counts as empty; nothing else is changed, since any
other normalisation could change the count) and SHA-256 of the tokenizer file and of the way
it is called. A run joins the documents' digests to the stored counts, encodes each missing
text once, appends the new counts to the cache as Parquet under the tokenizer's digest, and
joins again. A lost executor only repeats tasks; a run that fails while appending leaves no
rows (Spark's commit), and counts that two runs store twice are equal, one of them is taken.

Null and empty texts: 0 bytes and the tokenizer's count of "". Repeated rows share one
encoding. Extra columns are not read. Null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from evalspark.llm.common import small_batches, table, text_bytes, vocab_path
from evalspark.session import scratch_dir

MODEL = "piece_bpe_32k.model"
LIMIT = 4096


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """``texts -> counts`` with the library that the file belongs to."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(sp.encode(x, num_threads=1)) for x in texts]


def version_digest(path: str) -> str:
    """Digest of the tokenizer file and of the call convention of ``tokenizer``."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"plain-1\n" + f.read()).hexdigest()


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    schema = "digest binary, n_tokens long"
    try:
        rows = spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(spark: SparkSession, docs: DataFrame, cache: str, model: str | None = None,
                 text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; new counts are appended to the folder ``cache``."""
    path = model or vocab_path(MODEL)
    folder = f"{cache.rstrip('/')}/tokenizer={version_digest(path)}"
    small_batches(spark)

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = tokenizer(path)
        for batch in batches:
            yield pd.Series(counts(batch), dtype="int64")

    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(text_bytes(text), 256)).alias("digest")
    # equal texts meet inside the map tasks first, so a text that many rows share moves once a task
    distinct = docs.select(digest, content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    missing = distinct.join(_stored(spark, folder), "digest", "left_anti")
    missing.select("digest", count("content").alias("n_tokens")).write.mode("append").parquet(folder)
    rows = docs.select(F.col(id_col), digest, F.octet_length(content).cast("long").alias("n_bytes"))
    return rows.join(_stored(spark, folder), "digest", "left").select(id_col, "n_bytes", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, with a cache of its own, so that every distinct text is encoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(spark, docs, scratch_dir(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
