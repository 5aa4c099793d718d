"""From raw documents to token ids: five stages, each of which works on all that its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's documents. All but the
last return the columns of ``documents``.

1. toxicity: texts that score 0.7 or more go. The model learns from ``labels`` outside the
   held-out fold. Null and empty texts stay.
2. jaccard: of documents that are linked (directly or through others) by sets of five-word
   shingles of Jaccard similarity 0.8 or more, the one with the smallest id stays. Rows with one id are
   one document; rows with a null id, and documents without words, stay.
3. substring: words of passages of 35 or more words that recur go; the document stays, also
   when nothing of it is left. ``n_chars`` follows the new text (a null text keeps it).
4. contamination: documents that hold a benchmark item, in whatever order, go.
5. bpe: ids of every whole text, their number, and the digest of the bytes decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.bpe import bpe_decode, bpe_encode
from evalspark.llm.common import table, written
from evalspark.llm.decontaminate import decontaminate
from evalspark.llm.jaccard_join import jaccard_components
from evalspark.llm.substring_dedup import substring_dedup
from evalspark.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(spark, docs, train(docs, table(spark, sf_dir, "labels")))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_components(spark, docs.select("doc_id", "text"), width=5, threshold=80)
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark, docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_decode(spark, bpe_encode(spark, docs.select("doc_id", "lang", "source", "text")))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("substring", substring),
          ("contamination", contamination), ("bpe", bpe)]

#: A trained network decides in the first stage, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
