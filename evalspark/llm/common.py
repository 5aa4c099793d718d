"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name = f"_{stem}_{uuid.uuid4().hex[:6]}"
    return name


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; a null text counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def id_fold(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def total_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of a text column: one aggregate that returns one number."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch: texts are up to many kilobytes each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vocab_path(name: str) -> str:
    """Place of a public vocabulary file; ``EVALSPARK_TOKENIZERS`` names another folder."""
    base = os.environ.get("EVALSPARK_TOKENIZERS")
    if base:
        return os.path.join(base, name)
    import public_tokenizers
    return public_tokenizers.path(name)
