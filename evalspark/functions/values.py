"""Small literal tables built from JVM expressions (no Python-side RDD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table: ``values(spark, [("a", 1)], "name string, n int")``.

    Built with ``inline(array(struct(...)))`` over a one-row range, so it is a tiny JVM-side
    relation (one partition) — joins with it never start Python workers.
    """
    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
