"""Matrix-shaped inputs (S12-S15, S17, S18): per-sample files, probe tables, transposed
text matrices. A matrix is kept in long form (row, column, value), whatever its width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS_DDL = ("gene_id string, gene_name string, gene_type string, unstranded int, stranded_first int, "
              "stranded_second int, tpm_unstranded double, fpkm_unstranded double, fpkm_uq_unstranded double")


def parse_counts(spark: SparkSession, root: str, value_column: str = "tpm_unstranded") -> DataFrame:
    """Tab files with ``#`` comments; the four ``N_*`` summary rows are dropped;
    (sample, gene, value) where the sample is read from the file path."""
    df = spark.read.schema(COUNTS_DDL).option("sep", "\t").option("comment", "#").option(
        "recursiveFileLookup", True).csv(root)
    sample = F.regexp_extract(F.col("_metadata.file_path"), r"sample=([^/]+)", 1)
    return (df.filter(~F.col("gene_id").startswith("N_"))
            .select(sample.alias("sample"), F.col("gene_id").alias("gene"), F.col(value_column).cast("float").alias("value")))


def matrix_assemble(long_df: DataFrame, row: str = "sample", col: str = "feature", value: str = "value") -> DataFrame:
    """Samples × features in long form, one row for each cell that has a value (the
    smallest, should a cell have several). Tens of thousands of features are rows, not columns."""
    return long_df.groupBy(row, col).agg(F.min(value).alias(value)).filter(F.col(value).isNotNull())


def matrix_dedupe_pivot(probes: DataFrame) -> DataFrame:
    """(sample, probe, value, pos): the first value per (sample, probe) by position,
    non-numeric text → NULL, as probes × samples in long form."""
    return (probes.groupBy("probe", "sample").agg(F.min_by("value", "pos").alias("value"))
            .select("probe", "sample", F.col("value").try_cast("double").alias("value")))


def kv_target_extract(df: DataFrame, key: str, array_col: str = "characteristics", id_col: str = "sample") -> DataFrame:
    """``k: v`` characteristics → target = v of the first entry whose key matches
    (case-insensitive); rows without one are dropped."""
    e = df.select(id_col, F.posexplode(array_col).alias("pos", "kv"))
    parts = F.split(F.col("kv"), ":", 2)
    m = e.select(id_col, "pos", F.lower(F.trim(parts[0])).alias("k"), F.trim(F.element_at(parts, 2)).alias("v")) \
        .filter((F.col("k") == key.lower()) & F.col("v").isNotNull())
    return m.groupBy(id_col).agg(F.min_by("v", "pos").alias("target"))


def prevalence_filter(spark: SparkSession, path: str, min_prevalence: float = 0.1) -> DataFrame:
    """A text matrix (header = sample names, one marker per line, tab separated):
    keep markers whose values are all 0/1 and whose prevalence ≥ ``min_prevalence``,
    returned transposed in long form (sample, marker, value)."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    header = lines.filter(F.col("f")[0] == "marker").select(F.posexplode("f").alias("i", "sample")).filter("i > 0")
    body = lines.filter(F.col("f")[0] != "marker").select(F.col("f")[0].alias("marker"),
                                                          F.posexplode("f").alias("i", "raw")).filter("i > 0")
    stats = body.groupBy("marker").agg(F.bool_and(F.col("raw").isin("0", "1")).alias("binary"),
                                       F.avg(F.col("raw").try_cast("double")).alias("prevalence"))
    keep = stats.filter(F.col("binary") & (F.col("prevalence") >= min_prevalence)).select("marker")
    return (body.join(keep, "marker", "left_semi").join(header, "i")
            .select("sample", "marker", F.col("raw").cast("int").alias("value")))


def two_hop_label_join(wide: DataFrame, run_col: str, features: list[str], run_sample: DataFrame,
                       sample_meta: DataFrame, label_col: str) -> DataFrame:
    """Unpivot a run × feature table, join run → sample → metadata label (trimmed,
    lowercased; NULL or empty labels dropped)."""
    long = wide.unpivot([run_col], features, "feature", "value")
    lab = F.lower(F.trim(F.col(label_col)))
    return (long.join(run_sample, run_col).join(sample_meta, "sample")
            .withColumn("label", lab).filter(F.col("label").isNotNull() & (F.col("label") != ""))
            .select(run_col, "sample", "feature", "value", "label"))
