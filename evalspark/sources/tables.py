"""Typed table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Scan by suffix — ``.csv`` (comma), ``.tsv`` (tab) or parquet — header names
    trimmed. Pass an explicit schema in production (no inference pass over the data)."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv") or low.endswith(".tsv"):
        sep = "\t" if low.endswith(".tsv") else ","
        r = spark.read.option("header", True).option("sep", sep)
        df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    else:
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    return df.toDF(*[c.strip() for c in df.columns])


def resolve_table(spark: SparkSession, folder: str, name: str | None = None,
                  suffixes=(".csv", ".tsv", ".parquet")) -> str:
    """The named table in a folder, or the only table; error on none or several.

    Lists file paths only (``binaryFile`` with the content column pruned)."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
               .select("path"))
    cond = None
    for s in suffixes:
        c = F.lower("path").endswith(s)
        cond = c if cond is None else cond | c
    paths = listing.filter(cond)
    if name is not None:
        paths = paths.filter(F.element_at(F.split("path", "/"), -1) == name)
    found = [r["path"] for r in paths.limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"expected exactly one table in {folder} (name={name!r}), found {len(found)}")
    return found[0]


def embedding_explode(df: DataFrame, column: str, width: int | None = None, id_cols=("vec_id",)) -> DataFrame:
    """Comma-separated float string → one float column per dimension.

    NULL / empty strings and ragged widths are rejected (checked with one aggregate)."""
    arr = F.transform(F.split(F.col(column), ","), lambda s: F.trim(s).cast("float"))
    a = df.withColumn("__v", F.when(F.trim(F.col(column)) != "", arr))
    chk = a.agg(F.count_if(F.col("__v").isNull()).alias("bad"), F.min(F.size("__v")).alias("lo"),
                F.max(F.size("__v")).alias("hi")).first()
    if chk["bad"]:
        raise ValueError(f"{column}: {chk['bad']} null or empty embeddings")
    if chk["lo"] != chk["hi"]:
        raise ValueError(f"{column}: ragged embedding widths {chk['lo']}..{chk['hi']}")
    w = width or chk["lo"]
    keep = [c for c in df.columns if c != column]
    return a.select(*keep, *[F.col("__v")[i].alias(f"{column}_{i}") for i in range(w)])


REGISTRY_FIELDS = ("dataset_id display_name source fetch_id data_type target problem_type eval_metric enabled "
                   "redistributable license data_file embedding_column max_features notes").split()
REGISTRY_DDL = ("dataset_id string, display_name string, source string, fetch_id string, data_type string, "
                "target string, problem_type string, eval_metric string, enabled boolean, "
                "redistributable boolean, license string, data_file string, embedding_column string, "
                "max_features int, notes string")


def registry_scan(spark: SparkSession, path: str) -> DataFrame:
    """Registry JSON lines with a fixed schema; unknown fields and duplicate ids fail.

    Spark ignores fields outside a schema, so unknown keys are found from the raw text
    (``json_object_keys``) and duplicates with one aggregate."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    extra = raw.select(F.array_except(F.json_object_keys("value"),
                                      F.array(*[F.lit(f) for f in REGISTRY_FIELDS])).alias("x")) \
        .filter(F.size("x") > 0).limit(1).collect()
    if extra:
        raise ValueError(f"unknown registry field(s): {extra[0]['x']}")
    df = spark.read.schema(REGISTRY_DDL).option("mode", "FAILFAST").json(path)
    dup = df.groupBy("dataset_id").count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate dataset id {dup[0]['dataset_id']!r}")
    return df


def platform_filter(samples: DataFrame, platform: str | None = None) -> DataFrame:
    """Keep one platform; with several platforms and none pinned, refuse."""
    if platform is not None:
        return samples.filter(F.col("platform") == platform)
    n = samples.agg(F.countDistinct("platform").alias("n")).first()["n"]
    if n > 1:
        raise ValueError("several platforms present; pin one")
    return samples


HITS_DDL = "hits array<struct<id: string, cases: array<struct<samples: array<struct<sample_type: string>>>>>>"


def json_hits_flatten(df: DataFrame, json_col: str = "json", limit_n: int | None = None) -> DataFrame:
    """Nested JSON hits → (file_id, first case's first sample type); NULL types dropped.

    ``limit_n`` keeps the first n hits of each document (a paging cap is the feature)."""
    h = df.select(F.posexplode(F.from_json(F.col(json_col), HITS_DDL)["hits"]).alias("pos", "hit"))
    if limit_n is not None:
        h = h.filter(F.col("pos") < limit_n)
    out = h.select(F.col("hit.id").alias("file_id"),
                   F.element_at(F.element_at(F.col("hit.cases"), 1)["samples"], 1)["sample_type"].alias("sample_type"))
    return out.filter(F.col("sample_type").isNotNull())


def run_definition(spark: SparkSession, path: str) -> DataFrame:
    """Stored run definitions (JSON): the seeds, keys and models that a run is to score."""
    return spark.read.schema("seeds array<int>, keys array<string>, models array<string>").json(path)
