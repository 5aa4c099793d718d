"""Merging result trees.

A tree is a table ``(path, content)`` (or a manifest ``(path, size, sha256)``); merging two
trees is a full outer join on the path plus per-file equivalence rules, so trees with
millions of artifacts merge as one distributed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Regenerable files and folders that are never transferred.
DERIVED_NAMES = ("grid_metrics.csv", "feature_grid_metrics.csv", "feature_grid_summary.csv")
IGNORED_DIRS = ("metrics", "logs")
# ---------------------------------------------------------------- end of fixed values


def is_derived_or_log(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    in_dir = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*IGNORED_DIRS))
    return in_dir | name.isin(*DERIVED_NAMES)


def _json_map(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")


def files_equivalent(path: Column, src: Column, dst: Column) -> Column:
    """Same SHA-256; CSV equal after CRLF → LF; stats JSON equal without ``timestamp``;
    ``config.json`` equal after separator normalisation with source models ⊆ dest models."""
    name = F.element_at(F.split(path, "/"), -1)
    same_hash = F.sha2(src, 256) == F.sha2(dst, 256)
    csv_eq = F.regexp_replace(src, "\r\n", "\n") == F.regexp_replace(dst, "\r\n", "\n")

    def entries(m: Column, drop: list[str]) -> Column:
        kept = F.map_filter(m, lambda k, v: ~k.isin(*drop))
        return F.array_sort(F.map_entries(F.transform_values(
            kept, lambda k, v: F.when(k == "output_dir", F.regexp_replace(v, r"\\", "/")).otherwise(v))))

    sm, dm = _json_map(src), _json_map(dst)
    stats_eq = entries(sm, ["timestamp"]) == entries(dm, ["timestamp"])
    s_models = F.from_json(sm["models"], "array<string>")
    d_models = F.from_json(dm["models"], "array<string>")
    cfg_eq = (sm["models"].isNotNull() & dm["models"].isNotNull()
              & (entries(sm, ["models"]) == entries(dm, ["models"]))
              & (F.size(F.array_except(s_models, d_models)) == 0))
    rule = (F.when(name == "config.json", F.coalesce(cfg_eq, F.lit(False)))
            .when(F.lower(name).endswith(".csv"), csv_eq)
            .when(F.lower(name).endswith(".json") & F.array_contains(F.split(path, "/"), "stats"),
                  F.coalesce(stats_eq, F.lit(False)))
            .otherwise(F.lit(False)))
    return same_hash | rule


def conflicting_truth_units(source: DataFrame, dest: DataFrame) -> DataFrame:
    """(seed_dir, key) units whose shared ground-truth file differs."""
    truth = F.col("path").rlike(r"_ground_truth\.csv$")
    s = source.filter(truth).select("path", F.col("content").alias("src"))
    d = dest.filter(truth).select("path", F.col("content").alias("dst"))
    j = s.join(d, "path").filter(~files_equivalent(F.col("path"), F.col("src"), F.col("dst")))
    return j.select(F.regexp_extract("path", r"^(.*)/predictions/[^/]+$", 1).alias("seed_dir"),
                    F.regexp_extract("path", r"([^/]+)_ground_truth\.csv$", 1).alias("key")).distinct()


def merge_plan(source: DataFrame, dest: DataFrame, keep_dest_conflicting_units: bool = False) -> DataFrame:
    """Per source file: copied / identical / ignored_derived / skipped_conflicting_unit
    / conflict (the reference raises on the first conflict; here every conflict is listed)."""
    s = source.select("path", F.col("content").alias("src"))
    d = dest.select("path", F.col("content").alias("dst"))
    j = s.join(d, "path", "left")
    seed_dir = F.regexp_extract("path", r"^(.*)/(predictions|stats)/[^/]+$", 1)
    fname = F.regexp_extract("path", r"/(predictions|stats)/([^/]+)$", 2)
    j = j.withColumn("seed_dir", seed_dir).withColumn("fname", fname)
    if keep_dest_conflicting_units:
        units = conflicting_truth_units(source, dest)
        hit = ((F.col("fname") == F.concat(F.col("key"), F.lit("_ground_truth.csv"))) |
               F.col("fname").startswith(F.concat(F.col("key"), F.lit("_"))))
        hits = (j.select("path", "seed_dir", "fname").filter(F.col("fname") != "").join(units, "seed_dir")
                .filter(hit).select("path").distinct().withColumn("in_conflict", F.lit(True)))
        j = j.join(hits, "path", "left").withColumn("in_conflict", F.coalesce("in_conflict", F.lit(False)))
    else:
        j = j.withColumn("in_conflict", F.lit(False))
    action = (F.when(F.col("in_conflict"), "skipped_conflicting_unit")
              .when(is_derived_or_log(F.col("path")), "ignored_derived")
              .when(F.col("dst").isNull(), "copied")
              .when(files_equivalent(F.col("path"), F.col("src"), F.col("dst")), "identical")
              .otherwise("conflict"))
    return j.select("path", action.alias("action"))


def manifest_verify(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """Manifest (path, size, sha256) against a scan of the unpacked files."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha"))
    s = scanned.select("path", F.col("size").alias("s_size"), F.col("sha256").alias("s_sha"))
    j = m.join(s, "path", "full_outer")
    st = (F.when(F.col("s_size").isNull(), "missing").when(F.col("m_size").isNull(), "unlisted")
          .when(F.col("m_size") != F.col("s_size"), "size_mismatch")
          .when(F.col("m_sha") != F.col("s_sha"), "hash_mismatch").otherwise("ok"))
    return j.select("path", st.alias("check"))


def append_only(old: Column, new: Column) -> Column:
    """The old list is an ordered subset of the new one and strictly smaller."""
    kept = F.filter(new, lambda x: F.array_contains(old, x))
    return (kept == old) & (F.size(F.array_distinct(old)) < F.size(F.array_distinct(new))) & \
        (F.size(F.array_except(old, new)) == 0)
