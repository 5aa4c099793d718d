"""Artifact manifests (S19): path, size and SHA-256 of every raw file of a result tree."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import is_derived_or_log
from ..session import BROADCAST_ROWS, materialize
from . import commits

#: Folders that the files of a tree are dealt to: tasks list them side by side.
FOLDERS = 256
#: Files listed in one batch of rows, files hashed in one, and blocks of 512 bytes that are read of a file at once.
LISTED, HASHED, BLOCKS = 10_000, 1_000, 2048


def _put_files(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file a name, from rows (folder, name, line) in order of the names. A file gets its name when it is
    whole, so that a task that is run again, or twice, leaves the same files."""
    out, at, own, n = None, None, f".{uuid.uuid4().hex}", 0
    for b in batches:
        for where, name, line in zip(b["folder"].to_pylist(), b["name"].to_pylist(), b["line"].to_pylist(), strict=True):
            if (where, name) != at:
                if out:
                    out.close()
                    os.replace(out.name, f"{base}/{at[0]}/{at[1]}")
                if not at or at[0] != where:
                    os.makedirs(f"{base}/{where}", exist_ok=True)
                out, at, n = open(f"{base}/{where}/{own}", "wb"), (where, name), n + 1
            out.write((line or b"") + b"\n")
    if out:
        out.close()
        os.replace(out.name, f"{base}/{at[0]}/{at[1]}")
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def _put_single(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of names that come once, as :func:`_put_files`; rows of the others, marked ``many``, are passed on."""
    own, made = f".{uuid.uuid4().hex}", set()
    for b in batches:
        once = b.filter(pc.invert(b["many"]))
        for where, name, line in zip(once["folder"].to_pylist(), once["name"].to_pylist(), once["line"].to_pylist(), strict=True):
            if where not in made:
                os.makedirs(f"{base}/{where}", exist_ok=True)
                made.add(where)
            with open(f"{base}/{where}/{own}", "wb") as f:
                f.write((line or b"") + b"\n")
            os.replace(f.name, f"{base}/{where}/{name}")
        yield b.filter(b["many"]).select(["folder", "name", "line"])


def text_tree(df: DataFrame, key: str, text: str, root: str) -> None:
    """One text file for each value of ``key`` under ``root``, named after it (``key=value``), one line a row.

    Where ``root`` is a mounted folder the tasks write the files themselves: without Hadoop's native
    library its local file system starts two processes for each file, only to set its permissions, and
    a folder for each value makes a listing of as many folders. Elsewhere Spark's partitioned writer does it.
    Only rows of values that come more than once are shuffled, all rows if those values are too many to broadcast.
    """
    base = commits.mounted(df.sparkSession, root)
    if base is None:
        df.select(key, text).repartition(key).write.partitionBy(key).text(root)
        return
    value = F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = df.select(F.pmod(F.xxhash64(value), F.lit(FOLDERS)).alias("folder"),
                     F.concat(F.lit(f"{key}="), value).alias("name"), F.col(text).cast("binary").alias("line"))
    twice = materialize(rows.groupBy("name").count().filter("count > 1").select("name", F.lit(True).alias("many")), "twice")
    if twice.count() <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(twice), "name", "left").withColumn("many", F.coalesce("many", F.lit(False)))
        rows = marked.mapInArrow(lambda batches: _put_single(base, batches), rows.schema)
    rows = rows.repartition("name").sortWithinPartitions("folder", "name", "line")
    rows.mapInArrow(lambda batches: _put_files(base, batches), "n long").agg(F.sum("n")).collect()


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield batch()
            some.clear()
    if some:
        yield batch()


def _not_read(name: bytes) -> bool:
    """Names that Spark's file scans leave out, with what is below them."""
    out = name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_")
    return out and not name.startswith((b"_metadata", b"_common_metadata"))


def _listed(base: bytes, batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[tuple[bytes, bool]]:
    """Files, and folders unless ``deep``, in the folders among the rows (path below the root, is a folder)."""
    for b in batches:
        for rel, folder in zip(b["rel"].to_pylist(), b["folder"].to_pylist(), strict=True):
            if not folder:
                yield rel, False
            left = [rel] if folder else []
            while left:
                at = left.pop()
                with os.scandir(os.path.join(base, at)) as entries:
                    for e in entries:
                        if _not_read(e.name):
                            continue
                        link, name = e.is_symlink(), os.path.join(at, e.name)
                        if not (os.path.isdir(e.path) if link else e.is_dir()):
                            if os.path.isfile(e.path) if link else e.is_file():
                                yield name, False
                        elif deep:
                            left.append(name)
                        else:
                            yield name, True


def _digest(path: bytes) -> tuple[int, str]:
    """Size and SHA-256 of a file, block by block; against the checksums that Hadoop's local file system keeps beside its files."""
    size, sha, step, sums = 0, hashlib.sha256(), 0, None
    folder, name = os.path.split(path)
    with contextlib.ExitStack() as files:
        with contextlib.suppress(FileNotFoundError):
            sums = files.enter_context(open(os.path.join(folder, b"." + name + b".crc"), "rb"))
            head = sums.read(8)
            step = int.from_bytes(head[4:], "big") if head[:4] == b"crc\0" else 0
        f = files.enter_context(open(path, "rb"))
        while block := f.read(BLOCKS * (step or 512)):
            if step:
                found = b"".join(zlib.crc32(block[i:i + step]).to_bytes(4, "big") for i in range(0, len(block), step))
                if sums.read(len(found)) != found:
                    raise OSError(f"Checksum error: {os.fsdecode(path)} within {len(block)} bytes from {size}")
            sha.update(block)
            size += len(block)
    return size, sha.hexdigest()


def _hashed(base: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, str]]:
    for b in batches:
        for rel in b["rel"].to_pylist():
            size, sha = _digest(os.path.join(base, rel))
            if size:                        # Spark's file scans leave empty files out
                yield rel, size, sha


def _raw(rel: Column) -> Column:
    hidden = F.element_at(F.split(rel, "/"), -1).rlike("^[._]")      # the file system's own marks
    return ~is_derived_or_log(rel) & ~hidden


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(relative path, size, sha256) of the raw files under ``root`` — hashing runs on
    the executors that read the bytes.

    In a mounted folder the tasks list and read the files themselves, dealt out by path. Spark's file scan
    makes a task of few files, as it counts 4 MB for the opening of each, holds their list in the
    driver and a file in one cell; it reads other file systems, patterns and what is not a folder."""
    mounted = commits.mounted(spark, root)
    if mounted is None or re.search(r"[{}\[\]*?\\]", root) or not os.path.isdir(mounted):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        below = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?(?=/)", "", root.rstrip("/"))      # file:///x is listed as file:/x
        rel = F.regexp_extract(F.col("path"), re.escape(below) + "/(.*)$", 1)
        return (files.withColumn("rel_path", rel).filter(_raw(F.col("rel_path")))
                .select("rel_path", F.col("length").alias("size"), F.sha2(F.col("content"), 256).alias("sha256")))
    base, tasks = os.fsencode(mounted), int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(1).select(F.lit("").cast("binary").alias("rel"), F.lit(True).alias("folder"))
    for deep in (False, True):              # the root by one task, each folder in it by any
        found = found.mapInArrow(lambda rows, deep=deep: _batches(
            _listed(base, rows, deep), pa.schema([("rel", pa.binary()), ("folder", pa.bool_())]), LISTED), "rel binary, folder boolean")
        found = found.repartition(tasks, "rel")
    hashed = found.filter(_raw(F.col("rel").cast("string"))).select("rel").mapInArrow(lambda rows: _batches(
        _hashed(base, rows), pa.schema([("rel_path", pa.binary()), ("size", pa.int64()), ("sha256", pa.string())]), HASHED),
        "rel_path binary, size long, sha256 string")
    return hashed.withColumn("rel_path", F.col("rel_path").cast("string"))
