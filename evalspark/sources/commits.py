"""Small atomic steps on a shared file system: exclusive files and first-come renames.

Writers stage whole folders with Spark and make them visible by one metadata step that at
most one of them can win. The steps go through Hadoop's file API, so any file system that
Spark reads works; they are as atomic as it is (HDFS: atomic; plain object stores need
a committer that offers exclusive creation).
"""

from __future__ import annotations

import os
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scheme(spark: SparkSession, path: str) -> str:
    """Scheme of the file system that holds ``path``: ``file`` for a mounted folder."""
    return _fs(spark, path).getUri().getScheme()


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system has it, if a mounted folder holds it; else None."""
    if scheme(spark, path) != "file":
        return None
    return _fs(spark, path).makeQualified(_path(spark, path)).toUri().getPath()


def _exists_already(e: Py4JJavaError) -> bool:
    return "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception)


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if there is one already."""
    at = mounted(spark, path)
    if at is not None:          # Hadoop's local file system looks and then creates: two writers can both find nothing
        os.makedirs(os.path.dirname(at), exist_ok=True)
        try:
            with open(at, "xb") as f:
                f.write(text.encode())
        except FileExistsError:
            return False
        return True
    try:
        out = _fs(spark, path).create(_path(spark, path), False)
    except Py4JJavaError as e:
        if _exists_already(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, None if there is none."""
    if not exists(spark, path):
        return None
    for left in range(READS, 0, -1):
        try:
            return _read_once(spark, path)
        except Py4JJavaError as e:
            # its writer or deleter was at it: a local file and its checksum change one after the other
            if not left - 1 or not any(n in e.java_exception.getClass().getName() for n in ("ChecksumException", "FileNotFound")):
                raise
        time.sleep(0.1)
        if not exists(spark, path):
            return None


#: Times that a file in change is read.
READS = 10


def _read_once(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
    finally:
        stream.close()


def age_seconds(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was last written, None if there is none."""
    try:
        return time.time() - _fs(spark, path).getFileStatus(_path(spark, path)).getModificationTime() / 1000
    except Py4JJavaError as e:
        if "FileNotFound" in e.java_exception.getClass().getName():
            return None
        raise


def rename_new(spark: SparkSession, src: str, dst: str) -> bool:
    """Rename a file or folder to a name that is free; False if it is not, or if ``src`` went meanwhile."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, dst).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(_path(spark, src), _path(spark, dst), options)
        return True
    except Py4JJavaError as e:
        if _exists_already(e) or "FileNotFound" in e.java_exception.getClass().getName() or exists(spark, dst):
            return False
        raise


def make_folder(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if the folder is absent."""
    if not exists(spark, folder):
        return []
    return sorted(f.getPath().getName() for f in _fs(spark, folder).listStatus(_path(spark, folder)))
