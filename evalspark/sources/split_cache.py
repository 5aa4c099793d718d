"""A cache of derived tables (splits) that outlives the process and notices changed input.

An entry is named by a fingerprint of every parameter and of the input's file listing (path,
size and time of change of each file, summed up on the executors). A job that finds no entry
takes a lease, builds the table into a folder of its own and publishes that by creating the
entry's pointer file, which only one job can. Others wait for the pointer; a lease that is
older than its time counts as abandoned and is taken over. A lease saves double work, the
pointer alone decides: whatever happens, readers see one whole table or none.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import commits

LEASE_S = 1800.0
POLL_S = 0.5
POINTER, LEASE = "POINTER", "LEASE"


def listing_fingerprint(spark: SparkSession, inputs: list[str]) -> str:
    """Digest of the listing of all files under ``inputs``, whatever their order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    facts = [F.xxhash64(F.lit(i), "path", "length", F.unix_micros("modificationTime")) for i in range(2)]
    row = files.agg(F.count(F.lit(1)), F.sum(F.col("length").cast("decimal(38,0)")), *(F.bit_xor(f) for f in facts)).first()
    return hashlib.md5(repr(tuple(row)).encode()).hexdigest()


def entry_path(spark: SparkSession, name: str, params: dict, inputs: list[str], root: str | None = None) -> str:
    """Folder of the entry for these parameters and the present state of the inputs."""
    known = json.dumps(params, sort_keys=True) + listing_fingerprint(spark, inputs)
    return f"{root or shared_folder(spark)}/split-cache/{name}/{hashlib.md5(known.encode()).hexdigest()}"


def _take_lease(spark: SparkSession, entry: str, owner: str, lease_s: float) -> bool:
    lease = f"{entry}/{LEASE}"
    if commits.create_exclusive(spark, lease, owner):
        return True
    age = commits.age_seconds(spark, lease)
    if age is not None and age > lease_s and commits.rename_new(spark, lease, f"{entry}/abandoned-{uuid.uuid4().hex}"):
        return commits.create_exclusive(spark, lease, owner)
    return False


def cached_table(spark: SparkSession, name: str, params: dict, inputs: list[str], build: Callable[[], DataFrame],
                 root: str | None = None, lease_s: float = LEASE_S) -> tuple[DataFrame, bool]:
    """The table of ``build()``, from the cache if it is there, and whether it was."""
    entry = entry_path(spark, name, params, inputs, root)
    owner = uuid.uuid4().hex
    pointer = f"{entry}/{POINTER}"
    while True:
        found = commits.read_text(spark, pointer)
        if found:
            return spark.read.parquet(f"{entry}/{found}"), True
        if _take_lease(spark, entry, owner, lease_s):
            break
        time.sleep(POLL_S)
    data = f"data-{owner}"
    try:
        if not commits.exists(spark, pointer):      # published between the look and the lease
            build().write.parquet(f"{entry}/{data}")
            if commits.create_exclusive(spark, pointer, data):
                return spark.read.parquet(f"{entry}/{data}"), False
            commits.delete(spark, f"{entry}/{data}")        # a slow lease was taken over and its new holder came first
    finally:
        if commits.read_text(spark, f"{entry}/{LEASE}") == owner:
            commits.delete(spark, f"{entry}/{LEASE}")
    return spark.read.parquet(f"{entry}/{commits.read_text(spark, pointer)}"), True
