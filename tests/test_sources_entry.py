"""Scans with validation, and the driver contract."""

import json
import os
import tempfile

import pytest

from evalspark.sources import tables as TB

SF = "/root/testdata/sf0.001"


def test_registry_scan_rejects_unknown_field_and_duplicates(spark):
    d = tempfile.mkdtemp()
    good = {"dataset_id": "a", "target": "y", "problem_type": "binary", "enabled": True}
    p = os.path.join(d, "ok.json")
    with open(p, "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps({**good, "dataset_id": "b"}) + "\n")
    assert TB.registry_scan(spark, p).count() == 2
    p2 = os.path.join(d, "bad.json")
    with open(p2, "w") as f:
        f.write(json.dumps({**good, "colour": "red"}) + "\n")
    with pytest.raises(ValueError, match="unknown"):
        TB.registry_scan(spark, p2)
    p3 = os.path.join(d, "dup.json")
    with open(p3, "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps(good) + "\n")
    with pytest.raises(ValueError, match="duplicate"):
        TB.registry_scan(spark, p3)


def test_resolve_table(spark):
    d = tempfile.mkdtemp()
    open(os.path.join(d, "only.csv"), "w").write("a,b\n1,2\n")
    assert TB.resolve_table(spark, d).endswith("only.csv")
    open(os.path.join(d, "other.tsv"), "w").write("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        TB.resolve_table(spark, d)
    assert TB.resolve_table(spark, d, "other.tsv").endswith("other.tsv")


def test_platform_filter(spark):
    s = spark.createDataFrame([("s1", "P1"), ("s2", "P2")], "sample string, platform string")
    assert TB.platform_filter(s, "P1").count() == 1
    with pytest.raises(ValueError):
        TB.platform_filter(s)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "score" in df.columns and "position" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 150


def test_loader_protocol(spark):
    from evalspark.sources import loaders as L
    d = tempfile.mkdtemp()
    p = os.path.join(d, "t.csv")
    open(p, "w").write("a, label ,b\n1,x,2\n3,y,4\n")
    df = L.fetch(spark, {"source": "local", "data_file": p, "target": "label"})
    assert df.columns == ["a", "b", "target"] and df.count() == 2
    with pytest.raises(ValueError):
        L.fetch(spark, {"source": "nowhere"})

    from pyspark.sql import functions as F

    @L.register_loader("const-test")
    def _const(spark_, spec):
        return spark_.range(3).withColumn("target", F.lit("z"))
    assert L.fetch(spark, {"source": "const-test"}).count() == 3
