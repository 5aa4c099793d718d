"""Prompt formatting and answer parsing."""

import pytest
from pyspark.sql import functions as F

from evalspark.functions.text import fmt_value
from evalspark.operators import responses as RS


def test_fmt_value_matches_python_g(spark):
    vals = [0.5, 2.0, 123456.7, 964.65, 0.0001234, 1e-7, -3.25, None, 1e20]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(fmt_value(F.col("v"))).collect()]
    want = ["?" if v is None else (str(int(v)) if float(v).is_integer() else f"{v:.4g}") for v in vals]
    assert got == want


def _resp(spark, text, n):
    return spark.createDataFrame([(0, "k", "m", 0, n, text)],
                                 "seed int, key string, model string, chunk int, n_rows long, text string")


def _classes(spark, names):
    return spark.createDataFrame([(0, "k", c) for c in names], "seed int, key string, token string")


def test_parse_rows_first_wins_and_formats(spark):
    text = "Row 1: Yes\nRow 2: No\n3) Yes\nRow 1: No\n# 4. yes\n9) Yes"
    p = RS.parse_answers(_resp(spark, text, 4), _classes(spark, ["No", "Yes"]))
    got = {r["idx"]: r["token"] for r in p.collect()}
    assert got == {1: "Yes", 2: "No", 3: "Yes", 4: "Yes"}


def test_whole_word_longest_first(spark):
    p = RS.parse_answers(_resp(spark, "1) The class is B\n2) probably AB or so", 2),
                         _classes(spark, ["A", "B", "AB"]))
    got = {r["idx"]: r["token"] for r in p.collect()}
    assert got == {1: "B", 2: "AB"}


def test_unparsed_and_decimal_line(spark):
    p = RS.parse_answers(_resp(spark, "no answer here", 1), _classes(spark, ["A", "B"]))
    assert p.count() == 0
    p = RS.parse_answers(_resp(spark, "3.14", 3), _classes(spark, ["14", "A"]))
    assert [(r["idx"], r["token"]) for r in p.collect()] == [(3, "14")]


def test_confidence_and_proba(spark):
    text = "Row 1: Yes p=0.8\nRow 2: No p=0.9"
    p = RS.parse_confidence(RS.parse_answers(_resp(spark, text, 2), _classes(spark, ["No", "Yes"])))
    rows = p.withColumnRenamed("idx", "row_in_chunk")
    codec = spark.createDataFrame([(0, "k", "No", "No"), (0, "k", "Yes", "Yes")],
                                  "seed int, key string, cls string, token string")
    pr = RS.proba_long(rows.withColumn("row_id", F.col("row_in_chunk").cast("long")), codec)
    got = {(r["row_id"], r["cls"]): r["prob"] for r in pr.collect()}
    assert got[(1, "Yes")] == pytest.approx(0.8) and got[(1, "No")] == pytest.approx(0.2)
    assert got[(2, "No")] == pytest.approx(0.9) and got[(2, "Yes")] == pytest.approx(0.1)


def test_identity_check(spark):
    df = spark.createDataFrame([("prov/llama3-8b", "llama3-8b:latest"), ("prov/qwen", ""), ("prov/qwen", "gemma")],
                               "requested string, returned string")
    assert [r["identity_ok"] for r in RS.identity_check(df).collect()] == [True, True, False]


def test_only_newline_ends_an_answer_line(spark):
    p = RS.parse_answers(_resp(spark, "Row 1: A\rRow 2: B", 2), _classes(spark, ["A", "B"]))
    got = {r["idx"]: r["token"] for r in p.collect()}
    assert got == {1: "A"}      # a lone carriage return does not start a new answer line


def test_fmt_value_booleans_and_text(spark):
    df = spark.createDataFrame([(True, "x"), (False, None), (None, "y")], "b boolean, s string")
    got = [(r[0], r[1]) for r in df.select(fmt_value(F.col("b"), "bool"), fmt_value(F.col("s"), False)).collect()]
    assert got == [("True", "x"), ("False", "?"), ("?", "y")]
