"""The seed join against the column form, which looks every text up in every item."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.llm import decontaminate as D


def corpus():
    r = random.Random(8)
    say = lambda n, k=400: [f"w{r.randrange(k)}" for _ in range(n)]
    items = [say(r.randrange(1, 60)) for _ in range(40)] + [["a"] * 30, ["one"], ["two", "words"]]
    texts = [say(r.randrange(0, 200)) for _ in range(60)]
    for k in range(120):
        a, b = r.choice(items), r.choice(items)
        cut = r.randrange(len(a) + 1)
        texts.append(say(20) + a[cut:] + say(r.randrange(3)) + a[:cut] + (b if k % 3 else []) + say(9))
    texts += [["a"] * 50, ["A"] * 8 + ["b"] + ["a"] * 22, ["one"], ["x", "two", "words"]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs += [(900, None), (901, ""), (None, docs[70][1]), (None, docs[70][1]), (70, docs[70][1]), (902, docs[70][1].upper())]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)] + [(100, None), (101, ""), (None, " ".join(items[3])), (3, " ".join(items[3]))]
    return docs, bench


@pytest.mark.parametrize("short", [False, True])
def test_join_gives_what_the_column_gives(spark, short, monkeypatch):
    docs, bench = corpus()
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {"_doc_key": F.lit(1), "seed": F.lit(2), "matches": F.lit("m"), "place": F.lit(0)}).repartition(5)
    bench = spark.createDataFrame(bench, "item_id long, text string").withColumn("seed", F.lit(1))
    want = docs.withColumn("want", F.sort_array(D.matches(spark, docs, bench, short_items=short)))
    want = sorted(map(str, want.select("doc_id", "text", "want").collect()))
    for bits in (1 << 24, 64):      # the join decides, also where the bitmap keeps nothing out
        monkeypatch.setattr(D, "BITMAP", bits)
        got = D.with_matches(spark, docs, bench, "want", short_items=short)
        assert got.columns == [*docs.columns, "want"]
        assert sorted(map(str, got.select("doc_id", "text", "want").collect())) == want
    left = D.decontaminate(spark, docs, bench, short_items=short)
    assert left.columns == docs.columns
    assert left.count() == sum(w.endswith("want=[])") for w in want) > 20


def test_empty_tables_and_query(spark, tmp_path):
    docs, bench = corpus()
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    assert D.decontaminate(spark, docs, bench.limit(0)).count() == docs.count()
    assert D.with_matches(spark, docs.limit(0), bench, "m").count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = D.op10_decontaminate(spark, str(tmp_path)).collect()
    assert len(out) == docs.count()
    assert all(r["contaminated"] == bool(r["items"]) == (r["coverage"] >= 0.6) for r in out)
    whole = [r for r in out if r["doc_id"] == 70]
    assert len(whole) == 2 and whole[0] == whole[1]
