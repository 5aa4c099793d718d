"""The tree of one file a document, as Spark's partitioned writer would fill its files, but in few folders."""

import hashlib
import os

import pytest

from evalspark.sources import artifacts as A


def test_text_tree_and_its_manifest(spark, tmp_path):
    rows = [(i, f"tëxt {i}\nline two") for i in range(600)] + [(7, "again"), (8, None), (9, ""), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for root in (str(tmp_path / "a tree"), f"file://{tmp_path}/other"):
        A.text_tree(df, "doc_id", "text", root)
        path = root.removeprefix("file://")
        assert len(os.listdir(path)) <= A.FOLDERS       # not a folder a document
        want = {}
        for i, t in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
            name = f"doc_id={'__HIVE_DEFAULT_PARTITION__' if i is None else i}"
            want[name] = want.get(name, b"") + (t or "").encode() + b"\n"
        got = {os.path.basename(r["rel_path"]): (r["size"], r["sha256"]) for r in A.artifact_manifest(spark, root).collect()}
        assert sorted(got) == sorted(want), (sorted(set(got) ^ set(want))[:5], len(got), len(want))
        assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}
        assert not [f for _, _, fs in os.walk(path) for f in fs if f.startswith(".")]


def test_manifest_tasks_do_not_grow_with_the_files(spark, tmp_path):
    """Before: a task for 32 files, as Spark's file scan counts 4 MB for the opening of each."""
    root = str(tmp_path / "many")
    A.text_tree(spark.range(600).selectExpr("id", "repeat('x', id) as text"), "id", "text", root)
    m = A.artifact_manifest(spark, root)
    assert m.count() == 600 and m.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def _odd_tree(spark, root):
    names = ("top", "a/b/c/deep", "a=1/f", "_a=1/f", "_hid/f", ".hid/f", "_metadata/f", "x/_metadata", "x/_a=b", "x/.h", "x/y._COPYING_",
             "z._COPYING_/f", "metrics/q", "a/logs/q", "a/grid_metrics.csv", "logs", "sp ace/ü ö", "pct%20/%41")
    for name in names:
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(name * 3000)
    open(f"{root}/empty", "w").close()
    os.makedirs(f"{root}/nothing/in it")
    os.symlink("nowhere", f"{root}/broken")
    os.symlink(f"{root}/a/b", f"{root}/folder link")
    os.mkfifo(f"{root}/fifo")
    spark.range(5000).coalesce(1).selectExpr("cast(id as string) as v").write.text(f"{root}/with checksums")


def test_manifest_is_that_of_sparks_file_scan(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/odd tree"
    _odd_tree(spark, root)
    get = lambda at: sorted(map(tuple, A.artifact_manifest(spark, at).collect()))
    own = get(root)
    assert own == get(f"file://{root}") == get(root + "/") and len(own) == 10, [r[0] for r in own]
    with open(f"{root}/new\nline", "w") as f:       # the scan's way has no name for it
        f.write("x")
    assert get(root) == sorted([*own, ("new\nline", 1, hashlib.sha256(b"x").hexdigest())])
    os.remove(f"{root}/new\nline")
    monkeypatch.setattr(A.commits, "mounted", lambda *_: None)
    assert get(root) == own


def test_manifest_minds_the_checksums_beside_a_file(spark, tmp_path):
    root = f"{tmp_path}/sums"
    spark.range(50_000).coalesce(1).selectExpr("cast(id as string) as v").write.text(root)
    part = next(f for f in os.listdir(root) if f.startswith("part-"))
    with open(f"{root}/{part}", "rb") as f:
        good = f.read()
    assert [(r["size"], r["sha256"]) for r in A.artifact_manifest(spark, root).collect()] == [(len(good), hashlib.sha256(good).hexdigest())]
    for at in (0, len(good) // 2, len(good) - 1):
        with open(f"{root}/{part}", "wb") as f:
            f.write(good[:at] + b"?" + good[at + 1:])
        with pytest.raises(Exception, match="Checksum error"):
            A.artifact_manifest(spark, root).collect()


def test_text_tree_shuffles_the_texts_of_repeated_keys_only(spark, tmp_path, monkeypatch):
    """Before: all of them, which took disk besides the files that hold them."""
    rows = [(i, f"text {i}") for i in range(300)] + [(i, "again") for i in range(0, 300, 7)] + [(None, "no key"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    into, call = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a: into.append(self) or call(self, *a))
    got = []
    for most, shuffled in ((100_000, 2 * 43 + 2), (10, len(rows))):      # few repeated keys, and too many to broadcast
        monkeypatch.setattr(A, "BROADCAST_ROWS", most, raising=False)
        A.text_tree(df, "doc_id", "text", f"{tmp_path}/{most}")
        assert into[-1].count() == shuffled
        got.append(sorted(map(tuple, A.artifact_manifest(spark, f"{tmp_path}/{most}").collect())))
    assert got[0] == got[1] and len(got[0]) == 301
