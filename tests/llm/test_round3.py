"""Fingerprints, hard negatives and the prefix trie against brute force, on nulls, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- fingerprints

def paragraph_set(text):
    from evalspark.llm.bloom_lookup import PARAGRAPH
    return {xxhash.xxh64_intdigest(m.encode(), seed=42) for m in re.findall(PARAGRAPH, text)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["la", "über", "été", "the", "日本", "x1"]) + str(r.randrange(50)) for _ in range(n))
    lines = [say(r.randrange(1, 40)) for _ in range(60)]
    return [None, "", " \n\t", "one", say(30), "\n".join(lines), "\n".join(lines[:40] + [say(9)] + lines[40:]),
            "\n".join(lines) * 3, "\n".join(say(12) for _ in range(900)), say(3000), "end 🙂🙂"]


def brute_edits(by_id):
    ids = sorted(by_id, key=lambda i: (i is not None, i))
    out = defaultdict(list)
    for k, i in enumerate(ids):
        following = min(by_id[ids[(k + 1) % len(ids)]], key=lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42)))
        for t in by_id[i]:
            half = len(t) // 2
            edited = t[:len(t) - half] + following[:half]
            a, b, c = paragraph_set(t), paragraph_set(edited), paragraph_set(following)
            out[i].append((len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("hot", [0, 2600])
def test_fingerprint_edits(spark, texts, hot):
    from evalspark.llm.bloom_lookup import fingerprint_edits
    rows = [(i * 5 - 10, t, "b", 1) for i, t in enumerate(texts)] + [(None, "no id", "b", 2), (5, texts[4], "c", 3), (5, texts[4], "c", 3)]
    rows += [(7, f"hot {i % 3}", "d", 4) for i in range(hot)]       # an id with most of the rows
    by_id = defaultdict(list)
    for i, t, *_ in rows:
        by_id[i].append(t or "")
    docs = spark.createDataFrame(rows, "doc_id long, text string, b string, salt int").repartition(3)
    got, prints = defaultdict(list), defaultdict(set)
    for r in fingerprint_edits(spark, docs).collect():
        got[r.doc_id].append((r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)))
        prints[r.n_chars].add(r.fingerprint)
        assert r.peeled and len(r.fingerprint) == len(r.edited_fingerprint) == 24 * 40
    assert {i: sorted(v) for i, v in got.items()} == brute_edits(by_id)
    assert len(prints[len(texts[4])]) == 1


def test_difference_recovers_digests(spark):
    """The digests that peeling gives are those that one version alone holds; larger sketches follow where the first fails."""
    from evalspark.llm import bloom_lookup as B
    r = random.Random(1)
    cases = []
    for both, only_a, only_b in [(0, 0, 0), (50, 1, 0), (0, 3, 4), (300, 9, 11), (10, 400, 2), (2000, 700, 900)]:
        keys = [signed(r.getrandbits(64)) for _ in range(both + only_a + only_b)]
        cases.append((keys[:both + only_a], keys[:both] + keys[both + only_a:]))
    df = spark.createDataFrame(cases, "a array<long>, b array<long>").select(*(B._checked(F.col(c)).alias(c) for c in "ab"))
    df = df.withColumns({f"{c}s": B._sketch(B._signed(F.col(c), 1), F.lit(B.CELLS).cast("long")) for c in "ab"})
    rows = B.difference(df, "a", "b", "d", "as", "bs").select("a.k", F.col("b.k").alias("kb"), "d").collect()
    for row in rows:
        a, b = set(row["k"]), set(row["kb"])
        assert row.d.ok and sorted(row.d.old) == sorted(a - b) and sorted(row.d.new) == sorted(b - a)
        # 24 cells cannot hold more digests than that
        assert row.d.tries > 1 if len(a ^ b) > 24 else row.d.tries == 1


def test_fingerprints_of_few_rows(spark):
    from evalspark.llm.bloom_lookup import fingerprint_edits
    schema = "doc_id long, text string"
    assert fingerprint_edits(spark, spark.createDataFrame([], schema)).count() == 0
    for only in ("a b\nc d", None):
        row, = fingerprint_edits(spark, spark.createDataFrame([(3, only)], schema)).collect()
        assert row.near_next == 1.0 and row.n_chars == len(only or "")


def test_fingerprint_is_native(spark, texts):
    from evalspark.llm.bloom_lookup import fingerprint_edits
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    plan = fingerprint_edits(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- hard negatives

def brute_negatives(rows, is_anchor, n_pos=5, n_neg=10):
    seen, valid = set(), []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (i, label, tuple(v))
        if key not in seen:
            seen.add(key)
            valid.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, la, q in valid:
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, label) for i, label, v in valid if i != a and len(v) == len(q)]
        positives = sorted((s, i) for s, i, label in scored if label == la)[:n_pos]
        for ps, p in positives:
            inside = sorted((s, i) for s, i, label in scored if label != la and 30 * -ps <= 100 * -s <= 90 * -ps)[:n_neg]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "ties", "huge", "many"])
def test_hard_negatives(spark, monkeypatch, case):
    from evalspark.llm import hard_negatives as H
    r = np.random.default_rng(3)
    n = 900 if case == "many" else 160
    rows = []
    for i in range(n):
        d = 3 if i % 11 == 0 else 6
        v = r.normal(size=d) * (1e6 if case == "huge" and i % 3 == 0 else 1)
        if case == "ties":
            v = np.round(v * 2) / 2
        rows.append((i, int(r.integers(3)), [float(x) for x in v]))
    rows += [(None, 1, [1.0] * 6), (1000, None, [1.0] * 6), (1100, 1, None), (1200, 1, [1.0, None] * 3), (1300, 0, [math.nan] * 6),
             (1400, 0, [math.inf] * 6), (1500, 0, []), (1510, 0, []), (1501, 1, []), rows[20], rows[21], (20, 1, [0.5] * 6), (1600, 0, [0.0] * 6)]
    monkeypatch.setattr(H, "MIN_SHARD", 64)
    monkeypatch.setattr(H, "MAX_SHARD", 200)
    df = spark.createDataFrame([(*x, "s", 7) for x in rows], "vec_id long, label int, v array<double>, shard string, anchor int").repartition(3)
    got = sorted(tuple(x) for x in H.hard_negatives(spark, df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)


def test_threshold_stops_early():
    """Where one component rules, few rows are read before the threshold falls below the kth score."""
    from evalspark.llm.hard_negatives import Lists
    n = 20_000
    v = np.zeros((n, 4), np.float32)
    v[:, 0], v[:, 1:] = np.arange(n) % 997, np.random.default_rng(0).integers(0, 3, (n, 3))
    lists, read = Lists(np.arange(n), np.zeros(n, int), v), []
    q = np.array([9, 1, -1, 0], np.float32)
    (at, scores), = lists.search(q, lambda r: read.append(len(r)) or np.ones(len(r), bool), [(-math.inf, math.inf, 10)])
    full = v @ q
    want = np.lexsort((np.arange(n), -full))[:10]
    assert at.tolist() == want.tolist() and scores.tolist() == full[want].tolist() and sum(read) < n / 10


def test_hard_negatives_empty(spark):
    from evalspark.llm.hard_negatives import hard_negatives
    df = spark.createDataFrame([], "vec_id long, label int, v array<float>")
    assert hard_negatives(spark, df, F.col("vec_id") % 10 == 0).count() == 0


# ---------------------------------------------------------------- prefix trie

def brute_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    plain = {c: [(role, text) for _, role, text in sorted(v)] for c, v in convs.items()}
    built = plain
    if rebuild:
        built = {}
        for c, own in plain.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = plain.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def total(p):
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        below = [total(k) for k in kids[p]]
        return (sum(b[0] for b in below) or int(not below), own + sum(b[1] for b in below))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *total(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def turns():
    r = random.Random(9)
    say = lambda: " ".join(r.choice(["a", "b", "été"]) for _ in range(r.randrange(3)))
    rows = [(c, t, r.choice(["user", "bot"]), say()) for c in range(0, 90) for t in range(r.randrange(1, 9))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(5)]        # copies
    rows += [(300, t, "user", f"long {t % 7}") for t in range(70)] + [(301, t, "user", f"long {t % 7}") for t in range(75)]
    rows += [(400, None, None, None), (400, None, "x", None), (400, 1, None, "z"), (400, 1, None, "z"), (None, 1, "user", "lost")]
    r.shuffle(rows)
    return rows


def test_prefix_trie_of_rebuilt(spark, turns):
    from evalspark.llm import prefix_trie as T
    df = spark.createDataFrame([(*x, 1, "n") for x in turns], "conv_id long, turn long, role string, text string, depth int, name string")
    out = T.prefix_trie(spark, *T.rebuilt(*T.ordered_turns(spark, df.repartition(5)))).select(*COLS)
    assert sorted((tuple(x) for x in out.collect()), key=lambda r: (r[1], r[0])) == brute_trie(turns)


def test_prefix_trie_as_is(spark, turns):
    from evalspark.llm import prefix_trie as T
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    out = T.prefix_trie(spark, *T.as_sequences(*T.ordered_turns(spark, df))).select(*COLS)
    assert sorted((tuple(x) for x in out.collect()), key=lambda r: (r[1], r[0])) == brute_trie(turns, rebuild=False)


def test_prefix_trie_of_few_rows(spark):
    from evalspark.llm import prefix_trie as T
    schema = "conv_id long, turn long, role string, text string"
    for rows in ([], [(7, None, None, None)], [(None, 1, "a", "b")]):
        df = spark.createDataFrame(rows, schema)
        out = T.prefix_trie(spark, *T.rebuilt(*T.ordered_turns(spark, df))).select(*COLS).collect()
        assert sorted((tuple(x) for x in out), key=lambda r: (r[1], r[0])) == brute_trie(rows)


# ---------------------------------------------------------------- language sample

@pytest.mark.parametrize("n_ids", [1, 10, 100])
def test_language_sample_is_bounded_and_not_empty(spark, monkeypatch, n_ids):
    """Repeated ids and repeated rows neither swell nor empty the training sample."""
    from evalspark.llm import language_id as L
    sizes = []
    monkeypatch.setattr(L, "fit", lambda texts, labels, n: sizes.append((len(texts), np.bincount(labels).max())) or ())
    monkeypatch.setattr(L, "Tagger", lambda langs, *fitted: langs)
    rows = [(i % n_ids * 7 + 1, f"some text {i % 700}", "en" if i % 3 else "de", 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _k int").repartition(4)
    kept = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % L.HOLD_MOD != L.HOLD_OUT}
    langs = L.train(docs, per_lang=50)
    if kept:
        assert langs == ["de", "en"] and sizes[0][0] <= 100 and sizes[0][1] <= 50 and sizes[0][0] >= 60
    else:
        assert langs is None


def test_vector_search_by_length_with_clashing_columns(spark):
    from evalspark.llm.vector_search import nearest
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((300, 8)), rng.standard_normal((40, 5))
    rows = [(i, v.tolist(), i, 0.5) for i, v in enumerate(x)] + [(1000 + i, v.tolist(), i, 0.5) for i, v in enumerate(y)]
    rows += [(2000, [1.0, 2.0], 0, 0.5)]       # alone with its length: no neighbours
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard long, score double").repartition(3)
    got = defaultdict(list)
    for r in nearest(spark, df, df.filter("vec_id % 20 = 0"), 10, shard_rows=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {*range(0, 300, 20), 1000, 1020}
    hits = 0
    for q, found in got.items():
        at, z, base = (q, x, 0) if q < 1000 else (q - 1000, y, 1000)
        s = z @ z[at]
        s[at] = -np.inf
        hits += len(set(found) & {int(v) + base for v in np.lexsort((np.arange(len(z)), -s))[:10]})
        assert len(found) == 10 and all((v >= 1000) == (q >= 1000) for v in found)
    assert hits >= 0.95 * 10 * len(got)


def test_decontamination_of_short_items_and_repeated_words(spark):
    import time

    from evalspark.llm.decontaminate import Block, decontaminate
    started = time.monotonic()
    block = Block([("long", b"ha " * 20000), ("two", b"Blue whale"), ("none", b"  "), ("one", b"zyzzyva")], 5, short_items=True)
    got = block.find([b"ha " * 40000, b"a blue whale sings", b"blue and whale", b"", b"ha " * 11999, b"ha " * 12000, b"zyzzyva"], 0.6)
    assert [[(i, n, round(c, 4)) for i, n, c in r] for r in got] == [
        [("long", 1, 1.0)], [("two", 1, 1.0)], [], [], [], [("long", 1, 0.6)], [("one", 1, 1.0)]]
    assert time.monotonic() - started < 30      # far from the square of the lengths
    docs = spark.createDataFrame([(None, "the blue WHALE", 1), (1, "blue", 2), (1, "blue", 2), (2, None, 3)],
                                 "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(7, "blue whale"), (8, None)], "item_id long, text string")
    left = decontaminate(spark, docs, bench, short_items=True)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["matches"]) for r in left.collect()) == [(1, "blue", 2), (1, "blue", 2), (2, None, 3)]
    assert decontaminate(spark, docs.limit(0), bench).count() == 0


def test_a_chunk_takes_few_bytes_for_each_byte_of_text():
    import tracemalloc

    from evalspark.llm import textarrays as T
    from evalspark.llm.substring_dedup import remove_passages
    texts = [" ".join(f"w{i}x{j % 977}" for j in range(1000)).encode() for i in range(250)] + [b"", b"a " * 40, b"z" * 400_000 + b" y"]
    size = sum(len(t) for t in texts)
    T._POWERS.clear()
    tracemalloc.start()
    w = T.Words(texts)
    words_peak = tracemalloc.get_traced_memory()[1]
    at, _ = w.grams(35)
    starts = at[w.doc[at] % 2 == 0]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    out = remove_passages(texts, w, starts, 35)
    cut_peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert words_peak < 30 * size and cut_peak < 12 * size
    whole = T.spans_hash(w.pre, w.start, w.end, "byte")     # of the batch as one block
    assert (w.hash == whole).all()
    assert [x[:2] for x in out[:2]] == [(1000, 1000), (1000, 0)] and [x[0] for x in out[-3:]] == [0, 40, 2]
    assert all(x[2] == (b"" if d % 2 == 0 else t) for d, (t, x) in enumerate(zip(texts[:250], out, strict=False)))
