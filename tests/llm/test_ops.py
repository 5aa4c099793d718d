"""Every corpus operator against a brute-force version, on rows with nulls, empty texts, ties and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    b = (text or "").encode()
    return WORD.findall(b.lower() if lower else b)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = ["la", "mento", "über", "été", "the", "of", "Ça va", "x1", "naïve", "and", "to"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, other = say(60), say(45)
    out = [None, "", "  \n\t ", "one", "one two", "One TWO", passage, passage, passage.upper(),
           say(30) + "  " + passage + "\n" + say(20), passage + " " + passage, "a " * 200, "a " * 90, "a" * 300, "a" * 70,
           other + " end", say(10) + " " + other, "日本語 " * 40, "x" * 49, "y" * 50, "y" * 50, say(3000)]
    base = say(120).split()
    for k in range(8):      # near copies
        w = base[:]
        w[10 * k] = f"edit{k}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, None, i, "clash", i) for i, t in enumerate(texts)]
    rows.append((None, texts[6], "en", 1, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, size string, k long").repartition(3).cache()


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def all_texts(texts):
    return {**{i * 3: t for i, t in enumerate(texts)}, None: texts[6]}


def test_substring_dedup(spark, docs, all_texts):
    from evalspark.llm.substring_dedup import substring_dedup
    width = 35
    seen = Counter()
    for t in all_texts.values():
        w = words(t)
        seen.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = substring_dedup(spark, docs, joined=True)
    assert set(out.columns) == {*docs.columns, "n_removed"}
    got = by_id(out, "n_words", "n_removed", "text", "size")
    for d, t in all_texts.items():
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        assert got[d] == (len(w), len(gone), kept, None if d is None else "clash")
    same = by_id(substring_dedup(spark, docs), "text")
    assert same[0] == (None,) and same[6] == ("  \n\t ",)


@pytest.mark.parametrize("memory", [32 << 20, 2000])
def test_suffix_dedup(spark, docs, all_texts, memory):
    from evalspark.llm.suffix_dedup import suffix_dedup
    n, key = 50, lambda d: 1 << 62 if d is None else d
    least = {}
    for d, t in all_texts.items():
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            least[b[i:i + n]] = min(key(d), least.get(b[i:i + n], 1 << 63))
    got = by_id(suffix_dedup(spark, docs, memory=memory), "n_bytes", "n_removed", "n_spans", "text")
    for d, t in all_texts.items():
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if least[b[i:i + n]] < key(d):
                gone[i:i + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert got[d] == (len(b), int(gone.sum()), spans, kept), d


def test_induced_sort(tmp_path):
    from evalspark.llm import induced_sort as I
    rng = np.random.default_rng(1)
    block = I.BLOCK
    try:
        for trial in range(40):
            t = np.append(rng.integers(1, rng.integers(2, 5), int(rng.integers(1, 90))), 0)
            I.BLOCK = [3, block][trial % 2]
            f = tmp_path / str(trial)
            f.mkdir()
            out = list(I.sorted_suffixes(t, str(f), 200, memory=[50, 1 << 20][trial % 2], base=[2, 1 << 20][trial // 2 % 2]))
            x, v = (np.concatenate([b[k] for b in out])[::-1].tolist() for k in (0, 1))
            assert x == sorted(range(len(t)), key=lambda i: t[i:].tolist())
            for i in range(len(x) - 1):
                n = 0
                while max(x[i], x[i + 1]) + n < len(t) and t[x[i] + n] == t[x[i + 1] + n]:
                    n += 1
                assert v[i] == n
    finally:
        I.BLOCK = block


def test_jaccard(spark, docs, all_texts):
    from evalspark.llm.jaccard_join import jaccard_components

    def shingles(t):
        w = words(t, True)
        return {tuple(w)} - {()} if len(w) < 3 else {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    sets = {d: shingles(t) for d, t in all_texts.items()}
    for threshold in (90, 80):
        root = {d: d for d in sets}

        def find(d):
            while root[d] != d:
                d = root[d]
            return d
        for a in sets:
            for b in sets:
                if a != b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) > 0:
                    root[find(a)] = find(b)
        comp = defaultdict(list)
        for d in sets:
            comp[find(d)].append(d)
        got = by_id(jaccard_components(spark, docs, threshold=threshold), "n_shingles", "component_id")
        for d in sets:
            ids = [x for x in comp[find(d)] if x is not None]
            assert got[d] == (len(sets[d]), min(ids, default=None)), (threshold, d)


def test_jaccard_keys_meet():
    """Any two sets that link share a key, on either side of the boundary and across it."""
    from evalspark.llm.jaccard_join import boundary, keys_of_set
    light = boundary(90, 8)
    r = random.Random(5)
    for s in (9, 10, 11, light - 1, light, light + 1, light + 3, 40):
        for _ in range(30):
            a = [r.getrandbits(64) for _ in range(s)]
            b = a[:] if r.random() < 0.3 else a[:-1] + ([r.getrandbits(64)] if r.random() < 0.5 else [])
            if 100 * len(set(a) & set(b)) < 90 * len(set(a) | set(b)):
                continue
            df = Counter(a) + Counter(b) + Counter(r.sample(a, 3))
            ks = [keys_of_set(np.array(sorted(x), np.uint64), np.array([df[y] for y in sorted(x)]), light, 90) for x in (a, b)]
            assert ks[0] & ks[1], (s, len(b))


def test_components(spark):
    from evalspark.llm.components import components
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


def test_lm_scores(spark, docs, all_texts):
    from math import log

    from evalspark.llm.lm_score import lm_scores
    count = Counter()
    for t in all_texts.values():
        w = words(t, True)
        for n in (1, 2, 3):
            count.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        count[()] += len(w)
    got = by_id(lm_scores(spark, docs), "n_words", "log_score")
    for d, t in all_texts.items():
        w, s = words(t, True), 0.0
        for i in range(len(w)):
            x = 0.0
            for n in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if n == 1 or count[g] >= 2:
                    s += x + log(count[g] / count[g[:-1]])
                    break
                x += log(0.4)
        assert got[d][0] == len(w) and got[d][1] == pytest.approx(s, abs=1e-6)


def test_bpe(spark, docs, all_texts):
    from evalspark.llm import bpe
    from evalspark.llm.common import vocab_path
    enc = bpe.encoder(vocab_path(bpe.RANKS))
    got = by_id(bpe.bpe_decode(spark, bpe.bpe_encode(spark, docs, piece=50)), "ids", "decoded")
    for d, t in all_texts.items():
        assert list(got[d][0]) == enc.encode_ordinary(t or "") and bytes(got[d][1]) == (t or "").encode()
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["a", "bc ", " ", "  ", "\n", "'s", "é", "1", " ", "\x1c", "!", "don't "]) for _ in range(r.randrange(60)))
        assert bpe.encode_text(enc, t, piece=5, run=2) == enc.encode_ordinary(t), repr(t)


def test_token_counts(spark, docs, all_texts, tmp_path):
    from evalspark.llm import token_counts as T
    from evalspark.llm.common import vocab_path
    count = T.tokenizer(vocab_path(T.MODEL))
    cache = str(tmp_path / "cache")
    want = {d: (len((t or "").encode()), count([t or ""])[0]) for d, t in all_texts.items()}
    assert by_id(T.token_counts(spark, docs, cache), "n_bytes", "n_tokens") == want
    distinct = len({t or "" for t in all_texts.values()})
    assert spark.read.parquet(cache).count() == distinct
    # a second run with one new text encodes that text alone
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("entirely new")).withColumn("doc_id", F.lit(999).cast("long")))
    assert by_id(T.token_counts(spark, more, cache), "n_bytes", "n_tokens") == {**want, 999: (12, count(["entirely new"])[0])}
    assert spark.read.parquet(cache).count() == distinct + 1
    j = vocab_path("byte_bpe_50k.json")
    assert by_id(T.token_counts(spark, docs, cache, model=j), "n_tokens")[9] == (T.tokenizer(j)(["one"])[0],)


def test_decontaminate(spark):
    from evalspark.llm.decontaminate import decontaminate, matches, tile
    r = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    noise = lambda n: [r.choice(["the", "of", "and", "q", "z"]) for _ in range(n)]
    shuffled = item[30:] + ["mid"] + item[10:20] + item[20:30] + ["x"] + item[:10]
    rows = [(0, None), (1, ""), (2, " ".join(noise(500))), (3, " ".join(noise(50) + item + noise(30))),
            (4, " ".join(noise(9) + shuffled)), (5, " ".join(item[:12] + noise(60))), (6, " ".join(item).upper()),
            (7, " ".join(x for w in item for x in (w, "gap"))), (8, "tiny item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "tiny item"), (4, " ".join(item))], "item_id long, text string")
    assert {x["doc_id"] for x in decontaminate(spark, docs, bench).collect()} == {0, 1, 2, 5, 7, 8}
    got = {x["doc_id"]: x["m"] for x in docs.select("doc_id", matches(spark, docs, bench, block_bytes=10).alias("m")).collect()}
    assert [x["item"] for x in got[4]] == [1, 4] and got[3][0]["coverage"] == 1.0
    assert decontaminate(spark, docs, bench.limit(0)).count() == len(rows)
    # tiles: longest first, never overlapping; a brute-force version of the same greedy rule
    for _ in range(100):
        a, b = ([r.randrange(1, 4) for _ in range(r.randrange(25))] for _ in range(2))
        fa, fb, want = [True] * len(a), [True] * len(b), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < 2:
                break
            n, i, j = best[0], -best[1], -best[2]
            fa[i:i + n], fb[j:j + n] = [False] * n, [False] * n
            want.append((i, j, n))
        assert tile(a, b, 2) == want


def test_vector_search(spark):
    from evalspark.llm.vector_search import nearest
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16))
    x[200:700] = x[100]     # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0]), (None, [1.0] * 16), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in nearest(spark, df, df.filter("vec_id % 20 = 0"), 20, shard_rows=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        hits += len({v for v, _ in found} & set(order.tolist()))
        assert len(found) == 20 and all(abs(sc - s[v]) < 1e-9 for v, sc in found)
    assert hits / (20 * len(got)) >= 0.95
    assert nearest(spark, df.limit(0), df.limit(0), 20).count() == 0
    few = df.filter("vec_id in (0, 20, 40)")
    assert nearest(spark, few, few, 20).count() == 6


def test_toxicity_and_language(spark):
    from evalspark.llm import language_id as L
    from evalspark.llm import toxicity as T
    r = random.Random(6)
    syl = {"en": ["th", "and", "ing", "wh"], "fr": ["eau", "é", "qu", "oi"]}
    say = lambda lang, n: " ".join("".join(r.choices(syl[lang], k=3)) for _ in range(n))
    rows = []
    for i in range(400):
        lang, toxic = r.choice(["en", "fr"]), int(r.random() < 0.3)
        w = say(lang, r.randrange(5, 150)).split()
        if toxic:
            w[r.randrange(len(w))] = "badword" + r.choice(["s", "ly", "est"])
        rows.append((i, " ".join(w), lang, toxic))
    rows += [(1000, None, "en", 1), (1001, "", "fr", 0), (1002, "12 34 ...", "en", None), (1003, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = T.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = {x["doc_id"]: x["s"] for x in df.select("doc_id", T.score_column(spark, model).alias("s")).collect()}
    held = [x for x in rows[:400] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert np.mean([(got[x[0]] >= 0.7) == x[3] for x in held]) > 0.9
    assert got[1000] == got[1001] == 0.0 and got[1002] is not None
    clean = say("en", 5000)
    scores = T.scores(model, [clean.encode(), (clean[:9000] + " badwords " + clean[9000:]).encode()])
    assert scores[0] < 0.7 <= scores[1]     # one word in a long text
    assert T.train(df, df.select("doc_id", F.lit(0).alias("toxic"))) is None

    tagger = L.train(df)
    got = {x["doc_id"]: x["l"] for x in df.select("doc_id", L.language_column(spark, tagger).alias("l")).collect()}
    held = [x for x in rows[:400] if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([got[x[0]]["lang"] == x[2] for x in held]) > 0.95
    assert [got[i]["lang"] for i in (1000, 1001, 1002, 1003)] == ["und"] * 4
    f, p = tagger.words([(say("en", 30) + " " + say("fr", 30)).encode()])
    assert (p[5:25].argmax(1) == 0).all() and (p[35:55].argmax(1) == 1).all()
    # forward-backward against enumeration
    rng = np.random.default_rng(0)
    e, m, reset = rng.standard_normal((6, 2)), rng.standard_normal((2, 2)), np.array([1, 0, 0, 0, 1, 0], bool)
    want = np.zeros((6, 2))
    for code in range(64):
        y = [code >> i & 1 for i in range(6)]
        w = np.exp(sum(e[i, y[i]] for i in range(6)) + sum(m[y[i - 1], y[i]] for i in range(6) if not reset[i]))
        for i in range(6):
            want[i, y[i]] += w
    assert np.allclose(L.marginals(e, m, reset), want / want.sum(1, keepdims=True))


def test_empty_tables(spark, docs):
    from evalspark.llm.bpe import bpe_encode
    from evalspark.llm.jaccard_join import jaccard_components
    from evalspark.llm.lm_score import lm_scores
    from evalspark.llm.substring_dedup import substring_dedup
    from evalspark.llm.suffix_dedup import suffix_dedup
    none = docs.limit(0)
    for f in (bpe_encode, jaccard_components, lm_scores, substring_dedup, suffix_dedup):
        assert f(spark, none).count() == 0


def test_pipeline(spark, texts):
    """Each stage on its own input, against plain versions of what it must keep."""
    import corpus_pipeline as P
    from evalspark.llm.bpe import RANKS, encoder
    from evalspark.llm.common import vocab_path
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = []
    for name, stage in P.STAGES:
        out = P.written(spark, stage(spark, docs, sf), f"t-{name}")
        names.append(name)
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        else:
            enc = encoder(vocab_path(RANKS))
            ids = {r["doc_id"]: list(r["ids"]) for r in out.collect()}
            assert ids == {r["doc_id"]: enc.encode_ordinary(r["text"] or "") for r in docs.collect()}
        if name == "jaccard":
            sets = {r["doc_id"]: {tuple(w[i:i + 3]) for w in [words(r["text"], True)] for i in range(len(w) - 2)} for r in out.collect()}
            sets = {d: s for d, s in sets.items() if len(s) > 3}
            ids = sorted(sets)
            assert not [1 for i, a in enumerate(ids) for b in ids[:i] if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])]
        if name == "contamination":
            bench = [words(r["text"], True) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            kept = [b" " + b" ".join(words(r["text"], True)) + b" " for r in out.collect()]
            assert not [1 for b in bench for k in kept if b" " + b" ".join(b) + b" " in k]
        docs = out
    assert names == ["toxicity", "jaccard", "substring", "contamination", "bpe"]


def test_pipeline_near_copies(spark):
    """The stage links copies of 0.8 or more on five-word shingles, also those below 0.9 on three."""
    import corpus_pipeline as P
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(10 ** 6)}" for _ in range(n)]

    def alike(x, y, n):
        a, b = ({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in (x, y))
        return len(a & b) / len(a | b)

    def edited(w, places):
        out = w[:]
        for i in places:
            out[i] = f"edit{i}"
        return out
    short, long, far = say(100), say(239), say(100)
    pairs = [(short, edited(short, (30, 60))), (long, edited(long, (20, 60, 100, 140, 180))), (far, edited(far, (20, 50, 80)))]
    assert [alike(a, b, 5) >= 0.8 for a, b in pairs] == [True, True, False]
    assert all(alike(a, b, 3) < 0.9 for a, b in pairs)
    rows = [(i, " ".join(w)) for i, w in enumerate(w for pair in pairs for w in pair)]
    out = P.jaccard(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x["doc_id"] for x in out.collect()) == [0, 2, 4, 5]


def test_substring_dedup_spreads_copies(spark, monkeypatch):
    """Copies of one text are dealt over the chunks, and still lose all words."""
    from evalspark.llm import exchange as X
    from evalspark.llm.substring_dedup import substring_dedup
    chunked, seen = X.chunked, []
    monkeypatch.setattr(X, "chunked", lambda *a, **b: seen.append(chunked(*a, **b)) or seen[-1])
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(i, copy if i % 2 else " ".join(f"u{i}x{j}" for j in range(40))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    got = by_id(substring_dedup(spark, docs), "n_words", "n_removed", "text")
    assert got == {i: (40, 40, "") if i % 2 else (40, 0, t) for i, t in rows}
    sizes = [r["count"] for r in seen[0].df.groupBy(X.CHUNK).count().collect()]
    assert max(sizes) < 250 and sum(sizes) == 800


def test_jaccard_links(spark, monkeypatch):
    """Every link between different sets is counted, also in lists of many blocks."""
    from evalspark.llm import jaccard_join as J
    monkeypatch.setattr(J, "BLOCK", 8)
    r = random.Random(17)
    base = [f"w{i}" for i in range(120)]
    texts = ["", None, "alone here today", " ".join(base), " ".join(base).upper()]
    for k in range(60):     # near copies of one text, linked with some of one another
        w = base[:]
        for i in r.sample(range(120), 1 + k % 3):
            w[i] = f"edit{k}"
        texts.append(" ".join(w))
    sets = [frozenset(tuple(w[i:i + 3]) for w in [words(t, True)] for i in range(len(w) - 2)) for t in texts]
    want = {d: sum(1 for x in set(sets) if x and x != s and 100 * len(s & x) >= 90 * len(s | x)) for d, s in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(J.jaccard_components(spark, docs, links=True), "n_links")
    assert {d: n for d, (n,) in got.items()} == want and max(want.values()) > 20
