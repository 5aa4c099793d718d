"""Benchmark decontamination by greedy string tiling.

A document is held against every benchmark item with which it shares a seed: ``min_match``
words in a row. Per such pair, the longest matches that do not overlap are marked again and
again (running Karp-Rabin hashes find them; lengths shrink to ``min_match``), and the item's
coverage is the share of its words inside marked matches. Tiles may come in any order, so a
passage whose parts were put in another order is still covered. A document is contaminated
if an item's coverage reaches ``threshold``.

Every tile consists of seeds, so a document's words outside seeds of the item are left out of
the pair's tiling without changing it. Words are lower-cased (A to Z).

Seeds are joined: the benchmark's seeds are a table, hash by item, and so are the documents'
seeds that occur in it. Pairs meet by seed, a pair's seeds by pair, and each pair is tiled from
the item's words and the document's words inside the seeds, so whole texts move no more. Texts
and items are known by their digest: equal ones are tiled once, and a text of many copies makes
no hot key. A bitmap of ``BITMAP`` bits, of that size whatever the benchmark's, keeps most seeds
that the benchmark lacks out of the shuffle; the join decides.

``matches`` gives the same as a column without any shuffle, for a benchmark that is known to be
small: it reads the benchmark on the driver and broadcasts it in blocks of at most
``block_bytes`` of text.

Null or empty documents are clean. An item of fewer than ``min_match`` words matches nothing, or
with ``short_items`` matches where it stands whole; items without words, or null, match nothing.
Equal rows get equal results; items of equal text all match. Extra columns are kept and never
looked at.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from evalspark.llm.common import free_name, small_batches, table, text_bytes, written
from evalspark.llm.textarrays import Words

MIN_MATCH, THRESHOLD, BITMAP = 5, 0.6, 1 << 24
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def _karp_rabin(seq: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(start, running hash) of every window of ``s`` unmarked words."""
    drop, h, run = pow(_BASE, s, _MOD), 0, 0
    for i, x in enumerate(seq):
        if not free[i]:
            h, run = 0, 0
            continue
        h = (h * _BASE + x) % _MOD
        run += 1
        if run > s:
            h = (h - seq[i - s] * drop) % _MOD
        if run >= s:
            yield i - s + 1, h


def tile(a: list[int], b: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) of two word sequences; words are numbers over 0.

    Ties go to the match that starts first in ``a``, then in ``b``.
    """
    free_a, free_b = [True] * len(a), [True] * len(b)
    tiles: list[tuple[int, int, int]] = []
    s = _longest(a, b, free_a, free_b, min_match, min(len(a), len(b)))
    while s >= min_match:
        places = defaultdict(deque)
        for j, h in _karp_rabin(b, free_b, s):
            places[h].append(j)
        # no match is longer than s here: longer ones were marked in earlier rounds
        # and marks of this round are of length s, so they reach an end of every window that they touch
        for i, h in list(_karp_rabin(a, free_a, s)):
            if not (free_a[i] and free_a[i + s - 1]) or h not in places:
                continue
            left = places[h]        # places that are marked stay so: none is looked at twice
            while left and not (free_b[left[0]] and free_b[left[0] + s - 1]):
                left.popleft()
            j = next((j for j in left if free_b[j] and free_b[j + s - 1] and a[i:i + s] == b[j:j + s]), None)
            if j is not None:
                free_a[i:i + s] = [False] * s
                free_b[j:j + s] = [False] * s
                tiles.append((i, j, s))
        s = _longest(a, b, free_a, free_b, min_match, s - 1)
    return tiles


def _longest(a: list[int], b: list[int], free_a: list[bool], free_b: list[bool], low: int, high: int) -> int:
    """Length of the longest unmarked match, at most ``high``; under ``low`` if there is none."""
    def some(s: int) -> bool:
        there = defaultdict(list)
        for j, h in _karp_rabin(b, free_b, s):
            there[h].append(j)
        return any(a[i:i + s] == b[j:j + s] for i, h in _karp_rabin(a, free_a, s) for j in there.get(h, ()))

    if high < low or not some(low):
        return low - 1
    while low < high:       # a match of s words holds one of s - 1, so lengths can be halved
        mid = (low + high + 1) // 2
        low, high = (mid, high) if some(mid) else (low, mid - 1)
    return low


class Block:
    """Some items: their words as numbers, and the items and places of each seed hash."""

    def __init__(self, items: list[tuple[object, bytes]], min_match: int, short_items: bool = False):
        self.min_match, self.ids = min_match, [i for i, _ in items]
        w = Words([t for _, t in items], lower=True)
        # numbers of 60 bits stand for words
        self.words = [[int(x >> np.uint64(4)) + 1 for x in w.hash[w.first[k]:w.first[k + 1]]] for k in range(len(items))]
        size = np.diff(w.first)
        # seeds of min_match words; where short items count, one is a seed of its own length
        self.tables = []
        for n in range(1 if short_items else min_match, min_match + 1):
            at, h = w.grams(n)
            fit = np.flatnonzero((size[w.doc[at]] == n) | (n == min_match))
            if len(fit):
                fit = fit[np.argsort(h[fit], kind="stable")]
                seed, start = np.unique(h[fit], return_index=True)
                item = w.doc[at[fit]]
                self.tables.append((n, seed, np.append(start, len(fit)), item, at[fit] - w.first[item]))

    def find(self, texts: list[bytes], threshold: float) -> list[list[tuple[object, int, int]]]:
        """Per text, (item id, tiles, words of the item covered) of the items that it contains."""
        out: list[list] = [[] for _ in texts]
        if not self.tables or not texts:
            return out
        w = Words(texts, lower=True)
        # per text and item: the text's words and the item's words inside common seeds
        seeds: dict[tuple[int, int], tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for n, seed, start, item, place in self.tables:
            at, h = w.grams(n)
            k = np.minimum(np.searchsorted(seed, h), len(seed) - 1)
            hit = np.flatnonzero(seed[k] == h)
            at, k = at[hit], k[hit]
            order = np.lexsort((at, k, w.doc[at]))
            at, k = at[order], k[order]
            doc = w.doc[at]
            first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(k) != 0))) if len(at) else at
            # a seed's places in an item are taken once for a text, however often the text repeats it
            for x, y in zip(first.tolist(), np.append(first, len(at))[1:].tolist(), strict=True):
                held = slice(start[k[x]], start[k[x] + 1])
                ours = {p + r for p in at[x:y].tolist() for r in range(n)}
                by_item = defaultdict(set)
                for i, q in zip(item[held].tolist(), place[held].tolist(), strict=True):
                    by_item[i].update(range(q, q + n))
                for i, theirs in by_item.items():
                    mine = seeds[int(doc[x]), i]
                    mine[0].update(ours)
                    mine[1].update(theirs)
        for (d, item), (ours, theirs) in sorted(seeds.items()):
            words = self.words[item]
            if len(theirs) < threshold * len(words):
                continue            # tiles lie inside seeds: coverage cannot reach the threshold
            keep = sorted(ours)
            part, last = [], None
            for p in keep:
                if last is not None and p != last + 1:
                    part.append(-len(part) - 1)     # a gap: matches nothing
                part.append(int(w.hash[p] >> np.uint64(4)) + 1)
                last = p
            tiles = tile(words, part, min(self.min_match, len(words)))
            covered = sum(t[2] for t in tiles)
            if covered >= threshold * len(words):
                out[d].append((self.ids[item], len(tiles), covered / len(words)))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    block, size = [], 0
    for r in benchmark.select(F.col(item_col), text_bytes(text).alias("b")).toLocalIterator():
        block.append((r[0], bytes(r[1])))
        size += len(r[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id",
            item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
            block_bytes: int = 8 << 20, short_items: bool = False) -> Column:
    """Column of a document's matches: array<struct<item, n_tiles, coverage>>."""
    small_batches(spark)
    kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"array<struct<item:{kind},n_tiles:int,coverage:double>>"

    def column(block: list[tuple[object, bytes]]) -> Column:
        shared = spark.sparkContext.broadcast(Block(block, min_match, short_items))

        @pandas_udf(schema)
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                rows = shared.value.find(list(batch), threshold)
                yield pd.Series([[{"item": i, "n_tiles": n, "coverage": c} for i, n, c in r] for r in rows], dtype=object)

        return find(text_bytes(text))

    parts = [column(b) for b in _blocks(benchmark, item_col, item_text, block_bytes)]
    return F.concat(*parts) if parts else F.array().cast(schema)


def _numbers(hashes: np.ndarray) -> np.ndarray:
    """Numbers of 60 bits, over 0, stand for words."""
    return (hashes >> np.uint64(4)).astype(np.int64) + 1


def _item_seeds(items: DataFrame, sizes: range, min_match: int) -> DataFrame:
    """Each seed of each item (``item_key``, ``item_text``), once: (seed, item_key)."""
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, keys = Words(list(b["item_text"]), lower=True), b["item_key"].to_numpy()
            size = np.diff(w.first)
            for n in sizes:
                at, h = w.grams(n)
                item = w.doc[at]
                fit = (size[item] == n) | (n == min_match)
                one = pd.DataFrame({"seed": h[fit].view(np.int64), "item": item[fit]}).drop_duplicates()
                yield pd.DataFrame({"seed": one["seed"], "item_key": keys[one["item"]]})

    return items.mapInPandas(seeds, "seed long, item_key string")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which slots the seeds take: at most BITMAP / 64 numbers come to the driver."""
    slot = seeds.select((F.col("seed").bitwiseAND(F.lit(BITMAP - 1))).alias("slot"))
    rows = (slot.groupBy(F.shiftright("slot", 6).alias("at"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).collect())
    out = np.zeros(BITMAP // 64, np.int64)
    out[[r["at"] for r in rows]] = [r["bits"] for r in rows]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _document_seeds(spark: SparkSession, texts: DataFrame, bitmap: np.ndarray, sizes: range) -> DataFrame:
    """Seeds of ``texts`` (``doc_key``, ``doc_text``) whose slot is taken: (doc_key, place, seed, words), once a text."""
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = np.unpackbits(shared.value).view(bool)
        for b in batches:
            w, keys = Words(list(b["doc_text"]), lower=True), b["doc_key"].to_numpy()
            number = _numbers(w.hash)
            for n in sizes:
                at, h = w.grams(n)
                hit = taken[(h & np.uint64(BITMAP - 1)).astype(np.int64)]
                at, h = at[hit], h[hit]
                yield pd.DataFrame({"doc_key": keys[w.doc[at]], "place": at - w.first[w.doc[at]], "seed": h.view(np.int64),
                                    "words": pd.Series([number[p:p + n] for p in at.tolist()], dtype=object)})

    rows = texts.mapInPandas(seeds, "doc_key string, place long, seed long, words array<long>")
    return rows.dropDuplicates(["doc_key", "place", "seed"])


def _tile_pair(words: list[int], seeds: list, min_match: int, threshold: float) -> tuple[int, float] | None:
    """(tiles, coverage) of an item's ``words`` by a document's ``seeds`` (place, words); None under ``threshold``."""
    common, ours = set(), {}
    for seed in seeds:
        part = tuple(seed["words"].tolist())
        common.add(part)
        ours.update((seed["place"] + r, x) for r, x in enumerate(part))
    theirs = {q + r for n in {len(c) for c in common} for q in range(len(words) - n + 1)
              if tuple(words[q:q + n]) in common for r in range(n)}
    if len(theirs) < threshold * len(words):
        return None         # tiles lie inside seeds: coverage cannot reach the threshold
    text, last = [], None
    for p in sorted(ours):
        if last is not None and p != last + 1:
            text.append(-len(text) - 1)     # a gap: matches nothing
        text.append(ours[p])
        last = p
    tiles = tile(words, text, min(min_match, len(words)))
    covered = sum(t[2] for t in tiles)
    return (len(tiles), covered / len(words)) if covered >= threshold * len(words) else None


def found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id",
          item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
          short_items: bool = False) -> DataFrame:
    """(doc_key, matches) of the texts that hold an item; ``doc_key`` is the digest of the text's bytes.

    ``matches`` is array<struct<item, n_tiles, coverage>>, ordered by item.
    """
    small_batches(spark)
    sizes = range(1 if short_items else min_match, min_match + 1)
    named = benchmark.select(F.col(item_col).alias("item"), text_bytes(item_text).alias("item_text"))
    named = named.withColumn("item_key", F.sha2("item_text", 256))
    items = named.select("item_key", "item_text").dropDuplicates(["item_key"])
    seeds = written(spark, _item_seeds(items, sizes, min_match), "item-seeds")
    texts = docs.select(text_bytes(text).alias("doc_text")).select(F.sha2("doc_text", 256).alias("doc_key"), "doc_text")
    pairs = (_document_seeds(spark, texts, _bitmap(seeds), sizes).join(seeds, "seed")
             .groupBy("doc_key", "item_key").agg(F.collect_list(F.struct("place", "words")).alias("seeds")))

    @pandas_udf("struct<n_tiles:int,coverage:double>")
    def tiled(item: pd.Series, both: pd.Series) -> pd.DataFrame:
        w = Words(list(item), lower=True)
        number = _numbers(w.hash).tolist()
        rows = [_tile_pair(number[w.first[k]:w.first[k + 1]], s, min_match, threshold) for k, s in enumerate(both)]
        return pd.DataFrame([r or (0, None) for r in rows], columns=["n_tiles", "coverage"])

    good = (pairs.join(items, "item_key").select("doc_key", "item_key", tiled("item_text", "seeds").alias("t"))
            .filter("t.coverage is not null"))
    one = F.struct("item", "t.n_tiles", "t.coverage")
    return written(spark, good.join(named.select("item_key", "item"), "item_key").groupBy("doc_key")
                   .agg(F.sort_array(F.collect_list(one)).alias("matches")), "contaminated")


def with_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", **kw) -> DataFrame:
    """``docs`` with a column ``name`` of each document's matches, empty where there are none."""
    key = free_name(docs, "doc_key")
    hits = found(spark, docs, benchmark, text, **kw)
    kind = hits.schema["matches"].dataType
    hits = hits.select(F.col("doc_key").alias(key), F.col("matches").alias(name))
    return (docs.withColumn(key, F.sha2(text_bytes(text), 256)).join(hits, key, "left")
            .select(*docs.columns, F.coalesce(name, F.array().cast(kind)).alias(name)))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``docs`` without the contaminated documents."""
    key = free_name(docs, "doc_key")
    hits = found(spark, docs, benchmark, text, **kw).select(F.col("doc_key").alias(key))
    return docs.withColumn(key, F.sha2(text_bytes(text), 256)).join(hits, key, "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is contaminated, the items that it contains, its largest coverage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_matches(spark, docs, table(spark, sf_dir, "benchmark"), "m").select(
        "doc_id", (F.size("m") > 0).alias("contaminated"), F.sort_array("m.item").alias("items"),
        F.round(F.coalesce(F.array_max("m.coverage"), F.lit(0.0)), 6).alias("coverage"))
