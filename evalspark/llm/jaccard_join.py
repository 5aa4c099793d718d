"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets.

Two documents link when ``100 * intersection >= threshold * union`` of their sets. Documents
of equal sets are one class from the start, so copies cost one row each.

Corpus counts of all shingles come from ``exchange.global_counts``. Only shingles of two or
more documents can be shared, and the order "fewer documents first, then hash" puts common
lines and passages last.

* Light sets (up to ``boundary`` shingles): for each size t that a partner may have, all
  subsets of the fixed size that a link of s and t shingles must share are keys.
* Heavy sets: the first shingles of the order, so many that any two linked sets have one in
  common, are keys of inverted lists; light sets near the boundary are listed too.
* The boundary is the largest size at which enumerating costs no more than scanning:
  subsets against prefix length times ``list_cost`` (entries scanned a list).

A list is not turned into all its pairs: each member is compared with ``CENTERS`` members of
the list (one row each), and components are formed; then only members of one list that lie in
different components are compared, which finds every other link that components need. Where the
number of links is asked for, all pairs of a list are compared, in blocks of ``BLOCK`` by ``BLOCK``
members; each pair that links is a row then, so a group of m near copies costs up to m * m / 2 rows.
Before two sets
are fetched, their sizes and their parity sketches are compared: each shingle flips one of 1024
bits, so the bits that differ are no more than the shingles that differ, and a pair that must
fail is dropped inside the join without losing a link. What is left is compared exactly, on
the whole sets of 64-bit shingle hashes.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a text of fewer
words than a shingle has is one shingle; a text without words (null, empty, blank) has none
and links with nothing. Rows with equal sets link, so repeated rows do. Rows of a null id
link as others do and get the smallest non-null id of their component. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import exchange as X
from evalspark.llm.common import table, text_bytes, written
from evalspark.llm.components import components
from evalspark.llm.textarrays import U, Words, mix
from evalspark.session import scratch_dir

SHINGLE, THRESHOLD, LIST_COST = 3, 90, 8
CENTERS, SKETCH = 4, 16     # members that a list is compared with at first; words of 64 bits in a sketch
BLOCK = 256     # members of a list that one group of all its pairs has on either side


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted by both."""
    w = Words(texts, lower=True)
    at, h = w.grams(width)
    doc = w.doc[at]
    n = np.diff(w.first)
    for k in range(1, width):       # short texts: the whole sequence
        at, g = w.grams(k)
        on = n[w.doc[at]] == k
        doc, h = np.concatenate([doc, w.doc[at[on]]]), np.concatenate([h, mix(g[on] + U(k))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def overlap(s: int, t: int, threshold: int) -> int:
    """Fewest common shingles of linked sets of s and t."""
    return -(-threshold * (s + t) // (100 + threshold))


def partner_sizes(s: int, threshold: int) -> range:
    return range(-(-threshold * s // 100), 100 * s // threshold + 1)


def prefix_length(s: int, threshold: int) -> int:
    return s + threshold * s // -100 + 1       # s - ceil(threshold * s / 100) + 1


def boundary(threshold: int, list_cost: float) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning lists."""
    s = 0
    while sum(comb(s + 1, overlap(s + 1, t, threshold)) for t in partner_sizes(s + 1, threshold)
              if overlap(s + 1, t, threshold) <= min(s + 1, t)) <= list_cost * prefix_length(s + 1, threshold):
        s += 1
    return s


def keys_of_set(hashes: np.ndarray, counts: np.ndarray, light: int, threshold: int) -> set[int]:
    """Keys under which a set meets every set that it may link with."""
    s, out = len(hashes), set()
    order = np.lexsort((hashes, counts))
    shared = int((counts > 1).sum())
    if s <= light:
        own = np.sort(hashes[counts > 1])
        for t in partner_sizes(s, threshold):
            o = overlap(s, t, threshold)
            if t > light or o > shared or o > t:
                continue
            tag = U(min(s, t) * 4099 + max(s, t))
            for pick in combinations(range(len(own)), o):
                part = own[list(pick)]
                out.add(int(mix(np.array([int(mix(part + tag).sum(dtype=np.uint64))], U))[0]))
    if s * 100 >= threshold * (light + 1):
        first = order[:prefix_length(s, threshold)]
        out.update(int(x) for x in hashes[first[counts[first] > 1]])
    return out


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """SKETCH words: bit b is the parity of the hashes that end in b."""
    bits = np.bincount((hashes & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _signed(x: list[int]) -> list[int]:
    return [v - (1 << 64) if v >= 1 << 63 else v for v in x]


def _describe(c: X.Chunks, id_col: str, id_type: str, width: int, threshold: int, light: int) -> DataFrame:
    """Rows of three kinds: 'doc' (id, size, set digest), 'key' (key, size, digest), 'set' (digest, hashes, sketch)."""
    answers = X.global_counts(c, "_raw", lambda t: shingle_sets(t, width)[1], width=4, count_type="<u4")

    def run(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        texts = chunk["_raw"].to_pylist()
        doc, h = shingle_sets(texts, width)
        _, inverse = np.unique(h, return_inverse=True)
        count = X.totals_of(answer, "<u4")[inverse]
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        size = np.diff(first)
        digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None
                  for a, b in zip(first[:-1], first[1:], strict=True)]
        none = [None] * len(texts)
        kinds, sigs, sizes, keys, sets, sketches = ["doc"] * len(texts), list(digest), size.tolist(), none[:], none[:], none[:]
        done = set()
        for d, sig in enumerate(digest):
            if sig is None or sig in done:
                continue
            done.add(sig)
            mine = h[first[d]:first[d + 1]]
            found = _signed(sorted(keys_of_set(mine, count[first[d]:first[d + 1]], light, threshold)))
            if found:
                k = len(found) + 1
                kinds += ["key"] * len(found) + ["set"]
                sigs += [sig] * k
                sizes += [int(size[d])] * k
                keys += [*found, None]
                sets += [None] * len(found) + [mine.view(np.int64)]
                sketches += [None] * len(found) + [parity_sketch(mine)]
        extra = len(kinds) - len(texts)
        ids = pa.chunked_array([*chunk[id_col].chunks, pa.nulls(extra, chunk[id_col].type)])
        return pa.table({"id": ids, "kind": kinds, "sig": pa.array(sigs, pa.binary()), "size": pa.array(sizes, pa.int64()),
                         "k": pa.array(keys, pa.int64()), "members": pa.array(sets, pa.list_(pa.int64())),
                         "sketch": pa.array(sketches, pa.list_(pa.int64()))})

    return X.with_counts(c, answers, run,
                         f"id {id_type}, kind string, sig binary, size long, k long, members array<long>, sketch array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) of set digests that link, compared on their whole sets."""
    s = lambda x: sets.select(F.col("sig").alias(x), F.col("members").alias(f"set_{x}"))
    both = pairs.select("a", "b").join(s("b"), "b").join(s("a"), "a")
    i = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(i * (100 + threshold) >= (F.size("set_a") + F.size("set_b")) * threshold).select("a", "b")


def _may_link(x: str, y: str, threshold: int) -> Column:
    """Sizes s<x>, s<y> and sketches p<x>, p<y> that do not rule a link out."""
    s, t = F.col(f"s{x}"), F.col(f"s{y}")
    differ = reduce(add, [F.bit_count(F.col(f"p{x}")[i].bitwiseXOR(F.col(f"p{y}")[i])) for i in range(SKETCH)])
    return ((s * 100 >= t * threshold) & (t * 100 >= s * threshold)
            & (differ * (100 + threshold) <= (s + t) * (100 - threshold)))


def _all_pairs(keys: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b), a < b, of members of one list that sizes and sketches let link, each once.

    A list of n members is cut into blocks by the set digest, and each pair of blocks is one
    group, so no list is one task's work.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    own = F.pmod(F.xxhash64("sig"), blocks)
    side = lambda x, i, j: keys.withColumn("other", every).select(
        "k", (own if i else F.col("other")).alias("i"), (own if j else F.col("other")).alias("j"),
        F.col("sig").alias(x), F.col("size").alias(f"s{x}"), F.col("sketch").alias(f"p{x}"))
    return (side("a", True, False).join(side("b", False, True), ["k", "i", "j"])
            .filter((F.col("a") < F.col("b")) & _may_link("a", "b", threshold)).select("a", "b").distinct())


def jaccard_components(spark: SparkSession, docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                       width: int = SHINGLE, threshold: int = THRESHOLD, list_cost: float = LIST_COST,
                       links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row, and n_links with ``links``.

    ``n_links``: all classes of equal sets, besides the row's own, that link with it directly.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_bytes(text).alias("_raw"))
    path = scratch_dir(spark, "shingles")
    described = _describe(X.chunked(spark, rows, "_raw", [id_col]), id_col, kind, width, threshold,
                          boundary(threshold, list_cost))
    described.write.partitionBy("kind").parquet(path)
    found = spark.read.schema(described.schema).parquet(path)
    of = lambda x: found.filter(F.col("kind") == x)
    # the same set in several chunks: one row
    sets = of("set").groupBy("sig").agg(F.first("members").alias("members"))
    sketches = of("set").groupBy("sig").agg(F.first("sketch").alias("sketch"))
    # key rows are narrow, and meet by key once: copies of a row, members and centers are counted where they lie
    keys = of("key").select("k", "sig", "size").repartition("k").groupBy("k", "sig").agg(F.max("size").alias("size"))
    member = F.struct("sig", F.col("size").alias("sa"))
    centers = keys.groupBy("k").agg(F.count("*").alias("n"), F.array_distinct(F.array(*[
        F.min_by(member, F.xxhash64("sig", F.lit(i))) for i in range(CENTERS)])).alias("c")).filter("n > 1")
    # lists of two or more: only their members are given a sketch
    keys = written(spark, keys.join(centers, "k"), "lists")
    centers = keys.select("k", F.explode("c").alias("c")).distinct().select("k", F.col("c.sig").alias("a"), F.col("c.sa").alias("sa")) \
        .join(sketches.select(F.col("sig").alias("a"), F.col("sketch").alias("pa")), "a")
    keys = written(spark, keys.drop("c").join(sketches, "sig"), "keys")
    star = keys.select("k", F.col("sig").alias("b"), F.col("size").alias("sb"), F.col("sketch").alias("pb")).join(centers, "k").filter(
        (F.col("a") != F.col("b")) & _may_link("a", "b", threshold)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    comp = components(spark, written(spark, _linked(star, sets, threshold), "links"))
    lists = keys.select("k", "sig", "size", "sketch").join(comp.withColumnRenamed("node", "sig"), "sig", "left").select(
        "k", "sig", "size", "sketch", F.coalesce("root", "sig").alias("root"))
    split = lists.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("k")
    lists = written(spark, lists.join(split, "k", "left_semi"), "lists")
    side = lambda x: lists.select("k", F.col("sig").alias(x), F.col("size").alias(f"s{x}"),
                                  F.col("sketch").alias(f"p{x}"), F.col("root").alias(f"r{x}"))
    across = side("a").join(side("b"), "k").filter((F.col("ra") < F.col("rb")) & _may_link("a", "b", threshold)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = written(spark, _linked(across, sets, threshold), "links")
    roots = components(spark, comp.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    doc = of("doc").select("id", "sig", "size")
    classes = (doc.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("least"))
               .join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("sig", "component_id")
    added = []
    if links:
        pairs = written(spark, _linked(written(spark, _all_pairs(keys, threshold), "pairs"), sets, threshold), "links")
        degree = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).groupBy("sig").agg(F.count("*").alias("n_links"))
        classes = classes.join(degree, "sig", "left")
        added = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    return doc.join(classes, "sig", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *added)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its set and smallest doc_id reachable by links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(spark, docs).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
flat AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i
  FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * i >= 90 * (nx + ny - i)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sized
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, CAST(min(r.y) AS BIGINT) AS component_id
FROM sized s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""
