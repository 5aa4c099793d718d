"""Hard-negative mining by Fagin's threshold algorithm, shard by shard.

Rows are dealt by hash to shards of bounded size. A shard keeps its vectors and, for each
dimension, the list of its rows sorted by that component. For one anchor the lists are read
side by side, each from the end that the sign of the anchor's component favours; a row that is
seen for the first time is scored by random access (an integer inner product). The threshold,
the score that a row at all the current places would have, bounds every row not yet seen; the
reading stops once it lies strictly below the kth score of each window (or below the window,
where nothing unseen can fall into it), so ties are all seen. The lists are read in steps of
doubling depth: the algorithm of batched sorted access, with the same results.

Two rounds: the nearest rows of an anchor's own label (its positives), then, in one window of
scores a positive, the nearest rows of other labels. Each round sends the anchors to every
shard, where they stream past its lists batch by batch, and merges the shards' few best rows
of each anchor. Memory of a task is one shard. Shards grow with the square root of the table
up to ``MAX_SHARD`` rows, so that neither the number of shards nor their size grows with it.

Defined results: rows with a null id, label or vector, or a null, NaN or infinite component take
no part. Only vectors of one length are compared with each other; those of each length are
searched apart. Rows equal in id, label and vector are one row; other rows with a repeated id
are rows of their own, and are never their own anchor's partners. Scores are exact integers;
one that 64 bits cannot hold ends the job with an error. An empty table gives no rows. Extra
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import table, written

N_POSITIVES, N_NEGATIVES = 5, 10
#: A negative's score lies between these shares, in percent, of its positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows of a shard: 32 times the root of the number of rows, within these bounds.
MIN_SHARD, MAX_SHARD = 1024, 131072
FIRST_STEP = 64
ANY_LABEL = None


def _exact(bound: float) -> np.dtype:
    """The smallest type that holds all whole numbers up to ``bound``."""
    return np.dtype(np.float32) if bound < 2 ** 24 else np.dtype(np.float64) if bound < 2 ** 53 else np.dtype(object)


def _as(a: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """``a``, which holds whole numbers, in another type; Python integers if that is ``object``."""
    if dtype != object or a.dtype == object:
        return a.astype(dtype, copy=False)
    out = np.empty(a.size, object)
    out[:] = [int(x) for x in a.ravel().tolist()]
    return out.reshape(a.shape)


def _integers(values: np.ndarray, rows: int) -> np.ndarray:
    """floor(256 x) as a matrix of ``rows``: of floats where all sums of products are exact, else of Python integers."""
    scaled = np.floor(SCALE * values)
    m = scaled.reshape(rows, -1) if rows else scaled.reshape(0, 0)
    exact = _exact(float(np.abs(scaled).max(initial=0)) ** 2 * m.shape[1])
    if exact != object:
        return m.astype(exact)
    whole = [int(x) * SCALE if abs(x) >= 2 ** 53 else math.floor(SCALE * x) for x in values.tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(m.shape)


class Lists:
    """The sorted lists of some rows of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.peak = float(np.abs(vectors).max(initial=0))
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order.astype(np.int64), axis=0)

    def cast(self, dtype: np.dtype) -> Lists:
        if self.vectors.dtype == dtype:
            return self
        out = Lists.__new__(Lists)
        out.ids, out.labels, out.peak, out.order = self.ids, self.labels, self.peak, self.order
        out.vectors, out.sorted = _as(self.vectors, dtype), _as(self.sorted, dtype)
        return out

    def search(self, q: np.ndarray, wanted, windows: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high, k) the best k rows with a score in it, by score and then id, among those
        for which ``wanted(row numbers)`` holds: positions and scores."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        best = [(np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)) for _ in windows]
        kth = [low for low, _, _ in windows]        # below this no row can enter a window
        seen = np.zeros(n, bool)
        depth, step = 0, FIRST_STEP
        while depth < n:
            to = min(n, depth + step) if len(up) + len(down) else n
            hit = np.zeros(n, bool)
            if to < n:
                hit[self.order[n - to:n - depth][:, up].ravel()] = True
                hit[self.order[depth:to][:, down].ravel()] = True
                hit &= ~seen
            else:
                hit = ~seen
            seen |= hit
            new = np.flatnonzero(hit)
            new = new[wanted(new)]
            scores = self.vectors[new] @ q if len(new) else np.zeros(0, self.vectors.dtype)
            for w, (low, high, k) in enumerate(windows):
                inside = (scores >= kth[w]) & (scores <= high)
                if inside.any():
                    at, of = np.append(best[w][0], new[inside]), np.append(best[w][1], scores[inside])
                    if len(of) > k:
                        least = np.partition(of, len(of) - k)[len(of) - k]
                        at, of = at[of >= least], of[of >= least]
                    by = np.lexsort((self.ids[at], -of))[:k]
                    best[w] = at[by], of[by]
                    if len(by) == k:
                        kth[w] = max(low, best[w][1][-1])
            if to == n:
                break
            threshold = self.sorted[n - to, up] @ q[up] + self.sorted[to - 1, down] @ q[down]
            if all(threshold < x for x in kth):
                break
            depth, step = to, 2 * step
        return best


class Shard:
    """One shard's rows, and its lists as anchors ask for them."""

    def __init__(self):
        self.parts, self.rows, self.lists = [], None, {}

    def add(self, ids, labels, vectors: pa.ListArray) -> None:
        lengths = np.diff(vectors.offsets.to_numpy())
        self.parts.append((ids, labels, lengths, vectors.flatten().to_numpy(zero_copy_only=False)))

    def of(self, length: int, label) -> Lists | None:
        """Lists of the rows of one length, and of one label unless it is ``ANY_LABEL``."""
        if self.rows is None:
            ids, labels, lengths, values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.rows = [], {}
            of_value = np.repeat(lengths, lengths)
            for n in np.unique(lengths):
                at = lengths == n
                flat = values[of_value == n]
                self.rows[int(n)] = ids[at], labels[at], _integers(flat, int(at.sum())).reshape(int(at.sum()), int(n))
        if length not in self.rows:
            return None
        if (length, label) not in self.lists:
            ids, labels, m = self.rows[length]
            at = np.ones(len(ids), bool) if label is ANY_LABEL else labels == label
            self.lists[length, label] = Lists(ids[at], labels[at], m[at]) if at.any() else None
        return self.lists[length, label]


def _anchor_rows(shard: Shard, b: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """Best rows of one shard for a batch of anchors."""
    ids, keys, labels = (b.column(c).to_pylist() for c in ("vec_id", "akey", "label"))
    windows = b.column("windows").to_pylist()
    for vec_id, key, label, v, own in zip(ids, keys, labels, b.column("v"), windows, strict=True):
        values = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        lists = shard.of(len(values), label if own is None else ANY_LABEL)
        if lists is None:
            continue
        q = _integers(values, 1)[0]
        exact = _exact(float(np.abs(q).max(initial=0)) * lists.peak * len(q))
        q, lists = _as(q, exact), lists.cast(exact)
        if own is None:
            found = lists.search(q, lambda r, x=lists, i=vec_id: x.ids[r] != i, [(-math.inf, math.inf, k)])
            yield from ((vec_id, key, 0, int(lists.ids[r]), int(s)) for r, s in zip(*found[0], strict=True))
        elif any(w["score"] >= 0 for w in own):     # below 0 the window's bounds are the wrong way round: it is empty
            own = [w for w in own if w["score"] >= 0]
            asked = [(-(-LOW * w["score"] // 100), HIGH * w["score"] // 100, k) for w in own]
            found = lists.search(q, lambda r, x=lists, i=vec_id, y=label: (x.labels[r] != y) & (x.ids[r] != i), asked)
            for w, best in zip(own, found, strict=True):
                yield from ((vec_id, key, w["place"], int(lists.ids[r]), int(s)) for r, s in zip(*best, strict=True))


RESULT = "anchor_id long, akey long, place int, vec_id long, score long"


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard, a shard's own rows before its anchors, to the best rows of each anchor."""
    at, shard = None, Shard()
    for b in batches:
        shards, anchors = b.column("shard").to_numpy(), b.column("anchor").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (anchors[1:] != anchors[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if s == e:
                continue
            if shards[s] != at:
                at, shard = shards[s], Shard()
            part = b.slice(s, e - s)
            if not anchors[s]:
                shard.add(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), part.column("v"))
            elif shard.parts or shard.rows:
                rows = list(_anchor_rows(shard, part, k))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 names=["anchor_id", "akey", "place", "vec_id", "score"])


def _round(rows: DataFrame, anchors: DataFrame, shards: int, k: int) -> DataFrame:
    """The best ``k`` rows for each anchor and window over all shards, ranked."""
    none = F.lit(None).cast("array<struct<place:int,positive_id:bigint,score:bigint>>")
    stored = rows.select("shard", F.lit(False).alias("anchor"), "vec_id", "akey", "label", "v", none.alias("windows"))
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("anchor"),
                            "vec_id", "akey", "label", "v", "windows")
    dealt = stored.unionByName(asking).repartition(shards, "shard").sortWithinPartitions("shard", "anchor")
    found = dealt.mapInArrow(partial(_search, k=k), RESULT)
    best = Window.partitionBy("anchor_id", "akey", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def usable(embedding: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(embedding).isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def hard_negatives(spark: SparkSession, rows: DataFrame, anchors: Column, n_positives: int = N_POSITIVES,
                   n_negatives: int = N_NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``(vec_id, label, v)``;
    ``anchors`` says which rows are anchors."""
    valid = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>")) \
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).filter(usable("v")).distinct()
    valid = written(spark, valid.withColumn("akey", F.xxhash64("vec_id", "label", "v")), "negatives-rows")
    n = valid.count()
    size = min(MAX_SHARD, max(MIN_SHARD, 32 * math.isqrt(n)))
    shards = max(1, -(-n // size))
    valid = valid.withColumn("shard", F.pmod("akey", F.lit(shards)).cast("int"))
    asking = valid.filter(anchors)
    none = F.lit(None).cast("array<struct<place:int,positive_id:bigint,score:bigint>>")
    positives = written(spark, _round(valid, asking.withColumn("windows", none), shards, n_positives), "negatives-positives")
    windows = positives.groupBy("anchor_id", "akey").agg(F.sort_array(F.collect_list(
        F.struct(F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), "score"))).alias("windows"))
    asking = asking.join(windows.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "akey"])
    found = _round(valid, asking, shards, n_negatives).withColumnRenamed("vec_id", "negative_id") \
        .withColumnRenamed("score", "negative_score")
    of = positives.select("anchor_id", "akey", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                          F.col("score").alias("positive_score"))
    return found.join(of, ["anchor_id", "akey", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose id is divisible by 100, among all its rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("v"))
    return hard_negatives(spark, rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
with e as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label, cast(list_dot_product(a.v, r.v) as bigint) as score
  from e a join e r on r.vec_id <> a.vec_id and len(r.v) = len(a.v) where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select s.anchor_id, p.positive_id,
       cast(row_number() over (partition by s.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from s join p on p.anchor_id = s.anchor_id and s.label <> s.anchor_label
  and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""
