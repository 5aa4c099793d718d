"""Approximate nearest neighbours by largest inner product: one HNSW graph per shard.

Vectors are dealt to shards by a hash of their content. A shard's graph has layers of nodes
drawn by the same hash (one node in ``FAN`` rises a layer); in each layer a node keeps up to
``M`` (``2 M`` in the lowest) neighbours chosen by the usual heuristic (a candidate is kept if
it is nearer to the node than to any neighbour kept before), and edges go both ways. A shard
holds a bounded number of vectors, so the candidates are its exact nearest ones, found by
blocked matrix products. The graph is stored as flat arrays, one row per shard. Distances are
those of vectors with one more component that gives all the same length, so the nearest ones
have the largest inner product.

A search goes down the layers and keeps the best ``ef`` nodes of the lowest; all queries of a
block are searched side by side. Every shard is searched for every query, in blocks; the
shards' best are merged by score, ties to the smaller id. Scores are inner products of the
original components in double precision.

Equal vectors are one node that carries its ``k + 1`` smallest ids, so thousands of copies
neither fill the graph nor lose an id that the ties ask for. Null or zero vectors, vectors
with a null or non-finite component or of no component, and null ids take no part, as queries
or as candidates. A query is held against the candidates of its own length, each length having
its graphs. Rows with the same id and vector count once. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import table, written

SHARD_ROWS, M, FAN, CANDIDATES, EF = 1 << 14, 24, 16, 64, 192
QUERY_BLOCK, QUERY_GROUP = 512, 1 << 13


def _lift(x: np.ndarray) -> np.ndarray:
    """Vectors of one length whose distances order inner products."""
    sq = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]], 1).astype(np.float32)


def _nearest(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k nearest other nodes of each node, nearest first."""
    n = len(x)
    out = np.empty((n, k), np.int32)
    for lo in range(0, n, block):
        s = x[lo:lo + block] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        top = np.argpartition(s, n - k, axis=1)[:, n - k:]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[lo:lo + block] = np.take_along_axis(top, order, 1)
    return out


def _spread(x: np.ndarray, cand: np.ndarray, m: int, block: int = 2048) -> np.ndarray:
    """Up to m neighbours of each node by the heuristic, the rest -1."""
    n, k = cand.shape
    out = np.full((n, m), -1, np.int32)
    for lo in range(0, n, block):
        c = cand[lo:lo + block]
        v = x[c]
        to_node = np.einsum("nkd,nd->nk", v, x[lo:lo + block])
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(c.shape, bool)
        for j in range(k):      # larger product: nearer, as all have one length
            near = np.where(kept, between[:, j], -np.inf).max(1) <= to_node[:, j]
            kept[:, j] = near & (kept.sum(1) < m)
        # free places go to the nearest that were passed over
        order = np.argsort(~kept, axis=1, kind="stable")[:, :m]
        out[lo:lo + block, :order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _layer(x: np.ndarray, nodes: np.ndarray, m: int) -> np.ndarray:
    """Neighbours (2 m places: chosen ones, then edges back) of the layer's nodes, as node numbers."""
    n = len(nodes)
    out = np.full((n, 2 * m), -1, np.int32)
    if n < 2:
        return out
    v = x[nodes]
    chosen = _spread(v, _nearest(v, min(n - 1, max(m, CANDIDATES))), m)
    out[:, :m] = chosen
    a, b = np.repeat(np.arange(n), m), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((-(v[a] * v[b]).sum(1), b))      # edges back, nearest first, m at most
    a, b = a[order], b[order]
    nth = np.arange(len(b)) - np.searchsorted(b, b)
    take = nth < m
    out[b[take], m + nth[take]] = a[take]
    return np.where(out >= 0, nodes[out], -1).astype(np.int32)


def build(vectors: np.ndarray, level: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of a graph: for each layer from 0, its nodes and their neighbours."""
    x = _lift(vectors)
    nodes, edges, sizes = [], [], []
    for lv in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level >= lv).astype(np.int32)
        nodes.append(at)
        edges.append(_layer(x, at, M if lv == 0 else M // 2).ravel())
        sizes.append(len(at))
    cat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int32)
    return {"nodes": cat(nodes), "edges": cat(edges), "sizes": np.array(sizes, np.int32)}


def search(vectors: np.ndarray, graph: dict[str, np.ndarray], queries: np.ndarray, ef: int = EF) -> np.ndarray:
    """Node numbers (queries, ef) of the best found, -1 where fewer."""
    n, q = len(vectors), len(queries)
    sizes = graph["sizes"]
    out = np.full((q, ef), -1, np.int32)
    if not n or not q:
        return out
    node_at = np.concatenate([[0], np.cumsum(sizes)])
    width = [2 * (M if lv == 0 else M // 2) for lv in range(len(sizes))]
    edge_at = np.concatenate([[0], np.cumsum(sizes * np.array(width))])
    entry = np.full((q, 1), graph["nodes"][node_at[-2]], np.int32)
    for lv in range(len(sizes) - 1, -1, -1):
        rows = np.full(n, -1, np.int32)
        at = graph["nodes"][node_at[lv]:node_at[lv + 1]]
        rows[at] = np.arange(len(at))
        edges = graph["edges"][edge_at[lv]:edge_at[lv + 1]].reshape(len(at), width[lv])
        entry = _beam(vectors, edges, rows, queries, entry, ef if lv == 0 else 16)
    out[:, :entry.shape[1]] = entry
    return out


def _beam(x: np.ndarray, edges: np.ndarray, rows: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int,
          wide: int = 4) -> np.ndarray:
    """Best-first search of one layer for all queries: ``wide`` best open nodes are opened at a time."""
    q, line = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((q, len(x) + 1), bool)      # the last column stands for "no node"
    best = np.full((q, ef), -1, np.int32)
    score = np.full((q, ef), -np.inf, np.float32)
    is_open = np.zeros((q, ef), bool)
    k = min(entry.shape[1], ef)
    best[:, :k] = entry[:, :k]
    score[:, :k] = np.where(entry[:, :k] >= 0, np.einsum("qkd,qd->qk", x[entry[:, :k]], queries), -np.inf)
    is_open[:, :k] = entry[:, :k] >= 0
    seen[line, best] = True
    seen[:, -1] = True
    while True:
        active = np.flatnonzero(is_open.any(1))
        if not len(active):
            return best
        ln = active[:, None]
        order = np.argsort(np.where(is_open[active], -score[active], np.inf), axis=1, kind="stable")[:, :wide]
        go = is_open[ln, order]
        is_open[ln, order] = False
        new = np.where(go[:, :, None], edges[rows[best[ln, order]]], -1).reshape(len(active), -1)
        new = np.sort(new, axis=1)
        fresh = ~seen[ln, new] & (np.diff(new, axis=1, prepend=-2) != 0)
        new = np.where(fresh, new, -1)
        seen[ln, new] = True
        # only nodes seen for the first time are scored
        r, c = np.nonzero(fresh)
        s = np.full(new.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("nd,nd->n", x[new[r, c]], queries[active[r]])
        all_id = np.concatenate([best[active], new], 1)
        all_s = np.concatenate([score[active], s], 1)
        all_o = np.concatenate([is_open[active], fresh], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
        a = np.arange(len(active))[:, None]
        best[active], score[active], is_open[active] = all_id[a, top], all_s[a, top], all_o[a, top]


def valid_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v): rows whose vector takes part, as arrays of float32 or float64 values."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")).cast("double")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.filter(ok & F.exists("v", lambda x: x != 0))


def build_index(spark: SparkSession, rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(rows of a shard's vectors of one length, their ids and graph; number of shards)."""
    shards = max(1, math.ceil(rows.count() / shard_rows))
    width = k + 1

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch become one row, so that a vector of very many copies moves little."""
        for b in batches:
            d = b.to_pandas().groupby("v", sort=False)["id"].agg(lambda x: np.unique(x)[:width].tolist())
            yield pa.RecordBatch.from_pydict({"v": pa.array(d.index, pa.binary()), "ids": pa.array(list(d), pa.list_(pa.int64()))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["v"].flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.cumsum(pc.list_value_length(b["v"]).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"id": b["id"], "v": pa.array([x.tobytes() for x in np.split(flat, ends)[:-1]], pa.binary())})

    packed = rows.mapInArrow(pack, "id long, v binary").mapInArrow(collapse, "v binary, ids array<long>")
    dealt = packed.withColumn("h", F.xxhash64("v")).withColumn("shard", F.pmod("h", F.lit(shards)))

    def index(key, t):
        d = pd.DataFrame({"v": t["v"].to_pylist(), "h": t["h"].to_pylist(), "ids": t["ids"].to_pylist()})
        one = d.groupby("v", sort=True).agg(h=("h", "first"), ids=("ids", lambda x: np.unique(np.concatenate(list(x)))[:width]))
        x = np.stack([np.frombuffer(v, "<f8") for v in one.index])
        # the share of nodes that rise is a power of the fan-out: a hash of the vector decides
        u = ((one["h"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2 ** 53
        level = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(FAN)).astype(np.int32)
        g = build(x, level)
        return pa.table({"shard": [key[0].as_py()], "dim": pa.array([x.shape[1]], pa.int32()),
                         "vectors": pa.array([x.tobytes()], pa.binary()),
                         "id_at": pa.array([np.cumsum([0, *map(len, one["ids"])]).astype("<i8").tobytes()], pa.binary()),
                         "ids": pa.array([np.concatenate(list(one["ids"])).astype("<i8").tobytes()], pa.binary()),
                         **{n: pa.array([a.astype("<i4").tobytes()], pa.binary()) for n, a in g.items()}})

    schema = "shard long, dim int, vectors binary, id_at binary, ids binary, nodes binary, edges binary, sizes binary"
    return written(spark, dealt.groupBy("shard", F.length("v")).applyInArrow(index, schema), "hnsw"), shards


def nearest(spark: SparkSession, candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
            vec: str = "embedding", ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k best found of each query but itself."""
    rows = valid_vectors(candidates, id_col, vec).distinct()
    index, shards = build_index(spark, rows, k, shard_rows)
    q = valid_vectors(queries, id_col, vec).distinct()
    groups = max(1, math.ceil(q.count() / QUERY_GROUP))
    one_of = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    def block(key, t):
        vs = t["v"].to_pylist()
        size = np.array([len(v) for v in vs])
        return pa.table({"g": [key[0].as_py()], "qid": pa.array([t["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "qsize": pa.array([size.astype("<i4").tobytes()], pa.binary()),
                         "q": pa.array([np.concatenate(vs).astype("<f8").tobytes()], pa.binary())})

    # every group of queries meets every shard: rows of bounded size, one graph for each length of vector
    blocks = (q.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups))).groupBy("g")
              .applyInArrow(block, "g long, qid binary, qsize binary, q binary"))
    sent = blocks.withColumn("shard", F.explode(one_of(shards))).groupBy("shard", "g")
    graphs = index.withColumn("g", F.explode(one_of(groups))).groupBy("shard", "g")

    def find(right, left):
        parts = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for b in right.to_pylist():
            size, q_ids, flat = np.frombuffer(b["qsize"], "<i4"), np.frombuffer(b["qid"], "<i8"), np.frombuffer(b["q"], "<f8")
            for r in left.to_pylist():
                fit = size == r["dim"]
                if fit.any():
                    parts += best(r, q_ids[fit], flat[np.repeat(fit, size)].reshape(-1, r["dim"]))
        return pa.concat_tables(parts)

    def best(r, q_ids, qs):
        x = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"])
        g = {n: np.frombuffer(r[n], "<i4") for n in ("nodes", "edges", "sizes")}
        id_at, ids = np.frombuffer(r["id_at"], "<i8"), np.frombuffer(r["ids"], "<i8")
        x32 = x.astype(np.float32)
        for lo in range(0, len(qs), QUERY_BLOCK):
            qv = qs[lo:lo + QUERY_BLOCK]
            got = search(x32, g, qv.astype(np.float32), max(ef, k + 1))
            a, j = np.nonzero(got >= 0)
            node = got[a, j]
            s = np.einsum("nd,nd->n", x[node], qv[a])
            copies = id_at[node + 1] - id_at[node]
            row = np.repeat(np.arange(len(node)), copies)
            vid = ids[np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(id_at[node], copies)]
            qid, s = q_ids[lo + a[row]], s[row]
            keep = vid != qid
            qid, vid, s = qid[keep], vid[keep], s[keep]
            order = np.lexsort((vid, -s, qid))
            qid, vid, s = qid[order], vid[order], s[order]
            top = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
            yield pa.table({"query_id": qid[top], "vec_id": vid[top], "score": s[top]})

    found = sent.cogroup(graphs).applyInArrow(find, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")     # k rows a shard
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(spark, rows, rows.filter(F.col("vec_id") % 20 == 0), 20)
