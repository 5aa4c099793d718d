"""Prefix trie of conversations by van Emde Boas recursion, as joins and aggregates.

The depths of all sequences are cut in half again and again, and all pieces of one size are
worked on together, one Spark job a size:

1. names, small to large: the name of a block of 2^k turns is the digest of the names of its
   two halves (:func:`_blocks`);
2. cut prefixes, large to small: a prefix that ends where a piece is cut in half is named by
   the prefix at the start of the piece and the block of its upper half. The upper piece and
   the lower pieces below each cut prefix are then named in the same way, until every depth
   has its name: equal prefixes, and only they, have equal names (:func:`_prefixes`);
3. grafting, small to large: the total of each lower tree's top, a cut prefix, is added to
   its ancestors in the upper piece, which its smallest member lists (:func:`_graft`).

So a sequence of n turns costs about n rows a size, and log2 of the depth sizes; nothing is
held as one array, one group or one row a sequence. Names are 128 bits of SHA-256.

Turns are put in order by one range sort of all rows, by conversation, turn (null first), role
and text; a conversation of any length is spread over as many tasks as it needs. Rows that are
equal in all of these count as turns of their own.

Defined results: null role or text counts as empty; rows without conv_id belong to no
conversation and take no part; an empty table has no nodes; extra columns are not looked at.
The digest of a node's ends is one pass of SHA-256 over ids in order, which cannot be cut: the
ids are joined into pieces by many tasks, and one task streams the pieces of one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Bits of :func:`pyspark.sql.functions.monotonically_increasing_id` that count rows of a partition.
ROW_BITS = 33


def _name(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def ordered_turns(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns ``(conv_id, seq, part, sym, words)``, in order of ``seq`` within a conversation, and
    ``(conv_id, part, first, before, n)``: the turn ``seq`` of a part is the conversation's turn number
    ``before + seq - first``, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("tie"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "tie")]
    by_order = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sym = _name(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    turns = by_order.select("conv_id", F.monotonically_increasing_id().alias("seq"), sym.alias("sym"),
                            F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = written(spark, turns, "trie-turns").withColumn("part", F.shiftright("seq", ROW_BITS))
    parts = turns.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return turns, written(spark, parts, "trie-parts")


def as_sequences(turns: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: ``(conv_id, i, sym, words)`` and ``(conv_id, total)``."""
    seqs = turns.join(parts.drop("n"), ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("seq") - F.col("first")).alias("i"), "sym", "words")
    return seqs, parts.groupBy("conv_id").agg(F.sum("n").alias("total"))


def rebuilt(turns: DataFrame, parts: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations of which each begins with turns of another: conversation c takes the first
    h = crc32(c) % ``heads`` turns of conversation c - c % ``every`` and then its own after its first h."""
    lengths = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    meta = lengths.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    meta = meta.join(of_base, "base", "left").select(
        "conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    # the join with a conversation's parts comes first: a very long one meets its few facts in many tasks
    placed = turns.join(parts.join(meta.select("conv_id", "h", "taken"), "conv_id").drop("n"), ["conv_id", "part"]) \
        .withColumn("pos", F.col("before") + F.col("seq") - F.col("first"))
    own = placed.filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("i"), "sym", "words")
    first = placed.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads - 1)) \
        .select(F.col("conv_id").alias("base"), F.col("pos").alias("i"), "sym", "words")
    lent = meta.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter("i < taken") \
        .select("conv_id", "i", "sym", "words")
    total = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(lent), meta.select("conv_id", total.alias("total"))


def _blocks(spark: SparkSession, seqs: DataFrame, sizes: int) -> list[DataFrame]:
    """Names of the whole blocks of 2^k turns, ``(conv_id, i, sym)``, for each k below ``sizes``."""
    out = [seqs.select("conv_id", "i", "sym")]
    for _ in range(sizes - 1):
        half = out[-1].groupBy("conv_id", F.shiftright("i", 1).alias("j")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("sym"))).alias("left"),
            F.max(F.when(F.col("i") % 2 == 1, F.col("sym"))).alias("right"))
        half = half.filter("left is not null and right is not null")
        out.append(written(spark, half.select("conv_id", F.col("j").alias("i"), _name(F.concat("left", "right")).alias("sym")),
                           "trie-blocks"))
    return out


def _prefixes(spark: SparkSession, lengths: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """``(conv_id, depth, name)`` of every prefix of every sequence, the empty one included."""
    known = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), _name(F.lit(b"")).alias("name"))
    for k in reversed(range(len(blocks))):
        upper = blocks[k].filter(F.col("i") % 2 == 0).select("conv_id", F.shiftleft("i", k).alias("depth"), "sym")
        cut = known.join(upper, ["conv_id", "depth"]).select(
            "conv_id", (F.col("depth") + (1 << k)).alias("depth"), _name(F.concat("name", "sym")).alias("name"))
        known = written(spark, known.unionByName(cut), "trie-prefixes")
    return known


def _graft(spark: SparkSession, nodes: DataFrame, prefixes: DataFrame, sizes: int) -> DataFrame:
    """Turns each node's own ``leaves`` and ``saved`` into those of its subtree."""
    for k in range(sizes):
        depth, piece = F.col("depth"), F.shiftright("depth", k)
        cut = nodes.filter((piece % 2 == 1) & (depth % (1 << k) == 0)).select(
            "conv_id", (piece - 1).alias("piece"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        upper = prefixes.select("conv_id", "depth", "name", piece.alias("piece")).filter("piece % 2 = 0")
        more = upper.join(cut, ["conv_id", "piece"]).groupBy("depth", "name").agg(
            F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        nodes = nodes.join(more, ["depth", "name"], "left")
        nodes = nodes.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}) \
            .drop("more_leaves", "more_saved")
        nodes = written(spark, nodes, "trie-nodes")
    return nodes


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    return list(zip(start, np.append(start[1:], n), strict=True))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, name, conv_id) in order, to one piece of joined ids for each run of a node in a batch."""
    for b in batches:
        depth, name = (np.array(b.column(c).to_pylist(), object) for c in ("depth", "name"))
        ids = b.column("conv_id").to_pylist()
        runs = _runs(depth, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([depth[s] for s, _ in runs], pa.int64()), pa.array([name[s] for s, _ in runs], pa.binary()),
             pa.array([ids[s] for s, _ in runs], pa.int64()),
             pa.array([",".join(map(str, ids[s:e])) for s, e in runs], pa.string())], names=["depth", "name", "first", "piece"])


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node and first id, to one digest a node; holds one piece and one hash state."""
    names, at, state = ["depth", "name", "ends_sha256"], None, None

    def row(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in
                                           enumerate((pa.int64(), pa.binary(), pa.string()))], names=names)
    for b in batches:
        done = []
        for depth, name, piece in zip(*(b.column(c).to_pylist() for c in ("depth", "name", "piece")), strict=True):
            if (depth, name) == at:
                state.update(b"," + piece.encode())
                continue
            if at:
                done.append((*at, state.hexdigest()))
            at, state = (depth, name), hashlib.sha256(piece.encode())
        if done:
            yield row(done)
    if at:
        yield row([(*at, state.hexdigest())])


def ends_digest(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(depth, name, ends_sha256)``: digest of the ids of the sequences that end at a node, in order."""
    ends = prefixes.join(lengths.withColumnRenamed("total", "depth"), ["conv_id", "depth"]).select("depth", "name", "conv_id")
    by_id = ends.repartitionByRange("depth", "name", "conv_id").sortWithinPartitions("depth", "name", "conv_id")
    pieces = by_id.mapInArrow(_join_ids, "depth long, name binary, first long, piece string")
    return pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "first") \
        .mapInArrow(_digest_pieces, "depth long, name binary, ends_sha256 string")


def prefix_trie(spark: SparkSession, seqs: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of ``seqs`` ``(conv_id, i, sym, words)``; ``lengths`` has ``(conv_id, total)`` for every sequence,
    those without turns included. One row a node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    seqs, lengths = written(spark, seqs, "trie-sequences"), written(spark, lengths, "trie-lengths")
    deepest = lengths.agg(F.max("total")).first()[0] or 0
    prefixes = _prefixes(spark, lengths, _blocks(spark, seqs, deepest.bit_length()) if deepest else [])

    words = seqs.select("conv_id", (F.col("i") + 1).alias("depth"), "words")
    of_words = prefixes.join(words, ["conv_id", "depth"], "left")
    nodes = of_words.groupBy("depth", "name").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.coalesce(F.max("words"), F.lit(0)).alias("words"))
    # a node's parent is the prefix, one turn shorter, of its smallest member
    parent = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_name"))
    nodes = written(spark, nodes.join(parent, ["conv_id", "depth"], "left"), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_name").alias("name")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0))
    nodes = nodes.join(children, ["depth", "name"], "left").select(
        "depth", "name", "conv_id", "parent_name", "n_convs", n_children.alias("n_children"),
        F.when(n_children == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = _graft(spark, written(spark, nodes, "trie-nodes"), prefixes, deepest.bit_length())

    # every sequence holds the root: its smallest member is known without a join, which would meet in one task
    low = nodes.filter("depth = 0").select("conv_id").first()
    ids = nodes.filter("depth > 0 and n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(ids, ["depth", "parent_name"])
    top = nodes.filter("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(low[0] if low else None)).cast("long"))
    out = top.unionByName(deep).join(ends_digest(prefixes, lengths), ["depth", "name"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all rebuilt conversations of ``conversations``."""
    turns, parts = ordered_turns(spark, table(spark, sf_dir, "conversations"))
    return prefix_trie(spark, *rebuilt(turns, parts))


OP13_SQL = r"""
with recursive own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t
  from conversations where conv_id is not null),
conv as (select conv_id, conv_id - conv_id % 20 as base, cast(conv_id as varchar) as s from own group by conv_id),
bits as (  -- crc32, bit by bit: a byte comes in at each eighth step
  select conv_id, base, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(s) + 1),
           lambda i: list_prepend(ascii(substr(s, i::int, 1))::bigint + 256, [0::bigint, 0, 0, 0, 0, 0, 0, 0])))),
         lambda c, x: case when x >= 256 then xor(c, x - 256) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from conv),
meta as (select conv_id, base, xor(c, 4294967295) % 4 as h from bits),
n_base as (select m.conv_id, least(m.h, (select count(*) from own o where o.conv_id = m.base)) as taken from meta m),
built as (
  select m.conv_id, o.pos as i, o.t from meta m join own o on o.conv_id = m.base and o.pos < m.h
  union all
  select m.conv_id, o.pos - m.h + b.taken, o.t from meta m join n_base b using (conv_id) join own o on o.conv_id = m.conv_id and o.pos >= m.h),
seq as (select m.conv_id, coalesce(list(b.t order by b.i) filter (where b.t is not null), []) as ts
        from meta m left join built b using (conv_id) group by m.conv_id),
occ as (select conv_id, unnest(range(0, len(ts) + 1)) as depth, ts from seq),
pre as (select conv_id, depth, ts[1:depth] as p, depth = len(ts) as ends,
               case when depth = 0 then 0 else len(regexp_extract_all(ts[depth].text, '[^\x20\x09-\x0D]+')) end as words from occ),
node as (select p, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(words) as own_saved,
                sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
         from pre group by p, depth),
kids as (select p[1:depth - 1] as p, depth - 1 as depth, count(*) as n from node where depth > 0 group by all),
own_tot as (select n.*, coalesce(k.n, 0) as n_children from node n left join kids k using (p, depth)),
up as (select p[1:d] as p, d as depth, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(own_saved) as saved_tokens
       from (select p, n_children, own_saved, unnest(range(0, depth + 1)) as d from own_tot) group by 1, 2)
select cast(n.conv_id as bigint) as conv_id, cast(n.depth as bigint) as depth, cast(q.conv_id as bigint) as parent_conv_id,
       cast(n.n_convs as bigint) as n_convs, cast(n.n_children as bigint) as n_children, cast(u.n_leaves as bigint) as n_leaves,
       cast(u.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from own_tot n join up u using (p, depth) left join node q on q.depth = n.depth - 1 and q.p = n.p[1:n.depth - 1]
"""
