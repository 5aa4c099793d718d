"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs, in DataFrame functions only.

A text's paragraphs are its lines, long ones cut after every 24 words; the sketch holds the set
of their 64-bit digests. A sketch has three rows of cells; a digest lies in one cell of each,
and a cell keeps how many digests it holds, their exclusive or, and that of their check values.
Two sketches are subtracted cell by cell, so that what both texts hold is gone. A cell that
then holds one digest, as its check value tells, gives that digest away; it is taken out of its
other cells, which may leave one in those, and so on until all cells are empty (:func:`_peel`).

The fingerprint is the sketch of 3 x 8 cells, in hex. The difference of two texts is first
peeled from their fingerprints. Where that fails, the digests are dealt by hash to buckets of
about 8, each with a sketch of its own, and a bucket that fails again is done again with four
times as many cells (:func:`difference`). Long texts are cut by hash 64 ways first, as often as
needed, so the work of a text grows with its length. Likeness is the size of the two sets'
intersection by that of their union, both told by the recovered digests alone.

Edited texts need the next document. Cuts between ranges of ids are read from the ids alone; the
texts are then shuffled once, by range, and each document finds its next in its range or in
the first document of the next range, which is sent along. An id with many rows has a range
of its own, dealt to many tasks. All the rest happens within a row.

Defined results: a null text counts as empty. A text without words has the empty sketch; two
such texts have likeness 1. Rows with one id all have the next greater id as their next; where
that id has several rows, the text with the smallest xxhash64 is taken. Null ids sort first, as
one id. An only document is its own next. An empty table gives no rows; extra columns are not
looked at. Repeated paragraphs count once; the order of paragraphs is not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import partitions, table

#: A line, or 24 words of it.
PARAGRAPH = r"[^\x20\x09-\x0D]+(?:[\x20\x09]+[^\x20\x09-\x0D]+){0,23}"
HASHES, CELLS = 3, 8
#: Digests of a bucket on average at most; digests above which a set is cut 64 ways.
LOAD, LARGE = 8, 512
#: A bucket that fails is tried this often again, each time with four times as many cells.
RETRIES = 7
#: Ranges of ids for each shuffle partition.
CUTS = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs, in order of first occurrence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _checked(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k).alias("x")))


def _shift(key: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", key, by)


def _signed(keys: Column, sign: int) -> Column:
    """Elements (k, x) with the sign that they count with."""
    return F.transform(keys, lambda e: F.struct(e.k.alias("k"), e.x.alias("x"), F.lit(sign).alias("n")))


def _sketch(signed: Column, cells: Column) -> Column:
    """Cells of elements (k, x, n): the sum of their signs, and the exclusive or of digests and of check values;
    ``at`` and ``by`` say which bits of a digest lead to the cell."""
    def row(by: Column) -> Column:
        placed = F.transform(signed, lambda e: F.struct(_shift(e.k, by).bitwiseAND(cells - 1).alias("at"),
                                                        e.k.alias("k"), e.x.alias("x"), e.n.alias("n")))
        return _let(placed, lambda placed: F.transform(F.sequence(F.lit(0).cast("long"), cells - 1), lambda cell: F.aggregate(
            F.filter(placed, lambda e: e["at"] == cell),
            F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("x"),
                     cell.alias("at"), by.alias("by")),
            lambda a, e: F.struct((a.n + e.n).alias("n"), a.k.bitwiseXOR(e.k).alias("k"), a.x.bitwiseXOR(e.x).alias("x"),
                                  a["at"].alias("at"), a.by.alias("by")))))
    return F.concat(*(row(F.lit(20 * i)) for i in range(HASHES)))


def _subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda a, b: F.struct(
        (a.n - b.n).alias("n"), a.k.bitwiseXOR(b.k).alias("k"), a.x.bitwiseXOR(b.x).alias("x"), a["at"].alias("at"), a.by.alias("by")))


def _peel(sketch: Column, cells: Column) -> Column:
    """The digests that a difference of sketches holds: (ok, old, new); ok if its cells all came out empty.

    A round takes out what all cells with one digest hold; it ends when there is none."""
    none = F.array().cast("array<bigint>")
    start = F.struct(sketch.alias("cells"), none.alias("old"), none.alias("new"), F.lit(True).alias("go"))

    def rest(c: Column, keys: Column) -> Column:
        return F.aggregate(F.filter(keys, lambda q: _shift(q.k, c.by).bitwiseAND(cells - 1) == c["at"]), c, lambda c, q: F.struct(
            (c.n - q.n).alias("n"), c.k.bitwiseXOR(q.k).alias("k"), c.x.bitwiseXOR(q.x).alias("x"), c["at"].alias("at"), c.by.alias("by")))

    def taken(s: Column, keys: Column) -> Column:
        # a digest alone in several cells comes once, from the first
        sure = F.filter(keys, lambda q, i: F.array_position(F.transform(keys, lambda p: p.k), q.k) == i + 1)
        return _let(sure, lambda keys: F.struct(
            F.transform(s.cells, lambda c: F.when(c.k == 0, c).otherwise(rest(c, keys))).alias("cells"),
            F.concat(s.old, F.transform(F.filter(keys, lambda q: q.n == 1), lambda q: q.k)).alias("old"),
            F.concat(s.new, F.transform(F.filter(keys, lambda q: q.n == -1), lambda q: q.k)).alias("new"),
            F.lit(True).alias("go")))

    def step(s: Column) -> Column:
        single = F.filter(s.cells, lambda c: (c.k != 0) & ((c.n == 1) | (c.n == -1)) & (c.x == F.xxhash64(c.k)))
        return _let(single, lambda keys: F.when(F.size(keys) > 0, taken(s, keys)).otherwise(F.struct(
            s.cells.alias("cells"), s.old.alias("old"), s.new.alias("new"), F.lit(False).alias("go"))))

    # each round empties a cell at least
    end = F.aggregate(F.sequence(F.lit(0).cast("long"), cells * HASHES), start, lambda s, _: F.when(s.go, step(s)).otherwise(s))
    return _let(end, lambda s: F.struct(
        F.forall(s.cells, lambda c: (c.n == 0) & (c.k == 0) & (c.x == 0)).alias("ok"), s.old.alias("old"), s.new.alias("new")))


def _bucket_difference(pair: Column) -> Column:
    """(ok, old, new, tries) of one bucket (a, b): larger sketches until one peels."""
    def attempt(cells: Column, tries: Column) -> Column:
        # a sum of signs: the sketch of one set less that of the other
        both = F.concat(_signed(pair["a"], 1), _signed(pair["b"], -1))
        return _let(_peel(_sketch(both, cells), cells), lambda r: F.struct(
            r.ok.alias("ok"), r.old.alias("old"), r.new.alias("new"), tries.alias("tries")))

    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(False).alias("ok"), none.alias("old"), none.alias("new"), F.lit(0).alias("tries"))
    cells = lambda t: F.call_function("shiftleft", F.lit(CELLS).cast("long"), 2 * (t - 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(1 + RETRIES)), start,
                       lambda s, t: F.when(s.ok, s).otherwise(_let(cells(t), lambda c: attempt(c, t))))


def _cut(pairs: Column, by: int) -> Column:
    """Pairs of sets with more than ``LARGE`` digests, each cut 64 ways by six bits of the check value."""
    part = lambda keys, i: F.filter(keys, lambda e: F.shiftrightunsigned(e.x, by).bitwiseAND(63) == i)
    return F.flatten(F.transform(pairs, lambda p: F.when(
        F.size(p["a"]) + F.size(p["b"]) <= LARGE, F.array(p)).otherwise(F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.struct(part(p["a"], i).alias("a"), part(p["b"], i).alias("b"))))))


def _buckets(pairs: Column) -> Column:
    """Pairs of sets, each dealt by the last bits of the check value to buckets of ``LOAD`` digests or fewer on average."""
    part = lambda keys, i, n: F.filter(keys, lambda e: e.x.bitwiseAND(n - 1) == i)
    size = lambda p: F.size(p["a"]) + F.size(p["b"])
    number = lambda p: F.call_function(
        "shiftleft", F.lit(1), F.ceil(F.log2(F.greatest(F.lit(1.0), size(p) / F.lit(LOAD)))).cast("int"))
    return F.flatten(F.transform(pairs, lambda p: _let(number(p), lambda n: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.struct(part(p["a"], i, n).alias("a"), part(p["b"], i, n).alias("b"))))))


def difference(df: DataFrame, old: str, new: str, out: str, old_sketch: str, new_sketch: str) -> DataFrame:
    """Adds ``out``: (ok, old, new, tries), the digests that only ``old`` or only ``new`` holds.

    ``old`` and ``new`` are columns of checked digests, the others their sketches of ``CELLS``
    cells, which are subtracted first. ``tries`` is the largest number of sketches that a bucket took.
    """
    first, parts, done = f"{out}_first", f"{out}_parts", f"{out}_done"
    df = df.withColumn(first, _peel(_subtract(F.col(old_sketch), F.col(new_sketch)), F.lit(CELLS).cast("long")))
    pairs = F.array(F.struct(F.col(old).alias("a"), F.col(new).alias("b")))
    for by in (58, 52, 46):
        pairs = _cut(pairs, by)
    none = F.array().cast("array<struct<a:array<struct<k:bigint,x:bigint>>,b:array<struct<k:bigint,x:bigint>>>>")
    df = df.withColumn(parts, F.when(F.col(f"{first}.ok"), none).otherwise(_buckets(pairs)))
    df = df.withColumn(done, F.transform(parts, _bucket_difference))
    larger = F.struct(F.forall(done, lambda r: r.ok).alias("ok"), F.flatten(F.transform(done, lambda r: r.old)).alias("old"),
                      F.flatten(F.transform(done, lambda r: r.new)).alias("new"),
                      (1 + F.array_max(F.transform(done, lambda r: r.tries))).alias("tries"))
    once = F.struct(F.lit(True).alias("ok"), F.col(f"{first}.old").alias("old"), F.col(f"{first}.new").alias("new"),
                    F.lit(1).alias("tries"))
    return df.withColumn(out, F.when(F.col(f"{first}.ok"), once).otherwise(larger)).drop(first, parts, done)


def likeness(n_old: Column, n_new: Column, diff: str) -> Column:
    """Size of the intersection by that of the union, from the sets' sizes and what differs; 1 for two empty sets."""
    apart = F.size(f"{diff}.old") + F.size(f"{diff}.new")
    both = n_old + n_new
    return F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart)).cast("double")


def fingerprint(sketch: str) -> Column:
    """A sketch in hex, cell after cell: number (8 digits), digests and check values (16 each)."""
    digits = lambda c, n: F.lpad(F.hex(c), n, "0")
    return F.array_join(F.transform(sketch, lambda c: F.concat(digits(c.n, 8), digits(c.k, 16), digits(c.x, 16))), "")


def _bucket(ids: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above an id, by binary search; -1 for a null id."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(cuts).bit_length())))))
    sorted_cuts = F.array(*(F.lit(c).cast("long") for c in cuts)).cast("array<bigint>")
    return F.when(ids.isNull(), F.lit(-1)).otherwise(F.aggregate(
        steps, F.lit(0), lambda at, s: F.when(F.get(sorted_cuts, at + s - 1) <= ids, at + s).otherwise(at)))


def _buckets_of_ids(spark: SparkSession, docs: DataFrame) -> tuple[list[int], list[tuple]]:
    """Cuts between ranges of ids with about as many rows each, and for each range that has rows its number, the first id
    of the next one (cyclic) and the salts that its rows are dealt to. Read from ids alone; a few numbers a partition."""
    n = docs.count()
    per_cut = max(1, n // (CUTS * partitions(spark)))
    shares = [i / (CUTS * partitions(spark)) for i in range(1, CUTS * partitions(spark))]
    even = docs.agg(F.percentile_approx("doc_id", shares)).first()[0] or []
    # ids with so many rows stand alone: there are at most twice as many as cuts
    hot_rows = max(1000, per_cut // 2)
    hot = [r[0] for r in docs.filter("doc_id is not null").groupBy("doc_id").count().filter(F.col("count") > hot_rows).collect()]
    cuts = sorted({*even, *hot, *(h + 1 for h in hot if h < 2 ** 63 - 1)})
    found = docs.groupBy(_bucket(F.col("doc_id"), cuts).alias("b")).agg(F.min("doc_id"), F.count(F.lit(1)), F.max("doc_id")).collect()
    found.sort(key=lambda r: r[0])
    alone = [-(-r[2] // hot_rows) if r[1] == r[3] else 1 for r in found]
    return cuts, [(r[0], found[(i + 1) % len(found)][1], alone[i]) for i, r in enumerate(found)]


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text, keys, next_text, next_keys)``: each document and its next, with the digests of both."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts, buckets = _buckets_of_ids(spark, docs.select("doc_id"))
    row = lambda b, first, salts: F.struct(
        F.lit(b).alias("b"), F.lit(first).cast("long").alias("follower"), F.lit(salts).alias("salts"))
    of_bucket = spark.range(1).select(F.inline(F.array(*(row(*x) for x in buckets)))) if buckets else \
        spark.range(0).select(F.lit(0).alias("b"), F.col("id").alias("follower"), F.lit(1).alias("salts"))
    text_hash = F.xxhash64("text").alias("hash")
    # the first document of a range is sent to the range before it, behind that one's last
    asked = F.broadcast(of_bucket)
    firsts = docs.join(asked, docs["doc_id"].eqNullSafe(asked["follower"])).groupBy("b", "salts").agg(
        F.min(F.struct(text_hash, "doc_id", "text")).alias("d"))
    firsts = firsts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("sent"),
                           "d.doc_id", "d.text", digests(F.col("d.text")).alias("keys"), "d.hash")
    salted = {b: n for b, _, n in buckets if n > 1}
    rows = docs.withColumn("b", _bucket(F.col("doc_id"), cuts))
    if salted:
        of_salts = F.create_map(*(F.lit(x) for kv in salted.items() for x in kv))
        salts = F.coalesce(F.try_element_at(of_salts, F.col("b")), F.lit(1))
        rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    else:
        rows = rows.withColumn("salt", F.lit(0))
    rows = rows.select("b", "salt", F.lit(0).alias("sent"), "doc_id", "text", digests(F.col("text")).alias("keys"), text_hash)
    rows = rows.unionByName(firsts)
    order = ["sent", F.col("doc_id").asc_nulls_first(), "hash"]
    after = F.lead(F.struct("text", "keys")).over(Window.partitionBy("b", "salt").orderBy(*order))
    same_id = Window.partitionBy("b", "salt", "sent", "doc_id").orderBy("hash") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("after", after).withColumn("after", F.last("after").over(same_id)).filter("sent = 0")
    return rows.select("doc_id", "text", "keys", F.col("after.text").alias("next_text"), F.col("after.keys").alias("next_keys"))


def fingerprint_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text (its last half replaced by the beginning of
    the next document), the likeness of both and of the document and the next, the number of its paragraphs and
    of the digests that differ, and how many sketches the differences took."""
    rows = with_next(spark, docs).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half),
                                              F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       _checked(F.col("keys")).alias("own"), _checked(digests(F.col("edited"))).alias("edit"),
                       _checked(F.col("next_keys")).alias("next"))
    rows = rows.withColumns({f"{c}_sketch": _sketch(_signed(F.col(c), 1), F.lit(CELLS).cast("long")) for c in ("own", "edit", "next")})
    for c in ("edit", "next"):
        rows = difference(rows, "own", c, f"to_{c}", "own_sketch", f"{c}_sketch")
    size = lambda c: F.size(c)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("own_sketch").alias("fingerprint"),
        fingerprint("edit_sketch").alias("edited_fingerprint"), likeness(size("own"), size("edit"), "to_edit").alias("near_edited"),
        likeness(size("own"), size("next"), "to_next").alias("near_next"), size("own").alias("n_paragraphs"),
        *((size(f"to_{c}.old") + size(f"to_{c}.new")).alias(f"n_{c}_differ") for c in ("edit", "next")),
        F.greatest("to_edit.tries", "to_next.tries").alias("sketches"), (F.col("to_edit.ok") & F.col("to_next.ok")).alias("peeled"))


def op11_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of ``documents`` and of their edited texts."""
    return fingerprint_edits(spark, table(spark, sf_dir, "documents"))
