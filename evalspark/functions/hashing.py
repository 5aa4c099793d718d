"""Deterministic randomness as column expressions.

All draws are ``md5(seed:id)`` orders, never ``rand()``: the result is a pure function of
the data, the same on every executor and after a task retry, and DuckDB computes the same
strings, so every sample, split and bootstrap draw has an exact SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seeded_hash(seed, ident) -> Column:
    """Hex md5 of ``"<seed>:<id>"`` — the universal deterministic order key."""
    return F.md5(F.concat_ws(":", _c(seed).cast("string"), _c(ident).cast("string")))


def hash_number(text: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex digits of ``md5(text)`` as a non-negative integer."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


#: Buckets of the infinities and, above them as Spark orders it, of NaN: beyond those of all numbers.
INFINITE = 1 << 46


def order_bucket(c: Column, steps: int = 65536) -> Column:
    """A whole number that grows with a double: its binary exponent and ``steps`` equal
    steps inside each power of two, for either sign. Values that differ by more than one
    part in ``steps`` lie in different buckets, wherever the data are packed. The infinities
    and NaN, which is above them, have buckets of their own."""
    def magnitude(x: Column) -> Column:
        e = F.floor(F.log2(x))      # one off next to a power of two: the sum below still grows
        return (e + 1100) * steps + F.floor((x / F.pow(F.lit(2.0), e) - 1) * steps)

    x = c.cast("double")
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(x), F.lit(INFINITE + 1)).when(x == inf, F.lit(INFINITE)).when(x == -inf, F.lit(-INFINITE))
            .when(x == 0, F.lit(0)).when(x > 0, magnitude(x)).otherwise(-magnitude(-x))).cast("long")


def bucket_cumsum(df: DataFrame, partition_cols: list[str], bucket: Column, order_cols: list,
                  value=None, out: str = "cum", inclusive: bool = True) -> DataFrame:
    """Exact running sum of ``value`` (1 = row number) per partition group, in the order of
    ``order_cols``, without sorting a whole group in one task.

    ``bucket`` never decreases along ``order_cols``. One plan at every size: a histogram of
    the buckets (one map-side combined aggregate) gives what lies before each bucket, and a
    window sorts each bucket alone.
    """
    b = "__bucket"
    v = F.lit(1) if value is None else (F.col(value) if isinstance(value, str) else value)
    with_b = df.withColumn("__v", v).withColumn(b, bucket)
    end = Window.currentRow if inclusive else -1
    keys = list(partition_cols) + [b]
    totals = with_b.groupBy(*keys).agg(F.sum("__v").alias("__t"))
    wcum = Window.partitionBy(*partition_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__t").over(wcum), F.lit(0))).drop("__t")
    win = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end)
    local = with_b.withColumn("__local", F.coalesce(F.sum("__v").over(win), F.lit(0)))
    return (local.join(offsets, on=keys, how="inner")
            .withColumn(out, F.col("__before") + F.col("__local"))
            .drop(b, "__local", "__before", "__v"))


def hash_rank(df: DataFrame, partition_cols: list[str], order_hex: str, tiebreak: str,
              out: str = "rn", digits: int = 3) -> DataFrame:
    """Exact ``row_number() over (partition by ... order by order_hex, tiebreak)``.

    A plain window sorts a whole partition group in one task; when one group holds a
    third of the data that task is the job. ``order_hex`` is a uniform hex hash, so its
    first ``digits`` digits cut every group into 16**digits near-equal buckets (see
    :func:`bucket_cumsum`). Same result as the plain window.
    """
    r = bucket_cumsum(df, partition_cols, F.substring(order_hex, 1, digits),
                      [F.col(order_hex), F.col(tiebreak)], None, out)
    return r.withColumn(out, F.col(out).cast("long"))


#: Steps of a power of two in the first histogram of a percentile, and in the second, which reads one bucket of the first.
PERCENTILE_STEPS = (1 << 16, 1 << 32)


def exact_percentile(df: DataFrame, group_cols: list[str], value: str, q: float, out: str = "percentile",
                     steps: tuple[int, ...] = PERCENTILE_STEPS) -> DataFrame:
    """Exact percentile with linear interpolation (as Spark ``percentile`` / SQL
    ``quantile_cont``) per group, without sorting a group.

    The first pass counts the rows of each :func:`order_bucket` (map-side combined) and finds
    the one or two buckets that hold the ranks around q·(n−1). The next reads those buckets'
    rows alone and cuts them finer, so that a bucket holds a million distinct doubles at most,
    however close a group's values are. The last counts equal values and looks the ranks up.
    The ranks' table is sent to the rows, which are read twice and not shuffled but for the histogram.
    Infinite values take part as the ends of the order, NaN as above all of them (as Spark orders it).
    """
    g = list(group_cols)
    rows = df.filter(F.col(value).isNotNull()).select(*g, F.col(value).cast("double").alias("__x"), F.lit(1).cast("long").alias("__k"))
    pos = F.lit(float(q)) * (F.col("__n") - 1)
    lo, hi = F.floor("__pos") + 1, F.ceil("__pos") + 1
    end = F.col("__end")
    holds = ((F.col("__before") < lo) & (lo <= end)) | ((F.col("__before") < hi) & (hi <= end))
    known: list[str] = []
    for level, n_steps in enumerate(steps):
        b = f"__b{level}"
        rows = rows.withColumn(b, order_bucket(F.col("__x"), n_steps))
        carried = ["__pos", "__base"] if level else []
        hist = rows.groupBy(*g, *known, b).agg(F.sum("__k").alias("__c"), *(F.first(c).alias(c) for c in carried))
        up_to = Window.partitionBy(*g, *known).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if level == 0:
            hist = hist.withColumn("__n", F.sum("__c").over(Window.partitionBy(*g))).withColumn("__pos", pos) \
                .withColumn("__base", F.lit(0).cast("long"))
        cum = hist.withColumn("__end", F.col("__base") + F.sum("__c").over(up_to)).withColumn("__before", end - F.col("__c"))
        known.append(b)
        wanted = small_side(cum.filter(holds).select(*g, *known, F.col("__before").alias("__base"), "__pos"), "ranks")
        rows = rows.drop("__pos", "__base").join(wanted, [*g, *known])
        if level == 0:      # all later steps read these buckets' distinct values and how often they occur
            rows = materialize(rows.groupBy(*g, *known, "__base", "__pos", "__x").agg(F.sum("__k").alias("__k")), "rank-rows")
    vc = rows.groupBy(*g, *known, "__x").agg(F.sum("__k").alias("__c"), F.first("__base").alias("__base"),
                                             F.first("__pos").alias("__pos"))
    wb = Window.partitionBy(*g, *known).orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vc = vc.withColumn("__end", F.col("__base") + F.sum("__c").over(wb))
    start = end - F.col("__c")
    a = vc.groupBy(*g).agg(F.max(F.when((start < lo) & (lo <= end), F.col("__x"))).alias("__vl"),
                           F.max(F.when((start < hi) & (hi <= end), F.col("__x"))).alias("__vh"),
                           F.max("__pos").alias("__pos"))
    frac = F.col("__pos") - F.floor("__pos")
    vl, vh = F.col("__vl"), F.col("__vh")
    # an infinite neighbour wins unless the rank lies on the other, as in Spark's percentile
    endless = (F.abs(vl) == float("inf")) | (F.abs(vh) == float("inf"))
    between = F.when((vl == vh) | (frac == 0), vl).when(endless, vl * (1 - frac) + vh * frac).otherwise(vl + (vh - vl) * frac)
    return a.select(*g, between.alias(out))


def exact_median(df: DataFrame, group_cols: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group (see :func:`exact_percentile`)."""
    return exact_percentile(df, group_cols, value, 0.5, out)


def hash_threshold(rows: DataFrame, group_cols: list[str], order_hex: str, tiebreak: str, quotas: DataFrame,
                   digits: int = 3, levels: int = 2) -> DataFrame:
    """The ``quota``-th smallest ``(order_hex, tiebreak)`` of each group, ``(group, quota, __th, __tid)``, found without
    ranking or shuffling the rows: a distributed selection.

    ``quotas`` is ``(group, quota)``. A histogram of the first ``digits`` hex digits (map-side combined) tells
    the bucket that holds the rank; the rows of that bucket alone are written and cut by the next digits, and so on;
    only what is left after ``levels`` cuts, one row in 16**(digits * levels), is sorted. The table of cuts is sent to
    the rows (:func:`~evalspark.session.small_side`), so the rows are read twice and never shuffled. Both are null
    where the quota is 0 or at least the number of rows.
    """
    g = list(group_cols)
    quotas = small_side(quotas.select(*g, "quota"), "quotas")
    left = quotas.withColumn("__rest", F.col("quota"))
    inside = rows.select(*g, order_hex, tiebreak)
    for level in range(levels):
        b = F.substring(order_hex, 1 + level * digits, digits)
        hist = inside.withColumn("__b", b).groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("__c"))
        up_to = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = hist.withColumn("__end", F.sum("__c").over(up_to)).join(left, g)
        rest = F.col("__rest") - F.col("__end") + F.col("__c")
        left = small_side(cum.filter((rest >= 1) & (F.col("__rest") <= F.col("__end"))).select(
            *g, "quota", F.col("__b").alias("__cut"), rest.alias("__rest")), "cuts")
        inside = inside.join(left, g).filter(b == F.col("__cut")).select(*inside.columns)
        if level == 0:      # all later steps read the rows of one bucket in 16**digits
            inside = materialize(inside, "cut-rows")
        left = left.drop("__cut")
    rank = F.row_number().over(Window.partitionBy(*g).orderBy(order_hex, tiebreak))
    last = inside.join(left, g).withColumn("__r", rank).filter(F.col("__r") == F.col("__rest")) \
        .select(*g, F.col(order_hex).alias("__th"), F.col(tiebreak).alias("__tid"))
    return quotas.select(*g, "quota").join(last, g, "left")


def within_threshold(order_hex: str, tiebreak: str) -> Column:
    """Whether a row joined with its group's :func:`hash_threshold` is among the group's ``quota`` first."""
    h, i = F.col(order_hex), F.col(tiebreak)
    return F.when(F.col("quota") <= 0, F.lit(False)).when(F.col("__th").isNull(), F.lit(True)).otherwise(
        (h < F.col("__th")) | ((h == F.col("__th")) & (i <= F.col("__tid"))))
