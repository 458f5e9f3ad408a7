"""Exact ranks, percentiles and medians without a single-partition window.

``rank_below`` is the one primitive: for every distinct ordered key it gives
the total weight of rows ordered strictly before it within its group.

Plan (per group):
  1. pre-aggregate to distinct keys with their weight (map-side combine, so a
     value held by a third of all rows becomes one row);
  2. ``approx_percentile`` over the distinct first key gives ``buckets - 1``
     boundaries; the bucket of a key is a pure function of its first column,
     so equal values share a bucket whatever the boundaries' error;
  3. bucket totals (groups x buckets rows) are cumulated by a window over
     that small table;
  4. a window partitioned by (group, bucket) cumulates within the bucket.
The result is exact; only the balance of the buckets is approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_BUCKETS = 256


def default_buckets(df: DataFrame) -> int:
    """Buckets of a rank: twice the shuffle partitions, so that a table-wide
    rank uses every task of the session."""
    return max(MIN_BUCKETS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rank_below(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
               weight: str | None = None, buckets: int | None = None,
               accuracy: int = 10_000, few_groups: bool = False) -> DataFrame:
    """Distinct (group_cols, order_cols) rows with ``_cnt`` (their weight),
    ``_below`` (weight strictly before, same group) and ``_n`` (group total).

    Rows with a NULL in any order column are ignored (they are outside the
    population). The first order column must be numeric or a timestamp.
    ``few_groups`` says that the number of groups is fixed (such as two
    metrics): their bounds are then broadcast, and no join gathers a group.
    """
    buckets = buckets or default_buckets(df)
    small = F.broadcast if few_groups else (lambda t: t)
    group_cols, order_cols = list(group_cols), list(order_cols)
    w = F.col(weight) if weight else F.lit(1)
    base = df
    for c in order_cols:
        base = base.filter(F.col(c).isNotNull())
    d = base.groupBy(*group_cols, *order_cols).agg(F.sum(w).cast("long").alias("_cnt"))

    first = order_cols[0]
    probs = [i / buckets for i in range(1, buckets)]
    bounds = d.groupBy(*group_cols).agg(
        # duplicate bounds collapse, so a small group carries a short array
        F.array_distinct(F.percentile_approx(first, probs, accuracy)).alias("_bounds"),
        F.sum("_cnt").alias("_n"))
    if group_cols:
        # groups x buckets values; the optimizer broadcasts it when small
        withb = d.join(small(bounds), group_cols)
    else:
        # one row of at most `buckets` values: an uncorrelated scalar
        # subquery, run once and inlined into the projection (no join)
        one = bounds.select(F.struct("_bounds", "_n").alias("_s")).scalar()
        withb = d.withColumn("_s", one).select("*", "_s._bounds", "_s._n").drop("_s")
    withb = bucket_of(withb, "_bounds", first, buckets).drop("_bounds")

    totals = withb.groupBy(*group_cols, "_bucket").agg(F.sum("_cnt").alias("_bcnt"))
    wb = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*group_cols, "_bucket",
                            (F.sum("_bcnt").over(wb) - F.col("_bcnt")).alias("_off"))
    if group_cols:
        withb = withb.join(small(offsets), [*group_cols, "_bucket"])
    else:
        # at most `buckets` rows
        withb = withb.join(F.broadcast(offsets), "_bucket")

    wi = Window.partitionBy(*group_cols, "_bucket").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return withb.select(
        *group_cols, *order_cols, "_cnt", "_n",
        (F.col("_off") + F.sum("_cnt").over(wi) - F.col("_cnt")).alias("_below"))


def bucket_of(df: DataFrame, bounds: str, value: str, buckets: int, out: str = "_bucket") -> DataFrame:
    """Add ``out`` = number of elements of the ascending array ``bounds``
    (at most ``buckets - 1`` long) that are below ``value``.

    A binary search in plain column expressions: log2(buckets) compares per
    row inside whole-stage codegen. (A ``filter`` lambda over the array is
    interpreted and allocates per row; it measured ~25x slower on 40M rows.)
    Probes past the end of a short array are NULL and never advance.
    """
    step = 1
    while step * 2 < buckets:
        step *= 2
    df = df.withColumn(out, F.lit(0))
    while step >= 1:
        probe = F.try_element_at(F.col(bounds), F.col(out) + F.lit(step))
        df = df.withColumn(out, F.when(probe < F.col(value), F.col(out) + F.lit(step))
                           .otherwise(F.col(out)))
        step //= 2
    return df


def exact_median(df: DataFrame, value: str, group_cols: Sequence[str] = (),
                 buckets: int | None = None) -> DataFrame:
    """(group_cols, median) with the interpolated median of non-null ``value``
    (mean of the two middle values when the count is even)."""
    r = rank_below(df, [value], group_cols, buckets=buckets)
    k1 = F.floor((F.col("_n") + 1) / 2)
    k2 = F.floor(F.col("_n") / 2) + 1
    hit1 = (F.col("_below") < k1) & (k1 <= F.col("_below") + F.col("_cnt"))
    hit2 = (F.col("_below") < k2) & (k2 <= F.col("_below") + F.col("_cnt"))
    picked = r.filter(hit1 | hit2).groupBy(*group_cols).agg(
        F.max(F.when(hit1, F.col(value))).alias("_lo"),
        F.max(F.when(hit2, F.col(value))).alias("_hi"))
    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    return picked.select(*group_cols, (lo + (hi - lo) / 2).alias("median"))


#: Rank error of the bracketing sketch (1 / ACCURACY) and half the width of
#: the bracket, both as shares of a group.
ACCURACY, HALF_WIDTH = 10_000, 0.002


def exact_medians(df: DataFrame, values: Sequence[str], group_cols: Sequence[str] = (),
                  buckets: int | None = None, half_width: float = HALF_WIDTH) -> DataFrame:
    """(group_cols, median_<value>...) for several value columns of one type:
    the columns are stacked as (metric, value) rows, and each (group,
    metric) is bracketed.

    1. A mergeable sketch (of rank error 1 / ``buckets``) gives two values
       around the middle.
    2. One counting pass says how many values lie below and up to them, and
       so whether the middle is between them.
    3. Only the values in between (about 2 * ``half_width`` of all), counted
       once each per task, are shuffled and ranked.

    The result is exact whatever the sketch gives: a group whose middle lies
    outside its bracket takes part with all its values. Rows with a NULL
    group, and groups without any value, are left out.
    """
    group_cols = list(group_cols)
    keys = [*group_cols, "_m"]
    stacked = df.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), F.col(v).alias("_v")) for i, v in enumerate(values)]))).filter(F.col("_v").isNotNull())
    q = F.percentile_approx("_v", [0.5 - half_width, 0.5 + half_width], buckets or ACCURACY)
    bracket = stacked.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    met = stacked.join(bracket, keys)
    counts = met.groupBy(*keys, "_lo", "_hi").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v") < F.col("_lo")).alias("_under"),
                                                  F.count_if(F.col("_v") <= F.col("_hi")).alias("_upto"))
    first, last = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = (F.col("_under") < first) & (F.col("_upto") >= last)
    plan = counts.select(*keys, "_lo", "_hi", first.alias("_k1"), last.alias("_k2"), holds.alias("_holds"),
                         F.when(holds, F.col("_under")).otherwise(F.lit(0)).alias("_under"))
    inside = stacked.join(plan, keys).filter(~F.col("_holds") | ((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))))
    each = inside.groupBy(*keys, "_v", "_k1", "_k2", "_under").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_under") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_c"))

    def at(metric, k):
        hit = (F.col("_m") == metric) & (F.col("_below") < F.col(k)) & (F.col(k) <= F.col("_upto"))
        return F.max(F.when(hit, F.col("_v"))).cast("double")

    def middle(i):
        return at(i, "_k1") + (at(i, "_k2") - at(i, "_k1")) / 2
    return each.groupBy(*group_cols).agg(*[middle(i).alias(f"median_{v}") for i, v in enumerate(values)])


def first_n_by_rank(df: DataFrame, order_cols: Sequence[str], n: int,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of ``df`` in the ordering (per group), distributed
    for any n. The first order column (a number, not NULL) is ranked; of the
    rows that share the value at the cut, as many as still fit are taken, in
    the order of the other columns (NULLs last)."""
    group_cols, (first, *rest) = list(group_cols), order_cols
    r = rank_below(df, [first], group_cols).filter(F.col("_below") < n)
    j = df.join(r.select(*group_cols, first, "_cnt", (F.lit(n) - F.col("_below")).alias("_room")), [*group_cols, first])
    w = Window.partitionBy(*group_cols, first).orderBy(*(F.col(c).asc_nulls_last() for c in rest or [first]))
    tied = j.filter(F.col("_cnt") > F.col("_room")).withColumn("_nth", F.row_number().over(w))
    tied = tied.filter((F.col("_nth") <= n) & (F.col("_nth") <= F.col("_room")))
    return j.filter(F.col("_cnt") <= F.col("_room")).select(*df.columns).union(tied.select(*df.columns))
