"""The first n rows by an integer key, without ranking the table.

Counts of the key's leading bits (one map-side combined pass, a few thousand
counters at most) say exactly which interval of keys holds the n-th row. While
that interval holds many rows its next bits are counted in turn; then its few
keys are read, and the n-th key is known. The selection itself is a filter:
no row is sorted or shuffled, whatever n is. Since every step rests on exact
counts, a threshold is never too low and nothing has to be repeated. For a
small n, one pass asks each task for its n least keys instead, and the
threshold is the n-th of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewlens.session import input_bytes

KEY_BITS = 63
#: A small sample asks each task for its n least keys at once, if that is no
#: more keys in all; a task is taken to read TASK_BYTES.
MERGED_KEYS, TASK_BYTES = 500_000, 64 << 20
#: Leading bits counted at a time, and the keys read at once at most.
STEP_BITS, FEW_KEYS = 14, 50_000


def nth_key(keys: DataFrame, key: str, n: int) -> tuple[int, int, int] | None:
    """(key of the n-th smallest row, rows below that key, rows of that key,
    as far as they are known to pass n), or None if there are not more than
    ``n`` rows. ``key`` is a non-negative
    long, never NULL."""
    tasks = input_bytes(keys) // TASK_BYTES + int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n * tasks <= MERGED_KEYS:
        least = [r[0] for r in keys.orderBy(key).limit(n + 1).collect()]
        if len(least) <= n:
            return None
        cut = least[n - 1]
        # one row more than needed says that the key goes on
        return cut, least.index(cut), least.count(cut)
    low, high, below = 0, 1 << KEY_BITS, 0  # the n-th key is in [low, high)
    while True:
        shift = max(0, (high - low).bit_length() - 1 - STEP_BITS)
        inside = keys.filter((F.col(key) >= low) & (F.col(key) < high)) if low or high < 1 << KEY_BITS else keys
        counts = inside.groupBy(F.shiftright(key, shift).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        for r in sorted(counts.collect()):  # at most 2 ** STEP_BITS counters, or FEW_KEYS keys
            if below + r["_c"] >= n:
                break
            below += r["_c"]
        else:
            return None  # fewer than n rows
        start, rows = r["_b"] << shift, r["_c"]
        if shift == 0:
            return start, below, rows
        low, high = start, start + (1 << shift)
        if rows <= FEW_KEYS:
            found = (keys.filter((F.col(key) >= low) & (F.col(key) < high))
                     .groupBy(key).agg(F.count(F.lit(1)).alias("_c")).collect())
            for k, c in sorted(tuple(x) for x in found):
                if below + c >= n:
                    return k, below, c
                below += c


def first_n(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """The first min(n, size) rows of ``df`` by ``order_cols``, of which the
    first is a non-negative long without NULL. Rows that share the n-th key
    are taken in the order of the other columns (NULL last) as far as they
    fit; rows equal in all of them are taken one by one.

    ``df`` is read once for each step of the threshold (one or two, as a
    rule), by its key alone, and once for the result.
    """
    key, *rest = order_cols
    if n <= 0:
        return df.limit(0)
    found = nth_key(df.select(key), key, n)
    if found is None:
        return df
    cut, below, rows = found
    if below + rows == n:
        return df.filter(F.col(key) <= cut)
    order = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in rest or [key]))
    tied = df.filter(F.col(key) == cut).withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= n - below)
    return df.filter(F.col(key) < cut).unionByName(tied.drop("_nth"))
