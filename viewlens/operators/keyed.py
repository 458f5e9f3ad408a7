"""Point questions: requested keys reduce the input before it is aggregated
or shuffled (P24).

Few keys are broadcast (their number is counted first) and select the rows by
a semi-join within the scan's own tasks. Many keys become a bit filter: two
hashed positions a key in an array of words that every task reads, built and
tested with built-in functions; the rows that pass (all of the requested, and
about one in sixty of the others) then meet the keys in a plain semi-join
(``among``), or in the caller's own join of what it has combined by key
(``maybe_among``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most, and keys a bit filter is built for at most.
BROADCAST_KEYS, FILTER_KEYS = 200_000, 8_000_000
BITS_PER_KEY = 16


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits)) for seed in (1, 2)]


def bit_filter(requested: DataFrame, key: str, n_keys: int) -> tuple[Column, int]:
    """(array of 64-bit words as a scalar subquery, number of bits) for the
    distinct keys of ``requested``."""
    bits = 64
    while bits < n_keys * BITS_PER_KEY:
        bits *= 2
    at = requested.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("p"))
    word, bit = F.expr("shiftright(p, 6)").alias("id"), F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = at.groupBy(word).agg(F.bit_or(bit).alias("w"))
    every = requested.sparkSession.range(bits // 64).join(words, "id", "left")
    dense = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"])
    return every.agg(dense.alias("words")).scalar(), bits


def passes(words: Column, bits: int, key: Column) -> Column:
    """Whether ``key`` may be among the keys of the filter (never wrongly no)."""
    out = key.isNotNull()
    for p in _positions(key, bits):
        word = F.get(words, F.floor(p / 64).cast("int"))
        one = F.element_at(F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64))), (p % 64 + 1).cast("int"))
        out = out & (word.bitwiseAND(one) != 0)
    return out


def _filtered(df: DataFrame, requested: DataFrame, key: str) -> tuple[DataFrame, DataFrame, bool]:
    """(rows of ``df`` that may be asked for, distinct keys, whether the rows
    are exact); no row is shuffled."""
    keys = requested.select(key).filter(F.col(key).isNotNull()).distinct()
    n = keys.count()
    if n <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), key, "left_semi"), keys, True
    if n <= FILTER_KEYS:
        words, bits = bit_filter(keys, key, n)
        return df.filter(passes(words, bits, F.col(key))), keys, False
    return df.filter(F.col(key).isNotNull()), keys, False


def maybe_among(df: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among those of ``requested``, and
    a few others when there are many keys: for a caller that aggregates by
    ``key`` and joins the keys after that, so that no join gathers the rows
    of one key before they are combined."""
    return _filtered(df, requested, key)[0]


def among(df: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among those of ``requested`` (NULL
    is never). Only these rows leave the scan's tasks, up to FILTER_KEYS
    keys; beyond, a question about that many keys is a plain semi-join."""
    rows, keys, exact = _filtered(df, requested, key)
    return rows if exact else rows.join(keys, key, "left_semi")
