"""Selection of work: available filter, resume anti-joins and samples
(P22, J3, J4, J9, T6-T8, U1).

Samples are deterministic: rows are ordered by a 60-bit key taken from
md5('<id>:<seed>') (then the id) and the first n are kept by an exact
threshold on that key (``selection``), so a sample of any size is a filter:
no task or the driver gathers the candidates. A NULL id orders last; rows that
repeat an id are taken or left one by one, so a sample has exactly
min(n, size) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.functions import columns as C
from viewlens.operators.selection import first_n

NULL_KEY = 1 << 62  # above every pool bit and hash


def available(meta: DataFrame) -> DataFrame:
    """Drop the unavailable sentinel; NULL titles stay (TR9)."""
    return meta.filter(~F.col("api_title").eqNullSafe(S.UNAVAILABLE_TITLE))


def pending(items: DataFrame, done: DataFrame, key: str = "video_id", resume: bool = True) -> DataFrame:
    """Items not yet processed; ``resume=False`` offers everything."""
    if not resume:
        return items
    return items.join(done.select(key).distinct(), key, "left_anti")


def seeded(df: DataFrame, n: int | None, key: str = "video_id", seed: int = 42) -> DataFrame:
    """N rows without replacement; all rows when n is 0/None or >= size."""
    if not n:
        return df
    keyed = df.withColumn("_h", F.coalesce(C.md5_rank_key(key, seed), F.lit(NULL_KEY)))
    return first_n(keyed, ["_h", key], n).drop("_h")


def with_scored_flag(items: DataFrame, scored: DataFrame, key: str = "video_id") -> DataFrame:
    """One left join marks the scored pool."""
    s = scored.select(key).distinct().withColumn("is_scored", F.lit(True))
    return items.join(s, key, "left").withColumn("is_scored", F.coalesce("is_scored", F.lit(False)))


def priority(items: DataFrame, scored: DataFrame, n: int | None, key: str = "video_id",
             seed: int = 42) -> DataFrame:
    """T7 + J9 + U1: up to n rows, scored ones first, filled from the unscored
    pool; all rows when n is 0/None or >= size."""
    flagged = with_scored_flag(items, scored, key)
    if not n:
        return flagged
    # scored rows sort before every unscored row: the pool bit sits above the 60-bit hash
    pk = F.when(F.col("is_scored"), F.lit(0)).otherwise(F.lit(1 << 60)).cast("long") \
        + C.md5_rank_key(key, seed)
    keyed = flagged.withColumn("_p", F.coalesce(pk, F.lit(NULL_KEY)))
    return first_n(keyed, ["_p", key], n).drop("_p")


def pool_union(*pools: DataFrame) -> DataFrame:
    """Concatenate sample pools by column name."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out
