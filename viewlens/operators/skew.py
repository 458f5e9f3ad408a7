"""Joins of a log with one row per key, where a few keys hold most of the log
(J1).

``approx_top_k`` (a mergeable sketch, one pass over the key column) names the
heavy keys. Their log rows are dealt over as many salts as their share asks
for, their one row on the other side is repeated for each salt, and all other
keys join as they are. The result does not depend on which keys the sketch
finds: a key that it misses or overrates only lands in fewer or more tasks.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.session import input_bytes

#: Heavy keys sought at most, and the sketch's counters.
TOP, TRACKED = 64, 4096
#: Salts a key gets for each average task's worth of rows it holds.
SALTS_PER_TASK = 16


def heavy_keys(log: DataFrame, key: str, tasks: int) -> dict:
    """key -> number of salts, for keys that hold over half a task's share of
    the rows (at most TOP keys; all salts together at most
    ``SALTS_PER_TASK * tasks + TOP``)."""
    r = log.select(F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {TOP}, {TRACKED})").alias("top")).first()
    n = r["n"] or 0
    return {t["item"]: ceil(SALTS_PER_TASK * tasks * t["count"] / n) for t in (r["top"] or [])
            if t["item"] is not None and 2 * t["count"] * tasks > n}


def _salts(heavy: dict, key: Column) -> Column:
    pairs = [c for k, v in heavy.items() for c in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(1))


def broadcasts(df: DataFrame) -> bool:
    """Whether Catalyst would broadcast ``df`` by its estimated size."""
    limit = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return 0 <= input_bytes(df) <= limit


def left_join(log: DataFrame, one: DataFrame, key: str, heavy: dict | None = None) -> DataFrame:
    """``log`` left joined with ``one`` (one row per key) on ``key``.

    NULL keys match nothing and go around the join. If ``one`` is small
    enough that Catalyst broadcasts it, the log is not shuffled and nothing
    is salted; ``heavy`` (key -> salts) may be given where it is known.
    """
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known, none = log.filter(F.col(key).isNotNull()), log.filter(F.col(key).isNull())
    if heavy is None:
        heavy = {} if broadcasts(one) else heavy_keys(known, key, tasks)
    blank = [F.lit(None).cast(one.schema[c].dataType).alias(c) for c in one.columns if c != key]
    if heavy:
        # equal for a task that is run again, unlike a random number; rows alike in all columns part by task
        pick = F.pmod(F.xxhash64(F.spark_partition_id(), *known.columns), _salts(heavy, F.col(key)))
        spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(heavy, F.col(key)) - 1)))
        joined = (known.withColumn("_salt", pick.cast("int")).join(spread, [key, "_salt"], "left").drop("_salt"))
    else:
        joined = known.join(one, key, "left")
    return joined.unionByName(none.select("*", *blank))
