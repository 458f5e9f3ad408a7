"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from viewlens.llm.common import WORD, land, of_row, packed, shuffle_partitions, small, unpacked

WEIGHTS = (3, 1, 2)  # by source order, repeating
SHARE = (3, 2)       # all targets together: 3/2 of all words
LIMIT = 2            # no target above 2 times its source
SEED = "mix-1"
#: Seeds a source may draw with (turns of the hash by 1/DRAWS): it takes the
#: one whose mixture comes nearest to its target.
DRAWS = 32


def n_words(text: str | Column) -> Column:
    """Number of runs of other than ASCII white space (null: 0)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``pos``, the 0-based rank in ``order``, without a
    one-task sort: ranges are sorted apart, then shifted by the counts of
    the ranges before (one row for each partition)."""
    n = shuffle_partitions(df.sparkSession)
    at = land(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select("*", F.spark_partition_id().alias("_p"),
                      F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "numbered")
    per = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return at.join(F.broadcast(shift), "_p").select(*df.columns, (F.col("_i") + F.col("_s")).alias("pos"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, limit: int = LIMIT) -> DataFrame:
    """``sizes(source, source_size)`` -> plus ``target``.

    Sources by code point (null last) weigh ``weights``, repeating, and
    share ``share`` of all words; a target above ``limit`` times its source
    stops there and the excess is shared again by weight, until none is
    above. Each round is one small aggregate over the source table, exact
    in integers.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = land(numbered(sizes, F.col("source").asc_nulls_last()).withColumn(
        "w", F.get(cycle, (F.col("pos") % len(weights)).cast("int")).cast("long")), "sources")
    num, den = share
    total, wsum = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    goal, held, capped = (total or 0) * num, 0, -1  # goal and held in 1/den words
    wsum = wsum or 0
    big = lambda c: F.col(c).cast("decimal(38,0)")
    while True:
        full = F.lit(wsum == 0) if wsum == 0 else (
            big("source_size") * F.lit(limit * den).cast("decimal(10,0)") * F.lit(wsum).cast("decimal(18,0)")
            <= big("w") * F.lit(goal - held).cast("decimal(20,0)"))
        n, size, w = ranked.where(full).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("w")).first()
        if n == capped:
            break
        capped, held = n, limit * den * (size or 0)
        all_w = ranked.agg(F.sum("w")).first()[0] or 0
        if all_w == (w or 0):
            full = F.lit(True)
            break
        wsum = all_w - (w or 0)
    rest = float((goal - held) / den) if den in (1, 2, 4) else (goal - held) / den
    return ranked.select("source", "source_size", F.when(full, F.col("source_size").cast("double") * limit).otherwise(
        F.col("w").cast("double") * F.lit(rest) / F.lit(float(max(wsum, 1)))).alias("target"))


ADDED = ("size", "source_size", "target", "copies")


def _drawn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
           seed: str = SEED, **kw) -> DataFrame:
    """Packed rows ``_row`` of ``docs`` with ADDED."""
    sized = packed(docs).withColumn("size", n_words(of_row(text)))
    per = sized.groupBy(of_row(source).alias("source")).agg(F.sum("size").alias("source_size"))
    goal = land(targets(land(per, "sizes"), **kw), "targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mark = F.concat(F.lit(seed + ":"), F.coalesce(of_row(id_col).cast("string"), F.lit("null")), F.lit(":"),
                    F.md5(F.coalesce(of_row(text), F.lit(""))))
    draw = F.conv(F.substring(F.md5(mark), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

    def copies(turn) -> Column:
        turned = F.col("draw") + turn
        return F.floor("rate") + (turned - F.floor(turned) < F.col("rate") - F.floor("rate")).cast("long")

    met = (sized.withColumn("draw", draw).join(small(goal), of_row(source).eqNullSafe(F.col("of")))
           .withColumn("rate", rate))
    taken = met.select("of", "target", "size", "rate", "draw").groupBy("of", "target").agg(
        *(F.sum(F.col("size") * copies(F.lit(k / DRAWS))).alias(f"t{k}") for k in range(DRAWS)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"))
                                 for k in range(DRAWS))))
    turns = land(taken.select(F.col("of").alias("turn_of"), (best["k"] / F.lit(float(DRAWS))).alias("turn")), "turns")
    out = met.join(small(turns), F.col("of").eqNullSafe(F.col("turn_of")))
    return out.select("_row", "size", "source_size", "target", copies(F.col("turn")).alias("copies"))


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``: each document
    comes floor(rate) times, plus once more with the fraction's probability,
    by a hash of seed, id and text (so reruns agree, and rows that repeat id
    and text agree with each other). A few long documents can carry a small
    source off its target, so one aggregate sums what each of DRAWS turns of
    the hash would take, and a source draws by the turn that is nearest.

    Null sources are one source, ordered last; null and empty texts have
    size 0 and count for no words; a source of size 0 has target 0 and
    copies 0. An empty table gives an empty table; other columns stay, but
    those named like the added ones, which are replaced. ``id_col``,
    ``text``, ``source`` and ``seed`` may be given.
    """
    return _drawn(docs, **kw).select(*unpacked(docs.columns, without=ADDED), *ADDED)


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as it is drawn, with
    all its columns."""
    drawn = _drawn(docs, **kw).where("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*unpacked(docs.columns))
