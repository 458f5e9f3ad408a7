"""watch_enriched: J1, P16-P21, W4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.functions import columns as C
from viewlens.operators import skew


ORDER = "ingest_order"


def dedupe_first(meta: DataFrame, key: str = "video_id",
                 order: str | list[str] | None = None) -> DataFrame:
    """W4/TR18: one row per key. With ingest-order column(s) the first row wins
    (``ORDER`` is taken if the table has it); without any, the least row, so
    the choice never depends on how the rows arrive. Both are partial
    aggregates: a hot key is not one task's sort."""
    others = [c for c in meta.columns if c != key]
    if order is None:
        order = [ORDER] if ORDER in others else others
    order = [order] if isinstance(order, str) else list(order)
    packed = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
    return meta.groupBy(key).agg(packed.alias("_r")).select(key, "_r.*")


def clean_metadata(meta: DataFrame) -> DataFrame:
    """Canonical category id and numeric duration."""
    return (meta.withColumn("category_id", C.canonical_category("category_id"))
            .withColumn("duration_seconds", C.to_long("duration_seconds")))


def watch_enriched(watch: DataFrame, meta: DataFrame, ts: str = "timestamp", unique: bool = False) -> DataFrame:
    """J1 + P18 + P19 + P21: watch rows with duration, category, year and month.

    Left join on video_id: the metadata side is pruned to three columns
    (P26) and holds one row per video (TR18: a repeated metadata key must
    not multiply watch rows). ``unique=True`` says that ``meta`` is a written
    table of one row per key. Where the metadata is too large to broadcast,
    the heavy videos of the log are salted (``skew.left_join``), so a video
    with most of the history is many tasks' work. NULL ids match nothing and
    go around the join.
    """
    cols = ["video_id", "duration_seconds", "category_id", *([ORDER] if ORDER in meta.columns else [])]
    m = meta.select(*cols) if unique else dedupe_first(meta.select(*cols), "video_id")
    m = m.select("video_id", "duration_seconds", "category_id")
    return (skew.left_join(watch, m, "video_id")
            .withColumn("duration_hours", F.col("duration_seconds") / F.lit(3600.0))
            .withColumn("category", C.category_name("category_id"))
            .withColumn("year", F.year(ts))
            .withColumn("month", F.trunc(ts, "MM")))
