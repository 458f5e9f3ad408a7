"""History reports: A1-A15, T1, T2, T4, P27 over ``watch_enriched``.

Hours are summed as whole seconds and divided once, so results do not
depend on summation order (and an all-NULL group gives 0.0, TR5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.functions import columns as C


def hours_sum(seconds: str = "duration_seconds"):
    return F.coalesce(F.sum(seconds) / F.lit(3600.0), F.lit(0.0))


def totals(enriched: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row."""
    h = hours_sum()
    return enriched.agg(
        F.count(F.lit(1)).alias("events"),
        h.alias("total_hours"),
        (h / 24).alias("total_days"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count("duration_seconds").alias("with_duration"))


def yearly(enriched: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per year (NULL year excluded, TR6; whole 24-hour days, TR7)."""
    g = (enriched.filter(F.col("year").isNotNull()).groupBy("year")
         .agg(F.count(F.lit(1)).alias("events"), hours_sum().alias("hours"),
              F.min(ts).alias("_first"), F.max(ts).alias("_last")))
    return per_calendar_day(g)


def per_calendar_day(g: DataFrame) -> DataFrame:
    """A5 + A6 for yearly rows with hours and their first and last time."""
    jan1 = F.make_timestamp_ntz(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    dec31 = F.make_timestamp_ntz(F.col("year"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    start = F.greatest(F.col("_first"), jan1)
    end = F.least(F.col("_last"), dec31)
    cal = F.greatest(C.days_floor(start, end) + 1, F.lit(1)).cast("long")
    return (g.withColumn("cal_days", cal)
            .withColumn("hours_per_day", F.col("hours") / F.col("cal_days"))
            .drop("_first", "_last"))


def category_hours(enriched: DataFrame) -> DataFrame:
    """Hours per category."""
    return enriched.groupBy("category").agg(hours_sum().alias("hours"))


def ranked_categories(hours: DataFrame) -> DataFrame:
    """Categories by hours (ties by name): one row per category, bounded by
    the dimension."""
    return hours.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hours"), "category")))


def top_categories(enriched: DataFrame, n: int = 10) -> DataFrame:
    """The n categories with most hours. The limit is the feature."""
    return ranked_categories(category_hours(enriched)).filter(F.col("rank") <= n)


def monthly_hours(enriched: DataFrame) -> DataFrame:
    """Hours per month present (DATE, month start)."""
    return (enriched.filter(F.col("month").isNotNull()).groupBy("month")
            .agg(hours_sum().alias("hours")))


def events_by_year(enriched: DataFrame) -> DataFrame:
    """A9."""
    return (enriched.filter(F.col("year").isNotNull()).groupBy("year")
            .agg(F.count(F.lit(1)).alias("events")))


def type_breakdown(watch: DataFrame) -> DataFrame:
    """Events per entry type."""
    return watch.groupBy("type").agg(F.count(F.lit(1)).alias("events"))


def category_year_seconds(enriched: DataFrame) -> DataFrame:
    """Seconds per year and category: a few hundred rows, from one pass."""
    return enriched.groupBy("year", "category").agg(F.sum("duration_seconds").alias("duration_seconds"))


def category_groups(enriched: DataFrame, top: int = S.TOP_CATEGORIES) -> DataFrame:
    """Category -> slot (1..top by hours, top+1 = Other). One row per
    category, so the broadcast below is bounded by the dimension size."""
    return ranked_categories(category_hours(enriched)).select(
        "category", F.when(F.col("rank") <= top, F.col("rank")).otherwise(top + 1).alias("slot"))


def category_year_feed(enriched: DataFrame) -> DataFrame:
    """K7: hours per category and year, the long form of the pivot."""
    hours = F.coalesce(F.col("duration_seconds") / F.lit(3600.0), F.lit(0.0))
    return category_year_seconds(enriched).filter(F.col("year").isNotNull()).select("category", "year", hours.alias("hours"))


def category_year_slots(enriched: DataFrame, top: int = S.TOP_CATEGORIES) -> DataFrame:
    """A10/A11 without a driver round trip: year x (cat_1..cat_top, other),
    zero-filled; slot i is the i-th category by total hours."""
    cells = category_year_seconds(enriched)
    j = cells.join(F.broadcast(category_groups(cells, top)), "category", "left")
    aggs = [F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("duration_seconds"))) / F.lit(3600.0),
                       F.lit(0.0)).alias(f"cat_{i}") for i in range(1, top + 1)]
    aggs.append(F.coalesce(F.sum(F.when(F.col("slot") > top, F.col("duration_seconds")))
                           / F.lit(3600.0), F.lit(0.0)).alias("other"))
    return j.filter(F.col("year").isNotNull()).groupBy("year").agg(*aggs)


def category_year_pivot(enriched: DataFrame, top: int = S.TOP_CATEGORIES) -> DataFrame:
    """A10/A11 with real column names: top categories in order, then 'Other'
    only when some category falls outside the top. Collects at most top+1
    names (one row per category) to name the columns."""
    slots = category_groups(category_year_seconds(enriched), top).orderBy("slot").collect()
    names = [r["category"] for r in slots if r["slot"] <= top]
    has_other = any(r["slot"] > top for r in slots)
    wide = category_year_slots(enriched, top)
    cols = [F.col("year")] + [F.col(f"cat_{i + 1}").alias(n) for i, n in enumerate(names)]
    if has_other:
        cols.append(F.col("other").alias("Other"))
    return wide.select(*cols)


def ingest_summary(watch: DataFrame, ts: str = "timestamp") -> DataFrame:
    """A1 + A3 after parsing (per-type counts are type_breakdown)."""
    return watch.agg(F.count(F.lit(1)).alias("entries"), F.min(ts).alias("first_ts"),
                     F.max(ts).alias("last_ts"))


def head_sample(df: DataFrame, order_cols, n: int = 3) -> DataFrame:
    """T4: first n rows in a stated order (the limit is the feature)."""
    return df.orderBy(*order_cols).limit(n)
