"""Mergeable aggregates: reports from stored partial states (A1-A11, A17-A21,
A24).

A state table holds one row per key and period with sums, counts, least and
greatest times, and exact distinct sets as their members. States of two parts
of a history merge by adding rows, so new history costs its own rows only:
its states are appended and a report reads states, never old events.

* ``report_states``: (month, category, type) -> events, seconds, first and
  last time. A history of decades is a few ten thousand rows.
* ``channel_times``: (channel, time) -> watches; ``channel_videos``: the
  distinct (channel, video) pairs. Both are exact, so patterns from states
  equal patterns from events, the trend's midpoint included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.functions import columns as C
from viewlens.operators import evidence, reports

REPORT_KEYS = ["year", "month", "category", "type"]


def report_states(enriched: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per (year, month, category, type) of enriched events."""
    return enriched.groupBy(*REPORT_KEYS).agg(
        F.count(F.lit(1)).alias("events"), F.sum("duration_seconds").alias("duration_seconds"),
        F.count("duration_seconds").alias("with_duration"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def merged(states: DataFrame) -> DataFrame:
    """States of several parts as one row per key."""
    return states.groupBy(*REPORT_KEYS).agg(
        F.sum("events").alias("events"), F.sum("duration_seconds").alias("duration_seconds"),
        F.sum("with_duration").alias("with_duration"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def totals(states: DataFrame) -> DataFrame:
    """A1 A2 A3 A15 from states."""
    h = reports.hours_sum()
    return states.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), h.alias("total_hours"), (h / 24).alias("total_days"),
                      F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
                      F.coalesce(F.sum("with_duration"), F.lit(0)).alias("with_duration"))


def yearly(states: DataFrame) -> DataFrame:
    """A4 A5 A6 from states."""
    g = states.filter(F.col("year").isNotNull()).groupBy("year").agg(
        F.sum("events").alias("events"), reports.hours_sum().alias("hours"), F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last"))
    return reports.per_calendar_day(g)


def events_by_year(states: DataFrame) -> DataFrame:
    """A9 from states."""
    return states.filter(F.col("year").isNotNull()).groupBy("year").agg(F.sum("events").alias("events"))


def type_breakdown(states: DataFrame) -> DataFrame:
    """A12 from states."""
    return states.groupBy("type").agg(F.sum("events").alias("events"))


# Hours are sums of the states' sums: these reports read states as they are.
monthly_hours = reports.monthly_hours
category_hours = reports.category_hours
top_categories = reports.top_categories
category_year_slots = reports.category_year_slots


def channel_times(watch: DataFrame, channel: str = "channel_name", ts: str = "timestamp") -> DataFrame:
    """Watches per channel and time."""
    return watch.filter(F.col(channel).isNotNull()).groupBy(F.col(channel).alias("channel"), F.col(ts).alias("time")).agg(
        F.count(F.lit(1)).alias("watches"))


def channel_videos(watch: DataFrame, channel: str = "channel_name", video: str = "video_id") -> DataFrame:
    """The distinct videos of each channel, as pairs."""
    return watch.filter(F.col(channel).isNotNull() & F.col(video).isNotNull()).select(
        F.col(channel).alias("channel"), F.col(video).alias("video")).distinct()


def channel_patterns(times: DataFrame, videos: DataFrame) -> DataFrame:
    """A17-A21 from the states of any number of parts."""
    unique = videos.distinct().groupBy("channel").agg(F.count(F.lit(1)).alias("unique_videos"))
    return evidence.channel_patterns(times, channel="channel", ts="time", weight="watches", unique=unique)


def category_watches(watches: DataFrame, categories: DataFrame, key: str = "video_id") -> DataFrame:
    """A24 from (video, watches) states: watches and distinct videos watched
    per category."""
    per = watches.groupBy(key).agg(F.sum("watches").alias("watches"))
    return (per.join(categories, key).groupBy("category_id")
            .agg(F.sum("watches").alias("total_watches"), F.count(F.lit(1)).alias("unique_videos"))
            .select("category_id", C.category_name("category_id", default=None).alias("category_name"), "total_watches", "unique_videos"))
