"""Reports from stored states equal reports from all events, however the
history is cut into parts."""

import random
from functools import reduce

from pyspark.sql import functions as F

from viewlens.operators import evidence, history, reports, states


def events(spark):
    rng = random.Random(4)
    base = 1_500_000_000
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([f"v{rng.randrange(30)}", None]),
             rng.choice([None, base + rng.randrange(90_000_000), base + 86_400 * rng.randrange(40)]), rng.choice(["normal", "ad", None]))
            for _ in range(1500)]
    rows += [("single", "v1", base, "ad"), ("short", "v1", base, "ad"), ("short", "v2", base + 86_400 * 10, "ad"), ("untimed", "v1", None, "ad")]
    watch = spark.createDataFrame(rows, "channel_name string, video_id string, s long, type string").withColumn(
        "timestamp", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    meta = spark.createDataFrame([(f"v{i}", None if i % 7 == 0 else i * 60, str(i % 12)) for i in range(25)],
                                 "video_id string, duration_seconds long, category_id string")
    return history.watch_enriched(watch, meta)


def parts(df, n):
    cut = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return [df.filter(cut == i) for i in range(n)]


def grown(df, build, n=3):
    return reduce(lambda x, y: x.unionByName(y), [build(p) for p in parts(df, n)])


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_report_states(spark):
    e = events(spark)
    s = grown(e, states.report_states)
    assert s.count() < e.count()
    for stored in (s, states.merged(s), states.merged(states.merged(s).unionByName(s.limit(0)))):
        assert rows(states.totals(stored)) == rows(reports.totals(e))
        assert rows(states.yearly(stored)) == rows(reports.yearly(e))
        assert rows(states.events_by_year(stored)) == rows(reports.events_by_year(e))
        assert rows(states.type_breakdown(stored)) == rows(reports.type_breakdown(e))
        assert rows(states.monthly_hours(stored)) == rows(reports.monthly_hours(e))
        assert rows(states.top_categories(stored)) == rows(reports.top_categories(e))
        assert rows(states.category_year_slots(stored)) == rows(reports.category_year_slots(e))


def test_channel_states(spark):
    e = events(spark)
    got = states.channel_patterns(grown(e, states.channel_times), grown(e, states.channel_videos))
    want = evidence.channel_patterns(e)
    assert rows(got) == rows(want)
    assert {r.engagement_trend for r in want.collect()} >= {"insufficient_data"}


def test_category_watches(spark):
    e = events(spark)
    meta = e.select("video_id", "category_id", F.lit(1).alias("view_count"), F.lit(1).alias("like_count")).filter("category_id is not null").distinct()
    per = grown(e.filter("video_id is not null"), lambda p: p.groupBy("video_id").agg(F.count(F.lit(1)).alias("watches")))
    got = states.category_watches(per, evidence.video_categories(meta))
    want = evidence.category_context(e, meta).select(*got.columns)
    assert rows(got) == rows(want)


def test_empty_states(spark):
    e = events(spark).limit(0)
    s = states.report_states(e)
    assert rows(states.totals(s)) == rows(reports.totals(e))
    assert states.yearly(s).count() == 0
    assert states.channel_patterns(states.channel_times(e), states.channel_videos(e)).count() == 0
