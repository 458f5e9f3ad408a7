"""Properties: invariants across queries on the
driver tables, and round trips over generated values (one Spark job per
generated batch)."""

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from viewlens.functions import columns as C
from viewlens.operators import lookup as L, sampling as SM
from viewlens.plans import standins as V

Q = E.queries()


def one(df):
    return df.collect()[0]


def test_yearly_events_and_hours_add_up(spark):
    total = one(Q["watch_totals"](spark, SF001))
    yearly = Q["yearly_report"](spark, SF001).agg(F.sum("events").alias("e"), F.sum("hours").alias("h"))
    y = one(yearly)
    null_year = Q["watch_enriched"](spark, SF001).filter(F.col("year").isNull()).count()
    assert y.e + null_year == total.events
    assert abs(y.h - total.total_hours) < 1e-6
    m = Q["category_year_matrix"](spark, SF001)
    cells = sum(F.col(c) for c in m.columns if c != "year")
    assert abs(one(m.agg(F.sum(cells).alias("s"))).s - y.h) < 1e-6


SETTINGS = settings(max_examples=5, deadline=None)


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=10**6), min_size=1, max_size=200))
def test_duration_iso_round_trip(spark, secs):
    df = spark.createDataFrame([(s, f"PT{s // 3600}H{s // 60 % 60}M{s % 60}S") for s in secs], "s long, iso string")
    assert df.filter(C.iso_duration_seconds("iso") != F.col("s")).count() == 0


@SETTINGS
@given(st.lists(st.datetimes(min_value=dt.datetime(2005, 1, 1), max_value=dt.datetime(2030, 12, 31)),
                min_size=1, max_size=200))
def test_export_timestamp_round_trip(spark, stamps):
    stamps = [s.replace(microsecond=0) for s in stamps]
    text = [s.strftime("%b %-d, %Y, %-I:%M:%S") + " " + s.strftime("%p") + " EST" for s in stamps]
    df = spark.createDataFrame(list(zip(stamps, text)), "ts timestamp_ntz, t string")
    assert df.filter(~C.parse_export_timestamp("t").eqNullSafe(F.col("ts"))).count() == 0


@SETTINGS
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=100))
def test_clamp_is_idempotent(spark, xs):
    def clamp(c):
        return F.least(F.lit(5), F.greatest(F.lit(1), c))
    df = spark.createDataFrame([(x,) for x in xs], "x long").select(clamp(F.col("x")).alias("c"))
    assert df.filter(clamp(F.col("c")) != F.col("c")).count() == 0
    assert df.filter((F.col("c") < 1) | (F.col("c") > 5)).count() == 0


@SETTINGS
@given(st.integers(min_value=0, max_value=300), st.integers(min_value=1, max_value=9))
def test_sample_size_subset_and_stable(spark, n, parts):
    ids = spark.range(250).select(F.col("id").cast("string").alias("video_id"))
    a = {r[0] for r in SM.seeded(ids, n).collect()}
    b = {r[0] for r in SM.seeded(ids.repartition(parts), n).collect()}
    assert len(a) == (min(n, 250) if n else 250)
    assert a == b and a <= {str(i) for i in range(250)}


def test_pending_and_known_partition_the_ids(spark):
    watch = V.watch(spark, SF001)
    known = watch.filter(F.year("timestamp") == 1995).select("video_id").distinct()
    pending = L.pending_ids(watch, known)
    all_ids = L.distinct_ids(watch)
    assert pending.join(known, "video_id").count() == 0
    assert pending.unionByName(known).distinct().count() == all_ids.count()


def test_percentiles_bounded_and_monotone(spark):
    m = Q["engagement_metrics"](spark, SF001).filter(F.col("view_percentile").isNotNull())
    rows = sorted((r.views, r.view_percentile) for r in m.select("views", "view_percentile").collect())
    assert rows and all(0.0 <= p < 100.0 for _, p in rows)
    assert all(p1 <= p2 for (_, p1), (_, p2) in zip(rows, rows[1:]))
    assert all(p1 == p2 for (v1, p1), (v2, p2) in zip(rows, rows[1:]) if v1 == v2)
