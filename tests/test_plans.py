"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

QUERIES = E.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_row_at_a_time_python(spark, name):
    p = plan(QUERIES[name](spark, SF001))
    assert "BatchEvalPython" not in p  # only Arrow-batched Python (ArrowEvalPython / MapInPandas)


def window_specs(text):
    """(line, partitioned?) for every Window node of a plan string."""
    out = []
    for line in text.split("\n"):
        if "Window [" not in line:
            continue
        for spec in line.split("windowspecdefinition(")[1:]:
            first = spec.split(",")[0]
            out.append((line, not (" ASC" in first or " DESC" in first)))
    return out


@pytest.mark.parametrize("name", ["engagement_metrics", "engagement_lookup", "view_percentile",
                                  "category_context", "transcripts"])
def test_no_unpartitioned_window_over_data(spark, name):
    """The only window without a partition key runs over the bucket totals
    (at most `buckets` rows); every window over data rows is partitioned."""
    specs = window_specs(plan(QUERIES[name](spark, SF001)))
    assert specs
    for line, partitioned in specs:
        assert partitioned or "_bcnt" in line, line


def test_traces_need_no_window(spark):
    """The replay is one aggregate and a fold: nothing is ranked or joined."""
    p = plan(QUERIES["trace_summary"](spark, SF001))
    assert "Window" not in p and "Join" not in p and p.count("Exchange") == 1


@pytest.mark.parametrize("name", ["seeded_sample", "priority_sample", "pool_union", "plain_sample"])
def test_samples_gather_in_no_task(spark, name):
    """The draw is ranked in buckets: no top-k merge and no global sort."""
    p = plan(QUERIES[name](spark, SF001))
    assert "TakeOrderedAndProject" not in p and "GlobalLimit" not in p
    assert "rangepartitioning" not in p


def test_global_ranks_join_no_cross_product(spark):
    """Table-wide bounds and totals are scalar subqueries, not joins."""
    for name in ["view_percentile", "engagement_metrics", "score_summary"]:
        p = plan(QUERIES[name](spark, SF001))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_category_lookup_is_not_a_join(spark):
    p = plan(QUERIES["watch_enriched"](spark, SF001))
    assert p.count("Join") == 1  # the metadata join only; names come from a literal map


def test_scan_pruning_and_pushdown(spark):
    from pyspark.sql import functions as F
    from viewlens.plans import standins as V
    w = V.watch(spark, SF001).filter(F.col("type") == "R").select("video_id")
    p = plan(w)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in p
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in p


def test_top_channels_uses_group_limit(spark):
    p = plan(QUERIES["category_top_channels"](spark, SF001))
    assert "WindowGroupLimit" in p


def test_sized_conf_scales_with_input(spark):
    from viewlens.session import input_bytes, sized_conf
    small = sized_conf(10 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "24"  # floor: 3 per core
    mid = sized_conf(4 * (1 << 40), 8000)  # 4 TB: 1 TB of shuffle / 256 MB
    assert mid["spark.sql.shuffle.partitions"] == "24000"  # floor: 3 per core
    mid = sized_conf(40 * (1 << 40), 8000)
    assert mid["spark.sql.shuffle.partitions"] == "40960"
    big = sized_conf(100 * (1 << 40), 8000)  # 100 TB on 1000 x 8 cores: capped
    assert big["spark.sql.shuffle.partitions"] == "65536"
    assert int(big["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]) == 4 * (256 << 20)
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    assert input_bytes(li) > 0


def test_grouped_bounds_join_is_broadcast_at_runtime(spark):
    """Few groups (categories): AQE turns the (group) join of the distinct
    values with their bucket bounds into a broadcast, so a hot category's
    values are never gathered by one task on the group key."""
    df = QUERIES["category_context"](spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    p = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in p.split("\n") if "Join [category_id" in line and "_m#" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins), joins
