"""Every registered query against its DuckDB twin at sf0.01 (the driver's gate)."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, rows_of
from tests.conftest import SF001, SF0001

from viewlens.plans import catalog

catalog.load_all()
QUERIES = {k: v for k, v in E.queries().items() if k in catalog.QUERIES}
ORACLE = catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows_of(cols, res.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["year", "events", "hours", "cal_days", "hours_per_day"]
    assert SF0001


SENSITIVE = ["engagement_metrics", "view_percentile", "category_context", "transcripts", "seeded_sample",
             "priority_sample", "first_per_key", "trace_summary", "category_top_channels", "score_summary"]


@pytest.mark.parametrize("name", SENSITIVE)
def test_results_do_not_depend_on_partitioning(spark, duck, name):
    """Same rows with AQE off, sort-merge joins only and an odd partition count."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "37",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = QUERIES[name](spark, SF001)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    res = duck.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())
