"""Canonical views built from the driver's tables (Spark side + SQL twin).

The driver data holds no viewing history, so each operator runs on a
stand-in with the canonical column names:

* ``watch``: one row per lineitem - video_id = l_partkey, channel_name =
  l_suppkey, timestamp = l_shipdate, type = l_returnflag.
* ``meta``: one row per part - category_id = the brand number (so some ids
  fall outside the category dimension and report as Unknown); parts of type
  PROMO stand for withdrawn videos and carry the "[unavailable]" sentinel
  with blank fields, as the metadata store does for ids the service no
  longer returns.
* ``meta_stats``: meta plus engagement counts aggregated from lineitem
  (views = sum of quantities, likes = rows, comments = returned rows).
* ``scores``: one judgment per labelled document, dims derived from labels.

The SQL constants are the same views written for DuckDB (CTE bodies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.functions import columns as C
from viewlens.sources import io

WITHDRAWN_TYPE = "PROMO"


def watch(spark: SparkSession, base: str) -> DataFrame:
    li = io.read_table(spark, base, "lineitem")
    return li.select(F.col("l_partkey").alias("video_id"),
                     F.col("l_suppkey").alias("channel_name"),
                     F.col("l_shipdate").alias("timestamp"),
                     F.col("l_returnflag").alias("type"))


def meta(spark: SparkSession, base: str) -> DataFrame:
    p = io.read_table(spark, base, "part")
    gone = F.col("p_type") == WITHDRAWN_TYPE

    def keep(c):
        return F.when(~gone, c)

    return p.select(
        F.col("p_partkey").alias("video_id"),
        F.when(gone, F.lit(S.UNAVAILABLE_TITLE)).otherwise(F.col("p_name")).alias("api_title"),
        keep(F.col("p_brand")).alias("api_channel_title"),
        keep(F.regexp_extract("p_brand", r"#(\d+)", 1)).alias("category_id"),
        keep(F.col("p_size").cast("long") * 60).alias("duration_seconds"),
        keep(F.col("p_type")).alias("description"),
        keep(F.split(F.col("p_name"), " ")).alias("tags"),
    )


def lineitem_engagement(spark: SparkSession, base: str) -> DataFrame:
    li = io.read_table(spark, base, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("video_id")).agg(
        F.sum("l_quantity").cast("long").alias("views"),
        F.count(F.lit(1)).alias("likes"),
        F.count_if(F.col("l_returnflag") == "R").alias("comments"))


def meta_stats(spark: SparkSession, base: str) -> DataFrame:
    m = meta(spark, base)
    e = lineitem_engagement(spark, base)
    avail = F.col("api_title") != S.UNAVAILABLE_TITLE
    return (m.join(e, "video_id", "left")
            .withColumn("view_count", F.when(avail, F.col("views")))
            .withColumn("like_count", F.when(avail, F.col("likes")))
            .withColumn("comment_count", F.when(avail, F.col("comments")))
            .drop("views", "likes", "comments"))


def scores(spark: SparkSession, base: str) -> DataFrame:
    """Judgments: dims from (quality, toxic), composite and label as V5/V6."""
    lb = io.read_table(spark, base, "labels")
    q, t = F.col("quality"), F.col("toxic")
    dims = {
        "depth": (q * 3 + 1 + (F.col("doc_id") % 2)).cast("long"),
        "rigor": (q * 2 + 2 - t).cast("long"),
        "novelty": (F.col("doc_id") % 5 + 1).cast("long"),
        "effort": (q + 2).cast("long"),
        "engagement_quality": (5 - t * 3).cast("long"),
    }
    total = sum(dims.values(), F.lit(0))
    composite = F.round(total / F.lit(5.0), 2)
    return lb.select(F.col("doc_id").alias("video_id"), *[v.alias(k) for k, v in dims.items()],
                     composite.alias("composite_score"),
                     C.label_from_composite(composite).alias("triage_label"))


WATCH_SQL = """watch AS (SELECT l_partkey AS video_id, l_suppkey AS channel_name,
  l_shipdate AS "timestamp", l_returnflag AS type FROM lineitem)"""

META_SQL = """meta AS (SELECT p_partkey AS video_id,
  CASE WHEN p_type = 'PROMO' THEN '[unavailable]' ELSE p_name END AS api_title,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END AS api_channel_title,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE regexp_extract(p_brand, '#(\\d+)', 1) END AS category_id,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS BIGINT) * 60 END AS duration_seconds,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS description,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE string_split(p_name, ' ') END AS tags
  FROM part)"""

META_STATS_SQL = META_SQL + """,
eng AS (SELECT l_partkey AS video_id, CAST(sum(l_quantity) AS BIGINT) AS views,
  count(*) AS likes, count(*) FILTER (WHERE l_returnflag = 'R') AS comments
  FROM lineitem GROUP BY l_partkey),
meta_stats AS (SELECT m.*,
  CASE WHEN m.api_title <> '[unavailable]' THEN e.views END AS view_count,
  CASE WHEN m.api_title <> '[unavailable]' THEN e.likes END AS like_count,
  CASE WHEN m.api_title <> '[unavailable]' THEN e.comments END AS comment_count
  FROM meta m LEFT JOIN eng e USING (video_id))"""

SCORES_SQL = """scores_raw AS (SELECT doc_id AS video_id,
  CAST(quality * 3 + 1 + doc_id % 2 AS BIGINT) AS depth,
  CAST(quality * 2 + 2 - toxic AS BIGINT) AS rigor,
  CAST(doc_id % 5 + 1 AS BIGINT) AS novelty,
  CAST(quality + 2 AS BIGINT) AS effort,
  CAST(5 - toxic * 3 AS BIGINT) AS engagement_quality FROM labels),
scores AS (SELECT *, round((depth + rigor + novelty + effort + engagement_quality) / 5.0, 2) AS composite_score,
  CASE WHEN (depth + rigor + novelty + effort + engagement_quality) / 5.0 >= 4 THEN 'deep'
       WHEN (depth + rigor + novelty + effort + engagement_quality) / 5.0 >= 3 THEN 'useful'
       WHEN (depth + rigor + novelty + effort + engagement_quality) / 5.0 >= 2 THEN 'mixed'
       ELSE 'shallow' END AS triage_label FROM scores_raw)"""


def category_values_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in S.CATEGORIES)
    return f"catdim(category_id, category_name) AS (VALUES {rows})"
