"""History queries: enrichment join and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewlens.functions import columns as C
from viewlens.operators import history, reports, states
from viewlens.plans import standins as V
from viewlens.plans.catalog import register, with_ctes
from viewlens.plans.q_evidence import CHANNEL_SQL
from viewlens.sources import io

HOURS = "coalesce(CAST(sum(duration_seconds) AS DOUBLE) / 3600, 0.0)"

ENRICHED_SQL = """enriched AS (SELECT w.video_id, w.channel_name, w."timestamp", w.type,
  m.duration_seconds, m.category_id, CAST(m.duration_seconds AS DOUBLE) / 3600 AS duration_hours,
  coalesce(c.category_name, 'Unknown') AS category, CAST(year(w."timestamp") AS INTEGER) AS year,
  CAST(date_trunc('month', w."timestamp") AS DATE) AS month
  FROM watch w LEFT JOIN meta m USING (video_id) LEFT JOIN catdim c ON m.category_id = c.category_id)"""

BASE = with_ctes(V.WATCH_SQL, V.META_SQL, V.category_values_sql(), ENRICHED_SQL)


def enriched(spark, base):
    meta = history.clean_metadata(V.meta(spark, base))
    return history.watch_enriched(V.watch(spark, base), meta)


@register("watch_enriched", BASE + """SELECT video_id, channel_name, "timestamp", type,
  duration_seconds, category_id, duration_hours, category, year, month FROM enriched""")
def q_watch_enriched(spark, base):
    return enriched(spark, base).select(
        "video_id", "channel_name", "timestamp", "type", "duration_seconds", "category_id",
        "duration_hours", "category", "year", "month")


@register("watch_totals", BASE + f"""SELECT count(*) AS events, {HOURS} AS total_hours,
  {HOURS} / 24 AS total_days, min("timestamp") AS first_ts, max("timestamp") AS last_ts,
  count(duration_seconds) AS with_duration FROM enriched""")
def q_watch_totals(spark, base):
    return reports.totals(enriched(spark, base))


YEARLY_SQL = BASE + f"""SELECT year, events, hours, cal_days, hours / cal_days AS hours_per_day FROM (
  SELECT year, count(*) AS events, {HOURS} AS hours,
    greatest(CAST(floor((epoch_us(least(max("timestamp"), make_timestamp(year, 12, 31, 0, 0, 0)))
      - epoch_us(greatest(min("timestamp"), make_timestamp(year, 1, 1, 0, 0, 0)))) / 86400000000) AS BIGINT) + 1, 1)
      AS cal_days
  FROM enriched WHERE year IS NOT NULL GROUP BY year)"""


@register("yearly_report", YEARLY_SQL)
def q_yearly_report(spark, base):
    return reports.yearly(enriched(spark, base))


@register("category_hours_top10", BASE + f"""SELECT category, hours, rank FROM (
  SELECT category, hours, row_number() OVER (ORDER BY hours DESC, category) AS rank FROM (
    SELECT category, {HOURS} AS hours FROM enriched GROUP BY category)) WHERE rank <= 10""")
def q_category_hours_top10(spark, base):
    return reports.top_categories(enriched(spark, base), 10).withColumn("rank", F.col("rank").cast("long"))


@register("monthly_hours", BASE + f"""SELECT month, {HOURS} AS hours FROM enriched
  WHERE month IS NOT NULL GROUP BY month""")
def q_monthly_hours(spark, base):
    return reports.monthly_hours(enriched(spark, base))


@register("events_by_year", BASE + """SELECT year, count(*) AS events FROM enriched
  WHERE year IS NOT NULL GROUP BY year""")
def q_events_by_year(spark, base):
    return reports.events_by_year(enriched(spark, base))


def _slot_sql(i, cond):
    return (f"coalesce(CAST(sum(CASE WHEN {cond} THEN duration_seconds END) AS DOUBLE) / 3600, 0.0)"
            f" AS {i}")


@register("category_year_matrix", BASE + f""", cat AS (SELECT category, {HOURS} AS hours FROM enriched GROUP BY category),
  slots AS (SELECT category, CASE WHEN rn <= 6 THEN rn ELSE 7 END AS slot FROM (
    SELECT category, row_number() OVER (ORDER BY hours DESC, category) AS rn FROM cat))
  SELECT year, {", ".join(_slot_sql(f"cat_{i}", f"slot = {i}") for i in range(1, 7))},
    {_slot_sql("other", "slot > 6")}
  FROM enriched LEFT JOIN slots USING (category) WHERE year IS NOT NULL GROUP BY year""")
def q_category_year_matrix(spark, base):
    return reports.category_year_slots(enriched(spark, base))


@register("type_breakdown", with_ctes(V.WATCH_SQL) + """SELECT type, count(*) AS events
  FROM watch GROUP BY type""")
def q_type_breakdown(spark, base):
    return reports.type_breakdown(V.watch(spark, base))


@register("head_sample", with_ctes(V.WATCH_SQL) + """SELECT video_id, channel_name, "timestamp", type
  FROM watch ORDER BY "timestamp", video_id, channel_name, type LIMIT 3""")
def q_head_sample(spark, base):
    return reports.head_sample(V.watch(spark, base),
                               ["timestamp", "video_id", "channel_name", "type"], 3)


FIRST_ORDER = ["l_orderkey", "l_linenumber", "channel_name", "timestamp"]


@register("first_per_key", """SELECT video_id, l_orderkey, l_linenumber, channel_name, "timestamp", type,
  l_quantity FROM (SELECT l_partkey AS video_id, l_orderkey, l_linenumber, l_suppkey AS channel_name,
    l_shipdate AS "timestamp", l_returnflag AS type, l_quantity, row_number() OVER (
      PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS rn
  FROM lineitem) WHERE rn = 1""")
def q_first_per_key(spark, base):
    """The first row per video in ingest order; (orderkey, linenumber)
    alone repeats in the driver data, so the whole tuple orders."""
    li = io.read_table(spark, base, "lineitem").select(
        F.col("l_partkey").alias("video_id"), "l_orderkey", "l_linenumber",
        F.col("l_suppkey").alias("channel_name"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("type"), "l_quantity")
    return history.dedupe_first(li, "video_id", FIRST_ORDER)


@register("dimension_scan", with_ctes(V.META_SQL, V.category_values_sql()) + """SELECT d.category_id,
  d.category_name, count(m.video_id) AS videos FROM catdim d LEFT JOIN meta m USING (category_id)
  GROUP BY d.category_id, d.category_name""")
def q_dimension_scan(spark, base):
    """S13 + P26: the category dimension with the videos that use each id."""
    from viewlens.operators import lookup as L
    m = V.meta(spark, base).select("video_id", "category_id")
    return L.category_dimension(spark).join(m, "category_id", "left").groupBy(
        "category_id", "category_name").agg(F.count("video_id").alias("videos"))


@register("category_normalise", with_ctes(V.category_values_sql()) + """SELECT p_partkey AS video_id,
  raw_id, CASE WHEN d = floor(d) THEN CAST(CAST(d AS BIGINT) AS VARCHAR) END AS category_id,
  coalesce(c.category_name, 'Unknown') AS category
  FROM (SELECT p_partkey, raw_id, TRY_CAST(raw_id AS DOUBLE) AS d FROM (
    SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN '' WHEN 'LARGE' THEN 'n/a'
      WHEN 'MEDIUM' THEN CAST(p_size AS VARCHAR) || '.5'
      ELSE CAST(p_size AS VARCHAR) || '.0' END AS raw_id FROM part)) x
  LEFT JOIN catdim c ON c.category_id = (CASE WHEN d = floor(d) THEN CAST(CAST(d AS BIGINT) AS VARCHAR) END)""")
def q_category_normalise(spark, base):
    """P16 + J7 + P19 on float-like, blank and bad id texts built from p_size."""
    p = io.read_table(spark, base, "part")
    raw = (F.when(F.col("p_type") == "SMALL", F.lit(""))
           .when(F.col("p_type") == "LARGE", F.lit("n/a"))
           .when(F.col("p_type") == "MEDIUM", F.concat(F.col("p_size").cast("string"), F.lit(".5")))
           .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0"))))
    df = p.select(F.col("p_partkey").alias("video_id"), raw.alias("raw_id"))
    df = df.withColumn("category_id", C.canonical_category("raw_id"))
    return df.withColumn("category", C.category_name("category_id"))


@register("numeric_coerce", """SELECT p_partkey AS video_id, raw, TRY_CAST(raw AS DOUBLE) AS value,
  p_partkey IS NOT NULL AS has_id FROM (
  SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN '' WHEN 'SMALL' THEN 'n/a'
    WHEN 'LARGE' THEN CAST(p_size AS VARCHAR) || '.25' ELSE CAST(p_size AS VARCHAR) END AS raw FROM part)""")
def q_numeric_coerce(spark, base):
    """P17 + P23: good, blank and bad number texts -> DOUBLE or NULL."""
    p = io.read_table(spark, base, "part")
    raw = (F.when(F.col("p_type") == "PROMO", F.lit(""))
           .when(F.col("p_type") == "SMALL", F.lit("n/a"))
           .when(F.col("p_type") == "LARGE", F.concat(F.col("p_size").cast("string"), F.lit(".25")))
           .otherwise(F.col("p_size").cast("string")))
    df = p.select(F.col("p_partkey").alias("video_id"), raw.alias("raw"))
    return df.select("video_id", "raw", C.to_double("raw").alias("value"),
                     F.col("video_id").isNotNull().alias("has_id"))


@register("category_year_named", BASE + f""", ranked AS (SELECT category, row_number() OVER (ORDER BY hours DESC, category) AS rn
    FROM (SELECT category, {HOURS} AS hours FROM enriched GROUP BY category)),
  cells AS (SELECT year, CASE WHEN rn <= 6 THEN category ELSE 'Other' END AS label, duration_seconds
    FROM enriched JOIN ranked USING (category) WHERE year IS NOT NULL)
  PIVOT cells ON label USING coalesce(CAST(sum(duration_seconds) AS DOUBLE) / 3600, 0.0) GROUP BY year""")
def q_category_year_named(spark, base):
    """A10 + A11 + P27: the pivot under the names of the top categories, in
    their order, and 'Other' where there are more."""
    return reports.category_year_pivot(enriched(spark, base))


# --- reports from stored states (A1-A11, A17-A21) --------------------------------

def grown(spark, base, build, name):
    """The state table after two parts of the history were added, the old
    years first, then the rest."""
    from viewlens.session import scratch_path
    path = scratch_path(spark, name)
    new = F.year("timestamp") >= 1998
    rows = enriched(spark, base)
    for part in (rows.filter(~new | F.col("timestamp").isNull()), rows.filter(new)):
        io.append(build(part), path)
    return spark.read.parquet(path)


@register("yearly_from_states", YEARLY_SQL)
def q_yearly_from_states(spark, base):
    """A4-A6 from the states of an old history plus a new part."""
    return states.yearly(grown(spark, base, states.report_states, "states"))


@register("reports_from_states", BASE + f"""SELECT 'total' AS report, 'all' AS key, {HOURS} AS hours, count(*) AS events FROM enriched
  UNION ALL SELECT 'month', CAST(month AS VARCHAR), {HOURS}, count(*) FROM enriched WHERE month IS NOT NULL GROUP BY month
  UNION ALL SELECT 'category', category, {HOURS}, count(*) FROM enriched GROUP BY category
  UNION ALL SELECT 'type', type, {HOURS}, count(*) FROM enriched GROUP BY type""")
def q_reports_from_states(spark, base):
    """A1 A2 A7 A8 A12 from merged states."""
    s = states.merged(grown(spark, base, states.report_states, "states"))

    def of(name, key, rows):
        return rows.groupBy(key.cast("string").alias("key")).agg(
            reports.hours_sum().alias("hours"), F.sum("events").alias("events")).select(F.lit(name).alias("report"), "key", "hours", "events")
    out = states.totals(s).select(F.lit("total").alias("report"), F.lit("all").alias("key"), F.col("total_hours").alias("hours"), "events")
    return (out.unionByName(of("month", F.col("month"), s.filter(F.col("month").isNotNull())))
            .unionByName(of("category", F.col("category"), s)).unionByName(of("type", F.col("type"), s)))


@register("channel_patterns_from_states", CHANNEL_SQL + "SELECT * FROM patterns")
def q_channel_patterns_from_states(spark, base):
    """A17-A21 from the states of an old history plus a new part."""
    return states.channel_patterns(grown(spark, base, states.channel_times, "times"), grown(spark, base, states.channel_videos, "videos"))
