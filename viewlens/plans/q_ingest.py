"""Ingestion, lookup and storage queries (S1-S14, K1-K7, P1-P15, J2, J8, U2-U4,
A13, A14, A16, I1, I2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.functions import columns as C
from viewlens.operators import ingest as G
from viewlens.operators import lookup as L
from viewlens.operators import reports
from viewlens.plans import standins as V
from viewlens.plans.catalog import register, with_ctes
from viewlens.session import scratch_path
from viewlens.sources import io

NNBSP = " "

# --- export blocks built from conversations ------------------------------------
# One entry per turn: title = the turn text (+ an escaped '&' on user turns),
# user turns link a channel, assistant turns link a handle (removed), system
# turns have no second link and even ones carry the ad marker.


def export_blocks(spark, base):
    c = io.read_table(spark, base, "conversations")
    role, turn, cid = F.col("role"), F.col("turn"), F.col("conv_id")
    ts = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (cid % 28 + 1).cast("int"), (turn % 24).cast("int"),
                              ((cid * 7 + turn) % 60).cast("int"), (turn % 60).cast("int"))
    c = c.select(cid.alias("conv_id"), turn.alias("turn"), role.alias("role"), F.col("text"), ts.alias("ts"))
    role, turn, cid = F.col("role"), F.col("turn"), F.col("conv_id")
    sep = F.when(turn % 2 == 1, F.lit(NNBSP)).otherwise(F.lit(" "))
    when_text = F.concat(F.date_format("ts", "MMM d, yyyy, h:mm:ss"), sep, F.date_format("ts", "a"),
                         F.lit(" EST"))
    title = F.concat(F.col("text"), F.when(role == "user", F.lit(" &amp; more")).otherwise(F.lit("")))
    second = (F.when(role == "user", F.concat(
        F.lit('<a href="https://www.youtube.com/channel/UC'), role, F.lit('">'), role,
        F.lit(" &amp; co</a><br>")))
        .when(role == "assistant", F.lit('<a href="https://www.youtube.com/@assistant">assistant</a><br>'))
        .otherwise(F.lit("")))
    ad = F.when((role == "system") & (turn % 2 == 0), F.lit(S.AD_MARKER)).otherwise(F.lit(""))
    block = F.concat(
        F.lit(' mdl-cell"><div class="mdl-grid"><div ' + S.CONTENT_CELL_OPEN + 'Watched <a href="https://www.youtube.com/watch?v=c'),
        cid.cast("string"), F.lit('">'), title, F.lit("</a><br>"), second, when_text,
        F.lit('<br></div><div class="content-cell mdl-cell">'), ad, F.lit("</div></div></div><div "))
    head = spark.range(1).select(F.lit("<html><head><style>.x{}</style></head><body><div ").alias("block"))
    return head.unionByName(c.select(block.alias("block")))


EXPORT_SQL = """SELECT 'c' || CAST(conv_id AS VARCHAR) AS video_id,
  regexp_replace(replace(text || CASE WHEN role = 'user' THEN ' & more' ELSE '' END, chr(10), ' '),
    '^\\s+|\\s+$', '', 'g') AS title,
  CASE WHEN role = 'user' THEN 'user & co' END AS channel_name,
  CASE WHEN role = 'user' THEN 'normal' WHEN role = 'system' AND turn % 2 = 0 THEN 'ad' ELSE 'removed' END AS type,
  make_timestamp(2024, 1, CAST(conv_id % 28 + 1 AS BIGINT), CAST(turn % 24 AS BIGINT),
    CAST((conv_id * 7 + turn) % 60 AS BIGINT), CAST(turn % 60 AS DOUBLE)) AS "timestamp"
  FROM conversations"""


@register("export_scan", EXPORT_SQL)
def q_export_scan(spark, base):
    """S1 + P1-P11 + K1: blocks written with the entry separator, scanned back
    with the text source, parsed, and stored partitioned by year."""
    raw = scratch_path(spark, "export")
    io.write_blocks(export_blocks(spark, base), raw)
    parsed = G.parse_blocks(io.read_export(spark, raw))
    out = scratch_path(spark, "watch")
    io.overwrite(parsed.withColumn("year", F.year("timestamp")), out, partition_by=["year"])
    w = spark.read.parquet(out)
    return w.select("video_id", "title", "channel_name", "type", "timestamp")


# --- pages ---------------------------------------------------------------------

@register("page_links", """SELECT page_id, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS pos,
  unnest(h) AS href, unnest(t) AS text FROM (
  SELECT page_id, regexp_extract_all(html, '""" + S.LINK_RE + """', 1) AS h,
    regexp_extract_all(html, '""" + S.LINK_RE + """', 2) AS t FROM pages) WHERE len(h) > 0""")
def q_page_links(spark, base):
    """P2 + P3: every anchor of every page, in order."""
    p = io.read_table(spark, base, "pages").select("page_id", F.col("html").alias("body"))
    lk = G.links(p).filter(F.size("hrefs") > 0)
    z = lk.select("page_id", F.posexplode(F.arrays_zip("hrefs", "texts")).alias("pos", "l"))
    return z.select("page_id", (F.col("pos") + 1).alias("pos"), F.col("l.hrefs").alias("href"),
                    F.col("l.texts").alias("text"))


@register("entry_types", """SELECT page_id, len(h) AS n_links,
  CASE WHEN len(h) >= 2 AND contains(h[2], '/th') THEN 'normal'
       WHEN contains(html, '<!-- ad') THEN 'ad' ELSE 'removed' END AS type
  FROM (SELECT page_id, html, regexp_extract_all(html, '""" + S.LINK_RE + """', 1) AS h FROM pages)""")
def q_entry_types(spark, base):
    """P9 + P10 with page markers: second link '/th...' = channel, ad comment = ad."""
    p = io.read_table(spark, base, "pages").select("page_id", "html")
    lk = G.links(p, "html")
    return lk.select("page_id", F.size("hrefs").cast("long").alias("n_links"),
                     G.entry_type("hrefs", "html", channel_marker="/th", ad_marker="<!-- ad").alias("type"))


def _param_sql(name):
    q = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
    hit = f"list_filter(string_split({q}, '&'), lambda x: starts_with(x, '{name}=') AND length(x) > {len(name) + 1})[1]"
    raw = f"substr({hit}, {len(name) + 2})"
    return f"url_decode(replace({raw}, '+', ' ')) AS {name}"


@register("url_param", f"""SELECT page_id, {_param_sql('v')}, {_param_sql('page')}, {_param_sql('utm_source')},
  {_param_sql('ref')} FROM pages""")
def q_url_param(spark, base):
    """First non-blank query parameter, decoded, fragment excluded."""
    p = io.read_table(spark, base, "pages").select("page_id", "url")
    return p.select("page_id", *[C.query_param("url", n).alias(n) for n in ("v", "page", "utm_source", "ref")])


@register("title_clean", """SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(
  regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'),
  '&amp;', '&'), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS title FROM pages""")
def q_title_clean(spark, base):
    """Page titles unescaped, newlines folded, stripped (Arrow UDF only on '&' rows)."""
    p = io.read_table(spark, base, "pages").select("page_id", G.html_title("html").alias("_t"))
    return p.select("page_id", C.clean_title("_t").alias("title"))


# --- time, duration, display ------------------------------------------------------

@register("timestamp_parse", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
  ELSE date_trunc('second', ts) END AS parsed FROM events""")
def q_timestamp_parse(spark, base):
    """Export time text (U+202F on clicks, 'GMT+1' on views, a 7-letter
    zone on errors) found in a cell, zone dropped, parsed to wall clock."""
    e = io.read_table(spark, base, "events")
    et = F.col("event_type")
    sep = F.when(et == "click", F.lit(NNBSP)).otherwise(F.lit(" "))
    zone = F.when(et == "error", "UTCXYZW").when(et == "view", "GMT+1").otherwise("EST")
    body = F.concat(F.lit("Watched <a href=\"x\">y</a><br>"), F.date_format("ts", "MMM d, yyyy, h:mm:ss"), sep,
                    F.date_format("ts", "a"), F.lit(" "), zone, F.lit("<br>"))
    cell = e.select("event_id", body.alias("body"))
    t = cell.select("event_id", C.export_timestamp_text("body").alias("t"))
    return t.select("event_id", C.parse_export_timestamp("t").alias("parsed"))


@register("duration_parse", """SELECT p_partkey AS video_id, iso, CASE p_type
  WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 0 WHEN 'LARGE' THEN p_size * 60
  ELSE (p_size * 97) // 3600 * 3600 + ((p_size * 97) // 60) % 60 * 60 + (p_size * 97) % 60 END AS seconds
  FROM (SELECT *, CASE p_type WHEN 'PROMO' THEN 'P1DT2H' WHEN 'SMALL' THEN '' WHEN 'MEDIUM' THEN 'PT'
    || CAST(p_size AS VARCHAR) || '.5S' WHEN 'LARGE' THEN 'PT' || CAST(p_size AS VARCHAR) || 'M'
    ELSE 'PT' || CAST((p_size * 97) // 3600 AS VARCHAR) || 'H' || CAST(((p_size * 97) // 60) % 60 AS VARCHAR)
      || 'M' || CAST((p_size * 97) % 60 AS VARCHAR) || 'S' END AS iso FROM part)""")
def q_duration_parse(spark, base):
    """ISO-8601 durations (with day parts, fractions and blanks -> 0)."""
    p = io.read_table(spark, base, "part")
    s = F.col("p_size") * 97
    iso = (F.when(F.col("p_type") == "PROMO", F.lit("P1DT2H"))
           .when(F.col("p_type") == "SMALL", F.lit(""))
           .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("PT"), F.col("p_size").cast("string"), F.lit(".5S")))
           .when(F.col("p_type") == "LARGE", F.concat(F.lit("PT"), F.col("p_size").cast("string"), F.lit("M")))
           .otherwise(F.concat(F.lit("PT"), F.floor(s / 3600).cast("string"), F.lit("H"),
                               (F.floor(s / 60) % 60).cast("string"), F.lit("M"), (s % 60).cast("string"),
                               F.lit("S"))))
    df = p.select(F.col("p_partkey").alias("video_id"), iso.alias("iso"))
    return df.select("video_id", "iso", C.iso_duration_seconds("iso").alias("seconds"))


@register("duration_display", """SELECT p_partkey AS video_id, d AS seconds, CASE WHEN d <= 0 THEN 'N/A'
  WHEN d // 3600 > 0 THEN printf('%dh%02dm%02ds', d // 3600, (d // 60) % 60, d % 60)
  ELSE printf('%dm%02ds', (d // 60) % 60, d % 60) END AS display,
  coalesce(format('{:,}', CAST(trunc(p_retailprice * 1000) AS BIGINT)), 'N/A') AS count_text
  FROM (SELECT p_partkey, p_retailprice, CAST(p_size AS BIGINT) * p_size * 37 - 100 AS d FROM part)""")
def q_duration_display(spark, base):
    """P33 + P32: duration text and thousands-separated counts."""
    p = io.read_table(spark, base, "part")
    d = (F.col("p_size").cast("long") * F.col("p_size") * 37 - 100)
    df = p.select(F.col("p_partkey").alias("video_id"), d.alias("seconds"), "p_retailprice")
    return df.select("video_id", "seconds", C.duration_text("seconds").alias("display"),
                     C.count_text(F.col("p_retailprice") * 1000).alias("count_text"))


# --- lookup -----------------------------------------------------------------------

def first_year_known(spark, base):
    """Keys stored by an earlier run that covered the first year of history."""
    w = V.watch(spark, base)
    return L.distinct_ids(w.filter(F.year("timestamp") == 1995))


KNOWN_SQL = with_ctes(V.WATCH_SQL, """ids AS (SELECT DISTINCT video_id FROM watch WHERE video_id IS NOT NULL)""",
                      """known AS (SELECT DISTINCT video_id FROM watch WHERE year("timestamp") = 1995)""",
                      """pend AS (SELECT video_id FROM ids WHERE video_id NOT IN (SELECT video_id FROM known))""")


@register("distinct_ids", KNOWN_SQL + "SELECT video_id FROM ids")
def q_distinct_ids(spark, base):
    """A13."""
    return L.distinct_ids(V.watch(spark, base))


@register("pending_ids", KNOWN_SQL + "SELECT video_id FROM pend")
def q_pending_ids(spark, base):
    """J2 + U2: ids not stored by the first-year run."""
    return L.pending_ids(V.watch(spark, base), first_year_known(spark, base))


@register("lookup_progress", KNOWN_SQL + """SELECT (SELECT count(*) FROM ids) AS total_ids,
  (SELECT count(*) FROM known) AS stored, (SELECT count(*) FROM pend) AS remaining,
  CAST(ceil((SELECT count(*) FROM pend) / 50) AS BIGINT) AS calls""")
def q_lookup_progress(spark, base):
    """A14 + A16."""
    return L.progress(V.watch(spark, base), first_year_known(spark, base))


@register("lookup_batch_count", KNOWN_SQL + """SELECT count(*) AS pending,
  CAST(ceil(count(*) / 50) AS BIGINT) AS calls FROM pend""")
def q_lookup_batch_count(spark, base):
    """Calls needed for the pending ids."""
    return L.call_count(L.pending_ids(V.watch(spark, base), first_year_known(spark, base)))


def part_response(spark, base):
    """One landed response per part; withdrawn (PROMO) parts come back empty."""
    p = io.read_table(spark, base, "part")
    gone = F.col("p_type") == V.WITHDRAWN_TYPE
    item = F.struct(
        F.col("p_partkey").cast("string").alias("id"),
        F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("channelTitle"),
                 F.concat(F.regexp_extract("p_brand", r"#(\d+)", 1), F.lit(".0")).alias("categoryId"),
                 F.split("p_name", " ").alias("tags")).alias("snippet"),
        F.struct(F.concat(F.lit("PT"), F.col("p_size").cast("string"), F.lit("M")).alias("duration")
                 ).alias("contentDetails"),
        F.struct((F.col("p_retailprice") * 100).cast("long").cast("string").alias("viewCount")
                 ).alias("statistics"))
    items = F.when(gone, F.array()).otherwise(F.array(item))
    return p.select(F.array(F.col("p_partkey").cast("string")).alias("requested"),
                    F.to_json(F.struct(items.alias("items"))).alias("response"))


FLAT_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_name AS api_title, p_brand AS api_channel_title,
  regexp_extract(p_brand, '#(\\d+)', 1) AS category_id, string_split(p_name, ' ') AS tags,
  'PT' || CAST(p_size AS VARCHAR) || 'M' AS duration_iso, CAST(p_size AS BIGINT) * 60 AS duration_seconds,
  CAST(p_retailprice * 100 AS BIGINT) AS view_count FROM part"""


@register("items_flatten", FLAT_SQL + " WHERE p_type <> 'PROMO'")
def q_items_flatten(spark, base):
    """S10 + P12-P14: landed response JSON flattened to metadata columns."""
    f = L.flatten_items(part_response(spark, base))
    return f.select("video_id", "api_title", "api_channel_title", "category_id", "tags", "duration_iso",
                    "duration_seconds", "view_count")


@register("lookup_result", """SELECT CAST(p_partkey AS VARCHAR) AS video_id,
  CASE WHEN p_type = 'PROMO' THEN '[unavailable]' ELSE p_name END AS api_title,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE regexp_extract(p_brand, '#(\\d+)', 1) END AS category_id,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS BIGINT) * 60 END AS duration_seconds FROM part""")
def q_lookup_result(spark, base):
    """J8 + P15 + U3: returned items plus sentinel rows for ids not returned."""
    r = L.resolve(part_response(spark, base))
    return r.select("video_id", "api_title", "category_id", "duration_seconds")


def part_answers(spark, base):
    """What a metadata service would hold: the item of each part that is not
    withdrawn."""
    r = part_response(spark, base)
    item = F.from_json("response", S.RESPONSE)["items"]
    return r.select(F.col("requested")[0].alias("video_id"), F.explode(item).alias("item"))


LOOKUP_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS video_id,
  CASE WHEN p_type = 'PROMO' THEN '[unavailable]' ELSE p_name END AS api_title,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE regexp_extract(p_brand, '#(\\d+)', 1) END AS category_id,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS BIGINT) * 60 END AS duration_seconds,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_retailprice * 100 AS BIGINT) END AS view_count
  FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)"""


def lookup_cols(df):
    return df.select("video_id", "api_title", "category_id", "duration_seconds", "view_count")


def watched_ids(spark, base):
    return V.watch(spark, base).select(F.col("video_id").cast("string").alias("video_id"))


BATCH_SQL = """n AS (SELECT video_id, row_number() OVER (ORDER BY md5(CAST(video_id AS VARCHAR) || ':42'), video_id) - 1 AS i
  FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS video_id FROM lineitem WHERE l_partkey IS NOT NULL))"""


@register("lookup_batches", with_ctes(BATCH_SQL) + """SELECT video_id, i // 50 AS batch,
  CAST(i % 50 AS INTEGER) AS position FROM n""")
def q_lookup_batches(spark, base):
    """Every distinct watched id with its call and place in it."""
    return L.batch_numbers(L.distinct_ids(watched_ids(spark, base)))


@register("batched_lookup", LOOKUP_SQL)
def q_batched_lookup(spark, base):
    """S9 + W5 + U3: every distinct watched id asked for in calls of 50; the
    answers are the items of ``part``."""
    path = scratch_path(spark, "landed")
    batches = L.batch_numbers(L.distinct_ids(watched_ids(spark, base)))
    L.answered(batches, part_answers(spark, base)).write.parquet(path)
    return lookup_cols(L.resolve_calls(spark.read.parquet(path)))


@register("incremental_append", LOOKUP_SQL)
def q_incremental_append(spark, base):
    """K2-K5 + S5 + S14 + I1 + U4: run 1 has a quota of half its calls and
    keeps what landed; run 2 anti-joins the store and finishes. Every id ends
    in the store exactly once."""
    store = scratch_path(spark, "meta-store")
    answers = part_answers(spark, base)
    for run in (1, 2):
        known = io.read_keys(spark, store, schema=S.META)
        batches = L.batch_numbers(L.pending_ids(watched_ids(spark, base), known))
        if run == 1:
            calls = batches.agg(F.max("batch")).first()[0]
            batches = batches.filter(F.col("batch") <= F.lit(calls or 0) / 2)
        path = scratch_path(spark, "landed")
        L.answered(batches, answers).write.parquet(path)
        io.append(L.resolve_calls(spark.read.parquet(path)), store)
    io.require(spark, store, "lookup run wrote nothing")
    return lookup_cols(spark.read.parquet(store))


@register("latest_wins", with_ctes(V.SCORES_SQL) + """SELECT video_id, composite_score + 0.2 AS composite_score,
  2 AS run FROM scores""")
def q_latest_wins(spark, base):
    """The store holds two runs of every key; the newest row wins."""
    s = V.scores(spark, base).select("video_id", "composite_score")
    runs = s.withColumn("run", F.lit(1)).unionByName(
        s.withColumn("composite_score", F.col("composite_score") + 0.2).withColumn("run", F.lit(2)))
    path = scratch_path(spark, "runs")
    io.append(runs, path)
    return L.latest(spark.read.parquet(path), "video_id", "run")


@register("csv_roundtrip", """SELECT doc_id, md5(text) AS text_md5, length(text) AS text_chars,
  lang || '|' || source AS tags FROM documents""")
def q_csv_roundtrip(spark, base):
    """K6 + S2/S4: documents (newlines, quotes) through the CSV-compat sink
    and back with an explicit schema; arrays travel as '|'-joined text."""
    d = io.read_table(spark, base, "documents").select(
        "doc_id", "text", F.array("lang", "source").alias("tags"))
    path = scratch_path(spark, "csv")
    io.write_csv(d, path)
    back = io.read_csv(spark, path, "doc_id bigint, text string, tags string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_chars"),
                       "tags")


@register("chart_feeds", with_ctes(V.WATCH_SQL, V.META_SQL) + """, e AS (SELECT w.*, m.duration_seconds,
  CAST(date_trunc('month', w."timestamp") AS DATE) AS month, CAST(year(w."timestamp") AS INTEGER) AS year
  FROM watch w LEFT JOIN meta m USING (video_id))
  SELECT 'monthly_hours' AS feed, CAST(month AS VARCHAR) AS k,
    coalesce(CAST(sum(duration_seconds) AS DOUBLE) / 3600, 0.0) AS value FROM e GROUP BY month
  UNION ALL SELECT 'events_by_year', CAST(year AS VARCHAR), CAST(count(*) AS DOUBLE) FROM e GROUP BY year""")
def q_chart_feeds(spark, base):
    """K7: chart tables written as Parquet and read back as one feed table."""
    from viewlens.operators import history
    e = history.watch_enriched(V.watch(spark, base), V.meta(spark, base))
    p1, p2 = scratch_path(spark, "feed-month"), scratch_path(spark, "feed-year")
    io.overwrite(reports.monthly_hours(e), p1)
    io.overwrite(reports.events_by_year(e), p2)
    m = spark.read.parquet(p1).select(F.lit("monthly_hours").alias("feed"), F.col("month").cast("string").alias("k"),
                                      F.col("hours").alias("value"))
    y = spark.read.parquet(p2).select(F.lit("events_by_year").alias("feed"), F.col("year").cast("string").alias("k"),
                                      F.col("events").cast("double").alias("value"))
    return m.unionByName(y)


@register("stream_ingest", """SELECT CAST(p_partkey AS VARCHAR) AS video_id,
  CASE WHEN p_type = 'PROMO' THEN '[unavailable]' ELSE p_name END AS api_title,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE regexp_extract(p_brand, '#(\\d+)', 1) END AS category_id,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS BIGINT) * 60 END AS duration_seconds FROM part""")
def q_stream_ingest(spark, base):
    """I1 as a stream: responses land in two drops (small parts, then large
    ones, plus a replay of the first drop); each availableNow run appends
    only new ids, so the store ends with every part exactly once."""
    from viewlens.streaming import incremental as ST
    landing, store = scratch_path(spark, "landing"), scratch_path(spark, "stream-store")
    ckpt = scratch_path(spark, "stream-ckpt")
    resp = part_response(spark, base).withColumn("_size", F.col("requested")[0].cast("long"))
    sizes = io.read_table(spark, base, "part").select(F.col("p_partkey").alias("_size"), "p_size")
    resp = resp.join(sizes, "_size")
    first = resp.filter(F.col("p_size") <= 25)
    ST.land(first, landing)
    ST.ingest_landed(spark, landing, store, ckpt)
    ST.land(resp.filter(F.col("p_size") > 25), landing)
    ST.land(first, landing)  # the same responses landed again
    ST.ingest_landed(spark, landing, store, ckpt)
    return ST.store_rows(spark, store).select("video_id", "api_title", "category_id", "duration_seconds")


@register("category_year_feed", with_ctes(V.WATCH_SQL, V.META_SQL, V.category_values_sql()) + """SELECT
  coalesce(c.category_name, 'Unknown') AS category, CAST(year(w."timestamp") AS INTEGER) AS year,
  coalesce(CAST(sum(m.duration_seconds) AS DOUBLE) / 3600, 0.0) AS hours
  FROM watch w LEFT JOIN meta m USING (video_id) LEFT JOIN catdim c USING (category_id) GROUP BY 1, 2""")
def q_category_year_feed(spark, base):
    """K7 + A10: hours per category and year, written as a feed and read back."""
    from viewlens.operators import history
    path = scratch_path(spark, "feed-category-year")
    io.overwrite(reports.category_year_feed(history.watch_enriched(V.watch(spark, base), V.meta(spark, base))), path)
    return spark.read.parquet(path)


@register("csv_metadata_import", """SELECT CAST(p_partkey AS VARCHAR) AS video_id,
  CASE WHEN p_type = 'PROMO' THEN '[unavailable]' ELSE p_name END AS api_title,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE regexp_extract(p_brand, '#(\\d+)', 1) END AS category_id,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS BIGINT) * 60 END AS duration_seconds FROM part""")
def q_csv_metadata_import(spark, base):
    """S4 + K6: the metadata store through CSV and back with its own schema
    (array columns as '|'-joined text)."""
    path = scratch_path(spark, "meta-csv")
    io.write_csv(L.resolve(part_response(spark, base)), path)
    return io.read_csv(spark, path, S.META).select("video_id", "api_title", "category_id", "duration_seconds")


@register("watch_csv_import", with_ctes(V.WATCH_SQL) + """SELECT 'video "' || video_id || '"' || chr(10) || 'of ' || channel_name
    AS title, 'https://www.youtube.com/watch?v=' || video_id AS video_url, CAST(video_id AS VARCHAR) AS video_id,
  CAST(channel_name AS VARCHAR) AS channel_name, "timestamp", nullif(type, 'N') AS type, count(*) AS events
  FROM watch GROUP BY ALL""")
def q_watch_csv_import(spark, base):
    """S2 + K6: the watch history through CSV and back with its own schema
    (quotes and line breaks in titles, blanks for NULL)."""
    w = V.watch(spark, base)
    video, channel = F.col("video_id").cast("string"), F.col("channel_name").cast("string")
    rows = w.select(F.concat(F.lit('video "'), video, F.lit('"\nof '), channel).alias("title"),
                    F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("video_url"), video.alias("video_id"),
                    channel.alias("channel_name"), F.lit(None).cast("string").alias("channel_url"),
                    F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                    F.nullif("type", F.lit("N")).alias("type"))
    path = scratch_path(spark, "watch-csv")
    io.write_csv(rows, path)
    back = io.read_csv(spark, path, S.WATCH)
    return back.groupBy("title", "video_url", "video_id", "channel_name", "timestamp", "type").agg(
        F.count(F.lit(1)).alias("events"))
