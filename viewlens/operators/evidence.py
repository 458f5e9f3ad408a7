"""Evidence tables, computed for every key in one pass (A17-A26, W1-W6,
P20, P24, P25, X1-X4). A point lookup is a join of requested keys
against these tables, so asking about one key or a million costs the same
plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.functions import columns as C
from viewlens.operators import keyed
from viewlens.operators.history import ORDER, dedupe_first
from viewlens.operators.ranking import exact_medians, rank_below

# --- channel patterns (A17-A21) ---------------------------------------------


def channel_patterns(watch: DataFrame, channel: str = "channel_name", video: str = "video_id",
                     ts: str = "timestamp", weight: str | None = None, unique: DataFrame | None = None) -> DataFrame:
    """Per channel: totals, first/last watch, span, rate, rewatch ratio, trend.

    The profile is a partial aggregate, so a hot channel is combined
    map-side. The first-half count needs each channel's midpoint: whole days
    before it are counted from (channel, day) totals, and only the rows of
    the midpoint's own day meet it row by row, on (channel, day), so no join
    gathers a hot channel.

    Rows may stand for several watches (``weight``); the distinct videos then
    come as a table, ``unique(channel, unique_videos)``.
    """
    w = watch.filter(F.col(channel).isNotNull())
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    span = [F.sum(n).alias("total_watches"), F.min(ts).alias("first_watch"), F.max(ts).alias("last_watch")]
    if unique is None:
        prof = w.groupBy(channel).agg(F.count_distinct(video).alias("unique_videos"), *span)
    else:
        prof = w.groupBy(channel).agg(*span).join(unique.withColumnRenamed("channel", channel), channel, "left").withColumn(
            "unique_videos", F.coalesce("unique_videos", F.lit(0).cast("long")))
    prof = prof.withColumn("span_days", F.greatest(C.days_floor("first_watch", "last_watch"),
                                                   F.lit(1)).cast("long"))
    long_span = prof.filter(F.col("span_days") > S.TREND_MIN_SPAN_DAYS).select(
        channel, C.add_seconds("first_watch", F.col("span_days") * 43200).alias("_mid"))
    day = F.to_date(ts)
    daily = w.groupBy(channel, day.alias("_day")).agg(F.sum(n).alias("_n"))
    on_day = long_span.select(channel, F.to_date("_mid").alias("_day"), "_mid")
    before = daily.join(on_day.select(channel, F.col("_day").alias("_mid_day")), channel).select(
        channel, F.when(F.col("_day") < F.col("_mid_day"), F.col("_n")).otherwise(F.lit(0)).alias("_n"))
    same = (w.select(channel, ts, day.alias("_day"), n.alias("_w")).join(on_day, [channel, "_day"])
            .groupBy(channel).agg(F.sum(F.when(F.col(ts) < F.col("_mid"), F.col("_w")).otherwise(F.lit(0))).alias("_n")))
    halves = before.unionByName(same).groupBy(channel).agg(F.sum("_n").alias("_first_half"))
    p = prof.join(halves, channel, "left")
    first, total = F.col("_first_half"), F.col("total_watches")
    second = total - first
    f = S.TREND_FACTOR
    trend = (F.when(F.col("span_days") <= S.TREND_MIN_SPAN_DAYS, F.lit("insufficient_data"))
             .when(second > first * f, F.lit("increasing"))
             .when(first > second * f, F.lit("decreasing"))
             .otherwise(F.lit("stable")))
    return p.select(
        F.col(channel).alias("channel"), "total_watches", "unique_videos",
        F.when(F.col("unique_videos") > 0, C.round_ratio("total_watches", "unique_videos", 2))
        .otherwise(F.lit(0.0)).alias("rewatch_ratio"),
        "first_watch", "last_watch", "span_days",
        C.round_ratio(total * 30, F.col("span_days"), 1).alias("watches_per_month"),
        trend.alias("engagement_trend"))


def channel_lookup(patterns: DataFrame, requested: DataFrame, key: str = "channel") -> DataFrame:
    """P24 + P25: requested channels; unknown ones get total 0 and a note."""
    r = requested.select(F.col(key).alias("channel")).distinct()
    j = r.join(patterns.withColumn("_found", F.lit(True)), "channel", "left")
    return j.select(
        "channel", F.coalesce("total_watches", F.lit(0).cast("long")).alias("total_watches"),
        *[c for c in patterns.columns if c not in ("channel", "total_watches")],
        F.when(F.col("_found").isNull(), F.lit("Channel not found in watch history")).alias("note"))


def channels_asked(watch: DataFrame, requested: DataFrame, channel: str = "channel_name",
                   video: str = "video_id", ts: str = "timestamp") -> DataFrame:
    """P24 + P25 for ``requested(channel)``: only the history of these
    channels is aggregated (and of a few others, if many are asked: these go
    when the keys meet the patterns); the answer is that of
    ``channel_lookup`` over the patterns of all channels."""
    asked = requested.select(F.col("channel").alias(channel))
    mine = keyed.maybe_among(watch.select(video, channel, ts), asked, channel)
    return channel_lookup(channel_patterns(mine, channel, video, ts), requested)


# --- engagement (A22, A23, W1-W4) -------------------------------------------


def like_ratio(likes, views):
    """W2 population value: likes/views; +inf for likes/0; 0/0 and NULLs drop out."""
    likes, views = C.col(likes), C.col(views)
    return (F.when(views > 0, likes / views)
            .when((views == 0) & (likes > 0), F.lit(float("inf"))))


def engagement_metrics(meta: DataFrame, key: str = "video_id") -> DataFrame:
    """Per video: ratios, percentiles against the whole table, anomaly flag.

    Percentile = share of the population strictly below (x 100, 1 dp). The
    populations are every non-null view count (W1) and every defined like
    ratio (W2). Both are ranked in one ``rank_below`` pass over stacked
    (metric, value) rows (views as DOUBLE: exact below 2^53), so no step
    sorts the whole table in one task. Each video's two values then join
    their ranks on (metric, value); NULL values are dropped first, so they
    never pile into one join partition. The fold back per video reuses the
    dedupe's partitioning on the key.
    """
    ordered = [ORDER] if ORDER in meta.columns else []
    m = meta.select(key, *ordered, C.to_long("view_count").alias("views"),
                    C.to_long("like_count").alias("likes"),
                    C.to_long("comment_count").alias("comments"),
                    C.to_long("duration_seconds").alias("duration_seconds"))
    m = m.withColumn("_ratio", like_ratio("likes", "views"))

    def stacked(df, *keep):
        return df.select(*keep, F.inline(F.array(
            F.struct(F.lit(0).alias("_m"), F.col("views").cast("double").alias("_v")),
            F.struct(F.lit(1).alias("_m"), F.col("_ratio").alias("_v")))))

    ranks = rank_below(stacked(m), ["_v"], ["_m"], few_groups=True).select("_m", "_v", "_below", "_n")
    first = dedupe_first(m, key)  # W4: the first row of a video

    def pick(metric, c):
        return F.max(F.when(F.col("_m") == metric, F.col(c)))

    per_video = (stacked(first, key).filter(F.col("_v").isNotNull()).join(ranks, ["_m", "_v"])
                 .groupBy(key).agg(pick(0, "_below").alias("_vb"), pick(0, "_n").alias("_vn"),
                                   pick(1, "_below").alias("_lb"), pick(1, "_n").alias("_ln")))
    j = first.join(per_video, key, "left")
    has_views = F.col("views").isNotNull() & (F.col("views") > 0)
    has_ratio = has_views & F.col("likes").isNotNull()
    lb, ln = F.col("_lb"), F.col("_ln")
    flag = (F.when(lb * 100 > ln * S.HIGH_LIKE_PCT, F.lit("unusually_high_like_ratio"))
            .when(lb * 100 < ln * S.LOW_ENGAGEMENT_PCT, F.lit("unusually_low_engagement"))
            .otherwise(F.lit("none")))
    return j.select(
        key, F.lit("success").alias("status"),
        F.when(has_views, F.col("views")).alias("views"),
        F.when(has_ratio & (F.col("likes") != 0),
               C.round_ratio("likes", "views", 6)).alias("like_to_view_ratio"),
        F.when(has_views & F.col("comments").isNotNull() & (F.col("comments") != 0),
               C.round_ratio("comments", "views", 6)).alias("comment_to_view_ratio"),
        F.when(has_ratio, C.round_ratio(lb * 100, ln, 1)).alias("like_ratio_percentile"),
        F.when(has_ratio, flag).alias("anomaly_flag"),
        F.when(has_views, C.round_ratio(F.col("_vb") * 100, F.col("_vn"), 1)).alias("view_percentile"),
        F.when(~has_views | F.col("views").isNull(), F.lit("View count unavailable")).alias("note"),
        "duration_seconds",
        C.round_ratio("duration_seconds", F.lit(60), 1).alias("duration_minutes"))


def engagement_lookup(metrics: DataFrame, requested: DataFrame, key: str = "video_id") -> DataFrame:
    """P25: unknown ids -> status not_found."""
    r = requested.select(key).distinct()
    j = r.join(metrics, key, "left")
    return j.withColumn("status", F.coalesce("status", F.lit("not_found")))


# --- category context (J5-J7, A24-A26, P20, T3, W6) ---------------------------


def video_categories(meta: DataFrame, key: str = "video_id") -> DataFrame:
    """Distinct (video, category) pairs with a canonical id (TR13)."""
    return (meta.select(key, C.canonical_category("category_id").alias("category_id"))
            .filter(F.col("category_id").isNotNull()).distinct())


def category_context(watch: DataFrame, meta: DataFrame, key: str = "video_id",
                     approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Per category: name, watches, distinct videos watched, exact medians of
    views and likes over the category's videos (not watch-weighted),
    truncated to integers. Medians use the distributed exact rank.

    ``approx=True`` takes both medians from one ``percentile_approx``
    aggregate instead (partial sketches per task, no rank pass). The result
    is a value of the column within rank error n / ``accuracy``, not the mean
    of the two middle values."""
    vc = video_categories(meta, key)
    cw = (watch.select(key).join(vc, key)
          .groupBy("category_id").agg(F.count(F.lit(1)).alias("total_watches"),
                                      F.count_distinct(key).alias("unique_videos")))
    cm = meta.select(C.canonical_category("category_id").alias("category_id"),
                     C.to_long("view_count").alias("views"),
                     C.to_long("like_count").alias("likes")).filter(F.col("category_id").isNotNull())
    if approx:
        meds = cm.groupBy("category_id").agg(*[
            F.percentile_approx(c, 0.5, accuracy).cast("double").alias(f"median_{c}") for c in ("views", "likes")])
    else:
        # both medians from one rank pass (one row per category and metric)
        meds = exact_medians(cm, ["views", "likes"], ["category_id"])
    cats = cm.select("category_id").distinct()
    j = cats.join(cw, "category_id", "left").join(meds, "category_id", "left")
    return j.select(
        "category_id", C.category_name("category_id", default=None).alias("category_name"),
        F.coalesce("total_watches", F.lit(0).cast("long")).alias("total_watches"),
        "unique_videos",
        F.col("median_views").try_cast("bigint").alias("median_views"),
        F.col("median_likes").try_cast("bigint").alias("median_likes"))


def category_top_channels(watch: DataFrame, meta: DataFrame, key: str = "video_id",
                          channel: str = "channel_name", n: int = S.TOP_CHANNELS) -> DataFrame:
    """Top-n channels by watches per category (NULL channel excluded;
    ties by channel). ``row_number <= n`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so each task forwards at most n
    rows per category."""
    vc = video_categories(meta, key)
    counts = (watch.filter(F.col(channel).isNotNull()).select(key, channel).join(vc, key)
              .groupBy("category_id", channel).agg(F.count(F.lit(1)).alias("watches")))
    w = Window.partitionBy("category_id").orderBy(F.desc("watches"), F.col(channel))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumnRenamed(channel, "channel"))


def category_quality(meta: DataFrame, scores: DataFrame, key: str = "video_id") -> DataFrame:
    """A26 (long form): per category and label - scored_count, mean composite
    (2 dp, exact from hundredths) and label count."""
    vc = video_categories(meta, key)
    s = scores.select(key, "composite_score", "triage_label").join(vc, key)
    per_cat = s.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("scored_count"),
        F.sum(F.round(F.col("composite_score") * 100).cast("long")).alias("_c100"))
    per_cat = per_cat.select("category_id", "scored_count",
                             C.round_ratio("_c100", F.col("scored_count") * 100, 2).alias("avg_composite"))
    per_label = s.groupBy("category_id", "triage_label").agg(F.count(F.lit(1)).alias("label_count"))
    return per_cat.join(per_label, "category_id")


def category_quality_map(quality_long: DataFrame) -> DataFrame:
    """A26 as one row per category with a label -> count map (<= 4 entries)."""
    return quality_long.groupBy("category_id", "scored_count", "avg_composite").agg(
        F.map_from_entries(F.collect_list(F.struct("triage_label", "label_count")))
        .alias("label_distribution"))


def category_lookup(context: DataFrame, top_channels: DataFrame, requested: DataFrame,
                    quality: DataFrame | None = None) -> DataFrame:
    """P24 + P25 + S7: one record per requested category: its context, its top
    channels in rank order and its quality, or notes where a category is
    unknown or has no scores yet (``quality``, in long form, may be absent)."""
    r = requested.select("category_id").distinct()
    tops = top_channels.groupBy("category_id").agg(  # at most TOP_CHANNELS rows each
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel", "watches"))),
                    lambda t: F.struct(t["channel"].alias("channel"), t["watches"].alias("watches"))).alias("top_channels"))
    j = r.join(context.withColumn("_found", F.lit(True)), "category_id", "left").join(tops, "category_id", "left")
    if quality is None:
        j = j.select("*", F.lit(None).cast("long").alias("scored_count"), F.lit(None).cast("double").alias("avg_composite"),
                     F.lit(None).cast("map<string,long>").alias("label_distribution"))
    else:
        j = j.join(category_quality_map(quality), "category_id", "left")
    found = F.col("_found").isNotNull()
    return j.select(
        "category_id", "category_name", F.coalesce("total_watches", F.lit(0).cast("long")).alias("total_watches"),
        "unique_videos", "median_views", "median_likes", "top_channels", "scored_count", "avg_composite", "label_distribution",
        F.when(~found, F.lit("Category not found in metadata"))
        .when(F.col("scored_count").isNull(), F.lit("No quality scores available yet")).alias("note"))


def categories_asked(watch: DataFrame, meta: DataFrame, requested: DataFrame, scores: DataFrame | None = None,
                     scored_meta: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """P24 + P25 + S7 for ``requested(category_id)``: only the metadata of
    these categories, and the history of their videos, is read on; the
    answer is that of ``category_lookup`` over all categories.
    ``scored_meta`` (``meta`` if not given) holds the categories of scored
    videos."""
    asked = requested.select(F.col("category_id").alias("_asked"))

    def of_categories(m):
        return keyed.among(m.withColumn("_asked", C.canonical_category("category_id")), asked, "_asked").drop("_asked")

    mine = of_categories(meta)
    seen = keyed.among(watch, video_categories(mine, key), key)
    quality = None
    if scores is not None:
        quality = category_quality(mine if scored_meta is None else of_categories(scored_meta), scores, key)
    return category_lookup(category_context(seen, mine, key), category_top_channels(seen, mine, key), requested, quality)


# --- transcripts (X1-X4) -------------------------------------------------------


HEAD_PARTS = 32


def _heads(seg: DataFrame, key: str, seq: str, limit: int) -> DataFrame:
    """Within each task, the segments of a key that start within the first
    ``limit`` characters of what the task has of it. The rows are sorted in
    the task (no shuffle) and passed through in batches."""
    def run(batches):
        at, used = object(), 0  # no key yet
        for b in batches:
            keys, lengths, keep = b.column(key).to_pylist(), b.column("_l").to_pylist(), []
            for i, (k, n) in enumerate(zip(keys, lengths)):
                if k != at:
                    at, used = k, 0
                if used <= limit:
                    keep.append(i)
                used += n + 1
            yield b.take(pa.array(keep, pa.int64()))
    return seg.sortWithinPartitions(key, seq, "_t").mapInArrow(run, seg.schema)


def transcripts(segments: DataFrame, key: str = "video_id", seq: str = "seq", text: str = "text",
                limit: int = S.TRANSCRIPT_LIMIT) -> DataFrame:
    """Segments joined by one space in order; over ``limit`` characters the
    text is cut and '... [truncated, N chars total]' appended.

    The full length is a partial sum over every segment. Only a key's first
    segments can show, as each adds a character at least (its space), so each
    task first cuts its own segments of a key to the visible characters
    (``_heads``), before any shuffle; then a key's segments meet in
    HEAD_PARTS parts that are cut again, and at last in one window. No
    session setting matters, and however long a transcript is, a task gets at
    most HEAD_PARTS times ``limit`` characters of it in one place.
    """
    seg = segments.select(key, seq, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    full = seg.groupBy(key).agg((F.sum(F.length("_t") + 1) - 1).alias("full_length"))
    order = Window.partitionBy(key).orderBy(F.col(seq), "_t")
    seg = seg.select(key, seq, F.length("_t").alias("_l"), F.substring("_t", 1, limit + 1).alias("_t"))
    part = F.pmod(F.spark_partition_id(), F.lit(HEAD_PARTS)).alias("_part")
    r = _heads(_heads(seg.select("*", part), key, seq, limit).repartition(key, "_part"), key, seq, limit)
    r = r.drop("_part").withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= limit + 1)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_below", F.coalesce(F.sum(F.col("_l") + 1).over(upto), F.lit(0)))
    # a segment starting at offset `limit` still puts its leading space in the
    # prefix; each kept segment is trimmed to the characters that can fall
    # inside the first `limit`, so the collected text per key is bounded too
    visible = F.col("_t").substr(F.lit(1), (F.lit(limit) - F.col("_below")).cast("int"))
    head = (r.filter(F.col("_below") <= limit)
            .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_nth", visible.alias("_t")))).alias("_s")))
    joined = F.array_join(F.transform("_s", lambda x: x["_t"]), " ")
    out = head.join(full, key).select(key, "full_length", joined.alias("_j"))
    cut = F.when(F.col("full_length") > limit, F.concat(
        F.substring("_j", 1, limit), F.lit("... [truncated, "),
        F.col("full_length").cast("string"), F.lit(" chars total]"))).otherwise(F.col("_j"))
    return out.select(key, F.lit("success").alias("status"), "full_length",
                      F.length(cut).cast("long").alias("transcript_length"), cut.alias("transcript"))


def transcript_lookup(transcript_table: DataFrame, requested: DataFrame,
                      key: str = "video_id", failures: DataFrame | None = None) -> DataFrame:
    """X4 + S11: per requested id, success with the transcript, else error.
    ``failures(key, status, reason)`` names ids whose fetch failed, with
    status ``unavailable`` (no transcript exists) or ``error``, and why."""
    r = requested.select(key).distinct()
    j = r.join(transcript_table, key, "left")
    if failures is None:
        j = j.withColumn("_why", F.lit(None).cast("string")).withColumn("_how", F.lit(None).cast("string"))
    else:
        why = failures.groupBy(key).agg(F.min(F.struct("status", "reason")).alias("_f"))
        j = j.join(why.select(key, F.col("_f.status").alias("_how"), F.col("_f.reason").alias("_why")), key, "left")
    missing = F.col("status").isNull()
    return j.select(
        key, F.coalesce("status", "_how", F.lit("error")).alias("status"),
        "transcript_length", "transcript",
        F.when(missing, F.coalesce("_why", F.lit("no transcript segments"))).alias("reason"),
        F.when(missing, F.lit("Transcript unavailable; evaluate based on metadata")).alias("suggestion"))
