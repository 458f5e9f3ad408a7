"""Keyed enrichment: S9, S10, P12-P15, J2, J8, U3, A13, A14, A16, W5, I1, I2."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from viewlens import schemas as S
from viewlens.functions import columns as C


class QuotaExceeded(Exception):
    """Raised by a fetch callable when the service refuses further calls."""


def category_dimension(spark: SparkSession) -> DataFrame:
    """The fixed category dimension as a 32-row DataFrame."""
    rows = [F.struct(F.lit(k).alias("category_id"), F.lit(v).alias("category_name"))
            for k, v in S.CATEGORIES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def distinct_ids(watch: DataFrame, key: str = "video_id") -> DataFrame:
    """Distinct non-null ids (partial aggregation; no driver set)."""
    return watch.select(key).filter(F.col(key).isNotNull()).distinct()


def pending_ids(watch: DataFrame, known: DataFrame, key: str = "video_id") -> DataFrame:
    """Ids seen in the history but not yet stored (anti-join)."""
    return distinct_ids(watch, key).join(known.select(key), key, "left_anti")


def progress(watch: DataFrame, known: DataFrame, key: str = "video_id") -> DataFrame:
    """A14 + A16: total distinct ids, stored keys, remaining ids and calls needed."""
    ids = distinct_ids(watch, key).withColumn("_w", F.lit(1))
    k = known.select(key).distinct().withColumn("_k", F.lit(1))
    j = ids.join(k, key, "full")
    return j.agg(
        F.count("_w").alias("total_ids"),
        F.count("_k").alias("stored"),
        F.count_if(F.col("_w").isNotNull() & F.col("_k").isNull()).alias("remaining"),
    ).withColumn("calls", F.ceil(F.col("remaining") / F.lit(S.LOOKUP_BATCH_SIZE)).cast("long"))


def call_count(pending: DataFrame, batch_size: int = S.LOOKUP_BATCH_SIZE) -> DataFrame:
    """calls = ceil(pending / batch)."""
    return pending.agg(F.count(F.lit(1)).alias("pending")).withColumn(
        "calls", F.ceil(F.col("pending") / F.lit(batch_size)).cast("long"))


LANDED = T.StructType([
    T.StructField("requested", T.ArrayType(T.StringType())),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])


def fetch(pending: DataFrame, fetch_fn: Callable[[list[str]], dict], key: str = "video_id",
          batch_size: int = S.LOOKUP_BATCH_SIZE, max_parallel: int | None = None) -> DataFrame:
    """S9 + W5: call ``fetch_fn`` with up to ``batch_size`` ids at a time.

    Runs inside ``mapInPandas``. ``batch_numbers`` deals the ids to calls
    first, so exactly ceil(n / batch_size) are made (A16); the calls are dealt
    to ``max_parallel`` tasks (the shuffle partitions if not given), which is
    how many are in flight. The raw response is landed as JSON text next to
    the ids it answers, so parsing is a separate, replayable step. A call that
    fails lands its error instead of a response and the others go on; its ids
    stay pending for the next run. A ``QuotaExceeded`` ends the task's calls
    and keeps what already landed (K5); the next run's anti-join resumes.
    """
    tasks = max_parallel or int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buf: list[str] = []

        def call(ids):
            response = error = None
            try:
                response = json.dumps(fetch_fn(ids))
            except QuotaExceeded:
                raise
            except Exception as e:  # whatever the service raises: the row says what
                error = f"{type(e).__name__}: {e}"
            return pd.DataFrame({"requested": [ids], "response": [response], "error": [error]})

        at = None
        try:
            for pdf in batches:
                for v, batch in zip(pdf[key].tolist(), pdf["batch"].tolist()):
                    if buf and batch != at:
                        yield call(buf)
                        buf = []
                    at = batch
                    buf.append(str(v))
            if buf:
                yield call(buf)
        except QuotaExceeded:
            return

    ids = batch_numbers(pending.select(F.col(key).cast("string").alias(key)), batch_size, key)
    dealt = ids.repartition(tasks, "batch").sortWithinPartitions("batch", "position")
    return dealt.select(key, "batch").mapInPandas(run, LANDED)


def fetch_landed(pending: DataFrame, fetch_fn: Callable[[list[str]], dict], landing: str,
                 key: str = "video_id", batch_size: int = S.LOOKUP_BATCH_SIZE,
                 max_parallel: int | None = None) -> DataFrame:
    """S9 with each external call made once per run: ``fetch`` runs in one
    job whose output is written to ``landing`` (a fresh folder under the
    shared ``spark.checkpoint.dir``; one job commit), and the landed table is
    returned. ``resolve`` reads its input more than once, so it must read
    landed rows, never the lazy ``fetch`` (each read would call the service
    again)."""
    fetch(pending, fetch_fn, key, batch_size, max_parallel).write.mode("append").parquet(landing)
    return pending.sparkSession.read.schema(LANDED).parquet(landing)


def _item_columns() -> list[Column]:
    """META columns of a response item (its fields as columns)."""
    return [
        F.col("id").alias("video_id"),
        F.col("snippet.title").alias("api_title"),
        F.col("snippet.channelTitle").alias("api_channel_title"),
        F.col("snippet.channelId").alias("channel_id"),
        F.col("snippet.publishedAt").alias("published_at"),
        F.col("snippet.description").alias("description"),
        C.canonical_category("snippet.categoryId").alias("category_id"),
        F.coalesce(F.col("snippet.tags"), F.array().cast("array<string>")).alias("tags"),
        F.col("snippet.defaultLanguage").alias("default_language"),
        F.col("snippet.defaultAudioLanguage").alias("default_audio_language"),
        F.col("contentDetails.duration").alias("duration_iso"),
        C.iso_duration_seconds("contentDetails.duration").alias("duration_seconds"),
        F.col("contentDetails.definition").alias("definition"),
        F.col("contentDetails.caption").alias("caption"),
        C.to_long("statistics.viewCount").alias("view_count"),
        C.to_long("statistics.likeCount").alias("like_count"),
        C.to_long("statistics.commentCount").alias("comment_count"),
        F.coalesce(F.col("topicDetails.topicCategories"),
                   F.array().cast("array<string>")).alias("topic_categories"),
    ]


def flatten_items(landed: DataFrame) -> DataFrame:
    """S10 + P12-P14: response JSON -> one row per returned item, META columns.

    Missing fields are NULL (the CSV-compat sink writes them blank); lists
    stay arrays; statistics are coerced to integers; the duration text is
    parsed (missing -> 0)."""
    items = (landed.select(F.explode(F.from_json("response", S.RESPONSE)["items"]).alias("i"))
             .select("i.*"))
    return items.select(*_item_columns())


def unavailable_rows(requested: DataFrame, returned: DataFrame, key: str = "video_id") -> DataFrame:
    """J8 + P15: requested ids the service did not return -> sentinel rows
    (title "[unavailable]", every other field NULL, duration NULL: TR19)."""
    missing = requested.select(key).distinct().join(returned.select(key), key, "left_anti")
    cols = [F.col(key)]
    for f in S.META.fields:
        if f.name == key:
            continue
        v = F.lit(S.UNAVAILABLE_TITLE) if f.name == "api_title" else F.lit(None)
        cols.append(v.cast(f.dataType).alias(f.name))
    return missing.select(*cols)


def resolve(landed: DataFrame) -> DataFrame:
    """Returned items plus sentinel rows for the ids each call missed;
    calls without a response say nothing of their ids."""
    landed = landed.filter(F.col("response").isNotNull())
    returned = flatten_items(landed)
    requested = landed.select(F.explode("requested").alias("video_id"))
    return returned.unionByName(unavailable_rows(requested, returned))


def resolve_calls(landed: DataFrame) -> DataFrame:
    """U3 call by call, without a join (so that it works on a stream): the
    items a call returned and a sentinel row for each id that it asked for
    and did not return. Calls without a response say nothing of their ids."""
    item = S.RESPONSE["items"].dataType.elementType
    called = landed.filter(F.col("response").isNotNull()).select(
        "requested", F.coalesce(F.from_json("response", S.RESPONSE)["items"], F.array().cast(S.RESPONSE["items"].dataType)).alias("_i"))
    missing = F.array_except("requested", F.transform("_i", lambda i: i["id"]))
    entries = F.concat(F.transform("_i", lambda i: F.struct(i["id"].alias("_id"), i.alias("_item"))),
                       F.transform(missing, lambda m: F.struct(m.alias("_id"), F.lit(None).cast(item).alias("_item"))))
    each = called.select(F.explode(entries).alias("e")).select("e._id", "e._item", "e._item.*")
    gone = F.col("_item").isNull()
    return each.select(*(
        F.col("_id").alias(c) if c == "video_id" else
        F.when(gone, F.lit(S.UNAVAILABLE_TITLE if c == "api_title" else None)).otherwise(v).alias(c)
        for c, v in zip(S.META.fieldNames(), _item_columns())))


def batch_numbers(pending: DataFrame, size: int = S.LOOKUP_BATCH_SIZE, key: str = "video_id",
                  seed: int = 42) -> DataFrame:
    """(key, batch, position): the ids dealt to exactly ceil(n / size)
    calls, every call but the last with ``size`` ids. The key column holds
    each id once (repeats are numbered one by one, in any order).

    A dense number without a global sort: ids are ordered by a hash, cut into
    buckets by its leading bits, numbered within their bucket, and shifted by
    the counts of the buckets before (a few thousand rows). All of it is a
    function of the ids alone, so any partitioning gives the same calls.
    """
    bits = max(8, (2 * int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    ids = pending.select(key, F.coalesce(C.md5_rank_key(key, seed), F.lit(0)).alias("_h"))
    ids = ids.withColumn("_b", F.shiftright("_h", 60 - bits))
    counts = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))  # 2 ** bits rows at most
    within = Window.partitionBy("_b").orderBy("_h", key)
    at = (ids.withColumn("_i", F.row_number().over(within) - 1).join(F.broadcast(shift), "_b")
          .withColumn("_n", F.col("_i") + F.col("_s")))
    return at.select(key, F.floor(F.col("_n") / size).cast("long").alias("batch"), (F.col("_n") % size).cast("int").alias("position"))


def answered(batches: DataFrame, answers: DataFrame, key: str = "video_id") -> DataFrame:
    """Landed responses of calls that a table answers: ``batches(key, batch,
    position)`` from ``batch_numbers`` and ``answers(key, item)``, the items
    that the other side holds (one per id it knows). One LANDED row per
    call; a call's ids and items are at most the batch size."""
    met = batches.join(answers.select(key, "item"), key, "left")
    asked = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(key).cast("string").alias("id")))), lambda x: x["id"])
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("position", "item")))), lambda x: x["item"])
    return met.groupBy("batch").agg(asked.alias("requested"), items.alias("items")).select(
        "batch", "requested", F.to_json(F.struct("items")).alias("response"), F.lit(None).cast("string").alias("error"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row per key (max_by is partially aggregated: skew-safe)."""
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
            .select(key, "_r.*"))
