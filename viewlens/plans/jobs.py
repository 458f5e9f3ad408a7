"""The command-line steps of a viewing-history analysis as Spark jobs over folders.

parse   export text  -> watch history table (partitioned by year)
enrich  watch ids    -> metadata store (batched lookups, resumable append)
analyze watch + meta -> report tables (one folder per report)
select  meta + done  -> ids to judge next (seeded, or scored-first priority)
evidence watch + meta -> channel / engagement / category / transcript tables
score   judge responses -> score rows, rejects by reason, label summary
triage  evaluation traces -> report rows and tool-order counts

Every input and output is a folder; parquet unless stated. A table that
several outputs read is written once under the shared ``spark.checkpoint.dir``
and scanned back, so no expensive step (the export parse, the enrichment
join, the judgment parse) runs once per output. Each write is one job
commit; appends hold one row per key and are anti-joined against what is
stored. A re-run after a lost executor or a stopped run adds nothing twice.
Folders written in between are removed when a job ends. Every job first
requires its inputs (S14).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.operators import evidence as ev
from viewlens.operators import history, ingest, judgments, lookup, reports, sampling, traces
from viewlens.session import drop_scratch, scratch_path
from viewlens.sources import io


class _Scratch:
    """Folders of one job below the shared checkpoint folder, removed when it
    ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for path in self.paths:
            drop_scratch(self.spark, path)

    def path(self, name: str) -> str:
        self.paths.append(scratch_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and scan it back (cuts the lineage; later reads
        prune columns)."""
        path = self.path(name)
        io.overwrite(df, path)
        return self.spark.read.parquet(path)


FILE_ROWS = 1_000_000  # rows of a history file at most


def by_year(df: DataFrame, out: str, file_rows: int = FILE_ROWS) -> None:
    """K1: overwrite ``out`` with ``df`` (a written table), partitioned by
    ``year``, in files of at most ``file_rows`` rows. The rows of each year
    are counted first; a year of many files is dealt to as many tasks, and a
    small one to a single task and file."""
    files = {r["year"]: max(1, math.ceil(r["n"] / file_rows))
             for r in df.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a year
    salts = F.lit(files.get(None, 1))
    many = {y: n for y, n in files.items() if y is not None and n > 1}
    if many:
        of_year = F.element_at(F.create_map(*(F.lit(x) for yn in many.items() for x in yn)), F.col("year"))
        salts = F.when(F.col("year").isNull(), salts).otherwise(F.coalesce(of_year, F.lit(1)))
    elif None not in files or files[None] == 1:
        salts = F.lit(1)
    else:
        salts = F.when(F.col("year").isNull(), salts).otherwise(F.lit(1))
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *df.columns), salts)
    # a few more than the files, so that two of them seldom share a task
    tasks = max(1, min(2 * sum(files.values()), MAX_WRITERS))
    (df.repartition(tasks, F.col("year"), salt).write.mode("overwrite").option("maxRecordsPerFile", file_rows)
     .partitionBy("year").parquet(out))


MAX_WRITERS = 65_536


def parse(spark: SparkSession, export_path: str, out: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Export blocks -> watch history at ``out``, partitioned by year (S1,
    P1-P11, K1). Rows whose time text did not parse stay with a NULL year
    (TR2; ``ingest.time_quarantine`` lists them). The blocks are parsed once
    and written, then counted and laid out. Returns the summary row."""
    io.require(spark, export_path, "Export the history first.")
    parsed = ingest.parse_blocks(io.read_export(spark, export_path)).withColumn("year", F.year("timestamp"))
    with _Scratch(spark) as scratch:
        by_year(scratch.written(parsed, "parsed"), out, file_rows)
    return reports.ingest_summary(spark.read.parquet(out))


def enrich(spark: SparkSession, watch_path: str, store: str,
           fetch_fn: Callable[[list[str]], dict], batch_size: int = S.LOOKUP_BATCH_SIZE,
           max_parallel: int | None = None) -> DataFrame:
    """Look up every watched id not yet in ``store`` and append the resolved
    rows (S3, S5, S9, J2, J8, K2-K5, U2-U4). Responses land first, so each
    call is made once; a quota stop keeps what landed and the next run
    resumes; a failed call leaves its ids pending. ``max_parallel`` bounds the
    calls in flight. Returns the progress row (A14, A16) after the append."""
    io.require(spark, watch_path, "Run parse first.")
    watch = spark.read.parquet(watch_path).select(F.col("video_id").cast("string").alias("video_id"))
    known = io.read_keys(spark, store, schema=S.META)
    pending = lookup.pending_ids(watch, known)
    with _Scratch(spark) as scratch:
        landed = lookup.fetch_landed(pending, fetch_fn, scratch.path("landed"), batch_size=batch_size,
                                     max_parallel=max_parallel)
        io.append(history.dedupe_first(lookup.resolve(landed)), store)
    return lookup.progress(watch, io.read_keys(spark, store, schema=S.META))


# report name -> builder over the enriched history
REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "totals": reports.totals,
    "yearly": reports.yearly,
    "monthly_hours": reports.monthly_hours,
    "events_by_year": reports.events_by_year,
    "category_hours": reports.category_hours,
    "top_categories": reports.top_categories,
    "category_year": reports.category_year_pivot,
    "category_year_feed": reports.category_year_feed,
    "type_breakdown": reports.type_breakdown,
}


def analyze(spark: SparkSession, watch_path: str, meta_path: str, out: str,
            csv: bool = False) -> dict[str, str]:
    """Watch history x metadata -> one folder per report under ``out`` (A1-A12,
    T1, T2, K6, K7). The enriched history is joined once and written; every
    report then scans only its own columns. ``csv=True`` also writes
    CSV-compat copies. Returns report name -> folder."""
    io.require(spark, watch_path, "Run parse first.")
    io.require(spark, meta_path, "Run enrich first.")
    meta = history.clean_metadata(spark.read.parquet(meta_path))
    cols = ["video_id", "duration_seconds", "category_id", *([history.ORDER] if history.ORDER in meta.columns else [])]
    written = {}
    with _Scratch(spark) as scratch:
        meta = scratch.written(history.dedupe_first(meta.select(*cols)), "meta")
        enriched = scratch.written(history.watch_enriched(spark.read.parquet(watch_path), meta, unique=True), "enriched")
        for name, build in REPORTS.items():
            path = f"{out.rstrip('/')}/{name}"
            df = build(enriched)
            io.overwrite(df, path)
            if csv:
                io.write_csv(spark.read.parquet(path), f"{path}_csv")
            written[name] = path
    return written


def select(spark: SparkSession, meta_path: str, done_path: str, n: int | None,
           prioritise_scored: str | None = None, seed: int = 42, resume: bool = True,
           ids: list[str] | None = None) -> DataFrame:
    """Ids to send to the judge next (P22, J3, J4, T6, T7, J9). Available
    videos not yet done form the pool. Without ``prioritise_scored`` the draw
    is a seeded sample; with a scores folder, scored videos come first. With
    explicit ``ids`` (P24) these are taken whether done or not, as far as the
    metadata has them, and nothing is drawn."""
    io.require(spark, meta_path, "Run enrich first.")
    if ids is not None:
        asked = spark.createDataFrame([(i,) for i in ids], "video_id string").distinct()
        known = history.dedupe_first(spark.read.parquet(meta_path).select(F.col("video_id").cast("string").alias("video_id"),
                                                                           "api_title"))
        return known.join(asked, "video_id", "left_semi").select("video_id")
    meta = sampling.available(spark.read.parquet(meta_path))
    done = io.read_keys(spark, done_path, schema=S.META)
    pool = sampling.pending(meta.select("video_id"), done, resume=resume)
    if prioritise_scored:
        scored = io.read_keys(spark, prioritise_scored, schema=S.META)
        return sampling.priority(pool, scored, n, seed=seed)
    return sampling.seeded(pool, n, seed=seed)


def evaluation_texts(spark: SparkSession, meta_path: str, ids: DataFrame) -> DataFrame:
    """The evaluation text of each selected id (P31-P36, T9): a semi-join of
    the ids against the metadata, then one projection."""
    io.require(spark, meta_path, "Run enrich first.")
    meta = history.dedupe_first(spark.read.parquet(meta_path), "video_id")
    return judgments.evaluation_text(meta.join(ids.select("video_id"), "video_id", "left_semi"))


def evidence(spark: SparkSession, watch_path: str, meta_path: str, out: str,
             scores_path: str | None = None, segments_path: str | None = None) -> dict[str, str]:
    """Evidence for every channel, video and category, one table each (A17-A26,
    W1-W6, X1-X3). A question about one key or a million is a join of the
    requested keys against these tables (P24, P25, X4). Returns name -> folder."""
    io.require(spark, watch_path, "Run parse first.")
    io.require(spark, meta_path, "Run enrich first.")
    watch = spark.read.parquet(watch_path)
    meta = spark.read.parquet(meta_path)
    tables = {
        "channels": ev.channel_patterns(watch),
        "engagement": ev.engagement_metrics(meta),
        "categories": ev.category_context(watch, meta),
        "category_top_channels": ev.category_top_channels(watch, meta),
    }
    if scores_path:
        tables["category_quality"] = ev.category_quality_map(
            ev.category_quality(meta, spark.read.parquet(scores_path)))
    if segments_path:
        tables["transcripts"] = ev.transcripts(spark.read.parquet(segments_path))
    written = {}
    for name, df in tables.items():
        path = f"{out.rstrip('/')}/{name}"
        io.overwrite(df, path)
        written[name] = path
    return written


def score(spark: SparkSession, responses_path: str, meta_path: str, out: str,
          model: str, scored_at) -> DataFrame:
    """Judge responses (``video_id``, ``content`` blocks) -> ``out/scores``
    (valid rows, P28/P30, appended), ``out/rejects`` (V7) and
    ``out/summary`` (A27). The parse runs once and is written; all three
    outputs read the written rows. Returns the summary."""
    io.require(spark, responses_path, "Land the judge's responses first.")
    io.require(spark, meta_path, "Run enrich first.")
    resp = spark.read.parquet(responses_path)
    text = resp.select(F.col("video_id").cast("string").alias("video_id"),
                       judgments.response_text("content").alias("text"))
    titles = spark.read.parquet(meta_path).select(
        F.col("video_id").cast("string").alias("video_id"), F.col("api_title").alias("title"))
    base = out.rstrip("/")
    with _Scratch(spark) as scratch:
        # a response that landed twice is one judgment
        validated = scratch.written(judgments.validate(text).dropDuplicates(), "validated")
        ok, rejects = judgments.split(validated)
        stored = io.read_keys(spark, f"{base}/scores", schema=S.META)
        rows = judgments.score_rows(history.dedupe_first(ok), history.dedupe_first(titles, "video_id"), model, scored_at)
        io.append(rows.join(stored, "video_id", "left_anti"), f"{base}/scores")
        # a replay of the same responses logs nothing twice
        logged = io.read_optional(spark, f"{base}/rejects", rejects.schema)
        io.append(rejects.dropDuplicates().join(logged, ["video_id", "reason"], "left_anti"), f"{base}/rejects")
        io.overwrite(judgments.summary(validated), f"{base}/summary")
    return spark.read.parquet(f"{base}/summary")


def triage(spark: SparkSession, traces_path: str, meta_path: str, out: str, evaluated_at) -> DataFrame:
    """Evaluation traces -> ``out/report`` (P29, appended: ids that have a
    report are not reported again, S8/I1), ``out/tool_order`` (G7) and
    ``out/summary`` (G1-G6), the replay, written once and read by the other
    two. Returns the per-trace summary."""
    io.require(spark, traces_path, "Land the evaluation traces first.")
    io.require(spark, meta_path, "Run enrich first.")
    base = out.rstrip("/")
    io.overwrite(traces.summarise(spark.read.parquet(traces_path)), f"{base}/summary")
    summary = spark.read.parquet(f"{base}/summary")
    append_reports(summary, spark.read.parquet(meta_path), f"{base}/report", evaluated_at)
    io.overwrite(traces.tool_order(summary), f"{base}/tool_order")
    return summary


def append_reports(summary: DataFrame, meta: DataFrame, path: str, evaluated_at) -> None:
    """Append the report rows of ids that ``path`` does not hold yet."""
    spark = summary.sparkSession
    titles = history.dedupe_first(meta.select("video_id", "api_title", "api_channel_title",
                                              *([history.ORDER] if history.ORDER in meta.columns else [])))
    rows = traces.report_rows(summary, titles, evaluated_at)
    # what is stored keeps its type of id
    stored = io.read_optional(spark, path, rows.schema).select("video_id").distinct()
    io.append(rows.join(stored, "video_id", "left_anti"), path)
