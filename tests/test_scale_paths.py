"""Paths that only large or skewed tables take, forced on small ones."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from viewlens.operators import evidence as ev
from viewlens.operators import history, keyed, lookup, ranking, selection, skew, traces
from viewlens.operators.sampling import seeded
from viewlens.plans import jobs
from viewlens.streaming import incremental as ST


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    old = {}

    def put(**kw):
        for k, v in kw.items():
            k = "spark.sql." + k.replace("_", ".")
            old.setdefault(k, spark.conf.get(k))
            spark.conf.set(k, v)
    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


# --- selection (T6-T8) -------------------------------------------------------

def brute_first(rows, n):
    return sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))[:n]


@pytest.mark.parametrize(("bits", "merged"), [(5, 0), (14, 0), (14, 500_000)])
def test_first_n_equals_a_full_sort(spark, monkeypatch, bits, merged):
    monkeypatch.setattr(selection, "STEP_BITS", bits)
    monkeypatch.setattr(selection, "MERGED_KEYS", merged)
    monkeypatch.setattr(selection, "FEW_KEYS", 5)  # every level of the threshold
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 7, 1 << 62, rng.getrandbits(30)]), rng.choice([None, 1, 2, 3])) for _ in range(400)]
    df = spark.createDataFrame(rows, "h long, id long").repartition(5)
    for n in (0, 3, 200, 399, 1000):
        got = brute_first([tuple(r) for r in selection.first_n(df, ["h", "id"], n).collect()], n + 1)
        assert got == brute_first(rows, n)


@pytest.mark.parametrize("merged", [0, 500_000])
def test_first_n_with_most_rows_on_one_key(spark, monkeypatch, merged):
    monkeypatch.setattr(selection, "MERGED_KEYS", merged)
    rows = [(5, i) for i in range(3000)] + [(i, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "h long, id long")
    for n in (4, 6, 1500, 3500):
        assert brute_first([tuple(r) for r in selection.first_n(df, ["h", "id"], n).collect()], n + 1) == brute_first(rows, n)


def test_sample_is_a_filter(spark):
    df = spark.range(10_000).withColumnRenamed("id", "video_id")
    out = seeded(df, 50)
    assert out.count() == 50
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# --- point questions (P24) ----------------------------------------------------

@pytest.mark.parametrize("limits", [(200_000, 8_000_000), (0, 8_000_000), (0, 0)])
def test_among_keeps_the_rows_of_requested_keys(spark, monkeypatch, limits):
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", limits[0])
    monkeypatch.setattr(keyed, "FILTER_KEYS", limits[1])
    df = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("k"), "id").union(
        spark.sql("SELECT CAST(NULL AS STRING), 1L"))
    asked = spark.range(0, 9000, 13).select(F.col("id").cast("string").alias("k")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    want = {i for i in range(20_000) if (i % 5000) % 13 == 0}
    assert {r.id for r in keyed.among(df, asked.union(asked), "k").collect()} == want
    assert keyed.among(df, asked.limit(0), "k").count() == 0


def test_bit_filter_lets_few_others_pass(spark):
    asked = spark.range(0, 40_000, 4).select(F.col("id").alias("k"))
    words, bits = keyed.bit_filter(asked, "k", 10_000)
    other = spark.range(1, 40_000, 4).select(F.col("id").alias("k"))
    assert asked.filter(keyed.passes(words, bits, F.col("k"))).count() == 10_000
    assert other.filter(keyed.passes(words, bits, F.col("k"))).count() < 500


def rows_shuffled(df):
    """Rows written by the exchanges of the plan that ran."""
    df.collect()
    out = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_lookups_shuffle_requested_rows_only(spark, conf):
    watch = spark.range(50_000).select(
        (F.col("id") % 997).alias("video_id"), F.xxhash64("id").alias("channel_name"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 977).alias("timestamp"))
    asked = watch.limit(5).select(F.col("channel_name").alias("channel"))
    got = ev.channels_asked(watch, asked)
    full = ev.channel_lookup(ev.channel_patterns(watch), asked)
    assert sorted(got.collect(), key=str) == sorted(full.collect(), key=str)
    assert max(rows_shuffled(ev.channels_asked(watch, asked))) < 200  # 5 of 50,000 channels
    assert max(rows_shuffled(ev.channel_lookup(ev.channel_patterns(watch), asked))) > 10_000


@pytest.mark.parametrize("limits", [(0, 8_000_000), (0, 0)])
def test_many_channels_asked_are_joined_after_they_are_combined(spark, conf, monkeypatch, limits):
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", limits[0])
    monkeypatch.setattr(keyed, "FILTER_KEYS", limits[1])
    conf(autoBroadcastJoinThreshold="-1")
    watch = spark.range(20_000).select(
        (F.col("id") % 97).alias("video_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 800).alias("channel_name"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 977).alias("timestamp"))
    asked = spark.range(0, 1200, 7).select(F.col("id").alias("channel")).union(spark.sql("SELECT 1L UNION ALL SELECT CAST(NULL AS LONG)"))
    got = ev.channels_asked(watch, asked.union(asked))
    full = ev.channel_lookup(ev.channel_patterns(watch), asked)
    assert sorted(got.collect(), key=str) == sorted(full.collect(), key=str)
    # a join on the history's rows would gather each channel in one task, where they are aggregated uncombined
    assert "LeftSemi" not in got._jdf.queryExecution().executedPlan().toString()


# --- heavy keys (J1) ----------------------------------------------------------

def skewed(spark, n=60_000):
    """Nine rows in ten on one id, some on NULL, the rest spread."""
    i = F.col("id")
    video = F.when(i % 10 > 0, F.lit("hot")).when(i % 100 == 0, F.lit(None)).otherwise((i % 3000).cast("string"))
    watch = spark.range(0, n, 1, 8).select(video.alias("video_id"), F.lit("c").alias("channel_name"),
                                           F.timestamp_seconds(F.lit(1_600_000_000) + i % 7).alias("timestamp"))
    meta = spark.range(3000).select(F.col("id").cast("string").alias("video_id"), F.col("id").alias("duration_seconds"),
                                    F.lit("10").alias("category_id")).union(spark.sql("SELECT 'hot', 7L, '1'"))
    return watch, meta


def test_heavy_keys_are_found_and_bounded(spark):
    watch, _ = skewed(spark)
    heavy = skew.heavy_keys(watch, "video_id", 8)
    assert "hot" in heavy and sum(heavy.values()) <= skew.SALTS_PER_TASK * 8 + skew.TOP
    assert skew.heavy_keys(watch.limit(0), "video_id", 8) == {}


def test_a_hot_video_is_shared_by_the_tasks(spark, conf):
    watch, meta = skewed(spark)
    plain = history.watch_enriched(watch, meta)
    want = sorted(map(str, plain.groupBy("video_id", "duration_seconds", "category", "year").count().collect()))
    conf(autoBroadcastJoinThreshold="-1", adaptive_enabled="false", shuffle_partitions="8")
    for unique in (False, True):
        joined = history.watch_enriched(watch, meta, unique=unique)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, joined.groupBy("video_id", "duration_seconds", "category", "year").count().collect())) == want
        known = joined.filter(F.col("video_id").isNotNull())
        per_task = sorted(r["count"] for r in known.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert len(per_task) == 8 and per_task[-1] <= 4 * per_task[4]


def test_rows_alike_in_every_column_are_shared_too(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive_enabled="false", shuffle_partitions="8")
    watch = spark.range(0, 40_000, 1, 64).select(F.lit("hot").alias("k"))
    one = spark.sql("SELECT 'hot' AS k, 1 AS v")
    out = skew.left_join(watch, one, "k")
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == 40_000 and out.filter("v = 1").count() == 40_000 and max(per_task) < 16_000


# --- transcripts (X1) ---------------------------------------------------------

def bare(spark, conf):
    """The settings of a session that the caller made."""
    conf(optimizer_windowGroupLimitThreshold="1000")


def test_a_hot_transcript_is_cut_before_the_shuffle(spark, conf):
    bare(spark, conf)
    seg = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 20 == 0, F.lit("small")).otherwise(F.lit("hot")).alias("video_id"), F.col("id").alias("seq"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("text"))
    out = ev.transcripts(seg)
    # 3,001 segments a key and task could be needed if all were empty; here each has several characters
    assert max(rows_shuffled(out)) <= 8 * 2 * 900
    rows = {r.video_id: r for r in out.collect()}
    for key, ids in (("small", range(0, 200_000, 20)), ("hot", (i for i in range(200_000) if i % 20))):
        whole = " ".join(f"s{i}" for i in ids)
        assert rows[key].full_length == len(whole)
        assert rows[key].transcript == whole[:3000] + f"... [truncated, {len(whole)} chars total]"


def test_transcripts_equal_join_and_cut(spark, conf):
    bare(spark, conf)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(400), rng.choice([None, "", "x", "yy " * 30, "z" * 4000, "é😀"])) for _ in range(3000)]
    rows += [("empty", i, "") for i in range(3500)] + [("exact", 1, "e" * 3000), ("over", 1, "e" * 2999), ("over", 2, "")]
    got = {r.video_id: r for r in ev.transcripts(spark.createDataFrame(rows, "video_id string, seq long, text string").repartition(7)).collect()}
    for key in ("a", "b", "c", "empty", "exact", "over"):
        parts = sorted((s, t or "") for k, s, t in rows if k == key)
        whole = " ".join(t for _, t in parts)
        want = whole if len(whole) <= 3000 else whole[:3000] + f"... [truncated, {len(whole)} chars total]"
        assert (got[key].full_length, got[key].transcript) == (len(whole), want)


# --- medians (A25) ------------------------------------------------------------

def test_bracketed_medians_equal_sorted_ones(spark):
    rng = random.Random(6)
    rows = [("hot", int(rng.paretovariate(0.4)), rng.choice([None, 3])) for _ in range(20_000)]
    rows += [("ties", rng.choice([5, 5, 5, 5, 9]), None) for _ in range(3000)] + [("one", 4, 1), ("two", 1, 8), ("two", 4, 9), (None, 2, 2)]
    df = spark.createDataFrame(rows, "g string, x long, y long").repartition(6)
    got = {r.g: (r.median_x, r.median_y) for r in ranking.exact_medians(df, ["x", "y"], ["g"]).collect()}
    assert None not in got
    for g in {r[0] for r in rows} - {None}:
        want = [statistics.median(v) if (v := [r[i] for r in rows if r[0] == g and r[i] is not None]) else None for i in (1, 2)]
        assert list(got[g]) == want


def test_a_bracket_that_misses_is_widened(spark):
    df = spark.range(10_001).select(F.lit("g").alias("g"), "id")
    out = ranking.exact_medians(df, ["id"], ["g"], half_width=0.0, buckets=10)  # a coarse sketch
    assert out.first().median_id == 5000.0


def test_medians_shuffle_few_values(spark):
    df = spark.range(0, 200_000, 1, 4).select(F.lit("g").alias("g"), F.xxhash64("id").alias("x"))
    out = ranking.exact_medians(df, ["x"], ["g"])
    assert sum(rows_shuffled(out)) < 0.05 * 200_000
    assert out.first().median_x == statistics.median(r.x for r in df.select("x").collect())


# --- calls (W5) ---------------------------------------------------------------

def test_batches_are_dense_and_do_not_depend_on_partitioning(spark, conf):
    for n in (0, 1, 50, 51, 1234):
        ids = spark.range(n).select(F.col("id").cast("string").alias("video_id"))
        got = sorted(tuple(r) for r in lookup.batch_numbers(ids.repartition(5)).collect())
        assert [r[0] for r in got] == sorted(str(i) for i in range(n))
        at = sorted((b, p) for _, b, p in got)
        assert at == [(i // 50, i % 50) for i in range(n)]
        conf(shuffle_partitions="3")
        assert sorted(tuple(r) for r in lookup.batch_numbers(ids).collect()) == got


def test_fetch_makes_exactly_the_calls_needed(spark):
    ids = spark.range(1021).select(F.col("id").cast("string").alias("video_id"))
    landed = lookup.fetch(ids, lambda asked: {"items": []}, max_parallel=6).collect()
    sizes = sorted(len(r.requested) for r in landed)
    assert len(landed) == math.ceil(1021 / 50) and sizes == [21] + [50] * 20
    assert sorted(i for r in landed for i in r.requested) == sorted(str(i) for i in range(1021))


# --- layout (K1) --------------------------------------------------------------

def test_files_follow_the_rows_of_a_year(spark, tmp_path):
    i = F.col("id")
    year = F.when(i < 30_000, F.lit(2020)).when(i < 30_010, F.lit(2021)).when(i < 30_500, F.lit(None)).otherwise(F.lit(2022))
    written = str(tmp_path / "w")
    spark.range(0, 31_700, 1, 8).select(year.cast("int").alias("year"), F.lit("same").alias("v")).write.parquet(written)
    out = str(tmp_path / "h")
    jobs.by_year(spark.read.parquet(written), out, file_rows=1000)
    per = {}
    for r in spark.read.parquet(out).groupBy("year", F.input_file_name().alias("f")).count().collect():
        per.setdefault(r.year, []).append(r["count"])
    assert {y: sum(c) for y, c in per.items()} == {2020: 30_000, 2021: 10, None: 490, 2022: 1200}
    assert max(c for v in per.values() for c in v) <= 1000
    assert len(per[2021]) == 1 and len(per[None]) == 1 and 30 <= len(per[2020]) <= 80


# --- traces (G1-G6) -----------------------------------------------------------

TRACE = "video_id string, round int, pos int, block_type string, tool_name string, input_json string"


def replay(blocks):
    """The evaluation loop, block by block."""
    rounds = sorted({b[1] for b in blocks if b[1] <= 6})
    latest, tools, errors, end, done, failed = None, [], 0, None, False, False
    for r in rounds:
        here = sorted((b for b in blocks if b[1] == r), key=lambda b: b[2])
        calls = [b for b in here if b[3] == "tool_use"]
        for b in calls:
            if b[4] in traces.KNOWN:
                tools.append(b[4])
            else:
                errors += 1
            if b[4] == "submit_assessment":
                latest = b[5]
        end, failed = r, any(b[3] == "error" for b in here)
        done = bool(calls) and latest is not None and latest.strip("{ }") != ""
        if done or failed or not calls:
            break
    else:
        failed = False
        outcome = "empty_assessment" if latest is not None else "stopped_without_tools" if end < 6 else "round_cap"
        return outcome, end, latest, tools, errors
    empty = latest is not None and latest.strip("{ }") == ""
    outcome = "assessed" if done else "failed" if failed else "empty_assessment" if empty else "stopped_without_tools"
    return outcome, end, latest if outcome in ("assessed", "empty_assessment") else None, tools, errors


def test_fold_equals_the_loop(spark):
    rng = random.Random(12)
    rows = []
    for v in range(400):
        for r in range(1, rng.randrange(1, 9) + 1):
            if rng.random() < 0.1:
                continue
            for p in range(rng.randrange(1, 4)):
                kind = rng.choice(["tool_use"] * 12 + ["text", "error"])
                name = rng.choice([*traces.KNOWN, "search_web", "submit_assessment"]) if kind == "tool_use" else None
                body = rng.choice(["{}", " { } ", json.dumps({"summary": f"{v}-{r}"})]) if rng.random() < 0.5 else "{}"
                rows.append((str(v), r, p, kind, name, body if name == "submit_assessment" else "{}"))
    df = traces.summarise(spark.createDataFrame(rows, TRACE).repartition(5))
    got = {r.video_id: r for r in df.collect()}
    outcomes = set()
    for v in {r[0] for r in rows if r[1] <= 6}:
        outcome, end, latest, tools, errors = replay([r for r in rows if r[0] == v and r[1] <= 6])
        r = got[v]
        assert (r.outcome, r.end_round, r.assessment, r.tools_used, r.error_calls) == (outcome, end, latest, tools, errors)
        assert r.tool_rounds == sum(t != "submit_assessment" for t in tools)
        outcomes.add(outcome)
    assert outcomes == {"assessed", "failed", "empty_assessment", "stopped_without_tools", "round_cap"}
    plan = traces.summarise(spark.createDataFrame(rows, TRACE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


# --- keyed stream state (I1, S5) ----------------------------------------------

def call(ids, returned, error=None):
    body = None if error else json.dumps({"items": [{"id": i, "snippet": {"title": t}} for i, t in returned]})
    return (ids, body, error)


def test_stream_state_keeps_each_id_once(spark, tmp_path):
    landing, store, ckpt = (str(tmp_path / x) for x in ("landing", "store", "ckpt"))

    def drop(*calls):
        ST.land(spark.createDataFrame(calls, lookup.LANDED), landing)
        ST.ingest_landed(spark, landing, store, ckpt)
        return sorted((r.video_id, r.api_title) for r in ST.store_rows(spark, store).collect())

    one = drop(call(["a", "b"], [("a", "A")]), call(["c"], [], error="Timeout"))
    assert one == [("a", "A"), ("b", "[unavailable]")]
    # a replay, a late answer for b, and the call that failed before
    two = drop(call(["a", "b"], [("a", "A2")]), call(["b"], [("b", "B")]), call(["c", "d"], [("c", "C"), ("d", "D")]))
    assert two == [*one, ("c", "C"), ("d", "D")]
    assert drop(call(["d"], [("d", "D9")]), call(["d"], [("d", "D9")])) == two
    assert drop(call(["e"], [(None, "no id")])) == [*two, ("e", "[unavailable]")]


def test_stream_plan_does_not_read_the_store(spark, tmp_path):
    rows = ST.first_rows(spark.readStream.schema(lookup.LANDED).json(str(tmp_path)))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate [video_id" in plan and "Join" not in plan and plan.count("StreamingRelation") <= 1
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with ST._settings(spark, ST.STATE_CONF):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
