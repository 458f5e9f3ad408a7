"""Golden tests for operators on the hand-derived fixtures of FIXTURES.md."""

import datetime as dt

from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.operators import evidence as E
from viewlens.operators import history, ingest, judgments as J, lookup as L, reports
from viewlens.operators import sampling as SM, traces as TR
from viewlens.operators.ranking import exact_median, rank_below
from viewlens.sources import io

CELL = ' mdl-cell"><div ' + S.CONTENT_CELL_OPEN
CH = "https://www.youtube.com/channel/UC1"


def ts(s):
    return dt.datetime.fromisoformat(s)


# --- ingestion (section 2) -------------------------------------------------------

def test_parse_blocks(spark):
    w = '<a href="https://www.youtube.com/watch?v={}">{}</a><br>'
    bodies = [
        CELL + w.format("AAA", "Tom &amp; Jerry\npart 2") + f'<a href="{CH}">Toons &amp; Co</a><br>'
        "Feb 6, 2026, 2:02:26 PM EST</div>",
        CELL + w.format("AAB", "t") + f'<a href="{CH}">c</a><br>Feb 6, 2026, 2:02:26 PM EST</div>',
        CELL + w.format("BBB", "t") + "Jan 1, 2024, 12:00:00 AM EST</div>",
        CELL + w.format("ADS", "t") + "Jan 1, 2024, 1:00:00 AM EST</div><div>From Google Ads</div>",
        CELL + w.format("HDL", "t") + '<a href="https://www.youtube.com/@handle">h</a><br>'
        "Jan 1, 2024, 1:00:00 AM EST</div>",
        CELL + w.format("NAD", "t") + f'<a href="{CH}">c</a>Jan 1, 2024, 1:00:00 AM EST</div>From Google Ads',
        CELL + "no links here Jan 1, 2024, 1:00:00 AM EST</div>",
        ' mdl-cell"><div class="other">nothing</div>',
        CELL + w.format("NOT", "t") + "</div>",
        CELL + w.format("ODD", "t") + "Jan 1, 2024, 1:00:00 AM UTCXYZW</div>",
        CELL + '<a href="u"><b>x</b></a>' + w.format("NXT", "second") + "</div>",
    ]
    blocks = spark.createDataFrame([(b,) for b in bodies], "block string")
    rows = {r.video_id: r for r in ingest.parse_blocks(blocks).collect()}
    assert set(rows) == {"AAA", "AAB", "BBB", "ADS", "HDL", "NAD", "NOT", "ODD", "NXT"}
    a = rows["AAA"]
    assert (a.title, a.channel_name, a.type, a.channel_url) == ("Tom & Jerry part 2", "Toons & Co", "normal", CH)
    assert a.timestamp == ts("2026-02-06 14:02:26")
    assert rows["AAB"].timestamp == a.timestamp  # TR1
    assert (rows["BBB"].type, rows["BBB"].channel_name) == ("removed", None)
    assert rows["BBB"].timestamp.hour == 0
    assert rows["ADS"].type == "ad"
    assert rows["HDL"].type == "removed"  # TR20
    assert rows["NAD"].type == "normal"
    assert rows["NOT"].timestamp is None
    assert rows["ODD"].timestamp is None  # TR2: not raised, quarantined
    assert ingest.time_quarantine(ingest.parse_blocks(blocks)).count() == 1
    assert rows["NXT"].title == "second"


def test_export_scan_roundtrip(spark, tmp_path):
    from viewlens.sources import io
    blocks = spark.createDataFrame([("<html><head>css</head>",), (CELL + '<a href="https://y/watch?v=Q">T\nx</a></div>',)],
                                   "block string")
    io.write_blocks(blocks, str(tmp_path / "exp"))
    back = io.read_export(spark, str(tmp_path / "exp"))
    parsed = ingest.parse_blocks(back).collect()
    assert [(r.video_id, r.title) for r in parsed] == [("Q", "T x")]


# --- lookup (section 3) -----------------------------------------------------------

def test_pending_and_resolve(spark):
    watch = spark.createDataFrame([(x,) for x in ["a", "b", "a", None, "c", "d"]], "video_id string")
    known = spark.createDataFrame([("b",)], "video_id string")
    pending = L.pending_ids(watch, known)
    assert sorted(r[0] for r in pending.collect()) == ["a", "c", "d"]
    assert L.call_count(pending).collect()[0].calls == 1
    prog = L.progress(watch, known).collect()[0]
    assert (prog.total_ids, prog.stored, prog.remaining, prog.calls) == (4, 1, 3, 1)

    def service(ids):
        items = []
        if "a" in ids:
            items.append({"id": "a", "snippet": {"title": "A", "categoryId": "24.0", "tags": ["x", "y"]},
                          "contentDetails": {"duration": "PT1H2M3S"},
                          "statistics": {"viewCount": "100", "likeCount": "10"}})
        if "c" in ids:
            items.append({"id": "c", "snippet": {"title": "C"}})
        return {"items": items}

    out = {r.video_id: r for r in L.resolve(L.fetch(pending, service)).collect()}
    assert out["a"].duration_seconds == 3723 and out["a"].category_id == "24" and out["a"].tags == ["x", "y"]
    assert out["c"].duration_seconds == 0 and out["c"].tags == [] and out["c"].view_count is None
    assert out["d"].api_title == S.UNAVAILABLE_TITLE and out["d"].duration_seconds is None  # TR19
    many = spark.range(101).select(F.col("id").cast("string").alias("video_id"))
    assert L.call_count(many).collect()[0].calls == 3


def test_quota_keeps_landed(spark):
    ids = spark.range(120).select(F.col("id").cast("string").alias("video_id")).coalesce(1)

    class Budget:
        def __init__(self):
            self.n = 0

        def __call__(self, batch):
            self.n += 1
            if self.n > 1:
                raise L.QuotaExceeded()
            return {"items": [{"id": i} for i in batch]}

    landed = L.fetch(ids, Budget(), max_parallel=1)
    assert landed.count() == 1  # the first call landed, the rest stopped


# --- history (section 4) ----------------------------------------------------------

def test_calendar_days_and_totals(spark):
    watch = spark.createDataFrame([
        ("a", ts("2024-12-31 10:00:00")), ("a", ts("2023-01-10 09:00:00")), ("x", ts("2023-01-12 08:00:00")),
        (None, ts("2022-01-01 00:00:00")), ("a", ts("2022-12-31 23:00:00")), ("a", None)],
        "video_id string, timestamp timestamp_ntz")
    meta = spark.createDataFrame([("a", 1800, "10")], "video_id string, duration_seconds long, category_id string")
    e = history.watch_enriched(watch, meta)
    y = {r.year: r for r in reports.yearly(e).collect()}
    assert {k: v.cal_days for k, v in y.items()} == {2024: 1, 2023: 2, 2022: 365}
    t = reports.totals(e).collect()[0]
    assert t.events == 6 and t.with_duration == 4 and t.total_hours == 2.0
    cats = {r.category: r.hours for r in reports.category_hours(e).collect()}
    assert cats == {"Music": 2.0, "Unknown": 0.0}  # TR5


def test_category_pivot(spark):
    rows = []
    for i in range(8):  # category i has 8 - i hours in 2024
        rows.append((f"v{i}", ts("2024-05-01 00:00:00"), (8 - i) * 3600, str([1, 2, 10, 15, 17, 18, 19, 20][i])))
    df = spark.createDataFrame(rows, "video_id string, timestamp timestamp_ntz, duration_seconds long, category_id string")
    e = history.watch_enriched(df.select("video_id", "timestamp"), df)
    p = reports.category_year_pivot(e)
    assert p.columns == ["year", "Film & Animation", "Autos & Vehicles", "Music", "Pets & Animals", "Sports",
                         "Short Movies", "Other"]
    r = p.collect()[0]
    assert r["Other"] == 3.0 and r["Film & Animation"] == 8.0


# --- judgments (section 5) --------------------------------------------------------

def test_validate(spark):
    def j(d, label=None, extra=""):
        dims = ", ".join(f'"{k}": {v}' for k, v in zip(S.QUALITY_DIMENSIONS, d))
        lab = "" if label is None else f', "triage_label": {label}'
        return "{" + dims + lab + extra + "}"

    cases = [
        ("1", j([5, 4, 4, 4, 4], '"deep"')), ("2", j([1, 1, 1, 1, 1], '"deep"')),
        ("3", j([3, 3, 3, 3, 3], '"great"')), ("4", j([2, 2, 2, 2, 1])),
        ("5", j([4, 4, 4, 4, 4], "null")), ("6", j([9, -3, 3, 3, 3])),
        ("7", "```json\n" + j([3, 3, 3, 3, 3]) + "\n```"), ("8", "```\n" + j([3, 3, 3, 3, 3]) + "\n``` tail"),
        ("9", "oops"), ("10", j(['"4"', 4, 4, 4, 4])), ("11", j(["4.0", 4, 4, 4, 4])),
        ("12", j(["null", 4, 4, 4, 4])), ("13", j(["true", 4, 4, 4, 4])), ("14", "```nofence"),
        ("15", j([3, 3, 3, 3, 3], extra=', "rationale": "why"')),
    ]
    df = spark.createDataFrame(cases, "video_id string, text string")
    r = {x.video_id: x for x in J.validate(df).collect()}
    assert (r["1"].composite_score, r["1"].triage_label) == (4.2, "deep")
    assert (r["2"].composite_score, r["2"].triage_label) == (1.0, "deep")
    assert (r["3"].composite_score, r["3"].triage_label) == (3.0, "useful")
    assert (r["4"].composite_score, r["4"].triage_label) == (1.8, "shallow")
    assert r["5"].triage_label == "deep"
    assert (r["6"].depth, r["6"].rigor, r["6"].triage_label) == (5, 1, "useful")
    assert r["7"].status == "ok" and r["8"].status == "ok"
    assert r["9"].status == "json_error" and r["14"].status == "json_error"
    for k in ("10", "11", "12", "13"):
        assert r[k].status == "invalid_dim" and r[k].depth is None  # TR14, TR21
    assert r["15"].rationale == "why" and r["4"].rationale == ""


def test_summary(spark):
    v = spark.createDataFrame([("a", "ok", "deep"), ("b", "ok", "deep"), ("c", "ok", "mixed"),
                               ("d", "json_error", None)], "video_id string, status string, triage_label string")
    out = {r.triage_label: r for r in J.summary(v).collect()}
    assert (out["deep"].label_count, out["deep"].pct) == (2, 66.7)
    assert out["mixed"].pct == 33.3 and out["shallow"].label_count == 0 and out["useful"].pct == 0.0
    assert out["deep"].scored == 3 and out["deep"].errors == 1
    none = J.summary(v.filter("status <> 'ok'")).collect()
    assert all(r.pct == 0.0 for r in none)
    empty = J.summary(v.filter("false")).collect()
    assert sorted(r.triage_label for r in empty) == sorted(S.TRIAGE_LABELS)
    assert all((r.label_count, r.scored, r.errors) == (0, 0, 0) for r in empty)


def test_evaluation_text(spark):
    meta = spark.createDataFrame([("v", "T", "C", "27", 3723, "1235.5", None, "7", [f"t{i}" for i in range(16)],
                                   "d" * 10000)],
                                 "video_id string, api_title string, api_channel_title string, category_id string,"
                                 " duration_seconds long, view_count string, like_count string, comment_count string,"
                                 " tags array<string>, description string")
    p = J.evaluation_text(meta).collect()[0].prompt
    assert "Duration: 1h02m03s" in p and "Views: 1,235 | Likes: N/A | Comments: 7" in p
    assert "Tags: " + ", ".join(f"t{i}" for i in range(15)) + "\n" in p
    assert p.endswith("d" * 10000 + "\n")


# --- evidence (section 6) ---------------------------------------------------------

def test_engagement(spark):
    meta = spark.createDataFrame([("v1", 100, 10), ("v2", 200, 0), ("v3", 0, 5), ("v4", None, 3),
                                  ("v5", 400, None), ("v6", 0, 0)],
                                 "video_id string, view_count long, like_count long")
    meta = meta.withColumn("comment_count", F.lit(None).cast("long")).withColumn(
        "duration_seconds", F.lit(None).cast("long"))
    r = {x.video_id: x for x in E.engagement_metrics(meta).collect()}
    assert (r["v1"].view_percentile, r["v1"].like_ratio_percentile, r["v1"].anomaly_flag) == (40.0, 33.3, "none")
    assert r["v2"].like_to_view_ratio is None and r["v2"].like_ratio_percentile == 0.0
    assert r["v2"].anomaly_flag == "unusually_low_engagement" and r["v2"].view_percentile == 60.0
    assert r["v3"].note == "View count unavailable" and r["v3"].view_percentile is None
    assert r["v4"].note == "View count unavailable"
    assert r["v5"].view_percentile == 80.0 and r["v5"].like_ratio_percentile is None and r["v5"].anomaly_flag is None
    req = spark.createDataFrame([("v1",), ("zz",)], "video_id string")
    lk = {x.video_id: x.status for x in E.engagement_lookup(E.engagement_metrics(meta), req).collect()}
    assert lk == {"v1": "success", "zz": "not_found"}


def test_channel_patterns(spark):
    d = lambda s: ts(s + " 00:00:00")
    rows = [("X", "a", d("2024-01-01")), ("X", "a", d("2024-01-02")), ("X", "b", d("2024-03-10")),
            ("X", "c", d("2024-03-20")), ("X", "d", d("2024-03-31")),
            ("X2", "a", d("2024-01-01")), ("X2", "a", d("2024-01-02")), ("X2", "b", d("2024-03-10")),
            ("X2", "c", d("2024-03-20")), ("X2", "d", d("2024-03-31")), ("X2", "e", d("2024-03-31")),
            ("Y", "a", d("2024-01-01")), ("Y", "b", d("2024-03-01")), ("Z", "a", d("2024-01-01")),
            ("W", "a", ts("2024-01-01 23:00:00")), ("W", "b", ts("2024-01-03 01:00:00")), (None, "q", d("2024-01-01"))]
    w = spark.createDataFrame(rows, "channel_name string, video_id string, timestamp timestamp_ntz")
    r = {x.channel: x for x in E.channel_patterns(w).collect()}
    x = r["X"]
    assert (x.total_watches, x.unique_videos, x.rewatch_ratio, x.span_days, x.watches_per_month,
            x.engagement_trend) == (5, 4, 1.25, 90, 1.7, "stable")
    assert r["X2"].engagement_trend == "increasing"
    assert r["Y"].engagement_trend == "insufficient_data" and r["Y"].span_days == 60
    assert (r["Z"].span_days, r["Z"].watches_per_month, r["Z"].rewatch_ratio) == (1, 30.0, 1.0)
    assert r["W"].span_days == 1 and None not in r
    req = spark.createDataFrame([("X",), ("absent",)], "channel string")
    lk = {x.channel: x for x in E.channel_lookup(E.channel_patterns(w), req).collect()}
    assert lk["absent"].total_watches == 0 and lk["absent"].note == "Channel not found in watch history"


def test_category_context_medians_and_top(spark):
    meta = spark.createDataFrame([("a", "27", 1, 1), ("b", "27", 2, 2), ("c", "27", 10, None), ("d", "27", 11, None),
                                  ("e", "10", 1, None), ("f", "10", 2, None), ("g", "99", None, None)],
                                 "video_id string, category_id string, view_count long, like_count long")
    chans = [("a", f"ch{i}") for i in range(6) for _ in range(6 - i)] + [("a", None)] * 9
    watch = spark.createDataFrame(chans, "video_id string, channel_name string")
    r = {x.category_id: x for x in E.category_context(watch, meta).collect()}
    assert r["27"].median_views == 6 and r["27"].median_likes == 1
    assert r["10"].median_views == 1 and r["10"].median_likes is None  # TR15
    assert r["99"].category_name == "Category 99" and r["99"].total_watches == 0
    assert r["27"].category_name == "Education" and r["27"].total_watches == 30
    top = E.category_top_channels(watch, meta).collect()
    assert sorted(x.channel for x in top) == ["ch0", "ch1", "ch2", "ch3", "ch4"]
    scores = spark.createDataFrame([("a", 4.0, "deep"), ("b", 3.0, "useful"), ("c", 3.2, "useful")],
                                   "video_id string, composite_score double, triage_label string")
    q = E.category_quality_map(E.category_quality(meta, scores)).collect()[0]
    assert (q.scored_count, q.avg_composite, q.label_distribution) == (3, 3.4, {"useful": 2, "deep": 1})


def test_exact_rank_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    vals = [rnd.choice([0, 0, 0, 1, 2, 3, 5, 8, 13]) + rnd.random() * (rnd.random() < 0.3) for _ in range(3000)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g int, x double")
    got = {(r.g, r.x): r._below for r in rank_below(df, ["x"], ["g"], buckets=16).collect()}
    for (g, x), below in got.items():
        assert below == sum(1 for i, v in enumerate(vals) if i % 3 == g and v < x)
    med = {r.g: r.median for r in exact_median(df, "x", ["g"], buckets=8).collect()}
    import statistics
    for g in range(3):
        assert abs(med[g] - statistics.median(v for i, v in enumerate(vals) if i % 3 == g)) < 1e-12


# --- transcripts and traces (section 7) -----------------------------------------------

def test_transcripts(spark):
    segs = [("v1", 2, "b"), ("v1", 1, "a"), ("v2", 1, "x" * 3000)] + \
        [("v3", i, chr(96 + i % 26 + 1) * 99) for i in range(1, 41)]
    t = {r.video_id: r for r in E.transcripts(spark.createDataFrame(segs, "video_id string, seq long, text string"))
         .collect()}
    assert (t["v1"].transcript, t["v1"].transcript_length) == ("a b", 3)
    assert t["v2"].transcript == "x" * 3000
    v3 = t["v3"]
    full = " ".join(chr(96 + i % 26 + 1) * 99 for i in range(1, 41))
    assert v3.full_length == len(full) == 3999
    assert v3.transcript == full[:3000] + "... [truncated, 3999 chars total]"
    assert v3.transcript_length == 3033  # X3: measured after the suffix
    seg3001 = spark.createDataFrame([("w", 1, "z" * 3001)], "video_id string, seq long, text string")
    w = E.transcripts(seg3001).collect()[0]
    assert (w.full_length, w.transcript_length) == (3001, 3033)
    assert w.transcript == "z" * 3000 + "... [truncated, 3001 chars total]"
    req = spark.createDataFrame([("v1",), ("none",)], "video_id string")
    st = {r.video_id: r.status for r in E.transcript_lookup(E.transcripts(spark.createDataFrame(
        segs, "video_id string, seq long, text string")), req).collect()}
    assert st == {"v1": "success", "none": "error"}


def test_traces(spark):
    sub = "submit_assessment"
    A, B, C = '{"summary": "A"}', '{"summary": "B"}', '{"summary": "C"}'
    rows = [
        ("t1", 1, 0, "tool_use", "fetch_transcript", "{}"), ("t1", 1, 1, "tool_use", "compute_engagement_metrics", "{}"),
        ("t1", 2, 0, "tool_use", sub, A),
        ("t2", 1, 0, "tool_use", sub, A), ("t2", 1, 1, "tool_use", "analyze_channel_patterns", "{}"),
        ("t3", 1, 0, "tool_use", "bogus", "{}"), ("t3", 2, 0, "tool_use", sub, A),
        ("t4", 1, 0, "tool_use", sub, A), ("t4", 1, 1, "tool_use", sub, B),
        ("t5", 1, 0, "tool_use", sub, "{}"), ("t5", 2, 0, "tool_use", sub, C),
        ("t6", 1, 0, "tool_use", sub, A), ("t6", 1, 1, "tool_use", sub, "{}"), ("t6", 2, 0, "text", None, None),
        ("t7", 1, 0, "text", None, None),
    ] + [("t8", r, 0, "tool_use", "fetch_transcript", "{}") for r in range(1, 8)]
    tr = spark.createDataFrame(rows, "video_id string, round int, pos int, block_type string, tool_name string,"
                                     " input_json string")
    s = {r.video_id: r for r in TR.summarise(tr).collect()}
    assert (s["t1"].tools_used, s["t1"].tool_rounds, s["t1"].outcome) == (
        ["fetch_transcript", "compute_engagement_metrics", sub], 2, "assessed")
    assert (s["t2"].tools_used, s["t2"].tool_rounds) == ([sub, "analyze_channel_patterns"], 1)
    assert (s["t3"].tools_used, s["t3"].tool_rounds, s["t3"].error_calls) == ([sub], 0, 1)
    assert s["t4"].assessment == B and s["t5"].assessment == C
    assert s["t6"].outcome == "empty_assessment" and s["t6"].assessment == "{}"
    assert s["t7"].outcome == "stopped_without_tools" and s["t8"].outcome == "round_cap"
    meta = spark.createDataFrame([("t1", "T", "C")], "video_id string, api_title string, api_channel_title string")
    rep = {r.video_id: r for r in TR.report_rows(TR.summarise(tr), meta, F.current_timestamp()).collect()}
    assert set(rep) == {"t1", "t2", "t3", "t4", "t5", "t6"}
    assert rep["t6"].tools_used == [] and rep["t6"].tool_rounds == 0 and rep["t1"].title == "T"
    order = {(r.tool_name, r.position): r.calls for r in TR.tool_order(TR.summarise(tr)).collect()}
    assert order[(sub, 1)] == 5  # t2, t3, t4, t5, t6 open with a submit


# --- selection (section 8) ---------------------------------------------------------

def test_selection(spark):
    meta = spark.createDataFrame([("u", S.UNAVAILABLE_TITLE), ("n", None), ("x", "x")],
                                 "video_id string, api_title string")
    assert sorted(r[0] for r in SM.available(meta).collect()) == ["n", "x"]  # TR9
    items = spark.createDataFrame([("a",), ("b",)], "video_id string")
    done = spark.createDataFrame([("a",)], "video_id string")
    assert [r[0] for r in SM.pending(items, done).collect()] == ["b"]
    assert SM.pending(items, done, resume=False).count() == 2

    ten = spark.range(10).select(F.col("id").cast("string").alias("video_id"))
    s1 = sorted(r[0] for r in SM.seeded(ten, 3).collect())
    s2 = sorted(r[0] for r in SM.seeded(ten.repartition(5), 3).collect())
    assert len(s1) == 3 and s1 == s2
    for n in (10, 20, 0, None):
        assert SM.seeded(ten, n).count() == 10
    scored = spark.createDataFrame([(str(i),) for i in range(4)], "video_id string")
    p3 = SM.priority(ten, scored, 3).collect()
    assert len(p3) == 3 and all(r.is_scored for r in p3)
    p6 = SM.priority(ten, scored, 6).collect()
    assert sum(r.is_scored for r in p6) == 4 and len(p6) == 6


def test_samples_are_exact_for_any_n(spark):
    """One rule for every n: md5 order, NULL ids last, min(n, size) rows."""
    rows = [("a",), ("a",), (None,), ("b",), ("c",), ("c",), ("c",)] + [(f"v{i}",) for i in range(40)]
    ids = spark.createDataFrame(rows, "video_id string")
    draws = {n: sorted(str(r[0]) for r in SM.seeded(ids.repartition(5), n).collect()) for n in (1, 2, 3, 5, 45, 46, 47, 60)}
    for n, got in draws.items():
        assert len(got) == min(n, 47)
    for small, large in zip(list(draws), list(draws)[1:]):
        rest = list(draws[large])
        for v in draws[small]:
            rest.remove(v)  # a larger draw holds the smaller one
    assert "None" not in draws[46] and "None" in draws[47]
    scored = spark.createDataFrame([("c",), (None,)], "video_id string")
    assert sorted(r[0] for r in SM.priority(ids, scored, 2).collect()) == ["c", "c"]


def test_repeated_metadata_gives_the_first_row(spark):
    rows = [("v", 100, 1, 60, 2), ("v", 100, 90, 60, 1), ("w", 50, 5, 60, 3)]
    meta = spark.createDataFrame(rows, "video_id string, view_count long, like_count long, duration_seconds long, "
                                       "ingest_order long").withColumn("comment_count", F.lit(1).cast("long"))
    for shuffled in (meta, meta.orderBy(F.desc("ingest_order")).coalesce(1), meta.repartition(3)):
        got = {r.video_id: r.like_to_view_ratio for r in E.engagement_metrics(shuffled).collect()}
        assert got == {"v": 0.9, "w": 0.1}


def test_null_ids_and_unique_metadata_join_plainly(spark):
    watch = spark.createDataFrame([(None, "2024-01-01"), ("a", "2024-02-01"), ("z", None)], "video_id string, t string")
    watch = watch.withColumn("timestamp", F.to_timestamp_ntz("t")).drop("t")
    meta = spark.createDataFrame([("a", 3600, "10")], "video_id string, duration_seconds long, category_id string")
    for unique in (False, True):
        got = {r.video_id: (r.duration_hours, r.category) for r in history.watch_enriched(watch, meta, unique=unique).collect()}
        assert got == {None: (None, "Unknown"), "a": (1.0, "Music"), "z": (None, "Unknown")}


def test_failed_call_loses_its_own_batch_only(spark):
    def service(ids):
        if "13" in ids:
            raise ValueError("boom")
        return {"items": [{"id": i} for i in ids]}
    ids = spark.range(200).select(F.col("id").cast("string").alias("video_id"))
    landed = L.fetch(ids, service, batch_size=10, max_parallel=4).cache()
    assert landed.rdd.getNumPartitions() == 4
    failed = landed.where("response is null").collect()
    assert len(failed) == 1 and failed[0].error == "ValueError: boom" and "13" in failed[0].requested
    stored = L.resolve(landed)
    assert stored.count() == 200 - len(failed[0].requested)
    assert sorted(r[0] for r in L.pending_ids(ids, stored).collect()) == sorted(failed[0].requested)


def test_failed_trace(spark):
    from viewlens.operators import traces
    rows = [("a", 1, 0, "tool_use", "fetch_transcript", "{}"), ("a", 2, 0, "error", None, None),
            ("b", 1, 0, "tool_use", "fetch_transcript", "{}"), ("b", 2, 0, "text", None, None)]
    t = spark.createDataFrame(rows, "video_id string, round int, pos int, block_type string, tool_name string, input_json string")
    got = {r.video_id: r.outcome for r in traces.summarise(t).collect()}
    assert got == {"a": "failed", "b": "stopped_without_tools"}


def test_transcript_failures_have_their_reason(spark):
    table = E.transcripts(spark.createDataFrame([("a", 1, "x")], "video_id string, seq long, text string"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    failures = spark.createDataFrame([("b", "unavailable", "subtitles are off")], "video_id string, status string, reason string")
    got = {r.video_id: (r.status, r.reason) for r in E.transcript_lookup(table, asked, failures=failures).collect()}
    assert got == {"a": ("success", None), "b": ("unavailable", "subtitles are off"), "c": ("error", "no transcript segments")}


def test_watch_csv_round_trip(spark, tmp_path):
    from viewlens import schemas as S
    from viewlens.sources import io
    import datetime as dt
    rows = [('a "b"\nc', "u", "v1", "ch, x", None, dt.datetime(2024, 1, 2, 3, 4, 5), "normal"), (None,) * 7]
    df = spark.createDataFrame(rows, S.WATCH)
    io.write_csv(df, str(tmp_path / "w"))
    assert sorted(map(str, io.read_csv(spark, str(tmp_path / "w"), S.WATCH).collect())) == sorted(map(str, df.collect()))


def test_evaluation_text_without_title_column(spark):
    meta = spark.createDataFrame([("v", None, 1, 1, 1, 60, None, None)], "video_id string, api_title string, view_count long, "
                                 "like_count long, comment_count long, duration_seconds long, tags array<string>, description string")
    text = J.evaluation_text(meta.withColumn("category_id", F.lit("10"))).first().prompt
    assert "Title: Unknown" in text and "Channel: Unknown" in text


def test_dedupe_first_by_order_tuple(spark):
    # a hot key holding most rows, ties on the first order column broken by the second
    rows = [("hot", 5, i, f"r{i}") for i in range(300, 0, -1)] + [("hot", 4, 9, "win"), ("cold", 1, 2, "b"),
                                                                   ("cold", 1, 1, "a")]
    df = spark.createDataFrame(rows, "video_id string, o1 long, o2 long, v string").repartition(5)
    got = {r.video_id: (r.o1, r.o2, r.v) for r in history.dedupe_first(df, "video_id", ["o1", "o2"]).collect()}
    assert got == {"hot": (4, 9, "win"), "cold": (1, 1, "a")}
    assert history.dedupe_first(df, "video_id").count() == 2


def test_bucket_of_matches_counting(spark):
    import random
    from viewlens.operators.ranking import bucket_of
    rnd = random.Random(7)
    rows = []
    for buckets in (2, 3, 5, 64, 256):
        for _ in range(40):
            arr = sorted(rnd.sample(range(-50, 50), rnd.randint(0, min(buckets - 1, 60))))
            x = rnd.randint(-60, 60) if rnd.random() < 0.7 else rnd.choice(arr or [0])  # exact ties
            rows.append((buckets, arr, x, sum(b < x for b in arr)))
    df = spark.createDataFrame(rows, "buckets int, b array<long>, x long, want long")
    for buckets in (2, 3, 5, 64, 256):
        got = bucket_of(df.filter(F.col("buckets") == buckets), "b", "x", buckets, "k")
        assert got.filter(F.col("k") != F.col("want")).count() == 0


def test_exact_medians_one_pass_matches_brute_force(spark):
    import random
    import statistics
    from viewlens.operators.ranking import exact_medians
    rnd = random.Random(11)
    # group 0 is hot (a third of all rows share one value); y is NULL for group 2
    rows = [(0, 7, rnd.randint(0, 9)) for _ in range(900)] + \
        [(g, rnd.randint(0, 50), None if g == 2 else rnd.randint(0, 9)) for g in (0, 1, 2) for _ in range(600)]
    df = spark.createDataFrame(rows, "g int, x long, y long")
    got = {r.g: (r.median_x, r.median_y) for r in exact_medians(df, ["x", "y"], ["g"], buckets=8).collect()}
    for g in (0, 1, 2):
        xs = [x for gg, x, _ in rows if gg == g]
        ys = [y for gg, _, y in rows if gg == g and y is not None]
        assert got[g][0] == statistics.median(xs)
        assert got[g][1] == (statistics.median(ys) if ys else None)



def test_null_keys_grouping_and_duplicate_metadata(spark):
    """TR6: NULL year / month / channel rows count in the totals but form no
    group. TR18: a repeated metadata key does not multiply watch rows."""
    watch = spark.createDataFrame([("a", ts("2024-01-05 00:00:00")), ("a", None), ("b", None)],
                                  "video_id string, timestamp timestamp_ntz")
    meta = spark.createDataFrame([("a", 60, "10"), ("a", 60, "10")],
                                 "video_id string, duration_seconds long, category_id string")
    e = history.watch_enriched(watch, meta)
    assert e.count() == 3
    assert reports.totals(e).collect()[0].events == 3
    assert [tuple(r) for r in reports.events_by_year(e).collect()] == [(2024, 1)]
    assert [r.month for r in reports.monthly_hours(e).collect()] == [dt.date(2024, 1, 1)]


def test_channel_trend_null_timestamps_count_in_second_half(spark):
    """TR17: a NULL watch time is never before the midpoint, so it falls in
    the second half (total - first half); first/last ignore it."""
    d = lambda s: ts(s + " 00:00:00")
    rows = [("X", "a", d("2024-01-01")), ("X", "b", d("2024-01-02")), ("X", "c", d("2024-03-31"))] + \
        [("X", "n", None)] * 3
    r = E.channel_patterns(spark.createDataFrame(rows, "channel_name string, video_id string, timestamp timestamp_ntz")) \
        .collect()[0]
    assert (r.total_watches, r.span_days) == (6, 90)
    assert r.first_watch == d("2024-01-01") and r.last_watch == d("2024-03-31")
    assert r.engagement_trend == "increasing"  # halves 2 / 4: 4 > 2 * 1.5


def test_csv_only_empty_field_is_null(spark, tmp_path):
    """TR11 + TR12: quotes and newlines survive; 'None', 'NA', 'null' stay text."""
    rows = [(1, "None"), (2, "NA"), (3, "null"), (4, ""), (5, 'say "hi"\nbye'), (6, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = str(tmp_path / "csv")
    io.write_csv(df, path)
    back = {r.doc_id: r.text for r in io.read_csv(spark, path, "doc_id bigint, text string").collect()}
    assert back == {1: "None", 2: "NA", 3: "null", 4: None, 5: 'say "hi"\nbye', 6: None}


def test_landed_lookup_calls_each_batch_once(spark, tmp_path):
    """Resolving reads the responses three times (items, requested ids,
    missing ids); with the responses landed first, the service is called
    exactly ceil(n / 50) times when max_parallel=1 gathers the ids in one task."""
    log = tmp_path / "calls.log"

    def service(ids, log=str(log)):
        with open(log, "a") as fh:
            fh.write(",".join(ids) + "\n")
        return {"items": [{"id": i, "snippet": {"title": f"t{i}"}} for i in ids if int(i) % 3]}

    ids = spark.range(120).select(F.col("id").cast("string").alias("video_id")).repartition(6)
    landed = L.fetch_landed(ids, service, str(tmp_path / "landed"), max_parallel=1)
    rows = L.resolve(landed).collect()
    assert len(rows) == 120
    assert sum(r.api_title == S.UNAVAILABLE_TITLE for r in rows) == 40
    assert len(log.read_text().splitlines()) == 3


def test_transcripts_match_join_and_cut(spark):
    """X1-X3 against the rule itself: ' '.join in order, cut at `limit` with
    the suffix; covers empty segments, one huge segment, exact boundaries."""
    import random
    rnd = random.Random(5)
    limit = 40
    segs, want = [], {}
    for v in range(60):
        n = rnd.choice([1, 2, 3, 8, 20])
        texts = [("z" * 500 if rnd.random() < 0.05 else "".join(rnd.choice("ab") for _ in range(rnd.choice([0, 1, 5, 9, 13]))))
                 for _ in range(n)]
        for i, t in enumerate(texts):
            segs.append((f"v{v}", i + 1, t))
        full = " ".join(texts)
        want[f"v{v}"] = (full if len(full) <= limit else
                         full[:limit] + f"... [truncated, {len(full)} chars total]", len(full))
    df = spark.createDataFrame(segs, "video_id string, seq long, text string").repartition(4)
    got = {r.video_id: (r.transcript, r.full_length) for r in E.transcripts(df, limit=limit).collect()}
    assert got == want


def test_escaped_href_parity_and_option(spark):
    """TR4: '&amp;v=' is key 'amp;v' by default (no id); unescape_href=True decodes it."""
    block = CELL + '<a href="https://www.youtube.com/watch?l=1&amp;v=XYZ">t</a><br>Jan 1, 2024, 1:00:00 AM EST</div>'
    blocks = spark.createDataFrame([(block,)], "block string")
    assert ingest.parse_blocks(blocks).collect()[0].video_id is None
    r = ingest.parse_blocks(blocks, unescape_href=True).collect()[0]
    assert (r.video_id, r.video_url) == ("XYZ", "https://www.youtube.com/watch?l=1&v=XYZ")


def test_category_context_approx_median_is_a_middle_value(spark):
    import random
    rnd = random.Random(3)
    meta_rows = [(f"v{i}", str(rnd.choice([10, 24, 27])), rnd.randint(0, 1000), rnd.randint(0, 50)) for i in range(400)]
    meta = spark.createDataFrame(meta_rows, "video_id string, category_id string, view_count long, like_count long")
    watch = spark.createDataFrame([(r[0],) for r in meta_rows], "video_id string")
    exact = {r.category_id: r for r in E.category_context(watch, meta).collect()}
    approx = {r.category_id: r for r in E.category_context(watch, meta, approx=True).collect()}
    assert set(exact) == set(approx)
    for cat, r in approx.items():
        views = sorted(v for _, c, v, _ in meta_rows if c == cat)
        n = len(views)
        lo, hi = views[(n - 1) // 2], views[n // 2]
        assert lo <= r.median_views <= hi
        assert (r.total_watches, r.unique_videos) == (exact[cat].total_watches, exact[cat].unique_videos)
