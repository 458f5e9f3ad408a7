"""Judgment, sampling and trace queries (S12, V1-V8, A27, P28-P36, T6-T8, J3,
J4, J9, U1, G1-G7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.operators import judgments as J
from viewlens.operators import sampling as SM
from viewlens.operators import traces as TR
from viewlens.plans import standins as V
from viewlens.plans.catalog import half_even_sql as HE
from viewlens.plans.catalog import register, with_ctes
from viewlens.sources import io

CLOCK = "2026-01-01 00:00:00"
MODEL = "judge-v1"


def clock():
    return F.lit(CLOCK).cast("timestamp_ntz")


# --- responses built from events --------------------------------------------
# k = props.k; five raw dims from event fields; the event type decides the
# label and the defects (bad JSON, string/float/missing/null dims, fences).

def responses(spark, base):
    ev = io.read_table(spark, base, "events")
    k = F.from_json("props", "k bigint")["k"]
    et = F.col("event_type")
    df = ev.select(F.col("event_id").alias("video_id"), k.alias("k"), et.alias("et"),
                   "user_id", "event_id")
    k, et = F.col("k"), F.col("et")
    # staged projections: body and text are referenced, not re-inlined
    d1 = (k % 7 - 1).cast("string")
    depth = (F.when((et == "signup") & (k < 25), F.concat(F.lit('"'), d1, F.lit('"')))
             .when((et == "purchase") & (k < 15), F.concat(d1, F.lit(".0"))).otherwise(d1))
    effort = (F.when((et == "click") & (k < 10), F.lit(""))
              .when((et == "click") & (k >= 60), F.lit(', "effort": null'))
              .otherwise(F.concat(F.lit(', "effort": '), (F.col("event_id") % 5 + 1).cast("string"))))
    label = (F.when(et == "view", F.lit('"triage_label": "deep", '))
             .when(et == "click", F.lit('"triage_label": "useful", '))
             .when(et == "purchase", F.lit('"triage_label": "great", '))
             .when(et == "error", F.lit('"triage_label": null, ')).otherwise(F.lit("")))
    body = F.concat(F.lit('{"depth": '), depth, F.lit(', "rigor": '), (k % 5 + 1).cast("string"),
                    F.lit(', "novelty": '), (F.col("user_id") % 7).cast("string"), effort,
                    F.lit(', "engagement_quality": '), (F.floor(k / 10) % 6 + 1).cast("string"),
                    F.lit(", "), label, F.lit('"rationale": "'), et, F.lit(" "), k.cast("string"),
                    F.lit('"}'))
    df = df.withColumn("_body", body)
    body = F.col("_body")
    prefix = (F.when((et == "view") & (k % 2 == 0), F.lit("```json\n"))
              .when((et == "purchase") & (k >= 80), F.lit("```\n"))
              .when(et == "signup", F.lit("  ")).otherwise(F.lit("")))
    suffix = (F.when((et == "view") & (k % 2 == 0), F.lit("\n```"))
              .when((et == "purchase") & (k >= 80), F.lit("\n``` see above"))
              .when(et == "signup", F.lit("\n")).otherwise(F.lit("")))
    text = (F.when((et == "error") & (k < 30), F.concat(F.lit("oops "), k.cast("string")))
            .when((et == "error") & (k >= 90), F.lit("```nofence"))
            .otherwise(F.concat(prefix, body, suffix)))
    df = df.withColumn("_text", text)
    text = F.col("_text")
    block = "struct<type:string,text:string>"
    content = F.array(
        F.struct(F.lit("text").alias("type"), F.substring(text, 1, 10).alias("text")).cast(block),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text")).cast(block),
        F.struct(F.lit("text").alias("type"), F.substring(text, 11, 1 << 30).alias("text")).cast(block))
    return df.select("video_id", content.alias("content"))


RESP_SQL = """ev AS (SELECT event_id AS video_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  event_type AS et, user_id, event_id FROM events)""", """b AS (SELECT *,
  '{"depth": ' || CASE WHEN et = 'signup' AND k < 25 THEN '"' || CAST(k % 7 - 1 AS VARCHAR) || '"'
      WHEN et = 'purchase' AND k < 15 THEN CAST(k % 7 - 1 AS VARCHAR) || '.0' ELSE CAST(k % 7 - 1 AS VARCHAR) END
  || ', "rigor": ' || CAST(k % 5 + 1 AS VARCHAR) || ', "novelty": ' || CAST(user_id % 7 AS VARCHAR)
  || CASE WHEN et = 'click' AND k < 10 THEN '' WHEN et = 'click' AND k >= 60 THEN ', "effort": null'
      ELSE ', "effort": ' || CAST(event_id % 5 + 1 AS VARCHAR) END
  || ', "engagement_quality": ' || CAST((k // 10) % 6 + 1 AS VARCHAR) || ', '
  || CASE et WHEN 'view' THEN '"triage_label": "deep", ' WHEN 'click' THEN '"triage_label": "useful", '
      WHEN 'purchase' THEN '"triage_label": "great", ' WHEN 'error' THEN '"triage_label": null, ' ELSE '' END
  || '"rationale": "' || et || ' ' || CAST(k AS VARCHAR) || '"}' AS body,
  CASE WHEN et = 'error' AND (k < 30 OR k >= 90) THEN 'json_error'
       WHEN (et = 'signup' AND k < 25) OR (et = 'purchase' AND k < 15) OR (et = 'click' AND (k < 10 OR k >= 60))
       THEN 'invalid_dim' ELSE 'ok' END AS status,
  greatest(1, least(5, k % 7 - 1)) AS c1, greatest(1, least(5, k % 5 + 1)) AS c2,
  greatest(1, least(5, user_id % 7)) AS c3, greatest(1, least(5, event_id % 5 + 1)) AS c4,
  greatest(1, least(5, (k // 10) % 6 + 1)) AS c5 FROM ev)""", """v AS (SELECT *,
  round(CAST(c1 + c2 + c3 + c4 + c5 AS DOUBLE) / 5, 2) AS composite_score,
  CASE et WHEN 'view' THEN 'deep' WHEN 'click' THEN 'useful' ELSE
    CASE WHEN CAST(c1 + c2 + c3 + c4 + c5 AS DOUBLE) / 5 >= 4 THEN 'deep'
         WHEN CAST(c1 + c2 + c3 + c4 + c5 AS DOUBLE) / 5 >= 3 THEN 'useful'
         WHEN CAST(c1 + c2 + c3 + c4 + c5 AS DOUBLE) / 5 >= 2 THEN 'mixed' ELSE 'shallow' END END AS triage_label
  FROM b)"""

RESP = with_ctes(*RESP_SQL)


def validated(spark, base):
    r = responses(spark, base)
    return J.validate(r.select("video_id", J.response_text("content").alias("text")))


@register("response_text", RESP + """SELECT video_id, CASE
  WHEN et = 'error' AND k < 30 THEN 'oops ' || CAST(k AS VARCHAR)
  WHEN et = 'error' AND k >= 90 THEN '```nofence'
  WHEN (et = 'view' AND k % 2 = 0) OR (et = 'purchase' AND k >= 80) THEN body || chr(10)
  ELSE body END AS text FROM b""")
def q_response_text(spark, base):
    """S12 + V1: text blocks joined, fences removed."""
    r = responses(spark, base).select("video_id", J.response_text("content").alias("_raw"))
    return r.select("video_id", J.unfence(F.col("_raw")).alias("text"))


@register("judgment_parse", RESP + """SELECT video_id, status,
  CASE WHEN status = 'ok' THEN c1 END AS depth, CASE WHEN status = 'ok' THEN c2 END AS rigor,
  CASE WHEN status = 'ok' THEN c3 END AS novelty, CASE WHEN status = 'ok' THEN c4 END AS effort,
  CASE WHEN status = 'ok' THEN c5 END AS engagement_quality FROM b""")
def q_judgment_parse(spark, base):
    """V2-V4: parse, strict integer dims, clamp."""
    return validated(spark, base).select("video_id", "status", *S.QUALITY_DIMENSIONS)


@register("judgment_label", RESP + """SELECT video_id, composite_score, triage_label,
  et || ' ' || CAST(k AS VARCHAR) AS rationale FROM v WHERE status = 'ok'""")
def q_judgment_label(spark, base):
    """V5 + V6: composite and label (vocabulary label kept, else thresholds)."""
    ok, _ = J.split(validated(spark, base))
    return ok.select("video_id", "composite_score", "triage_label", "rationale")


@register("judgment_rejects", RESP + """SELECT status AS reason, count(*) AS rows FROM b
  WHERE status <> 'ok' GROUP BY status""")
def q_judgment_rejects(spark, base):
    """V7: quarantine counts by reason."""
    return J.rejects_by_reason(validated(spark, base))


@register("score_summary", RESP + f""", t AS (SELECT count(*) FILTER (WHERE status = 'ok') AS scored,
  count(*) FILTER (WHERE status <> 'ok') AS errors FROM v),
  c AS (SELECT triage_label, count(*) AS n FROM v WHERE status = 'ok' GROUP BY triage_label)
  SELECT l.triage_label, coalesce(c.n, 0) AS label_count,
    CASE WHEN t.scored > 0 THEN {HE('coalesce(c.n, 0) * 100', 't.scored', 1)} ELSE 0.0 END AS pct,
    t.scored, t.errors
  FROM (VALUES ('deep'), ('useful'), ('mixed'), ('shallow')) l(triage_label)
  LEFT JOIN c USING (triage_label) CROSS JOIN t""")
def q_score_summary(spark, base):
    """A27 + T5: label counts with zeros, percents, scored and errors."""
    return J.summary(validated(spark, base))


@register("score_rows", RESP + f""", d AS (SELECT doc_id AS video_id, text AS title FROM documents)
  SELECT v.video_id, c1 AS depth, c2 AS rigor, c3 AS novelty, c4 AS effort, c5 AS engagement_quality,
    composite_score, triage_label, et || ' ' || CAST(k AS VARCHAR) AS rationale, '{MODEL}' AS model,
    TIMESTAMP '{CLOCK}' AS scored_at, substr(d.title, 1, 60) AS title_preview
  FROM v LEFT JOIN d USING (video_id) WHERE status = 'ok'""")
def q_score_rows(spark, base):
    """P28 + P30: stored score rows (model tag, clock, 60-char preview)."""
    ok, _ = J.split(validated(spark, base))
    titles = io.read_table(spark, base, "documents").select(
        F.col("doc_id").alias("video_id"), F.col("text").alias("title"))
    return J.score_rows(ok, titles, MODEL, clock())


# --- evaluation text over documents -------------------------------------------

def doc_items(spark, base):
    d = io.read_table(spark, base, "documents")
    return d.select(
        F.col("doc_id").alias("video_id"), F.col("source").alias("api_title"),
        F.col("lang").alias("api_channel_title"),
        (F.col("n_chars") % 44 + 1).cast("string").alias("category_id"),
        (F.col("n_chars") - 100).alias("duration_seconds"),
        (F.col("n_chars") * 1000 + F.col("doc_id")).alias("view_count"),
        F.when(F.col("lang") != "de", F.col("n_chars")).alias("like_count"),
        F.col("doc_id").alias("comment_count"),
        F.when(F.col("lang") != "es", F.split("text", " ")).alias("tags"),
        F.col("text").alias("description"))


DUR_SQL = """CASE WHEN d IS NULL OR d <= 0 THEN 'N/A'
  WHEN d // 3600 > 0 THEN printf('%dh%02dm%02ds', d // 3600, (d // 60) % 60, d % 60)
  ELSE printf('%dm%02ds', (d // 60) % 60, d % 60) END"""


@register("evaluation_text", f"""SELECT video_id, 'Evaluate this YouTube video:' || chr(10) || chr(10)
  || 'Title: ' || api_title || chr(10) || 'Channel: ' || api_channel_title || chr(10)
  || 'Category: ' || category_id || chr(10) || 'Duration: ' || {DUR_SQL} || chr(10)
  || 'Views: ' || coalesce(format('{{:,}}', view_count), 'N/A')
  || ' | Likes: ' || coalesce(format('{{:,}}', like_count), 'N/A')
  || ' | Comments: ' || coalesce(format('{{:,}}', comment_count), 'N/A') || chr(10)
  || 'Tags: ' || CASE WHEN tags IS NULL OR len(tags) = 0 THEN 'None'
       ELSE array_to_string(list_slice(tags, 1, 15), ', ') END || chr(10)
  || 'Description:' || chr(10) || description || chr(10) AS prompt
  FROM (SELECT doc_id AS video_id, source AS api_title, lang AS api_channel_title,
    CAST(n_chars % 44 + 1 AS VARCHAR) AS category_id, n_chars - 100 AS d, n_chars * 1000 + doc_id AS view_count,
    CASE WHEN lang <> 'de' THEN n_chars END AS like_count, doc_id AS comment_count,
    CASE WHEN lang <> 'es' THEN string_split(text, ' ') END AS tags, text AS description FROM documents)""")
def q_evaluation_text(spark, base):
    """P31-P36 + T9 over every document (whole text as description)."""
    return J.evaluation_text(doc_items(spark, base))


def assessments(spark, base):
    ev = io.read_table(spark, base, "events")
    k = F.from_json("props", "k bigint")["k"]
    et = F.col("event_type")
    label = (F.when(et == "view", "deep").when(et == "click", "useful")
             .when(et == "purchase", "great").when(et == "signup", "mixed"))
    conf = F.element_at(F.array(*[F.lit(x) for x in [*S.CONFIDENCE_LEVELS, "sure"]]), (k % 4 + 1).cast("int"))
    ctype = F.element_at(F.array(*[F.lit(x) for x in [*S.CONTENT_TYPES, "vlog"]]), (k % 11 + 1).cast("int"))
    signals = F.slice(F.array(*[F.lit(x) for x in "abcdef"]), 1, (k % 7).cast("int"))
    summary = F.when(k % 13 != 0, et)
    a = F.to_json(F.struct(label.alias("triage_label"), conf.alias("confidence"),
                           ctype.alias("content_type"), signals.alias("key_signals"),
                           summary.alias("summary")))
    return ev.select(F.col("event_id").alias("video_id"), a.alias("assessment"))


@register("assessment_check", """SELECT video_id,
  coalesce(label IN ('deep', 'useful', 'mixed', 'shallow'), false) AS label_ok,
  k % 4 < 3 AS confidence_ok, k % 11 < 10 AS content_type_ok, k % 7 BETWEEN 3 AND 5 AS signals_ok,
  label IS NOT NULL AND k % 13 <> 0 AS required_ok,
  coalesce(label IN ('deep', 'useful', 'mixed', 'shallow'), false) AND k % 4 < 3 AND k % 11 < 10
    AND k % 7 BETWEEN 3 AND 5 AND label IS NOT NULL AND k % 13 <> 0 AS valid
  FROM (SELECT event_id AS video_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'view' THEN 'deep' WHEN 'click' THEN 'useful' WHEN 'purchase' THEN 'great'
      WHEN 'signup' THEN 'mixed' END AS label FROM events)""")
def q_assessment_check(spark, base):
    """V8: vocabulary flags of submitted assessments."""
    return J.assessment_check(assessments(spark, base))


# --- selection ---------------------------------------------------------------

AVAIL_SQL = with_ctes(V.META_SQL, """avail AS (SELECT video_id, api_title FROM meta
  WHERE api_title IS DISTINCT FROM '[unavailable]')""",
  """pend AS (SELECT * FROM avail a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.video_id))""")


def scored_keys(spark, base):
    return io.read_table(spark, base, "labels").select(F.col("doc_id").alias("video_id"))


def pending_scores(spark, base):
    items = SM.available(V.meta(spark, base)).select("video_id", "api_title")
    return SM.pending(items, scored_keys(spark, base))


@register("pending_scores", AVAIL_SQL + "SELECT video_id, api_title FROM pend")
def q_pending_scores(spark, base):
    """P22 + J3: available videos not yet scored."""
    return pending_scores(spark, base)


@register("seeded_sample", AVAIL_SQL + """SELECT video_id, api_title FROM pend
  ORDER BY md5(CAST(video_id AS VARCHAR) || ':42'), video_id LIMIT 50""")
def q_seeded_sample(spark, base):
    """50 pending videos, seed 42, partition-independent."""
    return SM.seeded(pending_scores(spark, base), 50, seed=42)


PRIORITY_SQL = AVAIL_SQL + """, tri AS (SELECT * FROM avail a WHERE NOT EXISTS (
    SELECT 1 FROM labels l WHERE l.doc_id = a.video_id AND l.toxic = 1)),
  flagged AS (SELECT t.video_id, t.api_title, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.video_id)
    AS is_scored FROM tri t)"""


def triage_items(spark, base):
    done = io.read_table(spark, base, "labels").filter(F.col("toxic") == 1).select(
        F.col("doc_id").alias("video_id"))
    items = SM.available(V.meta(spark, base)).select("video_id", "api_title")
    return SM.pending(items, done)


@register("priority_sample", PRIORITY_SQL + """SELECT video_id, api_title, is_scored FROM flagged
  ORDER BY CASE WHEN is_scored THEN 0 ELSE 1 END, md5(CAST(video_id AS VARCHAR) || ':42'), video_id LIMIT 500""")
def q_priority_sample(spark, base):
    """T7 + J9 + J4: 500 untriaged videos, scored ones first."""
    return SM.priority(triage_items(spark, base), scored_keys(spark, base), 500, seed=42)


@register("pool_union", PRIORITY_SQL + """SELECT * FROM (SELECT video_id, api_title, is_scored FROM flagged
  WHERE is_scored ORDER BY md5(CAST(video_id AS VARCHAR) || ':42'), video_id LIMIT 25)
  UNION ALL SELECT * FROM (SELECT video_id, api_title, is_scored FROM flagged WHERE NOT is_scored
  ORDER BY md5(CAST(video_id AS VARCHAR) || ':42'), video_id LIMIT 25)""")
def q_pool_union(spark, base):
    """Two seeded pools concatenated."""
    f = SM.with_scored_flag(triage_items(spark, base), scored_keys(spark, base))
    return SM.pool_union(SM.seeded(f.filter("is_scored"), 25), SM.seeded(f.filter("not is_scored"), 25))


@register("pending_triage", """SELECT doc_id, source FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def q_pending_triage(spark, base):
    """J4 + A28: documents without a (toxic) report yet."""
    d = io.read_table(spark, base, "documents").select("doc_id", "source")
    done = io.read_table(spark, base, "labels").filter(F.col("toxic") == 1)
    return SM.pending(d, done, key="doc_id")


@register("plain_sample", """SELECT doc_id, source FROM documents
  ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 50""")
def q_plain_sample(spark, base):
    """Plain sample (no score pool), here seeded for repeatability."""
    d = io.read_table(spark, base, "documents").select("doc_id", "source")
    return SM.seeded(d, 50, key="doc_id", seed=7)


# --- traces from conversations -------------------------------------------------

def trace(spark, base):
    c = io.read_table(spark, base, "conversations")
    role, turn = F.col("role"), F.col("turn")
    tools = F.array(*[F.lit(x) for x in S.EVIDENCE_TOOLS])
    name = (F.when(role == "assistant", F.lit(S.SUBMIT_TOOL))
            .when(role == "user", F.element_at(tools, ((F.col("conv_id") + turn) % 4 + 1).cast("int")))
            .otherwise(F.lit("search_web")))
    inp = F.when((role == "assistant") & (F.length("text") >= 120), F.concat(
        F.lit('{"summary": "c'), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"),
        F.lit('"}'))).otherwise(F.lit("{}"))
    return c.select(
        F.col("conv_id").alias("video_id"), (F.floor(turn / 2) + 1).cast("int").alias("round"),
        (turn % 2).cast("int").alias("pos"),
        F.when((role == "system") & (turn % 2 == 1), "text").otherwise("tool_use").alias("block_type"),
        name.alias("tool_name"), inp.alias("input_json"))


KNOWN_SQL = ", ".join(f"'{x}'" for x in [*S.EVIDENCE_TOOLS, S.SUBMIT_TOOL])
TOOLS_LIST = "[" + ", ".join(f"'{x}'" for x in S.EVIDENCE_TOOLS) + "]"

TRACE_SQL = with_ctes(f"""t AS (SELECT conv_id AS video_id, CAST(turn // 2 + 1 AS INTEGER) AS round,
  CAST(turn % 2 AS INTEGER) AS pos,
  CASE WHEN role = 'system' AND turn % 2 = 1 THEN 'text' ELSE 'tool_use' END AS block_type,
  CASE role WHEN 'assistant' THEN 'submit_assessment' WHEN 'user' THEN {TOOLS_LIST}[(conv_id + turn) % 4 + 1]
    ELSE 'search_web' END AS tool_name,
  CASE WHEN role = 'assistant' AND length(text) >= 120
    THEN '{{"summary": "c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '"}}' ELSE '{{}}' END
    AS input_json FROM conversations WHERE turn // 2 + 1 <= 6)""",
  """rounds AS (SELECT video_id, round, count(*) FILTER (WHERE block_type = 'tool_use') > 0 AS has_tool,
  arg_max(input_json, pos) FILTER (WHERE block_type = 'tool_use' AND tool_name = 'submit_assessment') AS last_submit
  FROM t GROUP BY video_id, round)""",
  """r2 AS (SELECT *, last_value(last_submit IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY round
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM rounds)""",
  """r3 AS (SELECT *, has_tool AND latest IS NOT NULL AND NOT regexp_matches(latest, '^\\s*\\{\\s*\\}\\s*$') AS done,
  NOT has_tool AS stop FROM r2)""",
  """per AS (SELECT video_id, min(round) FILTER (WHERE done OR stop) AS end_r, max(round) AS max_round,
  arg_min({'d': done, 'l': latest}, round) FILTER (WHERE done OR stop) AS at_end,
  arg_max({'l': latest}, round) AS last_l FROM r3 GROUP BY video_id)""",
  """per2 AS (SELECT video_id, coalesce(end_r, max_round) AS end_round,
  CASE WHEN end_r IS NOT NULL THEN at_end.l ELSE last_l.l END AS lat,
  end_r IS NOT NULL AND at_end.d AS done, end_r IS NOT NULL AS ended, max_round FROM per)""",
  f"""summ AS (SELECT p.video_id, CASE WHEN done THEN 'assessed'
      WHEN lat IS NOT NULL AND regexp_matches(lat, '^\\s*\\{{\\s*\\}}\\s*$') THEN 'empty_assessment'
      WHEN ended OR max_round < 6 THEN 'stopped_without_tools' ELSE 'round_cap' END AS outcome,
    p.end_round, CASE WHEN done OR (lat IS NOT NULL AND regexp_matches(lat, '^\\s*\\{{\\s*\\}}\\s*$'))
      THEN lat END AS assessment,
    coalesce((SELECT string_agg(tool_name, '|' ORDER BY round, pos) FROM t WHERE t.video_id = p.video_id
      AND t.block_type = 'tool_use' AND t.round <= p.end_round AND t.tool_name IN ({KNOWN_SQL})), '') AS tools_used,
    (SELECT count(*) FROM t WHERE t.video_id = p.video_id AND t.block_type = 'tool_use'
      AND t.round <= p.end_round AND t.tool_name IN ({KNOWN_SQL}) AND t.tool_name <> 'submit_assessment')
      AS tool_rounds,
    (SELECT count(*) FROM t WHERE t.video_id = p.video_id AND t.block_type = 'tool_use'
      AND t.round <= p.end_round AND t.tool_name NOT IN ({KNOWN_SQL})) AS error_calls
  FROM per2 p)""")


def summaries(spark, base):
    return TR.summarise(trace(spark, base))


@register("trace_summary", TRACE_SQL + "SELECT * FROM summ")
def q_trace_summary(spark, base):
    """Replay of every trace."""
    s = summaries(spark, base)
    return s.select("video_id", "outcome", "end_round", "assessment",
                    F.array_join("tools_used", "|").alias("tools_used"),
                    F.col("tool_rounds").cast("long").alias("tool_rounds"), "error_calls")


@register("tool_order", TRACE_SQL + """SELECT tool_name, position, count(*) AS calls FROM (
  SELECT unnest(l) AS tool_name, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS position FROM (
    SELECT string_split(tools_used, '|') AS l FROM summ WHERE tools_used <> ''))
  GROUP BY tool_name, position""")
def q_tool_order(spark, base):
    """Tool usage by position."""
    return TR.tool_order(summaries(spark, base))


@register("report_rows", with_ctes(V.META_SQL) + ", " + TRACE_SQL[len("WITH "):] + f"""SELECT s.video_id,
  m.api_title AS title, m.api_channel_title AS channel, NULL::VARCHAR AS triage_label,
  NULL::VARCHAR AS confidence, NULL::VARCHAR AS content_type,
  json_extract_string(s.assessment, '$.summary') AS summary, '' AS key_signals,
  CASE WHEN s.outcome = 'assessed' THEN s.tools_used ELSE '' END AS tools_used,
  CASE WHEN s.outcome = 'assessed' THEN s.tool_rounds ELSE 0 END AS tool_rounds,
  TIMESTAMP '{CLOCK}' AS evaluated_at, substr(json_extract_string(s.assessment, '$.summary'), 1, 120)
    AS summary_preview
  FROM summ s LEFT JOIN meta m USING (video_id) WHERE s.outcome IN ('assessed', 'empty_assessment')""")
def q_report_rows(spark, base):
    """P29 + P30 + K6 form: report rows for assessed traces (arrays '|'-joined)."""
    r = TR.report_rows(summaries(spark, base), V.meta(spark, base), clock())
    return r.select(*[F.array_join(c, "|").alias(c) if c in ("key_signals", "tools_used") else
                      (F.col(c).cast("long").alias(c) if c == "tool_rounds" else F.col(c))
                      for c in r.columns])


@register("report_append", with_ctes(V.META_SQL) + ", " + TRACE_SQL[len("WITH "):] + """SELECT s.video_id,
  m.api_title AS title, s.outcome = 'assessed' AS assessed, count(*) OVER (PARTITION BY s.video_id) AS reports
  FROM summ s LEFT JOIN meta m USING (video_id) WHERE s.outcome IN ('assessed', 'empty_assessment')""")
def q_report_append(spark, base):
    """The reports are appended twice; each id has one."""
    from viewlens.plans import jobs
    from viewlens.session import scratch_path
    path = scratch_path(spark, "reports")
    s = summaries(spark, base)
    for _ in range(2):
        jobs.append_reports(s, V.meta(spark, base), path, clock())
    r = spark.read.parquet(path)
    per = r.groupBy("video_id").agg(F.count(F.lit(1)).alias("reports"))
    outcome = s.select("video_id", (F.col("outcome") == "assessed").alias("assessed"))
    return r.select("video_id", "title").join(outcome, "video_id").join(per, "video_id").select(
        "video_id", "title", "assessed", "reports")


# --- traces that submit the assessments of events ------------------------------

def event_traces(spark, base):
    """One trace an event: it asks for evidence, then submits the event's
    assessment; calls of error events fail in round 2, and purchases stop
    without another call."""
    a = assessments(spark, base)
    ev = io.read_table(spark, base, "events").select(F.col("event_id").alias("video_id"), F.col("event_type").alias("et"))
    both = a.join(ev, "video_id")
    block = "struct<round:int,pos:int,block_type:string,tool_name:string,input_json:string>"

    def of(r, pos, kind, name=None, body=None):
        return F.struct(F.lit(r), F.lit(pos), F.lit(kind), F.lit(name).cast("string"),
                        body if body is not None else F.lit("{}")).cast(block)

    ask = of(1, 0, "tool_use", S.EVIDENCE_TOOLS[0])
    blocks = (F.when(F.col("et") == "error", F.array(ask, of(2, 0, "error")))
              .when(F.col("et") == "purchase", F.array(ask, of(2, 0, "text")))
              .otherwise(F.array(ask, of(1, 1, "tool_use", "search_web"), of(2, 0, "text"),
                                 of(2, 1, "tool_use", S.SUBMIT_TOOL, F.col("assessment")))))
    return both.select("video_id", F.inline(blocks))


@register("trace_failures", f"""SELECT event_id AS video_id, CASE event_type WHEN 'error' THEN 'failed'
    WHEN 'purchase' THEN 'stopped_without_tools' ELSE 'assessed' END AS outcome, 2 AS end_round,
  CASE WHEN event_type IN ('error', 'purchase') THEN '{S.EVIDENCE_TOOLS[0]}'
    ELSE '{S.EVIDENCE_TOOLS[0]}|{S.SUBMIT_TOOL}' END AS tools_used,
  CAST(CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE 1 END AS BIGINT) AS error_calls FROM events""")
def q_trace_failures(spark, base):
    """G4 + G5: traces with failed calls, unknown tools and no submission."""
    return TR.summarise(event_traces(spark, base)).select(
        "video_id", "outcome", "end_round", F.array_join("tools_used", "|").alias("tools_used"), "error_calls")


@register("report_fields", f"""SELECT video_id, label AS triage_label, ['high', 'medium', 'low', 'sure'][k % 4 + 1] AS confidence,
  [{", ".join("'" + c + "'" for c in [*S.CONTENT_TYPES, "vlog"])}][k % 11 + 1] AS content_type, summary,
  array_to_string(['a', 'b', 'c', 'd', 'e', 'f'][1:k % 7], '|') AS key_signals, substr(summary, 1, 120) AS summary_preview
  FROM (SELECT event_id AS video_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'view' THEN 'deep' WHEN 'click' THEN 'useful' WHEN 'signup' THEN 'mixed' END AS label,
    CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 13 <> 0 THEN event_type END AS summary
    FROM events WHERE event_type NOT IN ('error', 'purchase'))""".replace("['high', 'medium', 'low', 'sure']", "[" + ", ".join(
        "'" + c + "'" for c in [*S.CONFIDENCE_LEVELS, "sure"]) + "]"))
def q_report_fields(spark, base):
    """P29 + P30: the report of each assessed event with all its fields."""
    meta = io.read_table(spark, base, "events").select(
        F.col("event_id").alias("video_id"), F.col("event_type").alias("api_title"), F.lit(None).cast("string").alias("api_channel_title"))
    r = TR.report_rows(TR.summarise(event_traces(spark, base)), meta, clock())
    return r.select("video_id", "triage_label", "confidence", "content_type", "summary",
                    F.array_join("key_signals", "|").alias("key_signals"), "summary_preview")


@register("score_resume", RESP + """SELECT video_id, composite_score, triage_label, 1::BIGINT AS stored FROM v WHERE status = 'ok'""")
def q_score_resume(spark, base):
    """S6 + S14 + K3 + U4: judged twice over; the second run reads the keys
    that the first stored and appends what is left."""
    from viewlens.plans import jobs
    from viewlens.session import scratch_path
    landed, meta, out = (scratch_path(spark, n) for n in ("responses", "titles", "judged"))
    r = responses(spark, base)
    docs = io.read_table(spark, base, "documents").select(F.col("doc_id").alias("video_id"), F.col("text").alias("api_title"))
    io.overwrite(docs, meta)
    io.overwrite(r, landed)
    for _ in range(2):
        jobs.score(spark, landed, meta, out, MODEL, clock())
    io.require(spark, f"{out}/scores", "scoring wrote nothing")
    per = spark.read.parquet(f"{out}/scores").groupBy("video_id", "composite_score", "triage_label").agg(
        F.count(F.lit(1)).alias("stored"))
    return per.select(F.col("video_id").cast("long").alias("video_id"), "composite_score", "triage_label", "stored")


@register("evaluation_defaults", """SELECT doc_id AS video_id, 'Evaluate this YouTube video:' || chr(10) || chr(10)
  || 'Title: Unknown' || chr(10) || 'Channel: ' || coalesce(CASE WHEN lang <> 'fr' THEN lang END, 'Unknown') || chr(10)
  || 'Category: N/A' || chr(10) || 'Duration: N/A' || chr(10) || 'Views: N/A | Likes: N/A | Comments: N/A' || chr(10)
  || 'Tags: None' || chr(10) || 'Description:' || chr(10) || chr(10) AS prompt FROM documents""")
def q_evaluation_defaults(spark, base):
    """P36 + P31-P35: metadata without a title column, with blanks everywhere."""
    d = io.read_table(spark, base, "documents")
    none = {"category_id": "string", "duration_seconds": "long", "view_count": "long", "like_count": "long",
            "comment_count": "long", "tags": "array<string>", "description": "string"}
    return J.evaluation_text(d.select(
        F.col("doc_id").alias("video_id"), F.when(F.col("lang") != "fr", F.col("lang")).alias("api_channel_title"),
        *(F.lit(None).cast(t).alias(c) for c, t in none.items())))
