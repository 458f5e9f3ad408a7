"""Judgment parsing and validation as one table job (S12, V1-V8, P28,
P30-P36, A27). Responses are landed rows; each row ends valid or in
quarantine with a reason, never a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.functions import columns as C

ASSESSMENT_SCHEMA = ("triage_label string, confidence string, content_type string, "
                     "key_signals array<string>, summary string")


def response_text(content) -> "F.Column":
    """Concatenation of the text blocks of a response, in order."""
    texts = F.transform(F.filter(C.col(content), lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.array_join(texts, "")


FENCE_RE = r"(?s)^```[^\n]*\n(.*?)(```(?!.*```).*)?$"


def unfence(text) -> "F.Column":
    """V1: strip; when the text opens with a ``` line, drop that line and cut
    at the last ``` (if any). One regex, so the input is referenced once.
    A fence with no newline is left as is and fails the JSON parse."""
    return F.regexp_replace(C.strip_space(text), FENCE_RE, "$1")


def validate(responses: DataFrame, key: str = "video_id", text: str = "text") -> DataFrame:
    """V1-V6: status ok / json_error / invalid_dim, clamped dims, composite,
    label. Dimensions must be JSON integers: strings, floats, booleans and
    nulls become NULL under the typed parse and reject the row (TR14);
    clamping happens only after that check (TR21).

    The text is parsed once, to a variant; the fields are read from that.
    Each step is its own projection, so no expression is re-inlined into the
    next (the optimizer keeps projects apart when that would duplicate work).
    """
    df = responses.select(key, F.try_parse_json(unfence(F.col(text))).alias("_v"))

    def integer(name):  # a JSON integer that fits, else NULL
        v = F.try_variant_get("_v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get("_v", f"$.{name}", "bigint"))

    df = df.select(key, F.col("_v").isNotNull().alias("_ok_json"), F.struct(
        *(integer(d).alias(d) for d in S.QUALITY_DIMENSIONS),
        *(F.try_variant_get("_v", f"$.{c}", "string").alias(c) for c in ("triage_label", "rationale"))).alias("_j"))
    dims_ok = F.lit(True)
    for d in S.QUALITY_DIMENSIONS:
        dims_ok = dims_ok & F.col(f"_j.{d}").isNotNull()
    status = (F.when(~F.col("_ok_json"), F.lit("json_error"))
              .when(~dims_ok, F.lit("invalid_dim"))
              .otherwise(F.lit("ok")))
    df = df.select(key, "_j", status.alias("status"))
    valid = F.col("status") == "ok"
    df = df.select(key, "status", "_j", *[
        F.when(valid, F.least(F.lit(5), F.greatest(F.lit(1), F.col(f"_j.{d}")))).alias(d)
        for d in S.QUALITY_DIMENSIONS])
    total = sum((F.col(d) for d in S.QUALITY_DIMENSIONS), F.lit(0))
    df = df.withColumn("composite_score", F.round(total / F.lit(5.0), 2))
    label = F.col("_j.triage_label")
    final_label = (F.when(label.isin(*S.TRIAGE_LABELS), label)
                   .otherwise(C.label_from_composite("composite_score")))
    out = F.struct(
        F.col(key), F.col("status"), *[F.col(d) for d in S.QUALITY_DIMENSIONS], F.col("composite_score"),
        F.when(valid, final_label).alias("triage_label"),
        F.when(valid, F.coalesce(F.col("_j.rationale"), F.lit(""))).alias("rationale"))
    # A one-element generator closes the parse: filters and aggregates on
    # status/label stay above it instead of being substituted back into the
    # parse expressions (predicate pushdown inlines projections).
    return df.select(F.inline(F.array(out)))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V7: valid rows and the quarantine (with reason)."""
    ok = F.col("status") == "ok"
    return validated.filter(ok), validated.filter(~ok).select(
        F.col(validated.columns[0]), F.col("status").alias("reason"))


def outcome_counts(validated: DataFrame) -> DataFrame:
    """One pass over the validated rows: counts per (status, label), at most
    a handful of rows, from which every run figure is derived."""
    return validated.groupBy("status", "triage_label").agg(F.count(F.lit(1)).alias("n"))


def rejects_by_reason(validated: DataFrame) -> DataFrame:
    """V7 counts."""
    c = outcome_counts(validated)
    return (c.filter(F.col("status") != "ok").groupBy(F.col("status").alias("reason"))
            .agg(F.sum("n").alias("rows")))


def summary(validated: DataFrame, labels: list[str] | tuple[str, ...] = S.TRIAGE_LABELS) -> DataFrame:
    """A27 + T5: per label of the vocabulary (zeros kept): count, percent of
    scored (1 dp), and the run's scored / error totals.

    Everything comes from the outcome counts (at most statuses x labels
    rows) folded into one row, then spread over the fixed label list: one
    chain, so the validated rows are evaluated once, with no join.
    """
    c = outcome_counts(validated)
    ok = F.col("status") == "ok"
    one = c.agg(
        F.map_from_entries(F.collect_list(F.when(ok & F.col("triage_label").isNotNull(),
                                                 F.struct("triage_label", "n")))).alias("_counts"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("long").alias("scored"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).cast("long").alias("errors"))
    per = one.select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("triage_label"),
                     "_counts", "scored", "errors")
    n = F.coalesce(F.try_element_at(F.col("_counts"), F.col("triage_label")), F.lit(0)).cast("long")
    return per.select("triage_label", n.alias("label_count"),
                      F.when(F.col("scored") > 0, C.round_ratio(n * 100, F.col("scored"), 1))
                      .otherwise(F.lit(0.0)).alias("pct"), "scored", "errors").orderBy("triage_label")


def score_rows(valid: DataFrame, titles: DataFrame, model: str, scored_at,
               key: str = "video_id") -> DataFrame:
    """P28 + P30: output rows with the model tag, a clock value (injectable
    for reproducible runs) and a 60-character title preview."""
    # cut the preview before the join: the exchange carries 60 characters
    # per title, not the whole text
    t = titles.select(key, F.substring(F.col("title"), 1, 60).alias("title_preview"))
    j = valid.join(t, key, "left")
    return j.select(key, *S.QUALITY_DIMENSIONS, "composite_score", "triage_label", "rationale",
                    F.lit(model).alias("model"), F.lit(scored_at).alias("scored_at"), "title_preview")


def evaluation_text(meta: DataFrame, key: str = "video_id") -> DataFrame:
    """P31-P36 + T9: the per-video evaluation text (9-line template)."""
    def known(c):  # P36: a table without the column counts as all NULL
        return F.coalesce(F.col(c), F.lit("Unknown")) if c in meta.columns else F.lit("Unknown")

    title, channel = known("api_title"), known("api_channel_title")
    cat = F.coalesce(F.col("category_id").cast("string"), F.lit("N/A"))
    tags = F.array_join(F.slice(F.col("tags"), 1, S.TAG_DISPLAY_LIMIT), ", ")
    tag_str = F.when(F.col("tags").isNull() | (F.size("tags") == 0), F.lit("None")).otherwise(tags)
    desc = F.coalesce(F.col("description"), F.lit(""))
    text = F.concat(
        F.lit("Evaluate this YouTube video:\n\nTitle: "), title,
        F.lit("\nChannel: "), channel,
        F.lit("\nCategory: "), cat,
        F.lit("\nDuration: "), C.duration_text("duration_seconds"),
        F.lit("\nViews: "), C.count_text("view_count"),
        F.lit(" | Likes: "), C.count_text("like_count"),
        F.lit(" | Comments: "), C.count_text("comment_count"),
        F.lit("\nTags: "), tag_str,
        F.lit("\nDescription:\n"), desc, F.lit("\n"))
    return meta.select(key, text.alias("prompt"))


def assessment_check(assessments: DataFrame, key: str = "video_id",
                     assessment: str = "assessment") -> DataFrame:
    """V8: vocabulary and shape flags of a submitted assessment (flag, not drop)."""
    a = F.from_json(F.col(assessment), ASSESSMENT_SCHEMA)
    df = assessments.select(key, a.alias("_a"))
    n_sig = F.size(F.coalesce(F.col("_a.key_signals"), F.array().cast("array<string>")))
    flags = {
        "label_ok": F.coalesce(F.col("_a.triage_label").isin(*S.TRIAGE_LABELS), F.lit(False)),
        "confidence_ok": F.coalesce(F.col("_a.confidence").isin(*S.CONFIDENCE_LEVELS), F.lit(False)),
        "content_type_ok": F.coalesce(F.col("_a.content_type").isin(*S.CONTENT_TYPES), F.lit(False)),
        "signals_ok": (n_sig >= S.KEY_SIGNALS_MIN) & (n_sig <= S.KEY_SIGNALS_MAX),
        "required_ok": (F.col("_a.triage_label").isNotNull() & F.col("_a.confidence").isNotNull()
                        & F.col("_a.key_signals").isNotNull() & F.col("_a.summary").isNotNull()
                        & F.col("_a.content_type").isNotNull()),
    }
    allok = F.lit(True)
    for v in flags.values():
        allok = allok & v
    return df.select(key, *[v.alias(k) for k, v in flags.items()], allok.alias("valid"))
