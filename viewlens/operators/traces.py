"""Evaluation traces (G1-G7, P29): what each trace did, computed as one job.

A trace row is one content block: (video_id, round, pos, block_type,
tool_name, input_json). The evaluation loop is replayed with aggregates:
a round ends the loop when, after it, the latest submitted assessment is
non-empty (an empty ``{}`` does not end it), or when it has no tool calls;
rounds after the cap are never run. Only blocks of executed rounds count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens import schemas as S
from viewlens.operators.judgments import ASSESSMENT_SCHEMA

KNOWN = [*S.EVIDENCE_TOOLS, S.SUBMIT_TOOL]
EMPTY_RE = r"^\s*\{\s*\}\s*$"


def summarise(trace: DataFrame, key: str = "video_id", max_rounds: int = S.MAX_TOOL_ROUNDS) -> DataFrame:
    """Per trace: outcome (assessed / empty_assessment / failed /
    stopped_without_tools / round_cap; failed: the loop reached a round whose
    call failed, which the trace records as a block of type ``error``), final
    assessment JSON, ordered tools_used (unknown tools not recorded),
    tool_rounds (= non-submit calls), error_calls, end_round.

    One scan and one shuffle: an aggregate per trace holds a struct for each
    of the ``max_rounds`` rounds (partial in every task), and a fold over
    these structs, in round order, replays the loop.
    """
    is_tool = F.col("block_type") == "tool_use"
    is_submit = is_tool & (F.col("tool_name") == S.SUBMIT_TOOL)
    known = is_tool & F.col("tool_name").isin(*KNOWN)

    def of_round(r):
        here = F.col("round") == r
        submit = here & is_submit
        return [F.count_if(here).alias(f"_n{r}"), F.count_if(here & is_tool).alias(f"_c{r}"),
                F.count_if(here & (F.col("block_type") == "error")).alias(f"_e{r}"),
                F.max_by(F.when(submit, F.col("input_json")), F.when(submit, F.col("pos"))).alias(f"_s{r}"),
                F.collect_list(F.when(here & known, F.struct("pos", "tool_name"))).alias(f"_t{r}")]

    run = range(1, max_rounds + 1)
    per = trace.filter(F.col("round").between(1, max_rounds)).groupBy(key).agg(*(c for r in run for c in of_round(r)))
    rounds = F.array(*(F.struct(
        F.lit(r).alias("round"), (F.col(f"_n{r}") > 0).alias("met"), F.col(f"_c{r}").alias("calls"), (F.col(f"_e{r}") > 0).alias("error"),
        F.col(f"_s{r}").alias("submit"), F.transform(F.array_sort(f"_t{r}"), lambda t: t["tool_name"]).alias("tools")) for r in run))
    start = F.struct(F.lit(0).alias("end_round"), F.lit(False).alias("ended"), F.lit(False).alias("done"),
                     F.lit(False).alias("error"), F.lit(None).cast("string").alias("latest"),
                     F.array().cast("array<string>").alias("tools"), F.lit(0).cast("long").alias("calls"))

    def step(acc, r):
        latest = F.coalesce(r["submit"], acc["latest"])
        done = (r["calls"] > 0) & latest.isNotNull() & ~latest.rlike(EMPTY_RE)
        ran = F.struct(r["round"].alias("end_round"), (done | (r["calls"] == 0) | r["error"]).alias("ended"),
                       F.coalesce(done, F.lit(False)).alias("done"), r["error"].alias("error"), latest.alias("latest"),
                       F.concat(acc["tools"], r["tools"]).alias("tools"), (acc["calls"] + r["calls"]).alias("calls"))
        return F.when(acc["ended"] | ~r["met"], acc).otherwise(ran)

    # the one-element generator keeps the fold from being repeated in each later expression
    f = per.select(key, F.inline(F.array(F.aggregate(rounds, start, step))))
    empty = F.col("latest").isNotNull() & F.col("latest").rlike(EMPTY_RE)
    failed = F.col("ended") & F.col("error")
    outcome = (F.when(F.col("done"), F.lit("assessed")).when(failed, F.lit("failed"))
               .when(empty, F.lit("empty_assessment"))
               .when(F.col("ended") | (F.col("end_round") < max_rounds), F.lit("stopped_without_tools"))
               .otherwise(F.lit("round_cap")))
    return f.select(key, outcome.alias("outcome"), "end_round",
                    F.when(F.col("done") | (empty & ~failed), F.col("latest")).alias("assessment"),
                    F.col("tools").alias("tools_used"),
                    F.size(F.filter("tools", lambda x: x != S.SUBMIT_TOOL)).alias("tool_rounds"),
                    (F.col("calls") - F.size("tools")).alias("error_calls"))


def tool_order(summary: DataFrame) -> DataFrame:
    """How often each tool is called at each position (1-based)."""
    return (summary.select(F.posexplode("tools_used").alias("pos", "tool_name"))
            .groupBy("tool_name", (F.col("pos") + 1).alias("position"))
            .agg(F.count(F.lit(1)).alias("calls")))


def report_rows(summary: DataFrame, meta: DataFrame, evaluated_at, key: str = "video_id") -> DataFrame:
    """P29 + P30: one report row per assessed or empty assessment. An empty
    assessment keeps its row with blank fields, no tools and 0 rounds;
    summary_preview is the first 120 characters."""
    s = summary.filter(F.col("outcome").isin("assessed", "empty_assessment"))
    a = F.from_json(F.col("assessment"), ASSESSMENT_SCHEMA)
    assessed = F.col("outcome") == "assessed"
    j = s.select("*", a.alias("_a")).join(
        meta.select(key, F.col("api_title").alias("title"), F.col("api_channel_title").alias("channel")),
        key, "left")
    return j.select(
        key, "title", "channel", F.col("_a.triage_label").alias("triage_label"),
        F.col("_a.confidence").alias("confidence"), F.col("_a.content_type").alias("content_type"),
        F.col("_a.summary").alias("summary"),
        F.coalesce(F.col("_a.key_signals"), F.array().cast("array<string>")).alias("key_signals"),
        F.when(assessed, F.col("tools_used")).otherwise(F.array().cast("array<string>")).alias("tools_used"),
        F.when(assessed, F.col("tool_rounds")).otherwise(F.lit(0)).alias("tool_rounds"),
        F.lit(evaluated_at).alias("evaluated_at"),
        F.substring(F.col("_a.summary"), 1, 120).alias("summary_preview"))
