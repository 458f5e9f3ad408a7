"""End-to-end: the command steps as jobs over folders, on the sf0.001 tables."""

from pyspark.sql import functions as F

from tests.conftest import SF0001
from viewlens import schemas as S
from viewlens.operators import evidence as E, history, judgments as J, lookup as L, reports, traces as TR
from viewlens.plans import jobs
from viewlens.plans import q_ingest as QI, q_judgments as QJ
from viewlens.sources import io


def service(ids):
    """Answers every id whose number is not a multiple of 5."""
    return {"items": [{"id": i, "snippet": {"title": f"t{i}", "categoryId": "10"},
                       "contentDetails": {"duration": "PT1M30S"}}
                      for i in ids if int(i[1:]) % 5]}


class OneCall:
    def __init__(self):
        self.n = 0

    def __call__(self, ids):
        self.n += 1
        if self.n > 1:
            raise L.QuotaExceeded()
        return service(ids)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parse_enrich_analyze_select(spark, tmp_path):
    raw, watch_path, store, out = (str(tmp_path / x) for x in ("export", "watch", "store", "reports"))
    io.write_blocks(QI.export_blocks(spark, SF0001), raw)
    summary = jobs.parse(spark, raw, watch_path).collect()[0]
    n_turns = io.read_table(spark, SF0001, "conversations").count()
    assert summary.entries == n_turns
    assert "year" in spark.read.parquet(watch_path).columns

    first = jobs.enrich(spark, watch_path, store, OneCall(), batch_size=2).collect()[0]
    assert first.remaining > 0  # quota stopped the run; what landed is kept
    done = jobs.enrich(spark, watch_path, store, service).collect()[0]
    assert done.remaining == 0 and done.stored == done.total_ids
    meta = spark.read.parquet(store)
    assert meta.count() == meta.select("video_id").distinct().count() == done.total_ids

    log = tmp_path / "calls.log"

    def logged(ids, log=str(log)):
        with open(log, "a") as fh:
            fh.write(",".join(ids) + "\n")
        return service(ids)

    again = jobs.enrich(spark, watch_path, store, logged).collect()[0]  # I1: nothing left to do
    assert again.remaining == 0 and not log.exists()
    assert spark.read.parquet(store).count() == done.total_ids

    written = jobs.analyze(spark, watch_path, store, out, csv=True)
    watch = spark.read.parquet(watch_path)
    direct = history.watch_enriched(watch, history.clean_metadata(meta))
    assert rows(spark.read.parquet(written["yearly"])) == rows(reports.yearly(direct).select(
        *spark.read.parquet(written["yearly"]).columns))
    assert rows(spark.read.parquet(written["type_breakdown"])) == rows(reports.type_breakdown(direct))
    assert spark.read.option("header", True).csv(written["totals"] + "_csv").count() == 1

    ev_out = jobs.evidence(spark, watch_path, store, str(tmp_path / "evidence"))
    assert rows(spark.read.parquet(ev_out["channels"])) == rows(E.channel_patterns(watch))
    assert rows(spark.read.parquet(ev_out["engagement"])) == rows(E.engagement_metrics(meta))

    picked = jobs.select(spark, store, str(tmp_path / "nothing-done"), 5)
    ids = [r.video_id for r in picked.collect()]
    avail = {r.video_id for r in meta.filter(F.col("api_title") != S.UNAVAILABLE_TITLE).collect()}
    assert len(ids) == 5 and set(ids) <= avail
    texts = jobs.evaluation_texts(spark, store, picked).collect()
    assert sorted(r.video_id for r in texts) == sorted(ids)


def test_score_and_triage(spark, tmp_path):
    resp, out, tr, meta_path = (str(tmp_path / x) for x in ("resp", "scores", "traces", "meta"))
    QJ.responses(spark, SF0001).write.parquet(resp)
    spark.createDataFrame([("1", "title one", "chan")], "video_id string, api_title string, api_channel_title string") \
        .write.parquet(meta_path)
    for _ in range(2):  # a replay adds nothing
        summ = jobs.score(spark, resp, meta_path, out, "judge-v1", QJ.clock())
    want = QJ.validated(spark, SF0001)
    assert rows(summ) == rows(J.summary(want))
    assert spark.read.parquet(f"{out}/scores").count() == want.filter("status = 'ok'").count()
    assert spark.read.parquet(f"{out}/rejects").count() == want.filter("status <> 'ok'").count()

    QJ.trace(spark, SF0001).write.parquet(tr)
    s = jobs.triage(spark, tr, meta_path, str(tmp_path / "triage"), QJ.clock())
    direct = TR.summarise(QJ.trace(spark, SF0001))
    assert s.count() == direct.count()
    assert rows(spark.read.parquet(str(tmp_path / "triage" / "tool_order"))) == rows(TR.tool_order(direct))
