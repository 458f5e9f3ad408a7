"""The corpus pipeline on the small tables, stage by stage."""

import re

import pyarrow as pa

import __spark_entry__ as E
import corpus_pipeline
from tests.conftest import SF0001
from viewlens.llm.common import BATCH_BYTES, documents, land

from tests.llm.test_pairs import brute, overlaps


def test_stages(spark):
    docs = documents(spark, SF0001)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = land(stage(spark, docs, SF0001), "test-stage")
        assert docs.columns == columns
        seen[name] = (before, [(r.doc_id, r.text) for r in docs.collect()])
    before, after = seen["quality"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    good = [i for i, _ in before if quality.get(i) == 1]
    assert sum(i in dict(after) for i in good) >= 0.95 * len(good)
    before, after = seen["near_duplicates"]
    comp = brute(before)
    assert sorted(dict(after)) == sorted(i for i, _ in before if comp[i][1] == i)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    sure = [re.sub(r"\s+", " ", t) for _, t in items]
    gone = dict(before).keys() - dict(after).keys()
    assert gone == {i for i, t in before if any(s in re.sub(r"\s+", " ", t) for s in sure) or overlaps(t, items)}
    before, after = seen["mixture"]
    assert {i for i, _ in after} <= {i for i, _ in before}
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, SF0001)
    assert sorted(r.doc_id for r in packs.collect()) == sorted(i for i, _ in after)


def test_every_query_is_registered():
    names = E.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


def test_stages_send_batches_of_bounded_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    rows = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word and more ', 400) AS text", "'en' AS lang", "'s' AS source")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})
    try:
        corpus_pipeline.STAGES[3][1](spark, rows, SF0001)
        got = rows.mapInArrow(sizes, "n long, size long").collect()
    finally:
        spark.conf.unset(key)
    assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < 2 * BATCH_BYTES
