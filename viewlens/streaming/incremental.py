"""Incremental intake of landed lookup responses with Structured Streaming.

Landed responses (``requested`` ids + raw JSON, as written by
``lookup.fetch``) arrive as files in a landing folder. A file-source stream
with ``trigger(availableNow=True)`` takes the files not yet seen (the
checkpoint records them), resolves each call to metadata rows and appends the
rows of ids never met before (I1, S5, K2-K5 as a stream).

The ids already stored are keyed state of the stream (``dropDuplicates`` over
the RocksDB state store, checkpointed with the query): a micro-batch meets
only its own rows with the state of their keys, so its cost follows what
landed and not what is stored; the store is never scanned. The file sink
commits the files of a micro-batch at once and the state moves with the same
commit, so a batch that is replayed after a failure adds nothing twice.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from viewlens import schemas as S
from viewlens.operators import lookup as L

#: State on the executors' disks, moved as change logs: known ids need not fit in memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """``conf`` for the streams started within; the caller's settings return."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_rows(landed: DataFrame) -> DataFrame:
    """Streaming: the first row of each id that the calls in ``landed``
    resolve to (returned items, sentinels for ids without one). Which of
    several rows of one id in the same micro-batch is kept is not defined;
    one of a later batch never is."""
    rows = L.resolve_calls(landed)
    return rows.filter(rows.video_id.isNotNull()).select(*S.META.fieldNames()).dropDuplicates(["video_id"])


def ingest_landed(spark: SparkSession, landing: str, store: str, checkpoint: str) -> None:
    """Process every landed file not yet processed, then stop.

    ``store`` is written by this stream alone and ``checkpoint`` goes with
    it: together they are the table and its known ids."""
    with _settings(spark, STATE_CONF):
        stream = spark.readStream.schema(L.LANDED).json(landing)
        q = (first_rows(stream).writeStream.format("parquet").option("path", store)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()


def land(df: DataFrame, landing: str) -> None:
    """Write landed responses as JSON files (one drop)."""
    df.select("requested", "response", *(["error"] if "error" in df.columns else [])).write.mode("append").json(landing)


def store_rows(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(S.META).parquet(store)


__all__ = ["first_rows", "ingest_landed", "land", "store_rows"]
