"""Bounded training samples of labelled documents, and small numpy nets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlens.llm.common import land, of_row, packed, unpacked


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether a document is never learned from (a null id: never)."""
    doc = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % folds == fold, F.lit(False))


ADDED = ("held_out", "score", "predicted")


def scored(docs: DataFrame, text: str, scores) -> DataFrame:
    """``docs`` as packed rows ``_row`` with ``score``: ``scores`` maps an
    Arrow column of texts to their scores."""
    base = packed(docs)

    def run(batches):
        for b in batches:
            row = b.column("_row")
            yield pa.RecordBatch.from_arrays([row, pa.array(scores(row.field(text)), pa.float64())], names=["_row", "score"])
    return base.mapInArrow(run, T.StructType([base.schema["_row"], T.StructField("score", T.DoubleType())]))


def with_scores(docs: DataFrame, rows: DataFrame, id_col: str, folds: int, fold: int, accept: float) -> DataFrame:
    """``scored`` rows as ``docs`` plus ADDED; columns of these names in
    ``docs`` are replaced."""
    return rows.select(*unpacked(docs.columns, without=ADDED), held_out(of_row(id_col), folds, fold).alias("held_out"),
                       "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int,
           id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(text, label, pick)`` of at most ``rows`` labelled documents outside
    the held-out fold, picked by a hash of the id; ``pick`` orders them.

    The picks are bounded before and after they meet the documents. A
    threshold on the hash, from the number of labels, leaves few more than
    ``rows`` of them, which alone are sorted (a hash of the distinct ids is
    even; if too few are left, the threshold is doubled). An id that several
    documents share gives the one of the least text hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    known = land(known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("label"))
                 .withColumn("pick", F.xxhash64("_id", F.lit("train"))), "labels")
    n, share = known.count(), 1.1
    few = known
    while share * rows < n:
        few = known.where(F.col("pick") < F.lit(int((share * rows / n) * 2.0 ** 64 - 2.0 ** 63)))
        if few.count() >= rows:
            break
        few, share = known, share * 2
    few = F.broadcast(few.orderBy("pick", "_id").limit(rows))
    met = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(few, "_id")
    one = met.groupBy("_id", "label", "pick").agg(F.min(F.xxhash64("text")).alias("th"))
    # equal texts of an id are one after the hash, whichever row gives them
    return (met.join(F.broadcast(one.select(F.col("_id").alias("i"), "th")), (F.col("_id") == F.col("i")) & (F.xxhash64("text") == F.col("th")))
            .groupBy("_id", "label", "pick", "th").agg(F.first("text").alias("text")).select("text", "label", "pick"))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= scale * m / (np.sqrt(v) + 1e-8) + self.rate * self.decay * p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits of least log loss on held-back rows."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))

    def loss(t):
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - y * z))
    return float(min(grid, key=loss)) if len(y) else 1.0
