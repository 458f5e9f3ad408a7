"""Quality classifier: random-indexing word vectors pooled per document,
then a two-layer numpy network with temperature-calibrated probabilities.

Words are hashed to a fixed number of rows. Each row has a fixed sparse
ternary index vector; the vector of a word is the sum of the index vectors
of its neighbours over the whole corpus (integers: the order of summing
cannot matter). A document is the mean and deviation of its words' vectors, and the mean
product of neighbouring ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import byte_table, doc_slices, hash_words, splitmix, text_buffers
from viewlens.llm.labelled import Adam, sample, scored, sigmoid, temperature, with_scores

#: Rows and dimensions of the word table (its size is fixed: 2 MB), nonzero
#: entries of an index vector, and neighbours on either side.
ROWS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Labelled documents that are learned from, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS = 24, 60
FEATURES = 3 * DIMS
#: Words whose vectors are in memory at a time.
BLOCK = 1 << 16
#: Parts of the word table that are summed apart, and tasks for each part.
PARTS, SALT = 64, 8
ACCEPT = 0.7

_DIM = (splitmix(np.arange(ROWS * NONZERO, dtype=np.uint64)) % np.uint64(DIMS)).astype(np.int64).reshape(ROWS, NONZERO)
_SIGN = np.where(np.arange(NONZERO) % 2 == 0, 1.0, -1.0)


def _words(col):
    """Row of each word and document starts, for slices of a text column."""
    table = byte_table(lower=False)
    raw, off = text_buffers(col)
    for lo, hi in doc_slices(off):
        h, at = hash_words(raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], table)
        yield (h >> np.uint64(50)).astype(np.int64), at


def contexts(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Summed index vectors of the neighbours of each word row."""
    total = np.zeros(ROWS * DIMS)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for o in range(1, REACH + 1):
        same = doc[o:] == doc[:-o]
        a, b = rows[:-o][same], rows[o:][same]
        for x, y in ((a, b), (b, a)):
            base = x * DIMS
            for k in range(NONZERO):
                total += _SIGN[k] * np.bincount(base + _DIM[y, k], minlength=ROWS * DIMS)
    return total


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The word table over all of ``docs``, rows of unit length."""
    size = ROWS // PARTS * DIMS

    def gather(batches):
        total = np.zeros(ROWS * DIMS)
        for b in batches:
            for rows, at in _words(b.column(0)):
                total += contexts(rows, at)
        parts = total.astype(np.int32).reshape(PARTS, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()),
                                          pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "v"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, v in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(v.as_buffer(), np.int32 if len(v.as_buffer()) == 4 * size else np.int64)
                sums[part] = sums.get(part, 0) + got.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "v"])

    schema = "part int, v binary"
    salted = docs.select(text).mapInArrow(gather, schema).withColumn("salt", F.spark_partition_id() % SALT)
    sums = (salted.repartition(PARTS * SALT // 8, "part", "salt").select("part", "v").mapInArrow(add, schema)
            .repartition(PARTS // 4, "part").mapInArrow(add, schema).collect())  # the word table: 4 MB
    table = np.zeros((PARTS, size))
    for r in sums:
        table[r["part"]] += np.frombuffer(r["v"], np.int64)
    table = table.reshape(ROWS, DIMS)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norm, 1)).astype(np.float32)


def pooled(col, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each text, and the mean
    product of neighbours (0 if no words). Works on blocks of words."""
    out = []
    for rows, at in _words(col):
        n = np.diff(at)
        sums = np.zeros((len(n), 3 * DIMS), np.float64)
        for lo in range(0, len(rows), BLOCK):
            hi = min(lo + BLOCK, len(rows))
            v = vectors[rows[lo: hi + 1]]
            first, last = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi, side="left")
            docs = np.arange(first, last)
            docs = docs[n[docs] > 0]
            cut = np.maximum(at[docs] - lo, 0)
            pair = v[:hi - lo].copy()
            pair[: len(v) - 1] *= v[1:]
            ends = at[1:][docs] - 1 - lo  # a document's last word has no follower
            pair[ends[ends < hi - lo]] = 0
            v = v[: hi - lo]
            for k, part in enumerate((v, v * v, pair)):
                sums[docs, k * DIMS: (k + 1) * DIMS] += np.add.reduceat(part, cut, axis=0)
        sums /= np.maximum(n, 1)[:, None]
        mean = sums[:, :DIMS]
        dev = np.sqrt(np.maximum(sums[:, DIMS: 2 * DIMS] - mean * mean, 0))
        out.append(np.hstack([mean, dev, sums[:, 2 * DIMS:]]))
    return np.vstack(out) if out else np.zeros((0, FEATURES))


class Network:
    """Standardised input, one hidden layer, one output, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0) if len(x) else np.zeros(FEATURES)
        self.dev = x.std(0) + 1e-6 if len(x) else np.ones(FEATURES)
        held = np.arange(len(y)) % 5 == 4  # for the temperature
        z, t = ((x - self.mean) / self.dev)[~held], y[~held].astype(float)
        rate = np.clip(t.mean() if len(t) else 0.5, 0.01, 0.99)
        self.w1 = rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN))
        self.b1, self.w2 = np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, 1))
        self.b2, self.heat = np.array([np.log(rate / (1 - rate))]), 1.0
        adam = Adam([self.w1, self.b1, self.w2, self.b2], 3e-3, 1e-3)
        for _ in range(EPOCHS if len(t) else 0):
            order = rng.permutation(len(t))
            for lo in range(0, len(t), 128):
                i = order[lo: lo + 128]
                h = np.tanh(z[i] @ self.w1 + self.b1)
                g = (sigmoid(h @ self.w2 + self.b2) - t[i, None]) / len(i)
                back = (g @ self.w2.T) * (1 - h * h)
                adam.step([z[i].T @ back, back.sum(0), h.T @ g, g.sum(0)])
        if held.any():
            self.heat = temperature(self.logits(x[held]), y[held])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.dev @ self.w1 + self.b1)
        return (h @ self.w2 + self.b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.heat)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2,
        rows: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word table over all documents, network over the labelled sample."""
    vectors = word_vectors(docs)

    def features(batches):
        for b in batches:
            x = pooled(b.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("pick"), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["label", "pick", "x"])

    got = sample(docs, labels, label, folds, fold, rows).mapInArrow(features, "label int, pick long, x array<double>").collect()
    got.sort(key=lambda r: (r["pick"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(-1, FEATURES)
    return vectors, Network(x, np.array([r["label"] for r in got], np.int64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
          folds: int = 4, fold: int = 2, accept: float = ACCEPT) -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Null and empty texts are scored as texts without words. Labels that are
    null, of null ids or of no document are not used; of several labels of a
    document the largest counts. With no labels at all every score is 0.5.
    Null ids are not held out. Rows that repeat are scored alike. An empty
    table gives an empty table; other columns stay as they are, but those
    named like the added ones, which are replaced.
    """
    return with_scores(docs, _scored(docs, labels, id_col, text, label, folds, fold), id_col, folds, fold, accept)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
            folds: int = 4, fold: int = 2) -> DataFrame:
    vectors, net = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")),
                       labels, label, folds, fold)
    return scored(docs, text, lambda texts: net.score(pooled(texts, vectors)))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **kw) -> DataFrame:
    """``docs`` without the documents that the classifier rejects: those that
    ``score`` predicts 0, with its ``accept``. All columns stay."""
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("held_out", "score", "predicted")}
    rated = score(docs.withColumnsRenamed(aside), labels, accept=accept, **kw).where("predicted = 1")
    return rated.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
