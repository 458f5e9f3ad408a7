"""Toxicity: convolutional text classifier in numpy.

Hashed word embeddings (a word's own row plus those of its first letters,
so that inflected forms share a stem), filters of several widths, the
maximum of each filter over the text, one logistic output. Thresholds are calibrated by the language that
the text itself shows; a score of 0.7 is the threshold of its language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import byte_table, doc_slices, hash_words, text_buffers
from viewlens.llm.labelled import Adam, sample, scored, sigmoid, with_scores

#: Embedding rows and size, filter widths and filters of each, and the bytes
#: of a word that have rows of their own.
ROWS, SIZE, WIDTHS, FILTERS, STEMS = 1 << 16, 12, (1, 2, 3), 12, (5, 7)
#: Labelled documents that are learned from, at most; of these, at most so
#: many words each (longer ones are not picked).
SAMPLE, LONGEST = 6000, 50_000
EPOCHS, STEPS, BATCH, RATE = 6, 250, 64, 2e-3
PRIOR, MIN_DOCS = 10, 4
ACCEPT = 0.7
BLOCK = 1 << 14

#: Frequent words that tell the language of a text.
LANGUAGES = {"en": "the of and to in is that for with this are was be by not on from",
             "de": "der die und das den ist nicht mit sich ein eine von zu auf für dem im",
             "fr": "le les des et est une dans pour que qui pas au sur avec du un par",
             "es": "el los las y del que en por con para una se no su lo como la"}
_SEPARATORS = bytes(range(33)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = byte_table(_SEPARATORS)


def _tells() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and the language of each (words of two: none)."""
    names, words, of = list(LANGUAGES), [], []
    listed = [w for text in LANGUAGES.values() for w in text.split()]
    for i, name in enumerate(names):
        for w in LANGUAGES[name].split():
            if listed.count(w) == 1:
                words.append(w)
                of.append(i)
    raw, off = text_buffers(pa.array(words))
    h = hash_words(raw, off, _TABLE)[0]
    order = np.argsort(h)
    return h[order], np.array(of)[order]


def _words(col):
    """Embedding rows of each word, document starts and the language of each
    document (index, ties the first; no telling word: -1)."""
    tells, of = _tells()
    raw, off = text_buffers(col)
    for lo, hi in doc_slices(off):
        h, at, heads = hash_words(raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], _TABLE, prefixes=STEMS)
        hit = np.minimum(np.searchsorted(tells, h), len(tells) - 1)
        known = np.flatnonzero(tells[hit] == h)
        doc = np.searchsorted(at, known, side="right") - 1
        counts = np.zeros((hi - lo, len(LANGUAGES)), np.int64)
        np.add.at(counts, (doc, of[hit[known]]), 1)
        rows = np.empty((len(h), 1 + len(STEMS)), np.int32)
        rows[:, 0] = h >> np.uint64(48)
        for i, head in enumerate(heads):
            rows[:, i + 1] = np.where(head != 0, head >> np.uint64(48), ROWS)
        yield rows, at, np.where(counts.any(1), counts.argmax(1), -1)


def peaks(rows: np.ndarray, at: np.ndarray, e: np.ndarray, kernels: list[np.ndarray], where: bool = False):
    """Largest value of each filter in each text and, if asked, its position.
    Zeros follow a text, so that a short one has windows too. Blocks of words
    bound the memory; a text without words has zeros."""
    docs = len(at) - 1
    top = [np.full((docs, FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    pos = [np.zeros((docs, FILTERS), np.int64) for _ in WIDTHS]
    flat = np.concatenate([k[j] for k in kernels for j in range(len(k))], axis=1)
    for lo in range(0, len(rows), BLOCK):
        hi = min(lo + BLOCK, len(rows))
        mine = np.arange(np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi, side="left"))
        mine = mine[at[1:][mine] > at[:-1][mine]]
        cut, ends = np.maximum(at[mine] - lo, 0), at[1:][mine] - lo
        near = rows[lo: hi + max(WIDTHS) - 1]
        x = e[near[:, 0]]
        for c in range(1, near.shape[1]):
            x += e[near[:, c]]
        y = x @ flat
        col = 0
        for i, w in enumerate(WIDTHS):
            value = y[: hi - lo, col: col + FILTERS].copy()
            for j in range(1, w):
                part = y[j: j + hi - lo, col + j * FILTERS: col + (j + 1) * FILTERS].copy()
                for back in range(1, j + 1):  # windows do not run into the next text
                    z = ends - back
                    part[z[(z >= 0) & (z < len(part))]] = 0
                value[: len(part)] += part
            col += w * FILTERS
            best = np.maximum.reduceat(value, cut, axis=0)
            if where:
                for n, d in enumerate(mine):
                    p = value[cut[n]: min(ends[n], hi - lo)].argmax(0) + cut[n] + lo
                    pos[i][d] = np.where(best[n] > top[i][d], p, pos[i][d])
            top[i][mine] = np.maximum(top[i][mine], best)
    for t in top:
        t[np.isneginf(t)] = 0
    return top, pos


class Net:
    """Embeddings ``e`` (the last row pads), filters ``k``, output ``u, c``."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (ROWS + 1, SIZE)).astype(np.float32)
        self.e[ROWS] = 0
        self.k = [rng.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.u = rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.shift = np.zeros(len(LANGUAGES) + 1)

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        top, _ = peaks(rows, at, self.e, self.k)
        return np.hstack([np.maximum(t + b, 0) for t, b in zip(top, self.b)]) @ self.u + self.c[0]

    def start(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """First embedding coordinate: the log odds of the label given that a
        text holds the word, shrunk (by PRIOR texts
        of the usual mixture) where few texts do."""
        seen = np.zeros((2, ROWS))
        for t, label in zip(texts, y):
            mine = np.unique(t)
            seen[int(label), mine[mine < ROWS]] += 1
        n, base = seen.sum(0), y.mean()
        odds = (seen[1] + PRIOR * base) / (seen[0] + PRIOR * (1 - base))
        self.e[:ROWS, 0] = np.log(odds * (1 - base) / base) if 0 < base < 1 else 0
        self.known = np.append(n >= MIN_DOCS, False)  # rarer words stay without a vector
        self.e[~self.known] = 0
        for i, k in enumerate(self.k):  # one filter of each width starts on it alone
            k[:, :, 0] = 0
            k[:, 0, 0] = 1
            self.b[i][0] = -2 * len(k)
            self.u[i * FILTERS] = 1 / len(k)

    def fit(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.start(texts, y)
        self.c[0] = np.log(max(y.mean(), 0.01) / max(1 - y.mean(), 0.01))
        adam = Adam([self.e, *self.k, *self.b, self.u, self.c], RATE)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(len(texts), 1)))):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                pick = order[lo: lo + BATCH]
                at = np.concatenate(([0], np.cumsum([len(texts[i]) for i in pick])))
                rows = np.concatenate([texts[i] for i in pick])
                if not len(rows):
                    continue
                top, pos = peaks(rows, at, self.e, self.k, True)
                f = np.hstack([np.maximum(t + b, 0) for t, b in zip(top, self.b)])
                g = ((sigmoid(f @ self.u + self.c[0]) - y[pick]) / len(pick)).astype(np.float32)
                back = (g[:, None] * self.u) * (f > 0)
                ge, gk, gb = np.zeros_like(self.e), [np.zeros_like(k) for k in self.k], []
                for i, w in enumerate(WIDTHS):
                    d = back[:, i * FILTERS: (i + 1) * FILTERS]
                    gb.append(d.sum(0))
                    for j in range(w):
                        p = pos[i] + j
                        r = rows[np.minimum(p, len(rows) - 1)]
                        inside = (p < at[1:, None]) & (at[1:] > at[:-1])[:, None]
                        r = np.where(inside[:, :, None], r, ROWS)
                        gk[i][j] += np.einsum("df,dfs->sf", d, self.e[r].sum(2))
                        into = d[:, :, None] * self.k[i][j].T[None]
                        for c in range(r.shape[2]):
                            np.add.at(ge, r[:, :, c], into)
                ge[~self.known] = 0
                adam.step([ge, *gk, *gb, f.T @ g, np.array([g.sum()], np.float32)])

    def calibrate(self, z: np.ndarray, y: np.ndarray, lang: np.ndarray) -> None:
        """The threshold (a logit) of each language: best F1 on rows held
        back, midway between the rows on either side; a language of too few
        rows takes the threshold of all."""
        every = _threshold(z, y)
        for i in range(len(LANGUAGES) + 1):
            mine = lang == i if i < len(LANGUAGES) else lang < 0
            n = y[mine].sum()
            self.shift[i] = _threshold(z[mine], y[mine]) if n >= 8 and mine.sum() - n >= 8 else every

    def score(self, rows, at, lang) -> np.ndarray:
        return sigmoid(self.logits(rows, at) - self.shift[lang] + np.log(ACCEPT / (1 - ACCEPT)))


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    if not len(z) or not y.any():
        return 0.0
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    k = int(f1.argmax())
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


def train(texts: list[np.ndarray], y: np.ndarray, lang: np.ndarray) -> Net:
    """A net fitted on four rows in five, thresholds from the fifth."""
    net = Net()
    if len(y):
        back = np.arange(len(y)) % 5 == 4
        own = np.flatnonzero(~back)
        net.fit([texts[i] for i in own], y[own].astype(np.float32))
        held = np.flatnonzero(back)
        at = np.concatenate(([0], np.cumsum([len(texts[i]) for i in held]))).astype(np.int64)
        rows = np.concatenate([texts[i] for i in held]) if len(held) else np.zeros((0, 1 + len(STEMS)), np.int32)
        net.calibrate(net.logits(rows, at), y[held], lang[held])
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, fold: int = 1,
        rows: int = SAMPLE) -> Net:
    """The net of a bounded labelled sample of ``docs(doc_id, text)``."""
    def read(batches):
        for b in batches:
            words, langs = [], []
            for r, at, lang in _words(b.column("text")):
                words += [r[at[i]: at[i + 1]].astype("<i4").tobytes() for i in range(len(at) - 1)]
                langs += lang.tolist()
            short = [len(w) <= 4 * (1 + len(STEMS)) * LONGEST for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("pick"), pa.array(langs, pa.int32()), pa.array(words, pa.binary())],
                names=["label", "pick", "lang", "words"]).filter(pa.array(short))

    got = sample(docs, labels, label, folds, fold, rows).mapInArrow(
        read, "label int, pick long, lang int, words binary").collect()
    got.sort(key=lambda r: (r["pick"], r["words"]))
    return train([np.frombuffer(r["words"], "<i4").reshape(-1, 1 + len(STEMS)) for r in got],
                 np.array([r["label"] for r in got], np.int64), np.array([r["lang"] for r in got], np.int64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = 3, fold: int = 1, accept: float = ACCEPT) -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Null and empty texts are scored as texts without words, by the common
    threshold, like texts of no known language. Labels that are null, of
    null ids or of no document are not used; of several labels of a document
    the largest counts; without any label scores come from the untrained
    net. Null ids are not held out. Rows that repeat are scored alike. An
    empty table gives an empty table; other columns stay as they are, but
    those named like the added ones, which are replaced.
    """
    net = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), labels, label, folds, fold)

    def scores(texts):
        parts = [net.score(r, at, lang) for r, at, lang in _words(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return with_scores(docs, scored(docs, text, scores), id_col, folds, fold, accept)
