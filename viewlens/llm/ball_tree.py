"""Ranked lexical search: exact sparse ball trees for largest inner products.

A document is the sparse vector of its scores for the query terms it holds,
an item the vector of ones over its terms, so a score is their inner
product. Each task builds ball trees over its documents: nodes with a
centroid ``c`` and a radius ``r``, for which no document scores above
``c.q + r * |q|``. An item visits subtrees in falling order of that bound
and stops where the bound is below the tenth best score so far. Bounds are
computed in doubles and rounded up with a margin for the rounding errors;
scores at the leaves are 64-bit integers, so the ranking is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewlens.llm.common import land

#: Terms of a block of items: its vocabulary goes to every task.
BLOCK_TERMS = 100_000
#: Non-zero entries of one tree, documents of a leaf, bytes tokenised at once.
TREE_ENTRIES, LEAF, TOKEN_BYTES = 2_000_000, 64, 1 << 20
#: Doubles of the centroids times items that are held at once.
BOUND_CELLS = 8_000_000
_MAP = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None):
    """Blocks of the terms (UTF-8) of a whole text: runs of other than ASCII
    characters that are no letter or digit, A-Z lowered."""
    raw = (text or "").encode().translate(_MAP)
    lo = 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + TOKEN_BYTES)
        hi = len(raw) if hi < 0 else hi
        yield raw[lo:hi].split()
        lo = hi


def term_counts(text: str | None) -> tuple[int, Counter]:
    n, counts = 0, Counter()
    for block in terms(text):
        n += len(block)
        counts.update(block)
    return n, counts


def _vectors(vocab: dict[bytes, int], id_col: str, text: str):
    """Document vectors: length, and ids and counts of the terms in ``vocab``."""
    def run(batches):
        for b in batches:
            lengths, ids, tfs, docs = [], [], [], []
            for doc, t in zip(b.column(id_col).to_pylist(), b.column(text).to_pylist()):
                n, counts = term_counts(t)
                if n:
                    held = [(vocab[w], c) for w, c in counts.items() if w in vocab]
                    held.sort()
                    docs.append(doc)
                    lengths.append(n)
                    ids.append([h[0] for h in held])
                    tfs.append([h[1] for h in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tfs"])
    return run


def _frequencies(size: int):
    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column("ids").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])
    return run


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Rows:
    """Sparse rows of 64-bit integers: ``ids`` and ``values`` of row i are
    the entries ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.at, self.ids, self.values = at, ids, values

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.at[rows + 1] - self.at[rows]
        at = np.concatenate(([0], np.cumsum(sizes)))
        src = np.arange(at[-1]) - np.repeat(at[:-1] - self.at[rows], sizes)
        return Rows(at, self.ids[src], self.values[src])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner product of each row (none is empty) with a dense vector."""
        return np.add.reduceat(self.values * dense[self.ids], self.at[:-1])


class Tree:
    """Ball tree over the rows of ``x``: nodes in one array, children after
    their parent; leaves hold ranges of ``order``."""

    def __init__(self, x: Rows, width: int, leaf: int = LEAF):
        n = len(x.at) - 1
        self.order = np.arange(n)
        self.lo, self.hi, self.left, self.right = [0], [n], [-1], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= leaf:
                continue
            part = x.take(self.order[lo:hi])
            cut = self._halves(part, width)
            self.order[lo:hi] = self.order[lo:hi][cut]
            mid = lo + (hi - lo) // 2
            for a, b, side in ((lo, mid, self.left), (mid, hi, self.right)):
                side[node] = len(self.lo)
                todo.append(len(self.lo))
                for own, v in ((self.lo, a), (self.hi, b), (self.left, -1), (self.right, -1)):
                    own.append(v)
        self.x = x.take(self.order)
        self._balls(width)

    @staticmethod
    def _halves(part: Rows, width: int) -> np.ndarray:
        """Order of the rows along the line between two far rows, by angle:
        the first half is nearer to one of them."""
        length = np.maximum(np.sqrt(np.add.reduceat(part.values.astype(float) ** 2, part.at[:-1])), 1.0)

        def toward(i: int) -> np.ndarray:
            one = np.zeros(width)
            one[part.ids[part.at[i]: part.at[i + 1]]] = part.values[part.at[i]: part.at[i + 1]]
            return part.dot(one) / (length * length[i])

        a = int(np.argmin(toward(0)))
        near_a = toward(a)
        near_b = toward(int(np.argmin(near_a)))
        return np.argsort(near_b - near_a, kind="stable")

    def _balls(self, width: int) -> None:
        """Centroid (float64, on the node's own terms) and safe radius of each node."""
        x = self.x
        square = np.add.reduceat(x.values.astype(float) ** 2, x.at[:-1])
        self.centres, self.radius = [], np.zeros(len(self.lo))
        for node, (lo, hi) in enumerate(zip(self.lo, self.hi)):
            a, b = x.at[lo], x.at[hi]
            ids, values = x.ids[a:b], x.values[a:b]
            c = np.bincount(ids, weights=values, minlength=width) / (hi - lo)
            own = np.flatnonzero(c)
            self.centres.append((own, c[own]))
            cross = np.add.reduceat(values * c[ids], x.at[lo:hi] - a)
            size = float(c @ c)
            # |x - c|^2, raised by far more than its rounding error
            apart = square[lo:hi] - 2 * cross + size + 1e-11 * (square[lo:hi] + size)
            self.radius[node] = math.sqrt(max(0.0, float(apart.max()))) * (1 + 1e-9)

    def bounds(self, queries: list[np.ndarray], width: int) -> np.ndarray:
        """For each item and node an integer that no score of its documents exceeds."""
        out = np.empty((len(queries), len(self.lo)), np.int64)
        norm = np.sqrt(np.array([float(len(q)) for q in queries]))
        ends = np.cumsum([len(q) for q in queries])
        flat = np.concatenate(queries)
        step = max(1, BOUND_CELLS // width)
        for a in range(0, len(self.lo), step):
            centre = np.zeros((min(step, len(self.lo) - a), width))
            for i, (own, c) in enumerate(self.centres[a: a + step]):
                centre[i, own] = c
            for q, (hi, size) in enumerate(zip(ends, norm)):
                inner = centre[:, flat[hi - len(queries[q]): hi]].sum(axis=1)
                top = (inner + self.radius[a: a + step] * size) * (1 + 1e-9)
                out[q, a: a + step] = np.ceil(np.minimum(top, 9e18)).astype(np.int64) + 1
        return out

    def search(self, query: np.ndarray, bound: np.ndarray, best: list, keep: int, doc, width: int) -> int:
        """Add this tree's documents to ``best``, a heap of (score, -rank of
        the id, id) of at most ``keep`` entries; returns the leaves visited."""
        ask = np.zeros(width, np.int64)
        ask[query] = 1
        visited, open_ = 0, [(-int(bound[0]), 0)]
        while open_:
            top, node = heapq.heappop(open_)
            if len(best) >= keep and -top < best[0][0]:  # an equal score may still win by its id
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(open_, (-int(bound[child]), child))
                continue
            visited += 1
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.x.at[lo], self.x.at[hi]
            scores = np.add.reduceat(self.x.values[a:b] * ask[self.x.ids[a:b]], self.x.at[lo:hi] - a)
            for i in np.flatnonzero(scores > (best[0][0] - 1 if len(best) >= keep else 0)):
                entry = (int(scores[i]), *_falling(doc[self.order[lo + i]]))
                if len(best) < keep:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return visited


def _falling(doc: int | None) -> tuple:
    """Sorts ids falling, null (the last in rising order) lowest."""
    return (0, 0) if doc is None else (1, -doc)


def _search(queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, keep: int):
    width = len(weights)

    def tree_of(held):
        docs = [d for d, _, _, _ in held]
        sizes = np.array([len(ids) for _, _, ids, _ in held])
        at = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.concatenate([i for _, _, i, _ in held])
        tfs = np.concatenate([t for _, _, _, t in held])
        # the length factor in Python integers: n * N may pass 64 bits
        m = np.repeat(np.array([100 - 90 + (90 * n * n_docs) // n_terms for _, n, _, _ in held], np.int64), sizes)
        return docs, Rows(at, ids, weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m)))

    def run(batches):
        best: list[list] = [[] for _ in queries]

        def search(held):
            docs, rows = tree_of(held)
            tree = Tree(rows, width)
            bound = tree.bounds(queries, width)
            for q, query in enumerate(queries):
                tree.search(query, bound[q], best[q], keep, docs, width)

        held, entries = [], 0
        for b in batches:
            ids, tfs = b.column("ids"), b.column("tfs")
            for i, (doc, n) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist())):
                own = ids[i].values.to_numpy()
                if not len(own):
                    continue
                held.append((doc, n, own.astype(np.int64), tfs[i].values.to_numpy()))
                entries += len(own)
                if entries >= TREE_ENTRIES:
                    search(held)
                    held, entries = [], 0
        if held:
            search(held)
        rows = [(q, None if not known else -doc, score) for q, found in enumerate(best) for score, known, doc in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64())], names=["q", "doc_id", "score"])
    return run


def _blocks(items: DataFrame, block_terms: int):
    """The items with at least one term, in blocks of about ``block_terms``
    terms at most (dealt by hash): lists of (id, sorted distinct terms)."""
    def run(batches):
        for b in batches:
            ids, out, digest = [], [], []
            for item, t in zip(b.column("item").to_pylist(), b.column("t").to_pylist()):
                own = sorted({w for block in terms(t) for w in block})
                if own:
                    ids.append(item)
                    out.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.binary()))],
                                             names=["item", "terms"])
    held = land(items.mapInArrow(run, "item long, terms array<binary>").distinct(), "items")
    total = held.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = ceil(total / block_terms)
    for i in range(n):
        mine = held.where(F.pmod(F.xxhash64("item", "terms"), F.lit(n)) == i)
        yield [(r["item"], [bytes(t) for t in r["terms"]]) for r in mine.orderBy("item", "terms").collect()]


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, keep: int = 10, id_col: str = "doc_id",
           text: str = "text", item_col: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``keep`` highest-scoring rows
    of ``docs`` with a score above 0 for each item, equal scores by rising
    id (null last, repeated rows beside each other).

    The items are the stated query set: they are taken in blocks whose
    vocabulary fits a task, each against all documents. Rows of ``items``
    that repeat id and text are one item; an id with different texts is
    ranked for each of them. Items and documents without a term (null,
    empty, separators only) give no row and count in no statistic. Empty
    tables give an empty table; other columns are not read.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("t"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = []
    for block in _blocks(asked, block_terms):
        names = sorted({w for _, own in block for w in own})
        vocab = {w: i for i, w in enumerate(names)}
        vectors = land(rows.mapInArrow(_vectors(vocab, "doc_id", "text"),
                                       "doc_id long, n long, ids array<int>, tfs array<long>"), "vectors")
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(names), np.int64)  # as long as the block's vocabulary
        for r in (vectors.select("ids").mapInArrow(_frequencies(len(names)), "term int, df long")
                  .groupBy("term").agg(F.sum("df").alias("df")).collect()):
            df[r["term"]] = r["df"]
        weights = np.array([weight(int(c), n_docs) for c in df], np.int64)
        queries = [np.array([vocab[w] for w in own], np.int64) for _, own in block]
        near = vectors.mapInArrow(_search(queries, weights, n_docs, int(n_terms), keep), "q int, doc_id long, score long")
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
        ids = spark.createDataFrame(list(enumerate(i for i, _ in block)), "q int, item_id long")
        found.append(land(top.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
