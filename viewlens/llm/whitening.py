"""Embedding whitening by spectrum slicing.

Spark sums the exact integer moments of the distinct vectors; what reaches
the driver is one ``d x d`` matrix. The number of eigenvalues above a shift
``s`` is the number of positive pivots in the LDL^T factorisation of
``V - s I`` (Sylvester's law of inertia). Such counts cut the spectrum until
each leading eigenvalue stands alone in its interval, Rayleigh quotient
iteration then converges cubically within it, and two more counts, just above
and below, certify that the value found is the k-th. Equal eigenvalues, which
no shift can part, are solved together as one block.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import land

SCALE, OFFSET = 64, 1_000_000
#: Entries are held within this magnitude, so that a product of the fit keeps to Python's exact integers.
LIMIT = 1 << 52
EPS = float(np.finfo(float).eps)
#: Rows of a float64 product at most; it is split further where sums might pass 2^53.
ROWS = 1 << 16


# ---- eigenpairs on the driver (d x d)
def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """(positive, zero, negative) eigenvalues of a symmetric matrix by its
    LDL^T factorisation with symmetric pivoting and 1x1 and 2x2 pivots."""
    a = np.array(matrix, dtype=float)
    n, counts = len(a), [0, 0, 0]
    alpha = (1 + math.sqrt(17)) / 8
    nothing = float(np.abs(a).max(initial=0.0)) * EPS ** 2
    k = 0
    while k < n:
        rest = a[k:, k:]
        diagonal = np.abs(np.diagonal(rest))
        off = np.abs(rest - np.diag(np.diagonal(rest)))
        i, big = int(np.argmax(diagonal)), float(off.max()) if n - k > 1 else 0.0
        if max(diagonal[i], big) <= nothing:
            counts[1] += n - k
            break
        if diagonal[i] >= alpha * big:
            order = [i] + [j for j in range(n - k) if j != i]
            rest[:] = rest[np.ix_(order, order)]
            d = rest[0, 0]
            counts[0 if d > 0 else 2] += 1
            column = rest[1:, 0].copy()
            left = rest[1:, 1:] - np.outer(column, column / d)
            rest[1:, 1:] = (left + left.T) / 2
            k += 1
        else:  # the largest entry is off the diagonal: one positive and one negative eigenvalue
            i, j = np.unravel_index(int(np.argmax(off)), off.shape)
            order = [int(i), int(j)] + [x for x in range(n - k) if x not in (i, j)]
            rest[:] = rest[np.ix_(order, order)]
            block, columns = rest[:2, :2].copy(), rest[2:, :2].copy()
            counts[0] += 1
            counts[2] += 1
            left = rest[2:, 2:] - columns @ np.linalg.solve(block, columns.T)
            rest[2:, 2:] = (left + left.T) / 2
            k += 2
    return tuple(counts)


class Slicer:
    """Leading eigenpairs of a symmetric matrix by spectrum slicing."""

    def __init__(self, matrix: np.ndarray):
        self.v = (matrix + matrix.T) / 2
        self.d = len(matrix)
        self.size = float(np.abs(self.v).sum(axis=1).max()) if self.d else 0.0  # no eigenvalue is larger
        self.tiny = max(self.size, 1e-300) * EPS * max(self.d, 1)
        self.counted: dict[float, int] = {}

    def above(self, shift: float) -> int:
        """Number of eigenvalues above ``shift``."""
        if shift not in self.counted:
            self.counted[shift] = inertia(self.v - shift * np.eye(self.d))[0]
        return self.counted[shift]

    def isolate(self, k: int) -> tuple[float, float]:
        """An interval (lo, hi] with the k-th largest eigenvalue (from 1) and
        no other, or a narrow one with all that equal it."""
        marks = sorted(self.counted)  # earlier counts narrow the start
        lo = max([s for s in marks if self.counted[s] >= k], default=-self.size - self.tiny)
        hi = min([s for s in marks if self.counted[s] < k], default=self.size + self.tiny)
        while hi - lo > 8 * self.tiny:
            if self.above(lo) == k and self.above(hi) == k - 1:
                break
            mid = lo + (hi - lo) / 2
            if self.above(mid) >= k:
                lo = mid
            else:
                hi = mid
        return lo, hi

    def pairs(self, count: int) -> list[tuple[float, np.ndarray]]:
        """The ``count`` largest eigenvalues, falling, with unit vectors."""
        out: list[tuple[float, np.ndarray]] = []
        while len(out) < min(count, self.d):
            k = len(out) + 1
            lo, hi = self.isolate(k)
            many = self.above(lo) - (k - 1)
            if many > 1:
                out += self._cluster(lo, hi, many, out)
            else:
                out.append(self._single(k, lo, hi, out))
        return out[:count]

    def _against(self, x: np.ndarray, found) -> np.ndarray:
        for _ in range(2):
            for _, q in found:
                x = x - q * (q @ x)
        return x / np.linalg.norm(x)

    def _solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for step in (0.0, 1.0, 4.0):
            try:
                y = np.linalg.solve(self.v - (shift + step * self.tiny) * np.eye(self.d), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and np.abs(y).max() > 0:
                return y / np.abs(y).max()
        return x

    def _start(self, k: int) -> np.ndarray:
        return np.random.default_rng(k).standard_normal(self.d)

    def _single(self, k: int, lo: float, hi: float, found) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration, held within (lo, hi]: a quotient that
        leaves the interval has met another eigenvalue, and the interval is
        halved by a count instead."""
        x = self._against(self._start(k), found)
        value = lo + (hi - lo) / 2
        for _ in range(200):
            x = self._against(self._solve(value, x), found)
            quotient = float(x @ (self.v @ x))
            rest = float(np.linalg.norm(self.v @ x - quotient * x))
            if lo < quotient <= hi and rest <= 4 * self.tiny and self.certified(k, quotient, rest):
                return quotient, x
            if lo < quotient <= hi and rest < (hi - lo) / 4:
                value = quotient
                continue
            mid = lo + (hi - lo) / 2
            if hi - lo > 4 * self.tiny:
                lo, hi = (mid, hi) if self.above(mid) >= k else (lo, mid)
            value = lo + (hi - lo) / 2
        raise ArithmeticError(f"eigenvalue {k} did not converge")

    def certified(self, k: int, value: float, rest: float) -> bool:
        """Counts just above and below ``value`` show that it is the k-th."""
        near = max(rest, 8 * self.tiny) * 2
        return self.above(value + near) <= k - 1 and self.above(value - near) >= k

    def _cluster(self, lo: float, hi: float, many: int, found) -> list[tuple[float, np.ndarray]]:
        """``many`` equal eigenvalues: inverse iteration on a block."""
        block = np.random.default_rng(len(found)).standard_normal((self.d, many))
        for _ in range(6):
            block = np.column_stack([self._solve(lo + (hi - lo) / 2, block[:, j]) for j in range(many)])
            basis: list = []
            for j in range(many):
                basis.append((0.0, self._against(block[:, j], [*found, *basis])))
            block = np.column_stack([q for _, q in basis])
        values, turn = np.linalg.eigh(block.T @ self.v @ block)  # many x many: numbers equal ones
        block = block @ turn
        return [(float(values[j]), block[:, j]) for j in range(many - 1, -1, -1)]


# ---- moments on Spark
def _integers(column: pa.Array, d: int | None):
    """(rows that remain, their integer vectors) of an Arrow list column."""
    rows, out = [], []
    for i, v in enumerate(column):
        if not v.is_valid:
            continue
        own = v.values
        if own.null_count or (d is not None and len(own) != d):
            continue
        x = own.to_numpy(zero_copy_only=False).astype(float)
        if not np.isfinite(x).all():
            continue
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * x), -LIMIT, LIMIT - OFFSET)
        rows.append(i)
        out.append(x.astype(np.int64) + OFFSET)
    return rows, out


def _keys(column: str):
    def run(batches):
        for b in batches:
            _, out = _integers(b.column(column), None)
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in out], pa.int32()),
                                              pa.array([x.tobytes() for x in out], pa.binary())], names=["d", "x"])
    return run


def _blocks(batches, d: int):
    """Integer matrices of up to ROWS rows."""
    for b in batches:
        raw = b.column("x").to_pylist()
        for lo in range(0, len(raw), ROWS):
            yield np.frombuffer(b"".join(raw[lo: lo + ROWS]), np.int64).reshape(-1, d)


def exact_products(a: np.ndarray) -> np.ndarray:
    """``a.T @ a`` of an integer matrix as Python integers: in doubles, by
    as many rows at a time as keep every sum below 2^53."""
    most = int(np.abs(a).max(initial=0))
    rows = (1 << 53) // max(1, most * most)
    total = np.zeros((a.shape[1], a.shape[1]), object)
    if not rows:
        wide = a.astype(object)
        return wide.T @ wide
    for lo in range(0, len(a), rows):
        part = a[lo: lo + rows].astype(float)
        total = total + (part.T @ part).astype(np.int64)
    return total


PART = 10 ** 18


def _sums(d: int, centre: list[int] | None):
    """Per task: the sum of each entry, or of each product of centred
    entries, in two parts of 18 digits."""
    def run(batches):
        total = np.zeros(d if centre is None else (d, d), object)
        for x in _blocks(batches, d):
            if centre is None:
                safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
                total = total + (x if safe else x.astype(object)).sum(axis=0)
            else:
                total = total + exact_products(x - np.array(centre, np.int64))
        parts = [divmod(int(v), PART) for v in total.ravel()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([h for h, _ in parts], pa.int64()),
             pa.array([low for _, low in parts], pa.int64())], names=["i", "high", "low"])
    return run


def _added(fit: DataFrame, run, size: int) -> list[int]:
    """Column sums of what the tasks send: ``size`` exact integers."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = [0] * size
    for r in fit.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(wide("high"), wide("low")).collect():
        out[r["i"]] = int(r["high"]) * PART + int(r["low"])
    return out


class Whitener:
    """What the fit gives: ``n``, sums, mean split in an integer and a
    fraction, eigenvalues, unit vectors and the trace."""

    def __init__(self, n: int, sums: list[int], centre: list[int], products: list[int], components: int):
        d = len(sums)
        self.n, self.d, self.sums, self.centre = n, d, sums, centre
        left = [s - n * c for s, c in zip(sums, centre)]  # sums of the centred entries, |.| <= n / 2
        self.shift = np.array([float(Fraction(x, n)) for x in left])
        # exact until the one rounding of each entry
        self.cov = np.array([[float(Fraction(n * products[i * d + j] - left[i] * left[j], n * n)) for j in range(d)]
                             for i in range(d)]).reshape(d, d)
        self.trace = math.fsum(np.diagonal(self.cov))
        slicer = Slicer(self.cov)
        least = 1e3 * slicer.tiny  # below that a variance is rounding
        found = [(e, q) for e, q in slicer.pairs(min(components, slicer.above(least))) if e > least]
        self.values = np.array([e for e, _ in found])
        self.basis = np.array([q for _, q in found]).reshape(len(found), d).T

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integer vectors, unrounded."""
        if not len(self.values):
            return np.zeros((len(x), 0))
        return (x - np.array(self.centre, np.int64) - self.shift) @ self.basis / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        left = np.array([s - self.n * c for s, c in zip(self.sums, self.centre)], object)
        a = x - np.array(self.centre, np.int64)
        most = self.n * int(np.abs(a).max(initial=0)) + max([abs(int(v)) for v in left], default=0)
        kind = np.int64 if most * most * max(self.d, 1) < 1 << 63 else object
        off = a.astype(kind) * self.n - left.astype(kind)
        return [v if v < 1 << 63 else None for v in (int(s) for s in (off * off).sum(axis=1))]


def fit(vectors: DataFrame, column: str = "embedding", components: int = 16):
    """(whitener, fit list) of the distinct integer vectors of a table, or
    None without any. The fit list is a written table of (d, x)."""
    held = land(vectors.select(column).mapInArrow(_keys(column), "d int, x binary").distinct(), "fitlist")
    sizes = held.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    most = sizes.orderBy(F.col("n").desc(), "d").first()
    if most is None:
        return None
    d, n = most["d"], most["n"]
    held = held.where(F.col("d") == d)
    sums = _added(held, _sums(d, None), d)
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the nearest integer to the mean
    products = _added(held, _sums(d, centre), d * d)
    return Whitener(n, sums, centre, products, components), held


def identity_error(whitener: Whitener, fit_list: DataFrame) -> float:
    """Largest entry of the whitened fit list's covariance minus identity."""
    k = len(whitener.values)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, whitener.d):
            w = whitener.project(x)
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 1), dtype=np.int32)),
                                          pa.array(np.concatenate((first, second.ravel())))], names=["i", "v"])
    got = np.zeros(k * (k + 1))
    for r in fit_list.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[r["i"]] = r["v"]
    mean, cov = got[:k] / whitener.n, got[k:].reshape(k, k) / whitener.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each remaining row of ``vectors`` and component up to
    ``components``: ``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``.

    An entry c becomes the integer x = floor(64 c) + 1000000; components are
    the unit eigenvectors of the covariance of the distinct x vectors, by
    falling eigenvalue. Rows whose vector is null, or holds null, NaN or
    infinite entries, are dropped, and so are empty vectors and those of
    another length than most distinct vectors have (the shorter on a tie).
    Entries beyond 2^52 in magnitude count as that. Repeated rows and
    repeated ids give a row each, null ids stay null. A component without
    variance is not given, so a table of one distinct vector, as an empty
    table, gives no rows; equal eigenvalues give some orthonormal basis, the
    same for all rows. ``deviation`` is null where 64 bits do not hold it.
    No other column is read.
    """
    spark = vectors.sparkSession
    fitted = fit(vectors, column, components)
    if fitted is None:
        return spark.createDataFrame([], RESULT)
    whitener, fit_list = fitted
    error, k = identity_error(whitener, fit_list), len(whitener.values)
    explained = whitener.values / whitener.trace if k else whitener.values

    def run(batches):
        for b in batches:
            rows, out = _integers(b.column("v"), whitener.d)
            ids = b.column("id").take(pa.array(rows, pa.int64())).to_pylist()
            for lo in range(0, len(out) if k else 0, 4096):
                x = np.array(out[lo: lo + 4096])
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i in ids[lo: lo + m] for _ in range(k)], pa.int64()),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, whitener.n, np.int64)),
                     pa.array([v for v in whitener.deviations(x) for _ in range(k)], pa.int64()),
                     pa.array(whitener.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v")).mapInArrow(run, RESULT)
