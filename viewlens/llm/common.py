"""Helpers shared by the corpus operators: shared-folder tables, sizing and
vectorised word hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.session import scratch_path

#: Largest table (rows of a few numbers) that is broadcast; counted first.
BROADCAST_ROWS = 500_000

#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20

WORD = r"[^\x20\x09-\x0D]+"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: the
    lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES between executors and their Python workers, in
    place of 10,000 rows however long, unless the session sets a size. Both
    sides hold batches beside the heap, and little of it is given back while
    a session lasts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it counts at most ``rows`` rows, else
    unchanged: the join then shuffles. ``df`` should be landed and narrow."""
    return F.broadcast(df) if df.count() <= rows else df


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` as one struct column, so that its names clash with no other."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias(name))


def of_row(column: str, name: str = "_row") -> Column:
    """A column of a packed table."""
    return F.col(name).getField(column)


def unpacked(columns: list[str], name: str = "_row", without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a packed table again, but those named in ``without``."""
    return [of_row(c, name).alias(c) for c in columns if c not in without]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def splitmix(x: np.ndarray) -> np.ndarray:
    """Vectorised 64-bit finaliser (public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def byte_table(separators: bytes = b" \t\n\x0b\x0c\r", lower: bool = True) -> np.ndarray:
    """256 entries: 0 for a separator byte, else the (ASCII-lowered) byte + 1."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


_PAD = splitmix(np.arange(1, 257, dtype=np.uint64))


def _multipliers(n: int) -> np.ndarray:
    """Fixed pseudo-random factor for each byte position of a word."""
    global _PAD
    if n > len(_PAD):
        _PAD = splitmix(np.arange(1, max(n, 2 * len(_PAD)) + 1, dtype=np.uint64))
    return _PAD


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[col.offset: col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def doc_slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes (one document at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def hash_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray,
               block: int = 1 << 19, prefixes: tuple[int, ...] = ()):
    """64-bit hash of each word and, per document, the index of its first
    word (length docs + 1); with ``prefixes``, also the hash of each word's
    first so many bytes (0 for words that are not longer). Work arrays cover ``block`` bytes at a time, so
    memory does not follow the length of a document."""
    mapped = table[raw]
    word = mapped != 0
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    before[first] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    whole = _hash_runs(mapped, starts, ends, block)
    if not prefixes:
        return whole, bounds
    heads = []
    for n in prefixes:
        h = _hash_runs(mapped, starts, np.minimum(ends, starts + n), block)
        h[ends - starts <= n] = 0
        heads.append(h)
    return whole, bounds, heads


def _hash_runs(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, side="right")))
            s, e = starts[lo:hi], ends[lo:hi]
            size = e - s
            at = np.cumsum(size) - size
            pos = np.arange(int(size.sum())) - np.repeat(at, size)
            src = pos + np.repeat(s, size)
            part = _multipliers(int(size.max()))[pos] * mapped[src].astype(np.uint64)
            out[lo:hi] = np.add.reduceat(part, at) + size.astype(np.uint64)
            lo = hi
    return splitmix(out)


_STEP = splitmix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a document's ``k``-word shingles; fewer
    words: the whole sequence as one; no words: empty."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < k:
            whole = (words * _STEP[:n]).sum(dtype=np.uint64) + np.uint64(n)
            return splitmix(np.array([whole], dtype=np.uint64))
        total = words[: n - k + 1] * _STEP[0]
        for i in range(1, k):
            total = total + words[i: n - k + 1 + i] * _STEP[i]
    out = np.sort(splitmix(total))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
