"""Line dedup by sorted hash ranges and keep bitmaps.

Every line long enough to count becomes a row (128-bit key hash, document,
line number). The rows are dealt to ranges of (hash, document, number) and
sorted within them, so that one pass meets the first document of each key
before the others and marks the lines of the others. A key's run may cross
range borders: a frequent line fills several ranges instead of one task. The
rows of a range's first run are therefore put aside and settled with the
first document of each range's border keys, two rows for each range.

What comes back is no text but a compressed bitmap for each document that
loses a line; ``apply_bitmap`` makes the text of it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlens.llm.common import land, shuffle_partitions, small

SPACE = b" \t\n\x0b\x0c\r"
#: Code points a key needs to count.
MIN_KEY = 10
#: Lines of an output batch, and repeated rows that a task remembers.
BATCH_LINES, SEEN = 100_000, 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TRAIL = bytes(range(0x80, 0xC0))


def key_of(line: bytes) -> bytes:
    """A UTF-8 line's key: white space stripped at both ends, A-Z lowered."""
    return line.strip(SPACE).translate(_LOWER)


def split_lines(text: str | None) -> list[bytes]:
    """The lines of a text; null and empty texts are one empty line."""
    return (text or "").encode().split(b"\n")


def _lines(id_col: str, text: str, least: int):
    def run(batches):
        seen: set = set()
        for b in batches:
            h1, h2, ids, ths, ats = [], [], [], [], []
            for doc, th, t in zip(*(b.column(c).to_pylist() for c in (id_col, "th", text))):
                if (doc, th) in seen or not t:
                    continue
                if len(seen) >= SEEN:  # repeats that are met later are harmless
                    seen.clear()
                seen.add((doc, th))
                found = split_lines(t)
                for i, line in enumerate(found):
                    key = key_of(line)
                    if len(key) < least or len(key.translate(None, _TRAIL)) < least:
                        continue
                    h = xxhash.xxh3_128_digest(key)
                    h1.append(h[:8])
                    h2.append(h[8:])
                    ids.append(doc)
                    ths.append(th)
                    ats.append(len(found) << 32 | i)
                    if len(ids) >= BATCH_LINES:
                        yield _batch(h1, h2, ids, ths, ats)
                        h1, h2, ids, ths, ats = [], [], [], [], []
            if ids:
                yield _batch(h1, h2, ids, ths, ats)
    return run


def _batch(h1, h2, ids, ths, ats) -> pa.RecordBatch:
    longs = lambda parts: pa.array(np.frombuffer(b"".join(parts), np.int64))
    return pa.RecordBatch.from_arrays(
        [longs(h1), longs(h2), pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(ats, pa.int64())],
        names=["h1", "h2", "doc", "th", "at"])


LINES = "h1 long, h2 long, doc long, th long, at long"
DROP, OPEN, HEAD = 0, 1, 2


def _first_occurrences(batches):
    """Stream a sorted range. Lines outside the first document of their key
    are DROP rows; all lines of the range's first key are OPEN rows; HEAD
    rows give the first document met here of the first and last key."""
    def rows(kind, h1, h2, doc, none, th, at):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h1), kind, np.int8)), pa.array(h1), pa.array(h2), pa.array(doc, mask=none),
             pa.array(th), pa.array(at)], names=["kind", "h1", "h2", "doc", "th", "at"])

    opening = run = None  # the range's first key; the current key with its first document
    zero = np.zeros(1, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, th, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "th", "at"))
        none = b.column("doc").is_null().to_numpy(zero_copy_only=False)
        doc = b.column("doc").fill_null(0).to_numpy(zero_copy_only=False)
        new = np.concatenate(([run is None or (h1[0], h2[0]) != run[:2]], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        of = np.cumsum(new)  # the row's run in this batch; 0: the run before goes on
        before = (0, True) if run is None else run[2:]
        first = np.concatenate((np.array([before[0]], np.int64), doc[new]))[of]
        first_none = np.concatenate(([bool(before[1])], none[new]))[of]
        if opening is None:
            opening = (h1[0], h2[0])
            yield rows(HEAD, h1[:1], h2[:1], doc[:1], none[:1], zero, zero)
        is_open = (h1 == opening[0]) & (h2 == opening[1])
        if is_open.any():
            yield rows(OPEN, *(a[is_open] for a in (h1, h2, doc, none, th, at)))
        drop = ((doc != first) | (none != first_none)) & ~is_open
        if drop.any():
            yield rows(DROP, *(a[drop] for a in (h1, h2, doc, none, th, at)))
        run = (h1[-1], h2[-1], first[-1], first_none[-1])
    if run is not None and run[:2] != opening:
        yield rows(HEAD, *(np.array([v]) for v in run), zero, zero)


def pack_bitmap(dropped: np.ndarray, n_lines: int) -> bytes:
    """Keep bitmap of ``n_lines`` bits (1: the line stays), compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def apply_bitmap(text: str | None, bitmap: bytes | None) -> str:
    """The kept lines of ``text``; without a bitmap all of them."""
    if bitmap is None:
        return text or ""
    found = (text or "").split("\n")
    return "\n".join(line for line, kept in zip(found, unpack_bitmap(bitmap, len(found))) if kept)


def _bitmaps(batches):
    for b in batches:
        out = []
        for doc, th, n, ats in zip(*(b.column(c).to_pylist() for c in ("doc", "th", "n", "ats"))):
            out.append((doc, th, n, len(ats), pack_bitmap(np.array(ats, np.int64), n)))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["doc", "th", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = MIN_KEY) -> DataFrame:
    """``(doc, th, n_lines, n_dropped, keep)`` for each document that loses a
    line: id, hash of the text (``xxhash64``), and the keep bitmap. A
    document that is absent keeps all its lines.

    A line's key is the line stripped of ASCII white space with A-Z lowered.
    Keys of ``least`` code points or more that stand in several documents
    lose their lines in all but the smallest id; within that document its
    repeats stay. Rows that share an id are one document (and rows that
    share the text, too, one row here); null ids are one document, last in
    order. Null and empty texts have no key; an empty table gives an empty
    table. No other column is read. Keys are told apart by 128 bits of hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    # landed: the range bounds are taken from a sample of the rows, and the texts are split once
    lines = land(rows.mapInArrow(_lines("doc", "text", least), LINES), "lines")
    order = ["h1", "h2", F.col("doc").asc_nulls_last(), "th", "at"]
    dealt = lines.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    marked = land(dealt.mapInArrow(_first_occurrences, f"kind byte, {LINES}"), "marked")
    heads = marked.where(F.col("kind") == HEAD).groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    late = (marked.where(F.col("kind") == OPEN).join(small(land(heads, "heads")), ["h1", "h2"])
            .where(~F.col("doc").eqNullSafe(F.col("least"))))
    gone = marked.where(F.col("kind") == DROP).select("doc", "th", "at").union(late.select("doc", "th", "at"))
    n = F.shiftright("at", 32).alias("n")
    number = F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    # a document's own line numbers, no more than its text holds
    of_doc = gone.groupBy("doc", "th", n).agg(F.sort_array(F.collect_set(number)).alias("ats"))
    return of_doc.mapInArrow(_bitmaps, "doc long, th long, n_lines long, n_dropped long, keep binary")


def with_bitmaps(docs: DataFrame, out: str, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with a struct ``out`` of ``n_dropped`` and ``keep`` (null for
    documents that keep every line); all columns stay, whatever their names,
    but one named ``out``, which is replaced."""
    # one plan at every size: bitmaps grow with the documents, so they are never broadcast
    found = land(keep_bitmaps(docs, id_col, text, **kw), "bitmaps").select(
        F.struct("doc", "th", "n_dropped", "keep").alias("_found")).hint("merge")
    base = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    of = lambda c: F.col("_row").getField(c)
    mine = of(id_col).cast("long").eqNullSafe(F.col("_found.doc")) & (F.xxhash64(of(text)) == F.col("_found.th"))
    return base.join(found, mine, "left").select(
        *(of(c).alias(c) for c in docs.columns if c != out), F.col("_found").alias(out))


def _kept_texts(batches):
    for b in batches:
        kept = [None if t is None else apply_bitmap(t, k)
                for t, k in zip(b.column("t").to_pylist(), b.column("k").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with the kept lines as text; a null text stays null."""
    found = with_bitmaps(docs, "_bitmap", id_col, text, **kw)
    names = [c for c in docs.columns if c != "_bitmap"]
    row = F.struct(*(F.col(c) for c in names))
    asked = found.select(row.alias("row"), F.col(text).alias("t"), F.col("_bitmap.keep").alias("k"))
    done = asked.mapInArrow(_kept_texts, T.StructType([asked.schema["row"], T.StructField("kept", T.StringType())]))
    return done.select(*(F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row for each row of ``docs``: ``(doc_id, n_lines, n_dropped,
    kept_sha256)`` of its kept text (null texts count as empty)."""
    found = with_bitmaps(docs.select(id_col, text), "_bitmap", id_col, text, **kw)

    def run(rows):
        for b in rows:
            texts = b.column("text").to_pylist()
            kept = [hashlib.sha256(apply_bitmap(t, k).encode()).hexdigest()
                    for t, k in zip(texts, b.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()),
                 b.column("n_dropped"), pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    dropped: Column = F.coalesce(F.col("_bitmap.n_dropped"), F.lit(0)).cast("long")
    return found.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"),
                        F.col("_bitmap.keep").alias("keep"), dropped.alias("n_dropped")).mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
