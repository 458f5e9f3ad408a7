"""Line dedup by sorted hash ranges."""

import hashlib

import numpy as np
import pyarrow as pa

from viewlens.llm import line_dedup as ld

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    """(id, text) rows -> sorted (id, lines, dropped, kept digest)."""
    rank = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and (key(line) not in first or rank(d) < rank(first[key(line)])):
                first[key(line)] = d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [ln for ln in lines if len(key(ln)) < 10 or first[key(ln)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (rank(r[0]), r))


def digests(spark, rows, parts=5):
    docs = spark.createDataFrame([(d, t, None, "clash", 0) for d, t in rows], DOCS).repartition(parts)
    got = [tuple(r) for r in ld.digests(docs.withColumnRenamed("source", "keep").withColumnRenamed("lang", "th")).collect()]
    return sorted(got, key=lambda r: ((r[0] is None, r[0] or 0), r))


def test_digests_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    pool = ["short", "a line that many share", "  A Line That Many Share\t", "0123456789", "012345678", "é" * 9, "É" * 10, "é" * 10,
            "", " ", "\x1ca line that many share", "\x0ba line that many share\r", "über zehn Zeichen 😀", "x" * 3000]
    pool += [f"line number {i} of the pool" for i in range(40)]
    rows = [(int(i), "\n".join(rng.choice(pool, size=rng.integers(0, 12)))) for i in rng.permutation(300)]
    rows += [(5, "another text under id 5\na line that many share"), (None, "0123456789\nnull id line one"), (None, None),
             (None, "null id line one\nnull id line one"), (1000, None), (1001, ""), (1002, "\n\n"), (1003, None)]
    rows += [rows[3], rows[3], (2000, "line number 1 of the pool\n" * 20_000), (2001, "z" * 500_000 + "\n" + "only\n" * 9)]
    assert digests(spark, rows) == brute(rows)


def test_a_key_with_a_third_of_all_lines_crosses_ranges(spark):
    rows = [(i, f"the very same line\nown line number {i}\nthe very same line") for i in range(3000)]
    assert digests(spark, rows, 7) == brute(rows)


def test_all_lines_alike_and_empty_table(spark):
    rows = [(i, "the very same line") for i in range(9, 60)]
    assert digests(spark, rows) == brute(rows)
    assert digests(spark, [(1, None)]) == brute([(1, None)])
    assert digests(spark, []) == []


def test_deduplicated_keeps_columns(spark):
    rows = [(1, "kept because first\nx", "en", "s", 3), (2, "Kept because first \ny", None, "s", 4), (3, None, "th", None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as doc", "lang as _found", "source as keep")
    got = sorted(ld.deduplicated(docs).collect())
    assert ld.deduplicated(docs).columns == docs.columns
    assert [(r.doc_id, r.text, r.lang, r.doc, r.keep) for r in got] == [
        (1, "kept because first\nx", "en", 1, "s"), (2, "y", None, 2, "s"), (3, None, "th", 3, None)]


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1000):
        gone = np.flatnonzero(rng.random(n) < 0.3)
        keep = ld.unpack_bitmap(ld.pack_bitmap(gone, n), n)
        assert len(keep) == n and set(np.flatnonzero(~keep)) == set(gone)


def test_streaming_does_not_depend_on_batches():
    """One sorted range, cut into batches of any size, gives the same rows."""
    rng = np.random.default_rng(5)
    rows = sorted((int(h), 0, int(d), 0, 1 << 32 | int(p)) for h, d, p in rng.integers(0, 6, (200, 3)))
    names = ["h1", "h2", "doc", "th", "at"]

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i: i + size])], names=names)
                   for i in range(0, len(rows), size)]
        out = [r for b in ld._first_occurrences(batches) for r in zip(*(c.to_pylist() for c in b.columns))]
        return sorted(out)

    assert run(1) == run(7) == run(500)
    kinds = [r[0] for r in run(7)]
    assert kinds.count(ld.HEAD) == 2 and kinds.count(ld.OPEN) == sum(r[0] == 0 for r in rows)
