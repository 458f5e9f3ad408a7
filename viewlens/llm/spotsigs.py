"""Document fingerprints by SpotSigs.

A *spot* is a common word (anchor) with the chain of content words that
follows it. The hashes of a text's distinct spots, sorted, are its
fingerprint; likeness is their Jaccard coefficient, pruned by set length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import (byte_table, doc_slices, hash_words, land, shuffle_partitions, splitmix,
                                 text_buffers)
from viewlens.operators.ranking import bucket_of

#: Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from has he in is it of on or she that the their they this to was were will with you
als am an auch auf aus bei das dem den der des die ein eine einem einen einer es für hat im in ist mit nicht sich sie
sind und von war wie zu zum zur über
au aux avec ce cette dans de des du elle en est et il la le les ne nous ou par pas pour qu que qui se son sont sur un
une vous
al como con de del el en es esta fue ha la las lo los más no para pero por que se su sus un una y
""".split()
CHAIN = 2
_SEPARATORS = bytes(range(33)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _anchors() -> np.ndarray:
    raw, off = text_buffers(pa.array(sorted(set(ANCHORS))))
    return np.sort(hash_words(raw, off, byte_table(_SEPARATORS))[0])


def spots(words: np.ndarray, anchor: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Hashes of the spots of a text, given its words and which of them are
    anchors. Without any spot every word is an anchor of its followers."""
    at, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    after = np.searchsorted(content, at)
    full = after + chain <= len(content)
    at, after = at[full], after[full]
    if not len(at):
        if not len(words):
            return words
        at, content = np.arange(max(len(words) - chain, 1)), np.arange(len(words))
        chain = min(chain, len(words) - 1)
        after = at + 1
    with np.errstate(over="ignore"):
        total = words[at] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(chain):
            total = splitmix(total + words[content[after + i]])
    return np.unique(splitmix(total) >> np.uint64(32))


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The set of each text: empty for an empty text, else never empty."""
    table, known, out = byte_table(_SEPARATORS), _anchors(), []
    raw, off = text_buffers(pa.array(texts, pa.large_string()))
    for lo, hi in doc_slices(off):
        words, at = hash_words(raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], table)
        anchor = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words
        for i in range(hi - lo):
            s = spots(words[at[i]: at[i + 1]], anchor[at[i]: at[i + 1]])
            if not len(s) and texts[lo + i]:
                s = np.array([xxhash.xxh32_intdigest(texts[lo + i])], np.uint64)
            out.append(s)
    return out


def encode(s: np.ndarray) -> str:
    """Fingerprint as text: eight hex digits for each spot, ascending."""
    return s.astype(">u4").tobytes().hex()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint64)


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient; 0 without a look if the lengths alone keep it
    below ``least``. Two empty texts are alike (1)."""
    if not len(x) and not len(y):
        return 1.0
    if min(len(x), len(y)) < least * max(len(x), len(y)) or not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``, with the figures of its edited text
    (the last floor(n/2) code points replaced by as many from the start of
    the next document) and of the next document.

    The next document follows in ascending id (null first, ties by a hash of
    the text, rows that repeat both in any order); the first follows the
    last, and a single document follows itself. Null texts are empty.

    Ids are cut into ranges; the first row of each range is also dealt to
    the end of the range before, so each task sees its neighbour and the
    texts move once. No column but id and text is read; an empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("_cuts", F.array(*(F.lit(c).cast("long") for c in cuts)))
    rows = bucket_of(rows, "_cuts", "doc_id", len(cuts) + 1, "range").drop("_cuts")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th"))
    firsts = sorted((r["range"], r["f"]["doc_id"], r["f"]["th"])  # one row for each range
                    for r in rows.groupBy("range").agg(first.alias("f")).collect())
    tails = [(firsts[i][0], firsts[i][1], firsts[i][2], firsts[i - 1][0]) for i in range(len(firsts))]
    tails = spark.createDataFrame(tails, "_r int, _id long, _th long, _to int")
    met = (F.col("range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    own = F.struct(F.col("range").alias("at"), F.lit(False).alias("tail"))
    dealt = rows.join(F.broadcast(tails), met, "left").select("doc_id", "text", "th", F.explode(
        F.when(F.col("_r").isNull(), F.array(own)).otherwise(
            F.array(own, F.struct(F.col("_to").alias("at"), F.lit(True).alias("tail"))))).alias("d"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def figures(ids, texts, follow):
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, follow)]
        prints, changed = fingerprints([*texts, follow[-1]]), fingerprints(edited)
        cols = [ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                [encode(s) for s in prints[:-1]], [encode(s) for s in changed],
                [likeness(a, b) for a, b in zip(prints, changed)],
                [likeness(a, b) for a, b in zip(prints, prints[1:])]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        held_id = held = None
        at, over = None, False  # the range, and whether its tail was met
        ids, texts, follow, size = [], [], [], 0
        for b in batches:
            for row_at, tail, doc, t in zip(*(b.column(c).to_pylist() for c in ("at", "tail", "doc_id", "text"))):
                if row_at != at:
                    at, over, held = row_at, False, None
                    if ids:
                        yield figures(ids, texts, follow)
                        ids, texts, follow, size = [], [], [], 0
                if over:
                    continue
                if held is not None:
                    ids.append(held_id)
                    texts.append(held)
                    follow.append(t)
                    size += len(held)
                    if size >= 4 << 20:
                        yield figures(ids, texts, follow)
                        ids, texts, follow, size = [], [], [], 0
                held_id, held, over = doc, t, tail
        if ids:
            yield figures(ids, texts, follow)

    placed = dealt.select(F.col("d.at").alias("at"), F.col("d.tail").alias("tail"), "doc_id", "th", "text")
    placed = placed.repartition(n, "at").sortWithinPartitions("at", "tail", F.col("doc_id").asc_nulls_first(), "th")
    return placed.select("at", "tail", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def similar(prints: DataFrame, percent: int = 80, id_col: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """Pairs ``(a, b, likeness)`` of distinct fingerprints (each under its
    smallest id) whose Jaccard coefficient is ``percent`` or more.

    Sets are dealt to partitions by length, and a set meets those of its own
    and the next longer partition only. Within them a set is listed under
    the part of its spots, in hash order, that a likely partner must share;
    lengths prune before the sets are compared. Empty ones match nothing.
    """
    step = np.log(100 / percent)
    spot = F.transform(F.sequence(F.lit(0), F.floor(F.length(column) / 8).cast("int") - 1),
                       lambda i: F.substring(F.col(column), i * 8 + 1, F.lit(8)))
    sets = land(prints.where(F.length(column) > 0).groupBy(column).agg(F.min(id_col).alias("id"))
                .withColumn("s", spot).select("id", "s", F.size("s").alias("n")), "spotsets")
    listed = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    keys = sets.withColumn("part", F.floor(F.log("n") / step)).select("id", "n", "part", F.explode(listed).alias("spot"))
    near = keys.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    other = keys.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "part", "spot")
    size = (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (
        (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2"))))
    pairs = near.join(other, ["part", "spot"]).where(size).select("id", "id2").distinct()
    both = (pairs.join(sets.select("id", F.col("s").alias("x")), "id")
            .join(sets.select(F.col("id").alias("id2"), F.col("s").alias("y")), "id2")
            .withColumn("c", F.size(F.array_intersect("x", "y"))))
    total = F.size("x") + F.size("y") - F.col("c")
    return both.where(F.col("c") * 100 >= total * percent).select(
        F.col("id").alias("a"), F.col("id2").alias("b"), (F.col("c") / total).alias("likeness"))
